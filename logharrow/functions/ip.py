"""IP addresses as order-preserving text keys.

A key is the family digit followed by upper-case hexadecimal: ``4`` + 8 digits or
``6`` + 32 digits. Keys of one family sort like the addresses, so a range test is
a string comparison and a network prefix is a string prefix.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logharrow.functions.text import strip

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z"
_GROUP = r"[0-9A-F]{1,4}"
_V6_FULL = rf"^(?:{_GROUP}:){{7}}{_GROUP}\z"
_V6_SHORT = rf"^(?:{_GROUP}(?::{_GROUP})*)?::(?:{_GROUP}(?::{_GROUP})*)?\z"


def _v4_number(text: Column) -> Column:
    parts = F.split(text, r"\.")
    number = F.lit(0).cast("bigint")
    for i in range(4):
        number = number * 256 + F.get(parts, F.lit(i)).try_cast("bigint")
    return number


def v4_key(number: Column) -> Column:
    """Key of an IPv4 address given as a number."""
    return F.concat(F.lit("4"), F.lpad(F.hex(number.cast("bigint")), 8, "0"))


def _v6_key(text: Column) -> Column:
    # A dotted quad may stand for the last two groups.
    tail = F.substring_index(text, ":", -1)
    quad = F.rlike(tail, F.lit(_V4))
    hex8 = F.lpad(F.hex(F.when(quad, _v4_number(tail))), 8, "0")
    head = F.left(text, F.length(text) - F.length(tail))
    text = F.when(quad, F.concat(head, F.left(hex8, F.lit(4)), F.lit(":"), F.right(hex8, F.lit(4)))).otherwise(text)

    def groups(part: Column) -> Column:
        return F.filter(F.split(part, ":"), lambda g: g != "")

    short = F.rlike(text, F.lit(_V6_SHORT))
    left = groups(F.split_part(text, F.lit("::"), F.lit(1)))
    right = groups(F.split_part(text, F.lit("::"), F.lit(2)))
    missing = F.lit(8) - F.size(left) - F.size(right)
    zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
    filled = F.when(short, F.concat(left, zeros, right)).otherwise(groups(text))
    digits = F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), "")
    valid = (short & (missing >= 1)) | F.rlike(text, F.lit(_V6_FULL))
    return F.when(valid, F.concat(F.lit("6"), digits))


def ip_key(address: Column) -> Column:
    """Key of an address in text form; NULL when it is not a valid address."""
    text = F.upper(strip(address))
    return F.when(F.rlike(text, F.lit(_V4)), v4_key(_v4_number(text))).when(
        F.contains(text, F.lit(":")), _v6_key(text)
    )


def is_valid_ip(address: Column) -> Column:
    return F.coalesce(ip_key(address).isNotNull(), F.lit(False))


def is_private(key: Column) -> Column:
    """Addresses without a public location: private, loopback, link-local, unspecified."""
    # 10/8, 172.16/12, 192.168/16, 127/8, 169.254/16, fc00::/7.
    networks = ["40A", "4AC1", "4C0A8", "47F", "4A9FE", "6FC", "6FD"]
    # 0.0.0.0, ::, ::1.
    single = ["4" + "0" * 8, "6" + "0" * 32, "6" + "0" * 31 + "1"]
    test = key.isin(*single)
    for prefix in networks:
        test = test | key.startswith(prefix)
    return test
