"""Text helpers shared by the parse jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points with the Unicode White_Space property.
WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Separators for laying out groups; a line uses the first it does not contain.
SEPARATORS = ("\u0001", "\u0002", "\ufdd0")

# Prefix for every pattern: Unicode-aware \s \S \d, and only \n ends a line.
UNICODE = "(?Ud)"


def strip(c: Column) -> Column:
    """Strip Unicode whitespace from both ends (plain ``trim`` strips spaces only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def match_groups(c: Column, pattern: str, groups: int, anywhere: bool = False) -> Column:
    """All capture groups of ``pattern`` in one regex pass, as an array.

    Element ``i`` is group ``i``; an absent optional group is ``''``. Where the
    pattern does not match, ``group(m, i)`` is NULL for every ``i``. One
    ``regexp_replace`` and one ``split`` cost a single match per line, where a
    ``regexp_extract`` per field would match the line once per field. Give it a plain
    column and ``pin`` the result: both are mentioned many times.

    Only built-in functions with generated code are used, so that matching stays in
    one compiled stage with the scan. A line that holds all three separators is matched
    once per group instead.
    """
    head = "(?s:^.*?)" if anywhere else ""
    whole = UNICODE + head + pattern + "(?s:.*)"

    def laid_out(sep: str) -> Column:
        template = sep + sep.join(f"${i}" for i in range(1, groups + 1))
        return F.split(F.regexp_replace(c, whole, template), sep, -1)

    one_by_one = [F.regexp_extract(c, UNICODE + head + pattern, i) for i in range(1, groups + 1)]
    found = F.rlike(c, F.lit(UNICODE + head + pattern))
    result = F.when(found, F.array(F.lit(""), *one_by_one)).otherwise(F.array(c))
    for sep in reversed(SEPARATORS):
        result = F.when(~F.contains(c, F.lit(sep)), laid_out(sep)).otherwise(result)
    return result


def group(m: Column, i: int) -> Column:
    return F.get(m, F.lit(i))


def matched(m: Column) -> Column:
    return F.coalesce(F.size(m) > 1, F.lit(False))


def to_number(c: Column, kind: str) -> Column:
    """Whole decimal text to a number; anything else, or overflow, to NULL."""
    return F.when(F.rlike(c, F.lit(r"^[+-]?[0-9]+\z")), c.try_cast(kind))


def request_part(request: Column, i: int) -> Column:
    """Method, path or protocol (0, 1, 2) of a request line; absent parts are ''."""
    return F.coalesce(F.get(F.split(request, " ", 3), F.lit(i)), F.lit(""))
