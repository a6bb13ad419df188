"""Strictly typed JSON fields over VARIANT.

``from_json`` nulls a field of the wrong type and keeps the row; here a wrong type
makes the whole record unusable, so each field carries its own check.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def fields_of(names: list[str]) -> str:
    """Type of an object taken apart into VARIANT fields, in one step for all."""
    return "struct<" + ",".join(f"`{name}`:variant" for name in names) + ">"


def wrapped(text: Column) -> Column:
    """The text as the only element of a JSON array.

    ``try_parse_json`` ignores what follows the first value; inside an array it is a
    syntax error.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))


def only_object(text: Column, array: Column, names: list[str]) -> Column:
    """Fields of the object ``text`` consists of; NULL when it is anything else.

    ``array`` is ``wrapped(text)``. A tail that closes the array early is caught by
    wrapping in an object as well, needed only where ``}`` meets ``]``.
    """
    single = F.try_variant_get(array, "$[1]", "variant").isNull()
    closes_early = F.rlike(text, F.lit(r"\}\s*\]"))
    whole = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    shape = F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))
    fields = F.try_variant_get(array, "$[0]", fields_of(names))
    return F.when(shape & single & F.when(closes_early, whole).otherwise(F.lit(True)), fields)


def kind(v: Column) -> Column:
    """Type name of a field; VOID when it is absent or null."""
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def absent(v: Column) -> Column:
    return kind(v) == "VOID"


def is_text(v: Column) -> Column:
    return kind(v).isin("VOID", "STRING")


def is_integer(v: Column) -> Column:
    return kind(v).isin("VOID", "BIGINT")


def is_number(v: Column) -> Column:
    return F.rlike(kind(v), F.lit(r"^(VOID|BIGINT|DOUBLE|DECIMAL.*)\z"))


def text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def text_or_empty(v: Column) -> Column:
    return F.coalesce(text(v), F.lit(""))


def integer(v: Column) -> Column:
    return F.try_variant_get(v, "$", "bigint")


def number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def low_int(c: Column) -> Column:
    """The low 32 bits of a BIGINT, as a narrowing integer cast would keep them."""
    return F.shiftright(F.shiftleft(c, 32), 32).cast("int")


def all_true(tests: list[Column]) -> Column:
    return reduce(and_, tests)
