"""Typed reads of JSON held as VARIANT: the type is checked before any cast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: how SQL type texts of whole and decimal JSON numbers begin.
EXACT = "BIG,DEC"


def member(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column, path: str = "$") -> Column:
    """SQL type text of a member: NULL when absent, ``VOID`` for JSON null."""
    return F.schema_of_variant(v if path == "$" else member(v, path))


def shape(**members: str) -> str:
    """Type of an object with these members, all others left out; see ``shaped``."""
    return f"struct<{','.join(f'`{name}`:{of}' for name, of in members.items())}>"


def leaves(*names: str) -> dict[str, str]:
    """Members for ``shape`` that stay VARIANT, so that their own types are still seen."""
    return dict.fromkeys(names, "variant")


def shaped(v: Column, of: str, path: str = "$") -> Column:
    """An object or array taken apart in one pass, a part of another kind than ``of`` says being NULL.

    A read by path walks the document and copies what it finds, so many
    reads of one document cost its size each time.
    """
    return F.try_variant_get(v, path, of)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_object(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "struct<>").isNotNull()  # copies no member


def is_array(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<struct<>>").isNotNull()  # what is no object becomes NULL inside the array


def is_missing(v: Column, path: str) -> Column:
    """Absent or JSON null."""
    k = kind(v, path)
    return k.isNull() | (k == "VOID")


def text(v: Column, path: str = "$") -> Column:
    """A member that is JSON text, else NULL."""
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def is_number(v: Column, path: str = "$") -> Column:
    """True for a finite JSON number; a whole or decimal one need not be cast to see that."""
    of = kind(v, path)
    finite_one = F.abs(F.try_variant_get(v, path, "double")) < F.lit(float("inf"))
    return F.coalesce(F.when(F.instr(F.lit(EXACT), F.substring(of, 1, 3)) > 0, True).when((of == "DOUBLE") | (of == "FLOAT"), finite_one), F.lit(False))


def number(v: Column, path: str = "$") -> Column:
    """A member that is a finite JSON number as double, else NULL."""
    return F.when(is_number(v, path), F.try_variant_get(v, path, "double"))


def flag(v: Column, path: str) -> Column:
    return F.when(kind(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def items(v: Column, path: str = "$") -> Column:
    """A member that is an array, as ARRAY<VARIANT>, else NULL."""
    return F.try_variant_get(v, path, "array<variant>")


def with_value(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add ``value``, computed once per row.

    As a generated column it is not copied into each expression that reads it
    when filters are pushed down, which would compute it again and again.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_parsed(df: DataFrame, source: Column | str, name: str) -> DataFrame:
    """Add ``source``, JSON text, as VARIANT (NULL when it is not JSON), parsed once per row."""
    return with_value(df, F.try_parse_json(source), name)
