"""Tables addressed by key: latest row, upsert, purge, distinct keys, changed files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtel.operators.layout import BROADCAST_ROWS
from logtel.session import cut


#: A key with more than this share of the rows is a heavy one; there are at most as many of them as its inverse.
HEAVY_SHARE = 1e-5


def _spread(df: DataFrame) -> Column:
    """A hash of the row, without columns that have none: tells most of the rows with equal key and order apart."""

    def hashable(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return hashable(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(hashable(f.dataType) for f in kind)
        return not isinstance(kind, (T.MapType, T.VariantType))

    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if hashable(f.dataType)])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """The row with the greatest ``order`` per key; null orders come before all others, ties leave any one row.

    Two phases. The first aggregates the order alone: its greatest value by key
    and the number of rows, so nothing wide is sorted or exchanged. The second
    fetches the rows that have it. Where the keys are few they are broadcast
    and rows are filtered where they are read; where they are many, rows of
    heavy keys are filtered by a broadcast of those (their number is bounded),
    and the others meet their key's greatest order by key, order and a hash of
    the row, so that no key lands in one task. Of equal rows one is left.
    """
    order = F.col(order) if isinstance(order, str) else order
    rows = df.withColumn("_order", order)
    newest = cut(rows.groupBy(*keys).agg(F.max("_order").alias("_greatest"), F.count(F.lit(1)).alias("_rows")))
    seen = newest.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    newest = newest.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], "_greatest", "_rows")

    def of_key(extra: Column) -> Column:
        condition = extra
        for i, key in enumerate(keys):
            condition = condition & F.col(key).eqNullSafe(F.col(f"_key_{i}"))
        return condition

    if seen[0] <= BROADCAST_ROWS:
        found = rows.join(F.broadcast(newest), of_key(F.col("_order").eqNullSafe(F.col("_greatest"))), "left_semi")
    else:
        heavy = newest.filter(F.col("_rows") > HEAVY_SHARE * seen[1])
        light = rows.join(F.broadcast(heavy), of_key(~F.col("_order").eqNullSafe(F.col("_greatest"))), "left_anti")
        found = light.join(newest, of_key(F.col("_order").eqNullSafe(F.col("_greatest"))), "left_semi")
    # rows that are alike in key and order: one by hash first, where the rows are
    alike = Window.partitionBy(*keys).orderBy("_hash")
    ranked = found.withColumn("_hash", _spread(df)).withColumn("_place", F.row_number().over(alike))
    return ranked.filter("_place = 1").select(*df.columns)


def _key_match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def upsert_by_key(current: DataFrame, updates: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """``current`` with rows of equal key replaced by the last update, and new keys appended."""
    newest = latest_per_key(updates, keys, order).select(*current.columns)
    kept = current.join(newest, _key_match(current, newest, keys), "left_anti")
    return kept.unionByName(newest)


def _comparable(df: DataFrame, name: str) -> Column:
    """Keys compare as text, boolean or double; other types are refused."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.NumericType,)):
        return F.col(name).cast("double")
    if isinstance(kind, (T.StringType, T.BooleanType, T.NullType)):
        return F.col(name)
    raise ValueError(f"unsupported key type of {name}: {kind.simpleString()}")


def _key_columns(df: DataFrame, paths: Sequence[str]) -> list[str]:
    names = []
    for path in paths:
        name = path[1:] if path.startswith("/") else path
        if not name or "/" in name:
            raise ValueError(f"only top-level key columns are supported: {path}")
        if name not in df.columns:
            raise ValueError(f"missing key column: {name}")
        names.append(name)
    return names


def distinct_keys(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Distinct composite keys over top-level columns; nulls count as a key, numbers as double."""
    names = _key_columns(df, paths)
    return df.select(*[_comparable(df, n).alias(n) for n in names]).distinct()


def purge_keys(df: DataFrame, keys: DataFrame, paths: Sequence[str]) -> DataFrame:
    """``df`` without the rows whose composite key is in ``keys``; a null matches a null."""
    names = _key_columns(df, paths)
    wanted = keys.select(*[_comparable(keys, n).alias(f"_key_{n}") for n in _key_columns(keys, paths)]).distinct()
    condition = F.lit(True)
    for name in names:
        condition = condition & _comparable(df, name).eqNullSafe(F.col(f"_key_{name}"))
    return df.join(wanted, condition, "left_anti")


def verify_purged(df: DataFrame, keys: DataFrame | None = None, paths: Sequence[str] = ()) -> DataFrame:
    """One row: is the table (or the part of it under ``keys``) empty?"""
    rest = df
    if keys is not None:
        wanted = keys.select(*[_comparable(keys, n).alias(f"_key_{n}") for n in _key_columns(keys, paths)])
        condition = F.lit(True)
        for name in _key_columns(df, paths):
            condition = condition & _comparable(df, name).eqNullSafe(F.col(f"_key_{name}"))
        rest = df.join(wanted, condition, "left_semi")
    return rest.select(F.lit(1).alias("one")).limit(1).agg((F.count("one") == 0).alias("is_empty"))


def changed_files(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Added, changed and removed files between two listings of (path, size, modified_ms)."""
    before = previous.select(
        "path", F.col("size").alias("old_size"), F.col("modified_ms").alias("old_ms"), F.lit(True).alias("_before")
    )
    after = current.select("path", "size", "modified_ms", F.lit(True).alias("_after"))
    same = F.col("size").eqNullSafe(F.col("old_size")) & F.col("modified_ms").eqNullSafe(F.col("old_ms"))
    change = (
        F.when(F.col("_before").isNull(), "added")
        .when(F.col("_after").isNull(), "removed")
        .when(~same, "changed")
    )
    return (
        after.join(before, "path", "full_outer")
        .select("path", change.alias("change"), "size", "modified_ms")
        .filter(F.col("change").isNotNull())
    )
