"""Ordered passes over groups of any size.

A window over a whole group puts the group into one task. The functions here
do ordered work without that: rows are laid out in blocks by a range shuffle
on (keys, order), so a large group covers many blocks. Each block is scanned
by itself, and what the earlier blocks of the same group contribute is carried
in through a broadcast. A block can continue at most one group from the block
before it and hand one on to the next, so the carried table has at most two
rows per block whatever the data looks like.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtel.session import cut

BLOCK = "_block"

_FOLDS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``how`` is sum, max or min; ``before`` leaves out the row itself."""

    how: str
    value: Column
    before: bool = False

    def combine(self, carried: Column, local: Column) -> Column:
        if self.how == "sum":
            return F.coalesce(carried + local, local, carried)
        return (F.greatest if self.how == "max" else F.least)(carried, local)


#: Input bytes that one block should stand for.
BLOCK_BYTES = 256 << 20
#: Sizes from here on are Spark's way of saying that it does not know.
_UNKNOWN_BYTES = 1 << 60


def input_bytes(df: DataFrame) -> int:
    """Size of the files that ``df`` reads: tables as Spark knows them while planning, checkpoints as they are stored.

    What is planned on a checkpoint keeps the estimate of the plan that made
    it, a product of sizes after joins, so the stored files are asked instead.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(_leaf_bytes(df, leaves.apply(i)) for i in range(leaves.size()))


def _leaf_bytes(df: DataFrame, leaf) -> int:
    if leaf.getClass().getSimpleName() == "LogicalRDD":
        stored = leaf.rdd().getCheckpointFile()
        if not stored.isDefined():
            return 0
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(stored.get())
        return place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).getContentSummary(place).getLength()
    size = int(str(leaf.stats().sizeInBytes()))
    return size if size < _UNKNOWN_BYTES else 0


def block_count(df: DataFrame) -> int:
    """Blocks for an ordered pass: as many as there are shuffle partitions, more if blocks would get too large."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // BLOCK_BYTES))


def lay_out(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], blocks: int | None = None) -> DataFrame:
    """Range-partition by (keys, order), sort each block and number it in ``_block``.

    ``order`` should end in something unique, so that equal values can be split.
    The result is materialised: both the scan and the carried totals must see
    the same block of every row.
    """
    blocks = blocks or block_count(df)
    columns = [*keys, *order]
    placed = df.repartitionByRange(blocks, *columns).sortWithinPartitions(*columns)
    return cut(placed.withColumn(BLOCK, F.spark_partition_id()))


def _same_group(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = left[BLOCK] == right[BLOCK]
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def running(
    laid: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    columns: Mapping[str, Running],
    totals: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Add running aggregates, and aggregates of the whole group, to a laid-out frame."""
    totals = totals or {}
    folds = {name: (spec.how, spec.value) for name, spec in columns.items()} | dict(totals)

    per_block = laid.groupBy(*keys, BLOCK).agg(*[_FOLDS[how](value).alias(name) for name, (how, value) in folds.items()])
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = group.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        per_block.select(
            *keys,
            BLOCK,
            F.count(F.lit(1)).over(group).alias("_spans"),
            *[_FOLDS[spec.how](F.col(name)).over(earlier).alias(f"_carry_{name}") for name, spec in columns.items()],
            *[_FOLDS[how](F.col(name)).over(group).alias(f"_carry_{name}") for name, (how, _) in totals.items()],
        )
        .filter("_spans > 1")
        .drop("_spans")
    )

    block = Window.partitionBy(*keys, BLOCK)
    scan = block.orderBy(*order)
    through = scan.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up_to = scan.rowsBetween(Window.unboundedPreceding, -1)
    scanned = laid.select(
        "*",
        *[_FOLDS[s.how](s.value).over(up_to if s.before else through).alias(f"_local_{n}") for n, s in columns.items()],
        *[_FOLDS[how](value).over(block).alias(f"_local_{n}") for n, (how, value) in totals.items()],
    )
    joined = scanned.join(F.broadcast(carried), _same_group(scanned, carried, keys), "left")
    return joined.select(
        *[scanned[c] for c in laid.columns],
        *[s.combine(F.col(f"_carry_{n}"), F.col(f"_local_{n}")).alias(n) for n, s in columns.items()],
        *[F.coalesce(F.col(f"_carry_{n}"), F.col(f"_local_{n}")).alias(n) for n in totals],
    )


#: Rows of a table with one narrow row for each key that are broadcast to meet the facts.
BROADCAST_ROWS = 1 << 18
#: Parts that the facts of a key are split into where such a table is larger.
SALTS = 32


def counted(df: DataFrame) -> DataFrame:
    """``df`` materialised, with its number of rows known to ``attach``: for a small table that meets facts more than once."""
    kept = cut(df)
    kept.counted_rows = kept.count()
    return kept


def attach(facts: DataFrame, per_key: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """``facts`` joined to a table with one row for each key, however many facts a key has.

    The rows of the small table are counted before it is broadcast. Beyond
    ``most`` rows the facts of each key are split by a hash of the columns
    ``spread`` and meet copies of the key's row, so that no key lands in one task.
    """
    per_key = per_key if hasattr(per_key, "counted_rows") else counted(per_key)
    if per_key.counted_rows <= most:
        return facts.join(F.broadcast(per_key), list(keys), how)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def exchanged(df: DataFrame) -> DataFrame:
    """``df``, of any size, for a join that moves both sides by key and never broadcasts it.

    Spark estimates what is selected by the declared width of all that it is
    selected from, so a narrow table out of a wide shape (``variants.shaped``)
    counts as a few KB whatever it holds, and the driver would collect it.
    """
    return df.hint("merge")


def without(facts: DataFrame, keys_of: DataFrame, keys: Sequence[str], most: int = BROADCAST_ROWS) -> DataFrame:
    """``facts`` whose key is not in ``keys_of``; the keys are counted before they are broadcast."""
    listed = counted(keys_of.select(*keys).distinct())
    return facts.join(F.broadcast(listed) if listed.counted_rows <= most else listed, list(keys), "left_anti")


def least_of(df: DataFrame, value: Column) -> Column:
    """Least value in ``df`` as a scalar subquery: a comparison of a stored column with it reaches that column's scan.

    Written as the first row in order, so that it is not merged with a
    ``greatest_of`` over the same rows into a structure that scans cannot use.
    """
    return df.select(value.alias("_value")).orderBy("_value").limit(1).scalar()


def greatest_of(df: DataFrame, value: Column) -> Column:
    """Greatest value in ``df`` as a scalar subquery."""
    return df.agg(F.max(value)).scalar()


def brackets(laid: DataFrame, keys: Sequence[str], order: Sequence[Column | str], step: Column) -> DataFrame:
    """Add ``balance``, the running sum of ``step``, ``low_before``, its least value before the row, and ``ups`` and ``downs``, counts of steps.

    A block is summed up as (sum, least prefix, ups, downs); summaries of
    neighbouring blocks combine into one of both, so each block learns what
    comes before it from one row for each earlier block, and both results come
    from a single ordered scan of the block.
    """
    block = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    through, up_to = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(Window.unboundedPreceding, -1)
    one = F.lit(1).cast("bigint")
    steps = laid.withColumn("_step", step)
    up, down = F.when(F.col("_step") > 0, one).otherwise(0), F.when(F.col("_step") < 0, one).otherwise(0)
    scanned = steps.select(
        "*", F.sum("_step").over(through).alias("_balance"), F.sum(up).over(through).alias("_ups"), F.sum(down).over(through).alias("_downs")
    ).withColumn("_low", F.min("_balance").over(up_to))
    rows = scanned.groupBy(*keys, BLOCK).agg(
        F.sum("_step").alias("sum"), F.sum(up).alias("ups"), F.sum(down).alias("downs"), F.min("_balance").alias("_least")
    )
    group = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(BLOCK)
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.select(*keys, BLOCK, "_least", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_had_{n}") for n in ("sum", "ups", "downs")])
    parts = parts.withColumn("_had_low", F.min(F.col("_had_sum") + F.col("_least")).over(before))
    renamed = {key: f"_of_{i}" for i, key in enumerate([*keys, BLOCK])}
    carried = parts.drop("_least").filter("_had_ups + _had_downs > 0").withColumnsRenamed(renamed)
    here = F.lit(True)
    for key, other in renamed.items():
        here = here & F.col(key).eqNullSafe(F.col(other))
    joined = scanned.join(F.broadcast(carried), here, "left")
    had = {n: F.coalesce(f"_had_{n}", F.lit(0)) for n in ("sum", "ups", "downs")}
    return joined.select(
        *laid.columns,
        (had["sum"] + F.col("_balance")).alias("balance"),
        F.least("_had_low", had["sum"] + F.col("_low")).alias("low_before"),
        (had["ups"] + F.col("_ups")).alias("ups"),
        (had["downs"] + F.col("_downs")).alias("downs"),
    )


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """1-based position of every row within its group, for groups of any size."""
    return running(lay_out(df, keys, order), keys, order, {name: Running("sum", F.lit(1).cast("bigint"))}).drop(BLOCK)


def values_at_ranks(
    df: DataFrame, by: Sequence[str], value: str, ranks: Mapping[str, Callable[[Column], Column]]
) -> DataFrame:
    """Exact order statistics per group, with count, sum, min and max.

    ``ranks`` maps a column name to a function from the group's row count to a
    1-based rank. Equal values are counted before the shuffle, so neither a
    frequent value nor a large group lands in one task.
    """
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    laid = lay_out(counted, by, [value])
    placed = running(
        laid, by, [value], {"_through": Running("sum", F.col("_n"))}, totals={"_all": ("sum", F.col("_n"))}
    )
    picks = {}
    for name, rank in ranks.items():
        target = rank(F.col("_all"))
        hit = (F.col("_through") >= target) & (F.col("_through") - F.col("_n") < target)
        picks[name] = F.max(F.when(hit, F.col(value)))
    return placed.groupBy(*by).agg(
        F.sum("_n").alias("count"),
        F.sum(F.col(value) * F.col("_n")).alias("sum"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        *[pick.alias(name) for name, pick in picks.items()],
    )
