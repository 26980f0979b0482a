"""What the operators of this package share: table access, stored steps, text slices and connected components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtel.session import new_path, ship_package

ship_package()

#: Characters of text that are turned into arrays at once inside a task.
SLICE_CHARS = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: no lineage, real sizes, pruned columns."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(df: DataFrame) -> DataFrame:
    """(doc_id, text) of a document table, whatever else it holds; null texts count as empty."""
    return df.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(texts: Sequence[str], limit: int = SLICE_CHARS, most_rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` characters together; a longer text is a range by itself."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if i - start >= most_rows or held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``edges(a, b)`` as ``(node, root)``, root being the least node.

    Alternates the two star contractions of Kiveris et al. (2014): every round
    hangs the larger neighbours of a node, then the smaller ones, below the
    least node it knows. Only minima and narrow edges move; a node with very
    many edges is pre-aggregated before the shuffle, and the join that reads
    its minimum is one that Spark splits. Rounds end when no edge changes.
    """
    spark = edges.sparkSession

    def turned(e: DataFrame) -> DataFrame:
        return e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(current)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = turned(current)
        large = both.join(least(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        lower = least(large)
        small = large.join(lower, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
        current = stored(small.filter("a != b").distinct(), "edges")
        after = state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
