"""Exact deduplication by a tree merge of sorted digest runs.

Each input partition makes one run: its distinct texts as (digest, smallest
row, number of rows), sorted by digest. In every round ``2 ** bits``
neighbouring runs exchange their entries and are merged into one sorted run,
so that run r ends in run r >> bits; the last round leaves a single run. A
run is cut into lanes by digest, and lanes are what tasks get: neither a run
nor a text with very many copies ever sits in one task, as a text has at most
one entry in each run. Entries are sorted by a 64-bit digest and merged only
if their SHA-256 and lengths agree too, at every level.

DataFrame functions only. Results by case: a null text is an empty one; rows
that repeat both id and text are told apart by their place in the table, and
one of them stays; a null id stays only if no equal text has an id; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtel.llm.common import fresh, stored

#: White space whose replacement by a space changes the text: all but a single space.
_RUNS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
_ENTRY = ["digest", "text_sha256", "n_bytes"]


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def _digests(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint"), normalised(F.col("text")).alias("text"))
    return rows.select(
        "doc_id",
        F.xxhash64("text").alias("digest"),
        F.sha2("text", 256).alias("text_sha256"),
        F.octet_length("text").alias("n_bytes"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )


def _merged(entries: DataFrame, run: Column, lanes: int) -> DataFrame:
    """Runs exchanged and merged: entries sorted by (run, lane, digest), equal ones reduced to the smallest row."""
    keys = ["run", "lane", *_ENTRY]
    moved = entries.withColumn("run", run).repartition("run", "lane").sortWithinPartitions(*keys)
    return moved.groupBy(*keys).agg(F.min("first").alias("first"), F.sum("size").alias("size"))


def tree_merge(rows: DataFrame, bits: int = 4, lanes: int = 4096) -> DataFrame:
    """One entry for each different text of ``rows``: its smallest row ``first`` and how many rows have it."""
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    keys = ["run", "lane", *_ENTRY]
    last = rows.agg(F.max("run")).first()[0] or 0
    # round one: what a task has aggregated before it writes its shuffle files is its own sorted run
    runs = rows.withColumn("lane", F.pmod("digest", F.lit(lanes)).cast("int")).withColumn("run", F.shiftright("run", bits))
    entries, last = runs.groupBy(*keys).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size")), last >> bits
    while last:
        entries, last = _merged(entries, F.shiftright("run", bits), lanes), last >> bits
    return entries.select(*_ENTRY, "first", "size")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``keep_id`` of the row that stays, ``group_size``, ``kept`` and ``text_sha256``."""
    rows = stored(_digests(docs), "digests")
    entries = tree_merge(rows)
    return rows.join(entries, _ENTRY, "left").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    named = F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("none"))
    keys = [fresh(docs, "_kept_id"), fresh(docs, "_kept_text")]
    kept = exact_duplicates(docs).filter("kept").select(named.alias(keys[0]), F.col("text_sha256").alias(keys[1]))
    rows = docs.withColumn(keys[0], named).withColumn(keys[1], F.sha2(normalised(docs["text"]), 256))
    # rows that repeat id and text pass together; what the join has brought together is not moved again
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
