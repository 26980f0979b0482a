"""Telemetry row exports: CSV with quoted line breaks, read in parallel within each file."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtel.session import cut
from logtel.sources.lines import block_keys, join_blocks, read_blocks, without_cr


UNTERMINATED = "the record has a quote that is not closed before the end of the file"


def _records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Physical lines to records (file, _ord, record), and those left open: a line break inside quotes does not end one.

    A line begins inside quotes iff the quotes before it in its file are odd in
    number. That parity is carried from block to block; blocks without an odd
    line, begun outside quotes, hold one record per line and are passed on as
    they are. ``_ord`` is the number of the record's first line. In a file with
    an odd number of quotes the last record reaches to the end of the file: its
    lines are not brought together, it is reported by its first one.
    """
    counted = lines.withColumn("_odd", (F.length("value") - F.length(F.translate("value", '"', ""))) % 2)
    per_block = block_keys(counted).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"), F.sum("_odd").alias("_odds")
    )
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut(
        per_block.select(
            "_task",
            "_start",
            "_file_hash",
            "_first",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
            (F.coalesce(F.sum("_odds").over(before), F.lit(0)) % 2).alias("_inside"),
            "_odds",
            (F.sum("_odds").over(Window.partitionBy("file")) % 2 == 1).alias("_left_open"),
        )
    )
    placed = join_blocks(counted, blocks).withColumn("_ord", F.col("_offset") + F.col("_id") - F.col("_first") + 1)
    plain = (F.col("_odds") == 0) & (F.col("_inside") == 0)
    whole = placed.filter(plain).select("file", "_ord", F.col("value").alias("record"))

    in_block = Window.partitionBy("file", "_start").orderBy("_ord")
    earlier = in_block.rowsBetween(Window.unboundedPreceding, -1)
    through = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parity = (F.col("_inside") + F.coalesce(F.sum("_odd").over(earlier), F.lit(0))) % 2
    broken = (
        placed.filter(~plain)
        .withColumn("_begins", F.when(parity == 0, F.col("_ord")))
        .withColumn("_record", F.max("_begins").over(through))
    )
    last = block_keys(broken).agg(F.max("_begins").alias("_last"))
    final = F.max("_last").over(Window.partitionBy("file")).alias("_final")
    carried = cut(last.select("_task", "_start", "_file_hash", F.max("_last").over(before).alias("_carried"), final))
    pieces = join_blocks(broken, carried).withColumn("_record", F.coalesce("_record", "_carried"))
    left_open = F.col("_left_open") & (F.col("_record") == F.col("_final"))
    joined = pieces.filter(~left_open).groupBy("file", "_record").agg(
        F.array_sort(F.collect_list(F.struct("_ord", "value"))).alias("_lines")
    )
    text = F.array_join(F.transform("_lines", lambda x: x["value"]), "\n")
    records = whole.unionByName(joined.select("file", F.col("_record").alias("_ord"), text.alias("record")))
    return records, pieces.filter(left_open & (F.col("_ord") == F.col("_record"))).select("file", "_ord", F.col("value").alias("record"))


def read_row_export(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Rows of CSV exports as text columns named by the header, with ``_file`` and ``_ord``.

    Blank records are skipped, missing trailing fields are NULL, extra fields are
    dropped, an empty cell is NULL. All files must have the same header. A record
    that is left open is no row; ``read_checked_rows`` reports it.
    """
    return read_checked_rows(spark, path)[0]


def read_checked_rows(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): the rows of ``read_row_export``, and (_file, _ord, message, record) of records left open, with their first line."""
    records, left_open = _records(read_blocks(spark, path))
    records = records.withColumn("record", without_cr(F.col("record")))
    headers = [r[0] for r in records.filter("_ord = 1").select("record").distinct().limit(2).collect()]
    if not headers:
        raise ValueError(f"no header in {path}")
    if len(headers) > 1:
        raise ValueError(f"files with different headers in {path}")
    names = next(csv.reader([headers[0]]))
    fields = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
    options = {"sep": ",", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    body = records.filter("_ord > 1 AND length(record) > 0")
    parsed = body.select("file", "_ord", F.from_csv("record", fields.simpleString()[7:-1].replace(":", " "), options).alias("_r"))
    errors = left_open.select(F.col("file").alias("_file"), "_ord", F.lit(UNTERMINATED).alias("message"), without_cr(F.col("record")).alias("record"))
    return parsed.select("_r.*", "file", "_ord").toDF(*names, "_file", "_ord"), errors
