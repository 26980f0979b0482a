"""Poll telemetry as a stream of immutable log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logtel.operators.keyed import latest_per_key
from logtel.sources.files import DUPLICATE_KEYS
from logtel.sources.lines import with_line_numbers
from logtel.sources.poll_lines import of_tagged_lines, parse_poll_lines, tagged_lines
from logtel.streaming.tables import BATCH, read_batches, write_batch

_NAMES = ("stages", "cycles", "warnings")


def _empty_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "file string, line bigint, value string")


def table_schema(spark: SparkSession, name: str) -> T.StructType:
    return dict(zip(_NAMES, of_tagged_lines(tagged_lines(_empty_lines(spark)))))[name].schema


def stream_poll(spark: SparkSession, source: str, tables: str, files_per_batch: int | None = None) -> StreamingQuery:
    """Append stage events, warnings and each batch's last cycle per run, whole line (``facts``) included, below ``tables``.

    A line is parsed once; reads what is there, then stops.
    """
    spark.conf.set(DUPLICATE_KEYS, "true")
    reader = spark.readStream.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.text(source).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.xxhash64("_metadata.file_path").alias("_file_hash"),
        "value",
    )

    def store(batch: DataFrame, number: int) -> None:
        lines = with_line_numbers(batch.withColumn("_id", F.monotonically_increasing_id()))
        stages, cycles, warnings = parse_poll_lines(lines)
        write_batch(stages, f"{tables}/stages", number)
        write_batch(latest_per_key(cycles, ["run_id"], "arrival"), f"{tables}/cycles", number)
        write_batch(warnings, f"{tables}/warnings", number)

    return (
        raw.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{tables}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def poll_tables(spark: SparkSession, tables: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stages, cycles, warnings) as of now: one cycle per run, the last to arrive."""
    stages, cycles, warnings = (
        read_batches(spark, f"{tables}/{name}", table_schema(spark, name)) for name in _NAMES
    )
    placed = F.struct(F.col(BATCH).alias("batch"), F.col("arrival.file"), F.col("arrival.line"))
    current = latest_per_key(cycles.withColumn("arrival", placed), ["run_id"], "arrival")
    return stages.withColumn("arrival", placed).drop(BATCH), current.drop(BATCH), warnings.drop(BATCH)
