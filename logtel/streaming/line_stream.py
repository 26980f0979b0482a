"""Chunks of growing logs to whole lines, with the cut line of each log kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logtel.session import cut
from logtel.sources.lines import finished, split_chunks, without_cr
from logtel.streaming.tables import read_batches, read_before, write_batch, write_state

STATE = T.StructType().add("stream", T.StringType()).add("carry", T.StringType()).add("next_line", T.LongType())
LINES = T.StructType().add("stream", T.StringType()).add("line", T.LongType()).add("value", T.StringType())
_CARRY_CHUNK = -1


def advance_lines(chunks: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(whole lines, new state) after more chunks; chunks of one log are split over tasks like any others.

    The line that was cut is one more chunk before the others, and the lines a
    log has had are counted before it, so lines get their numbers where they are
    read and the state is made of what the chunks' ends left over.
    """
    carried = state.filter("length(carry) > 0").select(
        "stream", F.lit(_CARRY_CHUNK).cast("bigint").alias("chunk"), F.col("carry").alias("text")
    )
    had = state.select("stream", (F.coalesce("next_line", F.lit(1)) - 1).alias("n"))
    pieces = split_chunks(chunks.select("stream", "chunk", "text").unionByName(carried), had)
    seams = cut(pieces.seams)
    ended = seams.filter("ended").select("stream", "line", "value")
    rest = seams.filter("NOT ended").select(F.col("stream").alias("_stream"), F.col("value").alias("_rest"))
    new_state = pieces.ends.join(rest, F.col("stream").eqNullSafe(F.col("_stream")), "left").select(
        "stream", F.coalesce("_rest", F.lit("")).alias("carry"), (F.col("n") + 1).alias("next_line")
    )
    return finished(pieces.whole.unionByName(ended)), new_state


def stream_lines(spark: SparkSession, source: str, tables: str, files_per_batch: int | None = None) -> StreamingQuery:
    """Reassemble chunk files (parquet: stream, chunk, text) into ``tables/lines``; the cut lines wait in ``tables/state``."""
    reader = spark.readStream.schema("stream string, chunk bigint, text string").option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def store(batch: DataFrame, number: int) -> None:
        lines, state = advance_lines(batch, read_before(spark, f"{tables}/state", STATE, number))
        write_batch(lines, f"{tables}/lines", number)
        write_state(state, f"{tables}/state", number)

    return (
        reader.parquet(source)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{tables}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def reassembled(spark: SparkSession, tables: str, flush: bool = True) -> DataFrame:
    """Lines so far; with ``flush`` the cut last line of each log too."""
    lines = read_batches(spark, f"{tables}/lines", LINES).select("stream", "line", "value")
    if not flush:
        return lines
    state = read_batches(spark, f"{tables}/state", STATE)
    last = state.groupBy("stream").agg(F.max_by(F.struct("carry", "next_line"), "_batch_id").alias("s"))
    rest = last.filter("length(s.carry) > 0").select(
        "stream", F.col("s.next_line").alias("line"), without_cr(F.col("s.carry")).alias("value")
    )
    return lines.unionByName(rest)
