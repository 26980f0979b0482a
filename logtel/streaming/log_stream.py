"""Streams over the message log: draining to the head, and publishing keyed events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logtel.operators.ingest import continued_batches, event_time_ms, resolve_key, rows_to_json, write_keyed_events
from logtel.operators.messages import advance_checkpoints
from logtel.session import written
from logtel.streaming.tables import BATCH, read_batches, read_before, write_batch, write_state

TAILS = (
    T.StructType()
    .add("partition_id", T.LongType())
    .add("seq", T.LongType())
    .add("msg_offset", T.StringType())
    .add("events_read", T.LongType())
)


def drain_to_head(messages: DataFrame, tables: str) -> StreamingQuery:
    """Read what the log holds now and stop, keeping only each batch's tail per partition."""

    def tail(batch: DataFrame, number: int) -> None:
        tails = batch.groupBy("partition_id").agg(
            F.max("seq").alias("seq"), F.max_by("msg_offset", "seq").alias("msg_offset"), F.count(F.lit(1)).alias("events_read")
        )
        write_batch(tails, f"{tables}/tails", number)

    return (
        messages.writeStream.foreachBatch(tail)
        .option("checkpointLocation", f"{tables}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def drained_checkpoints(spark: SparkSession, checkpoints: DataFrame, tables: str) -> DataFrame:
    """The checkpoints after a drain: one new value per partition however many batches it took."""
    tails = read_batches(spark, f"{tables}/tails", TAILS).drop(BATCH)
    counts = tails.groupBy("partition_id").agg(F.sum("events_read").alias("events_read"))
    return advance_checkpoints(checkpoints, tails).drop("events_read").join(counts, "partition_id", "left").withColumn(
        "events_read", F.coalesce("events_read", F.lit(0).cast("bigint"))
    )


OPEN = T.StructType().add("_key", T.StringType()).add("held", T.LongType()).add("batches", T.LongType())
_NEVER = 9223372036854775807


def stream_keyed_events(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    field: str = "sessionId",
    allow_unkeyed: bool = False,
    partitions: int = 32,
    max_bytes: int | None = None,
) -> StreamingQuery:
    """Order, key, serialise and write rows micro-batch by micro-batch; a key's order holds within a micro-batch.

    ``rows`` needs ``_ord`` for ties. Each micro-batch has its own folder, so a replay replaces it.
    Rows without a key are not lost: ``skipped_rows`` and ``publish_summary`` read what became of them.

    With ``max_bytes`` the events of a key are also numbered into size-bounded
    batches, ``_batch``. A key's open batch (bytes and number) is kept beside
    each micro-batch, so that the next one, or a restart, goes on filling it;
    events without a readable time come last in theirs.
    """

    def publish(batch: DataFrame, number: int) -> None:
        keyed, _ = resolve_key(event_time_ms(batch), field, allow_unkeyed=True)
        # times are read and rows made into JSON once, whatever orders and writes them afterwards
        told = written(rows_to_json(keyed).select("_ord", "_event_ms", "_key", "_body"), "publishing")
        lost = F.lit(False) if allow_unkeyed else F.col("_key").isNull()
        write_batch(told.filter(lost).select("_ord", "_body"), f"{path}-skipped", number)
        bodies, also = told.filter(~lost), []
        if max_bytes is not None:
            opened = read_before(batch.sparkSession, f"{path}-open", OPEN, number)
            timed = bodies.withColumn("_when", F.coalesce("_event_ms", F.lit(_NEVER)))
            bodies, left = continued_batches(timed, max_bytes, ("_when", "_ord"), opened)
            write_state(left, f"{path}-open", number)
            also = ["_batch"]
        write_keyed_events(bodies, f"{path}/{BATCH}={number}", partitions, mode="overwrite", also=also)

    return (
        rows.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def skipped_rows(spark: SparkSession, path: str, order: str = "bigint") -> DataFrame:
    """The rows that were published to ``path`` without success for want of a key, as JSON, with ``_ord`` of type ``order``."""
    schema = T.StructType.fromDDL(f"_ord {order}, _body string")
    return read_batches(spark, f"{path}-skipped", schema)


def publish_summary(published: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: rows read, sent and skipped, and how many keys were sent."""
    sent = published.agg(F.count(F.lit(1)).alias("rows_sent"), F.count_distinct("key").alias("keys"))
    left = skipped.agg(F.count(F.lit(1)).alias("rows_skipped"))
    both = sent.withColumn("_one", F.lit(1)).join(left.withColumn("_one", F.lit(1)), "_one")
    return both.select((F.col("rows_sent") + F.col("rows_skipped")).alias("rows_read"), "rows_sent", "rows_skipped", "keys")
