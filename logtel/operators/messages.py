"""The partitioned message log: backlog, bounded reads, metadata and checkpoints.

Messages: partition_id, seq, msg_offset, enqueued_ms, partition_key, message_id,
correlation_id, content_type, body, system_properties, app_properties.
Heads: partition_id, is_empty, begin_seq, last_seq. Checkpoints: partition_id, seq, ...
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtel.operators.layout import BLOCK, Running, attach, counted, greatest_of, lay_out, least_of, running

# Messages per counting block when a read is capped.
COUNT_BLOCK = 65536
#: Before any sequence number.
_FIRST = -9223372036854775808


def partition_heads(messages: DataFrame) -> DataFrame:
    """First and last retained sequence number per partition."""
    return messages.groupBy("partition_id").agg(
        F.lit(False).alias("is_empty"), F.min("seq").alias("begin_seq"), F.max("seq").alias("last_seq")
    )


def partition_backlog(heads: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Messages still to be read per partition, behind its checkpoint or in all."""
    marks = checkpoints.select("partition_id", F.col("seq").alias("checkpoint_seq"))
    retained = F.when(F.col("is_empty"), F.lit(0)).otherwise(F.col("last_seq") - F.col("begin_seq") + 1)
    behind = F.col("last_seq") - F.col("checkpoint_seq")
    count = F.greatest(F.lit(0), F.when(F.col("checkpoint_seq").isNotNull(), behind).otherwise(retained))
    empty = F.when(F.col("checkpoint_seq").isNotNull(), F.col("backlog") == 0).otherwise(F.col("is_empty"))
    return (
        heads.join(marks, "partition_id", "left")
        .withColumn("backlog", count.cast("bigint"))
        .select(
            "partition_id", "begin_seq", "last_seq", "checkpoint_seq", "backlog", empty.alias("effectively_empty")
        )
    )


def backlog_total(backlog: DataFrame) -> DataFrame:
    return backlog.agg(F.coalesce(F.sum("backlog"), F.lit(0)).alias("total_backlog"))


def checkpoint_report(heads: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Unprocessed messages behind each checkpoint; none counted where there is no checkpoint."""
    marks = checkpoints.select("partition_id", F.col("seq").alias("checkpoint_seq"))
    last = F.coalesce(F.col("last_seq"), F.lit(-1).cast("bigint"))
    known = F.col("checkpoint_seq").isNotNull() & (last >= 0)
    unprocessed = F.when(known, F.greatest(F.lit(0), last - F.col("checkpoint_seq"))).otherwise(F.lit(0))
    return heads.join(marks, "partition_id", "left").select(
        "partition_id",
        last.alias("last_seq"),
        "checkpoint_seq",
        unprocessed.cast("bigint").alias("unprocessed"),
        F.when(F.col("checkpoint_seq").isNull(), "no_checkpoint").alias("status"),
    )


def checkpoint_report_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.sum("unprocessed").alias("total_unprocessed"), F.max("checkpoint_seq").alias("total_checkpointed")
    )


def partition_order(partition_id: Column) -> Column:
    """Sort key of a partition id: numeric ids by number, others after them."""
    number = partition_id.cast("string").try_cast("int")
    return F.struct(F.coalesce(number, F.lit(2147483647)).alias("n"), partition_id.cast("string").alias("s"))


def unread(
    messages: DataFrame, heads: DataFrame, checkpoints: DataFrame | None = None, only_backlog: bool = True
) -> DataFrame:
    """Messages up to the captured head: after the checkpoint where there is one, all of them without ``only_backlog``."""
    return _within(messages, _read_bounds(heads, checkpoints, only_backlog))


def _read_bounds(heads: DataFrame, checkpoints: DataFrame | None, only_backlog: bool) -> DataFrame:
    """One row for each partition: where its read starts (null: at the beginning) and stops."""
    bounds = heads.select("partition_id", F.col("last_seq").alias("_stop"))
    if checkpoints is not None and only_backlog:
        marks = checkpoints.select("partition_id", F.col("seq").alias("_start"))
        return counted(bounds.join(marks, "partition_id", "left"))
    return counted(bounds.withColumn("_start", F.lit(None).cast("bigint")))


def _within(messages: DataFrame, bounds: DataFrame) -> DataFrame:
    after = F.col("_start").isNull() | (F.col("seq") > F.col("_start"))
    # what holds for the partitions together reaches the scan, what holds for each of them follows
    some = messages.filter(
        (F.col("seq") > least_of(bounds, F.coalesce("_start", F.lit(_FIRST)))) & (F.col("seq") <= greatest_of(bounds, F.col("_stop")))
    )
    return attach(some, bounds, ["partition_id"], ["seq"]).filter(after & (F.col("seq") <= F.col("_stop"))).drop("_start", "_stop")


def bounded_read(
    messages: DataFrame,
    heads: DataFrame,
    checkpoints: DataFrame | None = None,
    max_events: int | None = None,
    only_backlog: bool = True,
) -> DataFrame:
    """``unread`` messages, numbered in ``index`` in (partition, sequence) order.

    Only partitions and sequence numbers are ordered; messages meet their number
    by these, so bodies move once, spread over all tasks. ``max_events``, if the
    caller sets it, bounds the read to the first so many. Blocks of sequence
    numbers are counted first then, so only rows of blocks that can hold kept
    messages are ordered at all.
    """
    bounds = _read_bounds(heads, checkpoints, only_backlog)
    numbered = _numbered(_within(messages.select("partition_id", "seq"), bounds), max_events)
    own = numbered.select(F.col("partition_id").alias("_partition"), F.col("seq").alias("_seq"), "index")
    place = (F.col("partition_id") == F.col("_partition")) & (F.col("seq") == F.col("_seq"))
    return _within(messages, bounds).join(own, place).select(*messages.columns, "index")


def _numbered(unread_places: DataFrame, max_events: int | None) -> DataFrame:
    wanted = unread_places.withColumn("_place", partition_order(F.col("partition_id")))
    order = ["_place", "seq"]
    number = {"index": Running("sum", F.lit(1).cast("bigint"))}
    if max_events is None:
        return running(lay_out(wanted, [], order), [], order, number).drop("_place", BLOCK)
    wanted = wanted.withColumn("_part", F.floor(F.col("seq") / F.lit(COUNT_BLOCK)))
    counts = wanted.groupBy("_place", "_part").agg(F.count(F.lit(1)).alias("_n"))
    laid = lay_out(counts, [], ["_place", "_part"])
    cumulative = running(laid, [], ["_place", "_part"], {"_through": Running("sum", F.col("_n"))})
    # Every kept block holds a message and all but the last are kept whole: at most max_events rows.
    kept = cumulative.filter(F.col("_through") - F.col("_n") < max_events).select("_place", "_part")
    some = wanted.join(kept, ["_place", "_part"], "left_semi")
    indexed = running(lay_out(some, [], order), [], order, number)
    return indexed.filter(F.col("index") <= max_events).drop("_place", "_part", BLOCK)


def body_preview(text: Column, preview: int) -> Column:
    more = F.length(text) - preview
    cut = F.concat(F.substring(text, 1, preview), F.lit("…(+"), more.cast("string"), F.lit(" more chars)"))
    return F.when(more > 0, cut).otherwise(text)


def utc_text(ms: Column) -> Column:
    """ISO text of epoch milliseconds, in UTC whatever the session zone is."""
    shifted = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18,6)"))
    return F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def message_metadata(read: DataFrame, preview: int = 1000) -> DataFrame:
    """Per-message metadata of a bounded read: body size, text, preview and properties as text."""
    body = F.decode(F.col("body"), "UTF-8")
    return read.select(
        "index",
        F.col("partition_id").cast("string").alias("partition_id"),
        F.col("seq").alias("sequence_number"),
        F.col("msg_offset").cast("string").alias("offset"),
        utc_text(F.col("enqueued_ms")).alias("enqueued_time_utc"),
        "partition_key",
        "message_id",
        "correlation_id",
        "content_type",
        F.octet_length("body").alias("body_bytes"),
        property_texts(read, "system_properties"),
        property_texts(read, "app_properties"),
        body.alias("body"),
        body_preview(body, preview).alias("preview"),
    )


def property_text(value: Column, kind: str) -> Column:
    """A message property as text: bytes base64, times ISO, everything else its plain text."""
    if kind == "binary":
        return F.base64(value)
    if kind in ("timestamp", "timestamp_ntz"):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return value.cast("string")


def property_texts(df: DataFrame, name: str) -> Column:
    """A property map, or a struct of typed properties, as a map of texts; a null property stays null."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StructType):
        pairs = [x for f in kind.fields for x in (F.lit(f.name), property_text(F.col(name)[f.name], f.dataType.typeName()))]
        return F.when(F.col(name).isNotNull(), F.create_map(*pairs)).alias(name)
    if isinstance(kind.valueType, T.StringType):
        return F.col(name)
    return F.transform_values(name, lambda _, v: property_text(v, kind.valueType.typeName())).alias(name)


def export_message_metadata(metadata: DataFrame, path: str) -> None:
    """JSON export with null fields written out."""
    metadata.drop("preview").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def advance_checkpoints(checkpoints: DataFrame, read: DataFrame) -> DataFrame:
    """One checkpoint per partition after a read; a checkpoint never moves back."""
    tail = read.groupBy("partition_id").agg(
        F.max("seq").alias("_seq"),
        F.max_by("msg_offset", "seq").alias("_offset"),
        F.count(F.lit(1)).alias("events_read"),
    )
    moved = F.col("_seq").isNotNull() & (F.col("seq").isNull() | (F.col("_seq") > F.col("seq")))
    return checkpoints.join(tail, "partition_id", "full_outer").select(
        "partition_id",
        F.when(moved, F.col("_seq")).otherwise(F.col("seq")).alias("seq"),
        F.when(moved, F.col("_offset")).otherwise(F.col("msg_offset")).alias("msg_offset"),
        F.coalesce("events_read", F.lit(0).cast("bigint")).alias("events_read"),
        moved.alias("advanced"),
    )
