"""Queries that run as streams over files derived from the given tables, and return what the streams wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from logtel.operators import messages, polls
from logtel.operators.ingest import event_time_ms
from logtel.plans import source_queries as sources
from logtel.plans import tables as t
from logtel.plans.ingest_queries import LIFECYCLES, MAX_BATCH_BYTES, WALK
from logtel.plans.registry import query
from logtel.plans.views import with_views
from logtel.session import new_path, written
from logtel.streaming.assembly_stream import stream_assemble
from logtel.streaming.line_stream import reassembled, stream_lines
from logtel.streaming.log_stream import drain_to_head, drained_checkpoints, publish_summary, skipped_rows, stream_keyed_events
from logtel.streaming.poll_stream import poll_tables, stream_poll


@query(
    "stream_poll",
    with_views("cyc", then=f"""SELECT source, count(*) AS cycle_count, sum(records) AS total_records, sum(input_rows) AS total_input_rows
    FROM (SELECT *, row_number() OVER (PARTITION BY arrival // 3 ORDER BY arrival DESC) AS rn FROM cyc WHERE {sources.POLL_CYCLES})
    WHERE rn = 1 GROUP BY source"""),
)
def stream_poll_metrics(spark, folder):
    logs, tables = new_path(spark, "poll-logs"), new_path(spark, "poll-tables")
    text = sources.poll_text(spark, folder)
    # Runs share their three events; each file holds whole runs, in order.
    part = F.floor(F.col("arrival") / (3 * sources.LINES_PER_FILE)).alias("part")
    placed = text.select("value", part, "arrival").repartition("part").sortWithinPartitions("part", "arrival")
    placed.drop("arrival").write.partitionBy("part").text(logs)
    stream_poll(spark, logs, tables).awaitTermination()
    stages, cycles, _ = poll_tables(spark, tables)
    resolved, _ = polls.resolve_cycles(stages, cycles)
    return polls.source_metrics(resolved).select("source", "cycle_count", "total_records", "total_input_rows")


@query("stream_lines", sources.DOC_LINES)
def stream_document_lines(spark, folder):
    """The chunks arrive in two parts; the stream is stopped between them and restarted."""
    inbox, tables = new_path(spark, "chunks"), new_path(spark, "line-tables")
    chunks = sources.cut_texts(spark, folder)
    for part in (chunks.filter("chunk < 3"), chunks.filter("chunk >= 3")):
        part.repartition("stream", "chunk").write.mode("append").parquet(inbox)
        stream_lines(spark, inbox, tables).awaitTermination()
    return reassembled(spark, tables).select("stream", "line", F.md5("value").alias("digest"))


@query(
    "drain_to_head",
    with_views("heads", "msg", then="""SELECT h.partition_id, last_seq AS seq, CAST(last_seq * 128 AS VARCHAR) AS msg_offset, true AS advanced,
    n AS events_read FROM heads h JOIN (SELECT partition_id, count(*) AS n FROM msg GROUP BY partition_id) c ON h.partition_id = c.partition_id"""),
)
def drain_log(spark, folder):
    inbox, tables = new_path(spark, "log"), new_path(spark, "drain")
    t.messages(spark, folder).select("partition_id", "seq", "msg_offset").write.parquet(inbox)
    log = spark.readStream.schema("partition_id bigint, seq bigint, msg_offset string").option("maxFilesPerTrigger", 8).parquet(inbox)
    drain_to_head(log, tables).awaitTermination()
    return drained_checkpoints(spark, t.checkpoints(spark, folder), tables)


def _publish(spark, folder):
    """Where the rows of the telemetry table have been published by a stream."""
    inbox, out = new_path(spark, "rows"), new_path(spark, "published")
    rows = t.telemetry(spark, folder)
    rows.write.parquet(inbox)
    stream = spark.readStream.schema(rows.schema).parquet(inbox)
    stream_keyed_events(stream, out, new_path(spark, "publish-checkpoint"), partitions=8).awaitTermination()
    return out


@query(
    "stream_keyed_events",
    with_views("tele", then="SELECT session_key AS key, event_id AS ord, coalesce(client_ms, precise_ms) AS event_ms FROM tele WHERE session_key IS NOT NULL"),
)
def published_rows(spark, folder):
    published = spark.read.parquet(_publish(spark, folder))
    return published.select("key", F.col("_ord").alias("ord"), F.col("_event_ms").alias("event_ms"))


@query("stream_keyed_batches", WALK + " SELECT key, ord, CASE WHEN NOT oversize THEN number END AS batch FROM walk")
def published_batches(spark, folder):
    """The rows arrive in three parts by event time; a key's open batch is filled on after each restart."""
    inbox, out, checkpoint = new_path(spark, "rows"), new_path(spark, "published"), new_path(spark, "publish-checkpoint")
    rows = t.telemetry(spark, folder)
    timed = written(event_time_ms(rows), "timed-rows")
    first, last = timed.agg(F.min("_event_ms")).scalar(), timed.agg(F.max("_event_ms")).scalar()
    part = F.coalesce(F.floor((F.col("_event_ms") - first) * 3 / (last - first + 1)), F.lit(2))
    parted = timed.select(*rows.columns, part.alias("_part"))
    for number in range(3):
        parted.filter(F.col("_part") == number).drop("_part").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rows.schema).parquet(inbox)
        stream_keyed_events(stream, out, checkpoint, partitions=8, max_bytes=MAX_BATCH_BYTES).awaitTermination()
    return spark.read.parquet(out).select("key", F.col("_ord").alias("ord"), F.col("_batch").alias("batch"))


@query(
    "stream_publish_summary",
    with_views("tele", then="""SELECT count(*) AS rows_read, count(session_key) AS rows_sent, count(*) - count(session_key) AS rows_skipped,
    count(DISTINCT session_key) AS keys FROM tele"""),
)
def published_summary(spark, folder):
    out = _publish(spark, folder)
    return publish_summary(spark.read.parquet(out), skipped_rows(spark, out))


def _parts_text(parts):
    chars = lambda p: F.try_variant_get(F.try_parse_json(p["payload"]), "$.chars", "string")
    return F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["part"], p["sequence_number"].cast("string"), chars(p))), ",")


@query(
    "stream_assemble",
    with_views("env_d", then="""SELECT session_id, event_id, CASE WHEN notice AND urgent THEN 'priority' WHEN notice OR has_opening AND has_question THEN 'full'
    ELSE 'partial' END AS decision, part_count, parts,
    CASE WHEN notice THEN '' ELSE concat_ws(',', CASE WHEN NOT has_opening THEN 'opening' END, CASE WHEN NOT has_question THEN 'question' END) END
    AS missing FROM (SELECT session_id, event_id, notice, bool_or(conv_id % 5 = 0) AS urgent, bool_or(part = 'opening') AS has_opening, bool_or(part = 'question') AS has_question,
      count(*) FILTER (NOT is_duplicate) AS part_count, min(received_ms) AS first_ms,
      string_agg(part || ':' || seq || ':' || chars, ',' ORDER BY seq) FILTER (NOT is_duplicate) AS parts FROM env_d GROUP BY session_id, event_id, notice)
    WHERE notice OR (has_opening AND has_question) OR first_ms + 43200000 <= (SELECT max(received_ms) FROM env WHERE mapped) - 3600000"""),
)
def assemble_stream(spark, folder):
    inbox, out = new_path(spark, "envelopes"), new_path(spark, "flushes")
    envelopes = t.envelopes(spark, folder)
    envelopes.write.parquet(inbox)
    flushed = stream_assemble(spark.readStream.schema(envelopes.schema).parquet(inbox), LIFECYCLES)
    flushed.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "assembly-checkpoint")).outputMode(
        "append"
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(flushed.schema).parquet(out).select(
        "session_id", "event_id", "decision", "part_count", _parts_text(F.col("parts")).alias("parts"), F.array_join("missing_parts", ",").alias("missing")
    )
