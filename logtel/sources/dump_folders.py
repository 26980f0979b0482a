"""Debug-dump run folders: many runs at once, one folder each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtel.functions import variants as v
from logtel.functions.payloads import doc_fields, message_label, view_ref
from logtel.functions.scalars import iso_ms, source_seq
from logtel.operators.layout import exchanged, without
from logtel.session import written
from logtel.sources.files import DUPLICATE_KEYS, read_documents

# Artifact names of a run folder, compared without case.
MESSAGES, FLUSH = "00-messages.json", "02-flush.json"
COMPOSED, COMPOSED_NAME = "01-composed/", "01-composed"
META, GROUPS, FINAL = "run-meta.json", "01-session-groups.json", "03-final-messages.json"
KNOWN_VERSION = 1
UNKNOWN_SESSION = "unknown-session"


def _message_columns(item: Column) -> list[Column]:
    record = v.member(item, "$.record")
    payload = v.member(record, "$.payload")
    view = view_ref(payload)
    return [
        v.number(item, "$.sequenceNumber").cast("bigint").alias("seq"),
        v.text(item, "$.partitionId").alias("partition_id"),
        v.text(item, "$.status").alias("status"),
        F.coalesce(v.text(record, "$.sessionId"), F.lit(UNKNOWN_SESSION)).alias("session_id"),
        message_label(record).alias("label"),
        v.text(record, "$.eventType").alias("event_type"),
        iso_ms(v.text(record, "$.timestampUtc")).alias("timestamp_ms"),
        iso_ms(v.text(item, "$.enqueuedTimeUtc")).alias("enqueued_ms"),
        view["id"].alias("view_id"),
        view["instance_id"].alias("view_instance_id"),
        payload.alias("payload"),
    ]


def parse_dump_runs(documents: DataFrame) -> dict[str, DataFrame]:
    """Tables of the run folders found in (file, text), each keyed by ``run_id``, the folder.

    A folder with a missing required artifact, or any broken one, is reported in
    ``errors`` and left out of the rest.
    """
    documents.sparkSession.conf.set(DUPLICATE_KEYS, "true")
    key = F.lower(F.regexp_replace("file", r"\\", "/"))
    composed = key.contains(COMPOSED) & key.endswith(".json")
    artifact = F.when(composed, COMPOSED_NAME)
    for name in (MESSAGES, FLUSH, META, GROUPS, FINAL):
        artifact = artifact.when(key.endswith(name), name)
    in_folder = F.when(composed, F.regexp_extract("file", r"(?i)^(.*?)/?01-composed/", 1)).otherwise(
        F.regexp_replace("file", r"/?[^/]*$", "")
    )
    named = documents.select("file", in_folder.alias("run_id"), artifact.alias("artifact"), "text")
    # each document is parsed once; the tables are filters over this one
    docs = written(v.with_parsed(named.filter(F.col("artifact").isNotNull()), "text", "root").drop("text"), "dump-documents")
    root, item = F.col("root"), F.col("item")

    def has(name: str) -> Column:
        return F.bool_or(F.col("artifact") == name)

    def missing(name: str, what: str) -> Column:
        return F.when(~has(name), F.struct(F.lit(name).alias("artifact"), F.lit(what).alias("message")))

    broken = F.min_by(F.struct("artifact", "file"), F.when(root.isNull(), F.struct("artifact", "file")))
    invalid = F.when(
        broken.isNotNull(),
        F.struct(broken["artifact"].alias("artifact"), F.concat(broken["artifact"], F.lit(" cannot be parsed as JSON")).alias("message")),
    )
    checked = docs.groupBy("run_id").agg(
        F.coalesce(
            missing(MESSAGES, f"the folder lacks {MESSAGES}"),
            missing(COMPOSED_NAME, f"no JSON file below {COMPOSED}"),
            missing(FLUSH, f"the folder lacks {FLUSH}"),
            invalid,
        ).alias("e")
    )
    errors = written(checked.filter(F.col("e").isNotNull()).select("run_id", "e.artifact", "e.message"), "dump-errors")
    good = without(docs, errors, ["run_id"])

    def of(name: str) -> DataFrame:
        return good.filter(F.col("artifact") == name)

    def exploded(name: str, path: str) -> DataFrame:
        return of(name).select("run_id", F.posexplode(v.items(root, path)).alias("position", "item"))

    listed = exploded(MESSAGES, "$.messages")
    messages = listed.select("run_id", *_message_columns(item))
    session = v.text(root, "$.sessionId")
    events = of(COMPOSED_NAME).select(
        "run_id", session.alias("session_id"), F.posexplode(v.items(root, "$.events")).alias("position", "item")
    )
    occurrence_id = F.concat("session_id", F.lit(":"), F.col("position").cast("string"))
    fields = doc_fields(v.member(item, "$.document"))
    occurrences = events.select(
        "run_id",
        "session_id",
        "position",
        occurrence_id.alias("occurrence_id"),
        v.text(item, "$.kind").alias("kind"),
        v.text(item, "$.lastActivityUtc").alias("last_activity"),
        fields.alias("fields"),
    ).select("*", "fields.*").drop("fields")
    refs = events.select("run_id", occurrence_id.alias("occurrence_id"), F.explode(v.items(item, "$.sources")).alias("ref"))
    sources = refs.select("run_id", "occurrence_id", source_seq(F.try_variant_get("ref", "$", "string")).alias("seq"))

    def whole(path: str) -> Column:
        return v.number(root, path).cast("bigint")

    flush = of(FLUSH).select(
        "run_id",
        whole("$.summary.eventsWritten").alias("events_written"),
        whole("$.summary.eventsFailed").alias("events_failed"),
        whole("$.summary.acknowledged").alias("acknowledged"),
        whole("$.summary.messagesMarkedDone").alias("messages_marked_done"),
        whole("$.summary.checkpointSequenceNumber").alias("checkpoint_seq"),
    )
    marked = exploded(FLUSH, "$.markedDone.messages").select(
        "run_id", v.number(item, "$.sequenceNumber").cast("bigint").alias("seq")
    )
    first = listed.filter("position = 0").select("run_id", v.text(item, "$.partitionId").alias("_first"))
    runs = of(MESSAGES).select("run_id").distinct()
    recorded = of(META).select(
        "run_id",
        v.text(root, "$.partitionId").alias("_partition"),
        F.coalesce(v.number(root, "$.dumpSchemaVersion") == KNOWN_VERSION, F.lit(False)).alias("_known"),
        whole("$.startingCheckpoint").alias("starting_checkpoint"),
        whole("$.finalCheckpoint").alias("final_checkpoint"),
        whole("$.sequenceRange.min").alias("range_min"),
        whole("$.sequenceRange.max").alias("range_max"),
    )
    meta = runs.join(exchanged(recorded), "run_id", "left").join(exchanged(first), "run_id", "left").select(
        "run_id",
        F.coalesce("_partition", "_first", F.lit("unknown")).alias("partition_id"),
        F.coalesce("_known", F.lit(False)).alias("enhanced"),
        "starting_checkpoint",
        "final_checkpoint",
        "range_min",
        "range_max",
    )
    groups = of(GROUPS).select("run_id", F.explode(v.items(root, "$.groups")).alias("item"))
    members = groups.select(
        "run_id", v.text(item, "$.sessionId").alias("session_id"), F.explode(v.items(item, "$.memberSequences")).alias("m")
    ).select("run_id", "session_id", v.number(F.col("m")).cast("bigint").alias("seq"))
    final = exploded(FINAL, "$.messages").select(
        "run_id",
        "position",
        v.number(item, "$.sequenceNumber").cast("bigint").alias("seq"),
        v.text(item, "$.status").alias("status"),
        v.text(item, "$.disposition").alias("disposition"),
    )
    return {
        "messages": messages,
        "occurrences": occurrences,
        "sources": sources.filter(F.col("seq").isNotNull()),
        "flush": flush,
        "marked_done": marked,
        "meta": meta,
        "session_groups": members,
        "final_messages": final,
        "errors": errors,
    }


def read_dump_runs(spark: SparkSession, path: str | Sequence[str], packed: bool = False) -> dict[str, DataFrame]:
    return parse_dump_runs(read_documents(spark, path, "*.[jJ][sS][oO][nN]", packed))
