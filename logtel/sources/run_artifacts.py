"""Benchmark run artifacts (one JSON document each) and live iteration logs (JSON lines)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtel.functions import variants as v
from logtel.functions.scalars import coerce_comparable, is_text, iso_ms
from logtel.operators.layout import exchanged
from logtel.operators.runs import summarize_iterations
from logtel.session import written
from logtel.sources import checks
from logtel.sources.files import DUPLICATE_KEYS, read_documents
from logtel.sources.lines import lines_of_documents, read_numbered_lines

# Member names of the artifact format and the columns they become.
TIMINGS = {
    "leaseAcquire": "lease_acquire",
    "pollKusto": "poll_source",
    "messageStoreSetup": "store_setup",
    "rehydrateMessageState": "rehydrate_state",
    "duplicateSourceRows": "duplicate_rows",
    "processMessagesToEvents": "process_events",
    "flush": "flush",
    "advanceCheckpoint": "advance_checkpoint",
    "total": "total_ms",
}
READ_TIMINGS = {
    "queryBuild": "query_build",
    "executeToFirstRow": "first_row",
    "streamRows": "stream_rows",
    "mapRows": "map_rows",
}
COUNTS = {
    "rowsFetched": "rows_fetched",
    "messagesProcessed": "messages_processed",
    "eventsFinalized": "events_finalized",
    "flushDocuments": "flush_documents",
    "fullFlushes": "full_flushes",
    "partialFlushes": "partial_flushes",
    "checkpointAdvancements": "checkpoint_advancements",
    "blockedMessages": "blocked_messages",
    "backlogMessages": "backlog_messages",
}
MEMORY = {"managedBytes": "managed_bytes", "workingSetBytes": "working_set_bytes", "gcHeapBytes": "gc_heap_bytes"}
STATUSES = {
    "pending": "pending",
    "done": "done",
    "skipped": "skipped",
    "duplicateAcknowledged": "duplicate_acknowledged",
    "poisoned": "poisoned",
}
EVENT_KINDS = ("read", "rehydrate", "process", "flush", "checkpoint", "blocked", "duplicate")
SUMMARY_NUMBERS = {
    "iterationCount": "iteration_count",
    "rowsFetched": "rows_fetched",
    "messagesProcessed": "messages_processed",
    "eventsFinalized": "events_finalized",
    "flushDocuments": "flush_documents",
    "fullFlushes": "full_flushes",
    "partialFlushes": "partial_flushes",
    "checkpointAdvancements": "checkpoint_advancements",
    "durationMs": "duration_ms",
    "throughputEventsPerSecond": "events_per_sec",
}
SUMMARY_TAIL = {
    "averageBacklogMessages": "avg_backlog",
    "maxBacklogMessages": "max_backlog",
    "blockedDurationMs": "blocked_ms",
}
RUN_TEXTS = ("runId", "label", "source", "startedAtUtc", "completedAtUtc", "clientId")
MANIFEST_NAME = "kusto-benchmark-run.json"
SYNTHESIZED_SOURCE = "Kusto"


# What is read of each kind of object.
_SUMMARY = v.shape(**v.leaves(*SUMMARY_NUMBERS, *SUMMARY_TAIL), averageTimingsMs=v.shape(**v.leaves(*TIMINGS)))
_ITERATION = v.shape(
    **v.leaves("iterationId", "clientId", "shardId", "windowStartUtc", "windowEndUtc", "startedAtUtc", "completedAtUtc", "pipeline"),
    timingsMs=v.shape(**v.leaves(*TIMINGS), kustoRead=v.shape(**v.leaves(*READ_TIMINGS))),
    counts=v.shape(**v.leaves(*COUNTS)),
    memory=v.shape(**v.leaves(*MEMORY)),
    checkpoint=v.shape(**v.leaves("previous", "upper", "advancedTo", "blockedDurationMs")),
)
_MESSAGE = v.shape(**v.leaves("ordinal", "rowId", "sessionId", "enqueuedTimeUtc", "status", "skipReason"))
_EVENT = v.shape(**v.leaves("atUtc", "kind", "label", "messageCount", "watermarkUtc"))
_PIPELINE = v.shape(
    **v.leaves("snapshotAtUtc", "shardId", "windowStartUtc", "windowEndUtc", "currentTimeUtc", "watermarkUtc"),
    **v.leaves("candidateWatermarkUtc", "checkpointAdvancedToUtc"),
    **v.leaves("totalShardMessages", "currentWindowMessages", "backlogMessages", "blockedMessages"),
    statusCounts=v.shape(**v.leaves(*STATUSES)),
    messages=f"array<{_MESSAGE}>",
    events=f"array<{_EVENT}>",
)
_SAMPLE = v.shape(**v.leaves("timestampUtc", "iterationId", *MEMORY))
_LISTED_RUN = v.shape(**v.leaves("runId", "startedAtUtc", "completedAtUtc", "clientId", "iterationCount"), summary=_SUMMARY)
_ARTIFACT = v.shape(
    **v.leaves("schemaVersion", "label", "generatedAtUtc", "runCount"),
    run=v.shape(**v.leaves(*RUN_TEXTS, "clientCount", "partitionScope", "configuration")),
    iterations=f"array<{_ITERATION}>",
    memorySamples=f"array<{_SAMPLE}>",
    runs=f"array<{_LISTED_RUN}>",
    summary=_SUMMARY,
    averages=_SUMMARY,
)


def _numbers(root: Column, member: str, keys: Sequence[str], where: Column) -> list[Column]:
    inner, place = root[member], checks.at(where, member)
    return [checks.an_object(inner, place), checks.numbers(inner, keys, place)]


def _message_error(message: Column, where: Column) -> Column:
    return F.coalesce(
        checks.an_object(message, where),
        checks.number(message, "ordinal", where),
        checks.text(message, "rowId", where, nullable=True),
        checks.text(message, "sessionId", where, nullable=True),
        checks.text(message, "enqueuedTimeUtc", where),
        checks.one_of(message, "status", where, tuple(STATUSES)),
        checks.text(message, "skipReason", where, nullable=True, optional=True),
    )


def _event_error(event: Column, where: Column) -> Column:
    return F.coalesce(
        checks.an_object(event, where),
        checks.text(event, "atUtc", where),
        checks.one_of(event, "kind", where, EVENT_KINDS),
        checks.text(event, "label", where),
        checks.number(event, "messageCount", where, optional=True),
        checks.text(event, "watermarkUtc", where, nullable=True, optional=True),
    )


def _pipeline_error(root: Column, where: Column) -> Column:
    place = checks.at(where, "pipeline")
    nullable = ("watermarkUtc", "candidateWatermarkUtc", "checkpointAdvancedToUtc")
    found = lambda inner: F.coalesce(
        checks.an_object(inner, place),
        checks.texts(inner, ("snapshotAtUtc", "shardId"), place),
        checks.texts(inner, ("windowStartUtc", "windowEndUtc"), place, nullable=True),
        checks.text(inner, "currentTimeUtc", place),
        checks.texts(inner, nullable, place, nullable=True),
        checks.numbers(
            inner, ("totalShardMessages", "currentWindowMessages", "backlogMessages", "blockedMessages"), place
        ),
        *_numbers(inner, "statusCounts", tuple(STATUSES), place),
        checks.an_array(inner["messages"], checks.at(place, "messages")),
        checks.each(inner["messages"], _message_error, checks.at(place, "messages")),
        checks.an_array(inner["events"], checks.at(place, "events")),
        checks.each(inner["events"], _event_error, checks.at(place, "events")),
    )
    return F.when(root["pipeline"].isNotNull(), v.bound(v.shaped(root["pipeline"], _PIPELINE), found))


def iteration_error(root: Column, where: Column) -> Column:
    """First thing wrong with one iteration, as ``_ITERATION`` shapes it; NULL when it is good."""
    checkpoint = root["checkpoint"]
    return F.coalesce(
        checks.an_object(root, where),
        checks.texts(root, ("iterationId", "clientId", "shardId"), where),
        checks.texts(root, ("windowStartUtc", "windowEndUtc"), where, nullable=True),
        checks.texts(root, ("startedAtUtc", "completedAtUtc"), where),
        *_numbers(root, "timingsMs", tuple(TIMINGS), where),
        *_numbers(root, "counts", tuple(COUNTS), where),
        *_numbers(root, "memory", tuple(MEMORY), where),
        checks.an_object(checkpoint, checks.at(where, "checkpoint")),
        checks.number(checkpoint, "blockedDurationMs", checks.at(where, "checkpoint")),
        _pipeline_error(root, where),
    )


def _pipeline(root: Column) -> Column:
    def moment(key: str, name: str) -> Column:
        return iso_ms(v.text(root[key])).alias(name)

    def amount(key: str, name: str) -> Column:
        return v.number(root[key]).alias(name)

    messages = F.transform(
        root["messages"],
        lambda m: F.struct(
            v.number(m["ordinal"]).alias("ordinal"),
            v.text(m["rowId"]).alias("row_id"),
            v.text(m["sessionId"]).alias("session_id"),
            iso_ms(v.text(m["enqueuedTimeUtc"])).alias("enqueued_ms"),
            v.text(m["status"]).alias("status"),
            v.text(m["skipReason"]).alias("skip_reason"),
        ),
    )
    events = F.transform(
        root["events"],
        lambda e: F.struct(
            iso_ms(v.text(e["atUtc"])).alias("at_ms"),
            v.text(e["kind"]).alias("kind"),
            v.text(e["label"]).alias("label"),
            v.number(e["messageCount"]).alias("message_count"),
            iso_ms(v.text(e["watermarkUtc"])).alias("watermark_ms"),
        ),
    )
    return F.when(
        root.isNotNull(),
        F.struct(
            moment("snapshotAtUtc", "observed_ms"),
            moment("currentTimeUtc", "current_ms"),
            moment("windowStartUtc", "window_start_ms"),
            moment("windowEndUtc", "window_end_ms"),
            moment("watermarkUtc", "watermark_ms"),
            moment("candidateWatermarkUtc", "candidate_watermark_ms"),
            v.text(root["checkpointAdvancedToUtc"]).isNotNull().alias("has_checkpoint"),
            moment("checkpointAdvancedToUtc", "checkpoint_ms"),
            amount("totalShardMessages", "total_shard_messages"),
            amount("currentWindowMessages", "window_messages"),
            amount("backlogMessages", "backlog_messages"),
            amount("blockedMessages", "blocked_messages"),
            *[v.number(root["statusCounts"][key]).alias(name) for key, name in STATUSES.items()],
            messages.alias("messages"),
            events.alias("events"),
        ),
    )


def iteration_columns(root: Column) -> list[Column]:
    """The columns of one (valid) iteration, as ``_ITERATION`` shapes it."""

    def texts(**names: str) -> list[Column]:
        return [v.text(root[key]).alias(name) for name, key in names.items()]

    def numbers(inner: Column, names: dict[str, str]) -> list[Column]:
        return [v.number(inner[key]).alias(name) for key, name in names.items()]

    def moment(key: str) -> Column:
        return iso_ms(v.text(root[key]))

    def mark(key: str) -> Column:
        return coerce_comparable(root["checkpoint"][key])

    return [
        *texts(iteration_id="iterationId", client_id="clientId", shard_id="shardId"),
        *texts(started_utc="startedAtUtc", completed_utc="completedAtUtc"),
        moment("startedAtUtc").alias("started_ms"),
        moment("completedAtUtc").alias("completed_ms"),
        moment("windowStartUtc").alias("window_start_ms"),
        moment("windowEndUtc").alias("window_end_ms"),
        *numbers(root["timingsMs"], TIMINGS),
        *numbers(root["timingsMs"]["kustoRead"], READ_TIMINGS),
        *numbers(root["counts"], COUNTS),
        *numbers(root["memory"], MEMORY),
        mark("previous").alias("previous"),
        mark("upper").alias("upper"),
        mark("advancedTo").alias("advanced_to"),
        iso_ms(v.text(root["checkpoint"]["advancedTo"])).alias("advanced_to_ms"),
        v.number(root["checkpoint"]["blockedDurationMs"]).alias("blocked_ms"),
        v.bound(v.shaped(root["pipeline"], _PIPELINE), _pipeline).alias("pipeline"),
    ]


def _summary_error(root: Column, member: str, where: Column) -> Column:
    inner, place = root[member], checks.at(where, member)
    return F.coalesce(
        checks.an_object(inner, place),
        checks.numbers(inner, tuple(SUMMARY_NUMBERS), place),
        *_numbers(inner, "averageTimingsMs", tuple(TIMINGS), place),
        checks.numbers(inner, tuple(SUMMARY_TAIL), place),
    )


def _summary_columns(root: Column, member: str) -> list[Column]:
    return [
        *[v.number(root[member][key]).alias(name) for key, name in (SUMMARY_NUMBERS | SUMMARY_TAIL).items()],
        v.number(root[member]["averageTimingsMs"]["total"]).alias("avg_total_ms"),
    ]


def parse_run_artifacts(documents: DataFrame) -> dict[str, DataFrame]:
    """Runs, iterations, memory samples, summaries and errors of artifact documents (file, text).

    A document counts as a whole: its first error, in document order, leaves it
    out of every other result.
    """
    documents.sparkSession.conf.set(DUPLICATE_KEYS, "true")
    root, doc, where = F.col("root"), F.col("doc"), F.lit("artifact")
    docs = v.with_parsed(documents.select("file", "text"), "text", "root").drop("text")
    docs = v.with_value(docs, v.shaped(root, _ARTIFACT), "doc")
    is_run = doc["run"].isNotNull()
    is_summary = doc["averages"].isNotNull() & doc["runs"].isNotNull()
    version = F.when(
        ~F.coalesce(v.number(doc["schemaVersion"]) == 1, F.lit(False)),
        F.lit("schemaVersion is not 1, the only one this reader knows."),
    )
    run, run_at = doc["run"], checks.at(where, "run")
    run_head = F.coalesce(
        version,
        checks.texts(run, RUN_TEXTS, run_at),
        checks.number(run, "clientCount", run_at),
        checks.text(run, "partitionScope", run_at),
        checks.an_object(v.shaped(run["configuration"], "struct<>"), checks.at(run_at, "configuration")),
        checks.an_array(doc["iterations"], checks.at(where, "iterations")),
    )
    summary_head = F.coalesce(
        version,
        checks.text(doc, "label", where),
        checks.text(doc, "generatedAtUtc", where),
        checks.number(doc, "runCount", where),
    )
    other = F.lit("Neither a run nor a summary of runs.")
    kind = F.when(is_run, "run").when(is_summary, "summary")
    head = (
        F.when(root.isNull(), F.lit("invalid JSON."))
        .when(doc.isNull(), F.lit("artifact must be an object."))
        .when(is_run, run_head)
        .when(is_summary, summary_head)
        .otherwise(other)
    )

    def sample_error(item: Column, at: Column) -> Column:
        return F.coalesce(
            checks.an_object(item, at),
            checks.text(item, "timestampUtc", at),
            checks.text(item, "iterationId", at),
            checks.numbers(item, tuple(MEMORY), at),
        )

    def listed_run_error(item: Column, at: Column) -> Column:
        return F.coalesce(
            checks.an_object(item, at),
            checks.texts(item, ("runId", "startedAtUtc", "completedAtUtc", "clientId"), at),
            checks.number(item, "iterationCount", at),
            _summary_error(item, "summary", at),
        )

    def each(member: str, check) -> Column:
        return checks.each(doc[member], check, checks.at(where, member))

    no_samples = checks.an_array(doc["memorySamples"], F.lit("artifact.memorySamples"))
    run_body = F.coalesce(each("iterations", iteration_error), no_samples, each("memorySamples", sample_error), _summary_error(doc, "summary", where))
    summary_body = F.coalesce(each("runs", listed_run_error), _summary_error(doc, "averages", where))
    message = F.coalesce(head, F.when(kind == "run", run_body).when(kind == "summary", summary_body))
    # each document is parsed and checked once; the tables are filters over this one
    tagged = docs.select("file", kind.alias("kind"), message.alias("message"), "root")
    tagged = written(tagged.withColumn("root", F.when(F.col("message").isNull(), root)), "artifacts")
    good = tagged.filter("message IS NULL")

    def of_kind(name: str) -> DataFrame:
        return v.with_value(good.filter(F.col("kind") == name), v.shaped(root, _ARTIFACT), "doc")

    run_docs, summary_docs = of_kind("run"), of_kind("summary")
    run_id = v.text(doc["run"]["runId"]).alias("run_id")

    def exploded(member: str) -> DataFrame:
        return run_docs.select("file", run_id, F.posexplode(doc[member]).alias("position", "item"))

    item = F.col("item")
    runs = run_docs.select(
        "file",
        run_id,
        v.text(doc["run"]["label"]).alias("label"),
        v.text(doc["run"]["source"]).alias("source"),
        v.text(doc["run"]["startedAtUtc"]).alias("started_utc"),
        v.text(doc["run"]["completedAtUtc"]).alias("completed_utc"),
        iso_ms(v.text(doc["run"]["startedAtUtc"])).alias("started_ms"),
        iso_ms(v.text(doc["run"]["completedAtUtc"])).alias("completed_ms"),
        v.text(doc["run"]["clientId"]).alias("client_id"),
        v.number(doc["run"]["clientCount"]).alias("client_count"),
        v.text(doc["run"]["partitionScope"]).alias("partition_scope"),
        doc["run"]["configuration"].alias("configuration"),
        *_summary_columns(doc, "summary"),
    )
    arrival = F.col("position").cast("bigint").alias("arrival")
    return {
        "runs": runs,
        "iterations": exploded("iterations").select("file", "run_id", arrival, *iteration_columns(item)),
        "memory_samples": exploded("memorySamples").select(
            "file",
            "run_id",
            v.text(item["iterationId"]).alias("iteration_id"),
            iso_ms(v.text(item["timestampUtc"])).alias("at_ms"),
            *[v.number(item[key]).alias(name) for key, name in MEMORY.items()],
        ),
        "summaries": summary_docs.select(
            "file",
            v.text(doc["label"]).alias("label"),
            v.number(doc["runCount"]).alias("run_count"),
            *_summary_columns(doc, "averages"),
        ),
        "errors": tagged.filter("message IS NOT NULL").select("file", "message"),
    }


def read_run_artifacts(spark: SparkSession, path: str | Sequence[str], packed: bool = False) -> dict[str, DataFrame]:
    return parse_run_artifacts(read_documents(spark, path, packed=packed))


def parse_iteration_lines(lines: DataFrame, latest_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(iterations, errors) of numbered JSON lines; ``latest_only`` looks at each file's last line only."""
    lines.sparkSession.conf.set(DUPLICATE_KEYS, "true")
    used = lines.filter(is_text(F.col("value")))
    where = F.concat(F.lit("line "), F.col("line").cast("string"))
    broken = F.concat(where, F.lit(": invalid JSON."))
    if latest_only:
        used = used.groupBy("file").agg(F.max("line").alias("line"), F.max_by("value", "line").alias("value"))
        where, broken = F.lit("line"), F.lit("invalid JSON.")
    root, item = F.col("root"), F.col("item")
    parsed = v.with_parsed(used.select("file", "line", "value"), "value", "root").drop("value")
    message = F.when(root.isNull(), broken).otherwise(iteration_error(item, where))
    checked = v.with_value(parsed, v.shaped(root, _ITERATION), "item").withColumn("message", message).drop("item")
    tagged = written(checked, "iteration-lines")
    good = v.with_value(tagged.filter(F.col("message").isNull()), v.shaped(root, _ITERATION), "item")
    return (
        good.select("file", F.col("line").alias("arrival"), *iteration_columns(item)),
        tagged.filter(F.col("message").isNotNull()).select("file", "line", "message"),
    )


def read_iterations_jsonl(
    spark: SparkSession, path: str | Sequence[str], latest_only: bool = False, packed: bool = False
) -> tuple[DataFrame, DataFrame]:
    lines = lines_of_documents(read_documents(spark, path, "*", packed)) if packed else read_numbered_lines(spark, path)
    return parse_iteration_lines(lines, latest_only)


# --- run folders ----------------------------------------------------------------------------


def _folder(c: Column) -> Column:
    return F.regexp_replace(c, r"/?[^/]*$", "")


def run_folder(file: Column) -> Column:
    """The run directory of a file: the part before its last ``/iterations``, else its folder."""
    folder = _folder(file)
    before = F.regexp_extract(folder, r"^(.*)/iterations", 1)
    return F.when(folder.contains("/iterations"), before).otherwise(folder)


def _base(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)/?$", 1)


def resolve_run_folders(runs: DataFrame, latest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, iterations) of folders that hold a manifest, live iteration files, or both.

    ``latest`` are the last iterations of the live files. A manifest beside live
    files takes their iterations and completion; an artifact without iterations
    adopts those of its folder; live files without a manifest give a run of
    their own. Runs carry ``origin``.
    """
    keyed = latest.withColumn("run_dir", run_folder(F.col("file")))
    live = keyed.groupBy("run_dir", "iteration_id").agg(
        F.max_by(F.struct(*[c for c in latest.columns if c != "iteration_id"]), F.struct("file", "arrival")).alias("_i")
    ).select("run_dir", "iteration_id", "_i.*")
    order = F.struct("started_utc", "iteration_id")
    folders = live.groupBy("run_dir").agg(
        F.min_by(F.struct("iteration_id", "shard_id", "client_id", "started_utc"), order).alias("_first"),
        F.max_by("completed_utc", order).alias("_completed"),
        F.count(F.lit(1)).alias("_live"),
        F.count_distinct("shard_id").alias("_shards"),
    )
    totals = summarize_iterations(live, by=("run_dir",))
    listed = runs.withColumn("run_dir", _folder(F.col("file")))
    both = listed.join(folders, "run_dir", "full_outer")

    first = F.col("_first")
    marker = F.concat(F.lit("-"), first["shard_id"], F.lit("-"))
    place = F.call_function("locate", marker, first["iteration_id"])
    base = _base(F.col("run_dir"))
    named = F.when((base != "") & (base != "iterations"), base).otherwise("jsonl-iterations")
    inferred = F.when(place > 1, F.call_function("substring", first["iteration_id"], F.lit(1), place - 1)).otherwise(named)
    parent = _base(_folder(F.col("run_dir")))
    label = F.when(base == "iterations", inferred).otherwise(
        F.coalesce(F.nullif(parent, F.lit("")), F.nullif(base, F.lit("")), inferred)
    )
    lonely = F.col("file").isNull()
    is_manifest = F.lower(_base(F.col("file"))) == MANIFEST_NAME
    has_live = F.col("_live").isNotNull()
    empty = F.coalesce(F.col("iteration_count"), F.lit(0)) == 0
    takes_live = lonely | (has_live & (is_manifest | empty))
    recounts = lonely | (has_live & is_manifest)
    scope = F.concat(F.col("_shards").cast("string"), F.lit(" shard(s)"))
    resolved = both.select(
        "run_dir",
        F.when(lonely, inferred).otherwise(F.col("run_id")).alias("run_id"),
        F.when(lonely, label).otherwise(F.col("label")).alias("label"),
        F.when(lonely, SYNTHESIZED_SOURCE).otherwise(F.col("source")).alias("source"),
        F.when(lonely, first["started_utc"]).otherwise(F.col("started_utc")).alias("started_utc"),
        F.when(recounts, F.col("_completed")).otherwise(F.col("completed_utc")).alias("completed_utc"),
        F.when(lonely, first["client_id"]).otherwise(F.col("client_id")).alias("client_id"),
        F.when(lonely, F.lit(1.0)).otherwise(F.col("client_count")).alias("client_count"),
        F.when(lonely, scope).otherwise(F.col("partition_scope")).alias("partition_scope"),
        F.when(lonely, "synthesized").when(takes_live & is_manifest, "manifest").otherwise("artifact").alias("origin"),
        takes_live.alias("_takes_live"),
        recounts.alias("_recounts"),
        *[F.col(c).alias(f"_own_{c}") for c in ("iteration_count", "rows_fetched", "events_finalized", "duration_ms", "events_per_sec")],
    )
    counted = totals.select(
        "run_dir",
        *[F.col(c).cast("double").alias(f"_live_{c}") for c in ("iteration_count", "rows_fetched", "events_finalized", "duration_ms", "events_per_sec")],
    )
    summed = resolved.join(exchanged(counted), "run_dir", "left")
    figures = [
        F.when(F.col("_recounts"), F.col(f"_live_{c}")).otherwise(F.col(f"_own_{c}")).alias(c)
        for c in ("iteration_count", "rows_fetched", "events_finalized", "duration_ms", "events_per_sec")
    ]
    runs_out = summed.select(*resolved.columns[:10], *figures)
    adopted = live.join(exchanged(resolved.filter("_takes_live").select("run_dir", "run_id")), "run_dir")
    return runs_out, adopted
