"""Queries that read files or JSON documents which Spark first derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from logtel.functions import variants as v
from logtel.operators import polls, runs
from logtel.operators.layout import exchanged
from logtel.operators.messages import utc_text
from logtel.plans import tables as t
from logtel.plans.registry import query
from logtel.plans.views import MS, with_views
from logtel.session import cut, new_path, written
from logtel.sources import dump_folders, files, lines, poll_lines, rows, run_artifacts

def _text(c):
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# --- rows and lines -------------------------------------------------------------------------


@query(
    "read_row_export",
    """SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 50 <> 0 THEN 's' || user_id END AS "sessionId",
    CASE WHEN event_id % 3 = 0 THEN event_type || chr(10) || '"' || props || '",' || chr(10) || 'end' ELSE props END AS note FROM events""",
)
def read_row_export(spark, folder):
    broken = F.concat("event_type", F.lit('\n"'), "props", F.lit('",\nend'))
    export = t.load(spark, folder, "events").select(
        _text("event_id").alias("id"),
        t.every(50, "event_id", F.concat(F.lit("s"), _text("user_id"))).alias("sessionId"),
        F.when(F.col("event_id") % 3 == 0, broken).otherwise(F.col("props")).alias("note"),
    )
    path = new_path(spark, "row-export")
    export.write.option("header", "true").option("escape", '"').csv(path)
    return rows.read_row_export(spark, path).select("id", "sessionId", "note")


LINES_PER_FILE = 1000


@query(
    "number_lines",
    f"""SELECT event_id, event_id % {LINES_PER_FILE} + 1 AS line FROM events WHERE event_id % 10 <> 0""",
)
def number_lines(spark, folder):
    text = F.when(F.col("event_id") % 10 == 0, "").otherwise(_text("event_id"))
    part = F.floor(F.col("event_id") / LINES_PER_FILE).alias("part")
    path = new_path(spark, "lines")
    wide = t.load(spark, folder, "events").select(text.alias("value"), part, "event_id")
    wide.repartition("part").sortWithinPartitions("part", "event_id").drop("event_id").write.partitionBy("part").text(path)
    numbered = lines.read_numbered_lines(spark, path)
    return numbered.filter("value <> ''").select(F.col("value").cast("bigint").alias("event_id"), "line")


CHUNK_CHARS = 97


def cut_texts(spark, folder):
    """Document texts cut every so many characters, wherever that falls."""
    docs = t.load(spark, folder, "documents")
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK_CHARS}}}"), 0)
    placed = docs.filter("length(text) > 0").select(_text("doc_id").alias("stream"), F.posexplode(pieces).alias("i", "text"))
    return placed.select("stream", F.col("i").cast("bigint").alias("chunk"), "text")


def chunks(spark, folder):
    """Document texts stored as a log of chunks in many files."""
    return written(cut_texts(spark, folder).repartition("stream", "chunk"), "chunks")


_DOC_LINES = """SELECT stream, line, md5(value) AS digest FROM (SELECT CAST(doc_id AS VARCHAR) AS stream,
    unnest(range(1, len(parts) + 1)) AS line, rtrim_cr(unnest(parts)) AS value, len(parts) AS n
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE length(text) > 0)) WHERE line < n OR length(value) > 0"""
DOC_LINES = _DOC_LINES.replace("rtrim_cr(unnest(parts))", "regexp_replace(unnest(parts), chr(13) || '$', '')")


@query("reassemble_lines", DOC_LINES)
def reassemble_lines(spark, folder):
    whole = lines.reassemble_lines(chunks(spark, folder))
    return whole.select("stream", "line", F.md5("value").alias("digest"))


# --- poll lines -----------------------------------------------------------------------------


def poll_text(spark, folder):
    """One log line per event: cycles, stage events, and broken or unknown ones among them."""
    c = t.cycles(spark, folder, t.load_spread)
    at = lambda name: utc_text(F.col(name))
    entries = F.col("timeline").cast("array<struct<stage:string,startMs:double,durMs:double>>")  # by place
    optional = [F.col(name).alias(key) for key, name in poll_lines.OPTIONAL_NUMBERS.items()]
    cycle = F.struct(
        F.lit("cycle").alias("type"), at("completed_ms").alias("ts"), F.concat(F.lit("r"), _text(F.floor(F.col("arrival") / 3))).alias("runId"),
        "source", "outcome", at("started_ms").alias("startedAtUtc"), at("completed_ms").alias("completedAtUtc"),
        F.col("total_ms").alias("totalMs"), F.when(F.col("arrival") % 43 != 0, F.col("records")).alias("records"),
        F.col("records_per_sec").alias("recordsPerSec"), entries.alias("timeline"), *optional, F.col("input_rows").alias("inputRows"),
        at("window_start_ms").alias("windowStartUtc"), at("window_end_ms").alias("windowEndUtc"),
    )
    stage = F.struct(
        F.when(F.col("arrival") % 41 == 0, "other").otherwise("stage").alias("type"), at("started_ms").alias("ts"),
        F.concat(F.lit("r"), _text(F.floor(F.col("arrival") / 3))).alias("runId"), F.lit("seal").alias("stage"),
        F.when(F.col("arrival") % 2 == 0, "start").otherwise("end").alias("ev"), (F.col("arrival") % 50).cast("double").alias("atMs"),
        F.when(F.col("arrival") % 2 == 1, F.col("arrival") % 7).cast("double").alias("durMs"),
    )
    value = F.when(F.col("outcome") == "success", F.to_json(cycle)).otherwise(F.to_json(stage))
    broken = F.when(F.col("arrival") % 37 == 0, F.concat(F.lit("{"), value)).otherwise(value)
    made = v.with_value(c.withColumn("_line", F.col("arrival") + 1), broken, "value")
    return made.select(F.lit("log").alias("file"), F.col("_line").alias("line"), "value", "arrival")


def _parsed(spark, folder):
    return poll_lines.parse_poll_lines(poll_text(spark, folder).drop("arrival"))


POLL_CYCLES = "outcome = 'success' AND arrival % 37 <> 0 AND arrival % 43 <> 0"


@query(
    "read_poll_cycles",
    with_views("cyc", then=f"""SELECT 'r' || (arrival // 3) AS run_id, source, outcome, started_ms, completed_ms, total_ms, records,
    users, round(query_ms, 6) AS query_ms, input_rows, store_failed, window_start_ms, window_end_ms, arrival + 1 AS line,
    CASE WHEN arrival % 6 = 0 THEN 3 ELSE 4 END AS spans FROM cyc WHERE {POLL_CYCLES}"""),
)
def read_poll_cycles(spark, folder):
    _, cycles, _ = _parsed(spark, folder)
    return cycles.select(
        "run_id", "source", "outcome", "started_ms", "completed_ms", "total_ms", "records", "users", F.round("query_ms", 6).alias("query_ms"),
        "input_rows", "store_failed", "window_start_ms", "window_end_ms", F.col("arrival.line").alias("line"), F.size("timeline").alias("spans"),
    )


POLL_STAGES = "outcome <> 'success' AND arrival % 37 <> 0 AND arrival % 41 <> 0"


@query(
    "read_poll_stages",
    with_views("cyc", then=f"""SELECT 'r' || (arrival // 3) AS run_id, 'seal' AS stage, CASE WHEN arrival % 2 = 0 THEN 'start' ELSE 'end' END AS ev,
    CAST(arrival % 50 AS DOUBLE) AS at_ms, CASE WHEN arrival % 2 = 1 THEN CAST(arrival % 7 AS DOUBLE) END AS dur_ms, started_ms AS ts_ms,
    arrival + 1 AS line FROM cyc WHERE {POLL_STAGES}"""),
)
def read_poll_stages(spark, folder):
    stages, _, _ = _parsed(spark, folder)
    return stages.select("run_id", "stage", "ev", "at_ms", "dur_ms", "ts_ms", F.col("arrival.line").alias("line"))


_WARNINGS = f"""SELECT arrival + 1 AS line, 'line ' || (arrival + 1) || CASE WHEN arrival % 37 = 0 THEN ': invalid JSON.'
    WHEN outcome = 'success' THEN '.records must be a finite number.' ELSE ': unknown event type "other".' END AS message
    FROM cyc WHERE NOT ({POLL_CYCLES}) AND NOT ({POLL_STAGES})"""


@query("read_poll_warnings", with_views("cyc", then=_WARNINGS))
def read_poll_warnings(spark, folder):
    _, _, warnings = _parsed(spark, folder)
    return warnings.select("line", "message")


@query("recent_warnings", with_views("cyc", then=_WARNINGS + " ORDER BY line DESC LIMIT 5"))
def recent_warnings(spark, folder):
    _, _, warnings = _parsed(spark, folder)
    return polls.recent_warnings(warnings, 5).select("line", "message")


# --- run artifacts --------------------------------------------------------------------------


def _iteration_json(**more):
    """An iteration object built from a row of the iterations table, ``file`` and the rest aside."""
    c = F.col
    at = lambda name: utc_text(c(name))

    def group(names):
        return F.struct(*[c(column).alias(key) for key, column in names.items()])

    always = {"started": F.coalesce(at("started_ms"), F.lit("unknown")), "completed": F.coalesce(at("completed_ms"), F.lit("unknown"))}
    checkpoint = F.struct(
        c("previous").alias("previous"), F.format_number(c("upper"), 0).alias("upper"), utc_text(c("advanced_to").cast("bigint")).alias("advancedTo"),
        c("blocked_ms").alias("blockedDurationMs"),
    )
    timings = {k: n for k, n in run_artifacts.TIMINGS.items()}
    read = group(run_artifacts.READ_TIMINGS).alias("kustoRead")
    return F.struct(
        c("iteration_id").alias("iterationId"), c("client_id").alias("clientId"), c("shard_id").alias("shardId"),
        at("window_start_ms").alias("windowStartUtc"), at("window_end_ms").alias("windowEndUtc"),
        always["started"].alias("startedAtUtc"), always["completed"].alias("completedAtUtc"),
        F.struct(*[c(n).alias(k) for k, n in timings.items()], read).alias("timingsMs"),
        group(run_artifacts.COUNTS).alias("counts"), group(run_artifacts.MEMORY).alias("memory"), checkpoint.alias("checkpoint"),
    )


def _json(struct):
    return F.to_json(struct, {"ignoreNullFields": "false"})


def artifact_documents(spark, folder):
    """One document per order: runs of one iteration and one memory sample, summaries, and broken ones."""
    its = t.iterations(spark, folder, t.load_spread)
    k = F.col("arrival")
    timings = F.struct(*[F.col(n).alias(key) for key, n in run_artifacts.TIMINGS.items()])
    figures = [F.lit(1.0).alias(key) for key in (*run_artifacts.SUMMARY_NUMBERS, *run_artifacts.SUMMARY_TAIL)]
    summary = F.struct(*figures, timings.alias("averageTimingsMs"))
    run = F.struct(
        F.concat(F.lit("run"), _text(k)).alias("runId"), F.lit("label").alias("label"), F.lit("bench").alias("source"),
        utc_text(F.col("started_ms")).alias("startedAtUtc"), F.lit("2026-01-01T00:00:00Z").alias("completedAtUtc"), F.col("client_id").alias("clientId"),
        F.lit(1).alias("clientCount"), F.lit("all").alias("partitionScope"), F.struct(F.lit(1).alias("x")).alias("configuration"),
    )
    sample = F.struct(
        F.lit("2026-01-01T00:00:00Z").alias("timestampUtc"), F.col("iteration_id").alias("iterationId"),
        *[F.when((k % 17 != 0) | (F.lit(key) != "gcHeapBytes"), F.col(n)).alias(key) for key, n in run_artifacts.MEMORY.items()],
    )
    version = F.when(k % 31 == 0, 2).otherwise(1).alias("schemaVersion")
    as_run = F.struct(version, run.alias("run"), F.array(_iteration_json()).alias("iterations"), F.array(sample).alias("memorySamples"), summary.alias("summary"))
    as_summary = F.struct(
        version, F.concat(F.lit("sum"), _text(k)).alias("label"), F.lit("x").alias("generatedAtUtc"), (k % 4).alias("runCount"),
        F.array().cast("array<struct<runId:string>>").alias("runs"), summary.alias("averages"),
    )
    text = F.when(k % 29 == 0, "{broken").when(k % 10 == 0, _json(as_summary)).otherwise(_json(as_run))
    return v.with_value(its, text, "text").select(F.concat(F.lit("/art/"), _text(k), F.lit(".json")).alias("file"), "text")


_ART_ERROR = """CASE WHEN k % 29 = 0 THEN 'invalid JSON.' WHEN k % 31 = 0 THEN 'schemaVersion is not 1, the only one this reader knows.'
    WHEN k % 10 <> 0 AND started_ms IS NULL THEN 'artifact.run.startedAtUtc must be a non-empty string.'
    WHEN k % 10 <> 0 AND k % 17 = 0 THEN 'artifact.memorySamples[0].gcHeapBytes must be a finite number.' END"""


@query(
    "artifact_errors",
    with_views("iter", then=f"SELECT '/art/' || k || '.json' AS file, message FROM (SELECT k, {_ART_ERROR} AS message FROM iter) WHERE message IS NOT NULL"),
)
def artifact_errors(spark, folder):
    return run_artifacts.parse_run_artifacts(artifact_documents(spark, folder))["errors"]


@query(
    "artifact_iterations",
    with_views("iter", then=f"""SELECT 'run' || k AS run_id, iteration_id, shard_id, started_ms, completed_ms, window_start_ms, window_end_ms,
    total_ms, poll_source, map_rows, rows_fetched, backlog_messages, managed_bytes, previous, upper_ms AS upper, advanced_to, blocked_ms
    FROM iter WHERE k % 10 <> 0 AND {_ART_ERROR} IS NULL"""),
)
def artifact_iterations(spark, folder):
    return run_artifacts.parse_run_artifacts(artifact_documents(spark, folder))["iterations"].select(
        "run_id", "iteration_id", "shard_id", "started_ms", "completed_ms", "window_start_ms", "window_end_ms", "total_ms", "poll_source",
        "map_rows", "rows_fetched", "backlog_messages", "managed_bytes", "previous", "upper", "advanced_to", "blocked_ms",
    )


@query(
    "artifact_runs",
    with_views("iter", then=f"""SELECT 'run' || k AS id, 'label' AS label, started_ms, total_ms AS avg_total_ms, 1.0 AS weight FROM iter
    WHERE k % 10 <> 0 AND {_ART_ERROR} IS NULL UNION ALL SELECT 'summary', 'sum' || k, NULL, total_ms, k % 4 FROM iter
    WHERE k % 10 = 0 AND {_ART_ERROR} IS NULL"""),
)
def artifact_runs(spark, folder):
    parsed = run_artifacts.parse_run_artifacts(artifact_documents(spark, folder))
    own = parsed["runs"].select(F.col("run_id").alias("id"), "label", "started_ms", "avg_total_ms", F.col("client_count").alias("weight"))
    return own.unionByName(
        parsed["summaries"].select(
            F.lit("summary").alias("id"), "label", F.lit(None).cast("bigint").alias("started_ms"), "avg_total_ms", F.col("run_count").alias("weight")
        )
    )


def iteration_lines(spark, folder):
    """Live iteration logs, one per customer; some lines broken."""
    its = t.iterations(spark, folder, t.load_spread, also=["o_custkey"])
    value = F.when(F.col("arrival") % 11 == 0, "nope").otherwise(_json(_iteration_json()))
    file = F.concat(F.lit("/live/c"), _text("o_custkey"), F.lit("/run/iterations/x.jsonl"))
    return v.with_value(its, value, "value").select(file.alias("file"), F.col("arrival").alias("line"), "value")


@query(
    "iterations_jsonl",
    with_views("iter", then="SELECT iteration_id, shard_id, total_ms, k AS arrival FROM iter WHERE k % 11 <> 0"),
)
def iterations_jsonl(spark, folder):
    good, _ = run_artifacts.parse_iteration_lines(iteration_lines(spark, folder))
    return good.select("iteration_id", "shard_id", "total_ms", "arrival")


@query(
    "iterations_jsonl_errors",
    with_views("iter", then="SELECT k AS line, 'line ' || k || ': invalid JSON.' AS message FROM iter WHERE k % 11 = 0"),
)
def iterations_jsonl_errors(spark, folder):
    _, bad = run_artifacts.parse_iteration_lines(iteration_lines(spark, folder))
    return bad.select("line", "message")


_LATEST = """(SELECT max(o_orderkey) AS k, o_custkey AS c FROM orders GROUP BY o_custkey)"""


@query(
    "latest_iterations",
    f"SELECT '/live/c' || c || '/run/iterations/x.jsonl' AS file, CAST(k AS VARCHAR) AS iteration_id FROM {_LATEST} WHERE k % 11 <> 0",
)
def latest_iterations(spark, folder):
    good, _ = run_artifacts.parse_iteration_lines(iteration_lines(spark, folder), latest_only=True)
    return good.select("file", "iteration_id")


@query(
    "resolve_run_folders",
    f"""WITH live AS (SELECT l.*, 'shard-' || (c % 12) AS shard, {MS.format('o_orderdate')} AS ms, c % 3 AS cl FROM {_LATEST} l
      JOIN orders ON o_orderkey = k WHERE k % 11 <> 0),
    art AS (SELECT c_custkey AS c FROM customer WHERE c_custkey % 2 = 0)
    SELECT '/live/c' || coalesce(l.c, a.c) || '/run' AS run_dir, CASE WHEN a.c IS NULL THEN 'run' ELSE 'm' || a.c END AS run_id,
    CASE WHEN a.c IS NULL THEN 'c' || l.c ELSE 'manifest' END AS label, CASE WHEN a.c IS NULL THEN 'c' || cl ELSE 'mc' END AS client_id,
    CASE WHEN a.c IS NULL THEN 'synthesized' WHEN l.c IS NOT NULL THEN 'manifest' ELSE 'artifact' END AS origin,
    CASE WHEN l.c IS NOT NULL THEN 1 ELSE 0 END AS iteration_count, CASE WHEN l.c IS NOT NULL THEN CAST(l.k % 500 AS DOUBLE) ELSE 0 END AS rows_fetched,
    CASE WHEN l.c IS NULL THEN 'declared' WHEN l.k % 103 = 0 THEN 'unknown' ELSE 'live' END AS completed
    FROM live l FULL JOIN art a ON l.c = a.c""",
)
def resolve_run_folders(spark, folder):
    latest, _ = run_artifacts.parse_iteration_lines(iteration_lines(spark, folder), latest_only=True)
    c = F.col("c_custkey")
    zero = lambda name: F.lit(0.0).alias(name)
    manifests = t.load(spark, folder, "customer").filter(c % 2 == 0).select(
        F.concat(F.lit("/live/c"), _text(c), F.lit(f"/run/{run_artifacts.MANIFEST_NAME}")).alias("file"), F.concat(F.lit("m"), _text(c)).alias("run_id"),
        F.lit("manifest").alias("label"), F.lit("bench").alias("source"), F.lit("s").alias("started_utc"), F.lit("declared").alias("completed_utc"),
        F.lit("mc").alias("client_id"), F.lit(1.0).alias("client_count"), F.lit("all").alias("partition_scope"),
        *[zero(n) for n in ("iteration_count", "rows_fetched", "events_finalized", "duration_ms", "events_per_sec")],
    )
    resolved, _ = run_artifacts.resolve_run_folders(manifests, latest)
    ended = F.when(F.col("completed_utc").isin("declared", "unknown"), F.col("completed_utc")).otherwise("live")
    return resolved.select("run_dir", "run_id", "label", "client_id", "origin", "iteration_count", "rows_fetched", ended.alias("completed"))


@query(
    "read_checkpoints",
    """SELECT 'group' AS consumer_group, 'hub' AS hub, CAST(c_custkey AS VARCHAR) AS partition_id,
    CASE WHEN c_custkey % 5 NOT IN (0, 1) THEN c_custkey * 7 END AS seq, CASE WHEN c_custkey % 5 <> 0 THEN 'o' || c_custkey END AS msg_offset,
    CASE WHEN c_custkey % 5 = 0 THEN 'error: invalid JSON' WHEN c_custkey % 5 = 1 THEN 'no_checkpoint' END AS status FROM customer""",
)
def read_checkpoints(spark, folder):
    c = F.col("c_custkey")
    offset = F.concat(F.lit("o"), _text(c)).alias("Offset")
    as_text = F.to_json(F.struct(_text(c * 7).alias("SequenceNumber"), offset))
    as_number = F.to_json(F.struct((c * 7).alias("SequenceNumber"), offset))
    body = F.when(c % 5 == 0, "{").when(c % 5 == 1, F.to_json(F.struct(offset))).when(c % 5 == 2, as_text).otherwise(as_number)
    docs = t.load(spark, folder, "customer").select(F.concat(F.lit("/cp/group/hub/"), _text(c)).alias("file"), body.alias("text"))
    return files.parse_checkpoints(docs).select("consumer_group", "hub", "partition_id", "seq", "msg_offset", "status")


# --- debug dumps ----------------------------------------------------------------------------


def dump_documents(spark, folder):
    """A run folder per event, of a message, a composed file and a flush; some lack one, some are broken."""
    base = f"/dump/"
    run = F.concat(F.lit(base), _text("event_id"))
    record = F.struct(
        F.concat(F.lit("s"), _text("user_id")).alias("sessionId"), utc_text(F.col("ms")).alias("timestampUtc"),
        F.struct(F.col("event_type").alias("action")).alias("payload"),
    )
    message = F.struct(
        _text(F.col("user_id") % 4).alias("partitionId"), F.col("event_id").alias("sequenceNumber"), F.lit("Pending").alias("status"),
        F.when(F.col("event_id") % 6 != 0, record).alias("record"),
    )
    messages = F.to_json(F.struct(F.lit(1).alias("count"), F.array(message).alias("messages")))
    refs = F.array(F.concat(_text(F.col("user_id") % 4), F.lit("/"), _text("event_id")), F.lit("none"))
    occurrence = F.struct(
        F.when(F.col("event_id") % 2 == 0, "Emit").otherwise("Acknowledge").alias("kind"), utc_text(F.col("ms")).alias("lastActivityUtc"), refs.alias("sources"),
        F.struct(F.concat(F.lit("d"), _text("event_id")).alias("id"), F.lit("5").alias("dwellMs")).alias("document"),
    )
    composed = F.to_json(F.struct(F.concat(F.lit("s"), _text("user_id")).alias("sessionId"), F.array(occurrence).alias("events")))
    summary = F.struct(F.lit(1).alias("eventsWritten"), F.lit(1).alias("messagesMarkedDone"), F.col("event_id").alias("checkpointSequenceNumber"))
    flush = F.to_json(F.struct(summary.alias("summary"), F.struct(F.array(message).alias("messages")).alias("markedDone")))
    meta = F.to_json(F.struct((F.col("event_id") % 2).alias("dumpSchemaVersion"), (F.col("event_id") - 1).alias("startingCheckpoint")))
    events = t.load(spark, folder, "events").withColumn("ms", t.epoch_ms("ts"))

    def file(name, text, present):
        return F.when(present, F.struct(F.concat(run, F.lit(f"/{name}")).alias("file"), text.alias("text")))

    made = F.array_compact(
        F.array(
            file("00-Messages.json", F.when(F.col("event_id") % 23 == 0, "[").otherwise(messages), F.col("event_id") % 19 != 0),
            file("01-composed/a.json", composed, F.col("event_id") % 17 != 0),
            file("02-flush.json", flush, F.col("event_id") % 13 != 0),
            file("run-meta.json", meta, F.col("event_id") % 4 == 0),
        )
    )
    return cut(events.select(F.inline(made)))


_DUMP_OK = "event_id % 19 <> 0 AND event_id % 17 <> 0 AND event_id % 13 <> 0 AND event_id % 23 <> 0"


@query(
    "dump_run_messages",
    f"""SELECT '/dump/' || event_id AS run_id, event_id AS seq, CASE WHEN event_id % 6 <> 0 THEN 's' || user_id ELSE 'unknown-session' END AS session_id,
    CASE WHEN event_id % 6 <> 0 THEN event_type ELSE '(unmapped)' END AS label, CASE WHEN event_id % 6 <> 0 THEN {MS.format('ts')} END AS timestamp_ms
    FROM events WHERE {_DUMP_OK}""",
)
def dump_run_messages(spark, folder):
    read = dump_folders.parse_dump_runs(dump_documents(spark, folder))
    return read["messages"].select("run_id", "seq", "session_id", "label", "timestamp_ms")


@query(
    "dump_run_occurrences",
    f"""SELECT '/dump/' || event_id AS run_id, 's' || user_id || ':0' AS occurrence_id, CASE WHEN event_id % 2 = 0 THEN 'Emit' ELSE 'Acknowledge' END AS kind,
    'd' || event_id AS doc_id, CAST(NULL AS DOUBLE) AS dwell_ms, event_id AS seq FROM events WHERE {_DUMP_OK}""",
)
def dump_run_occurrences(spark, folder):
    read = dump_folders.parse_dump_runs(dump_documents(spark, folder))
    return read["occurrences"].join(exchanged(read["sources"]), ["run_id", "occurrence_id"]).select(
        "run_id", "occurrence_id", "kind", "doc_id", "dwell_ms", "seq"
    )


@query(
    "dump_run_errors",
    f"""SELECT '/dump/' || event_id AS run_id, CASE WHEN event_id % 19 = 0 THEN '00-messages.json' WHEN event_id % 17 = 0 THEN '01-composed'
    WHEN event_id % 13 = 0 THEN '02-flush.json' ELSE '00-messages.json' END AS artifact FROM events WHERE NOT ({_DUMP_OK})
    AND NOT (event_id % 19 = 0 AND event_id % 17 = 0 AND event_id % 13 = 0 AND event_id % 4 <> 0)""",
)
def dump_run_errors(spark, folder):
    return dump_folders.parse_dump_runs(dump_documents(spark, folder))["errors"].select("run_id", "artifact")


@query(
    "dump_run_meta",
    f"""SELECT '/dump/' || event_id AS run_id, CAST(user_id % 4 AS VARCHAR) AS partition_id, false AS enhanced,
    CASE WHEN event_id % 4 = 0 THEN event_id - 1 END AS starting_checkpoint, event_id AS checkpoint_seq, event_id AS marked FROM events WHERE {_DUMP_OK}""",
)
def dump_run_meta(spark, folder):
    read = dump_folders.parse_dump_runs(dump_documents(spark, folder))
    marked = read["marked_done"].select("run_id", F.col("seq").alias("marked"))
    return read["meta"].join(exchanged(read["flush"]), "run_id").join(exchanged(marked), "run_id").select(
        "run_id", "partition_id", "enhanced", "starting_checkpoint", "checkpoint_seq", "marked"
    )
