"""Queries over telemetry rows, keyed tables and multi-part envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from logtel.functions import payloads
from logtel.operators import assembly, ingest, keyed
from logtel.operators.layout import number_rows
from logtel.plans import tables as t
from logtel.plans.registry import query
from logtel.plans.sample_lifecycle import CONFIG
from logtel.plans.views import with_views
from logtel.session import new_path, written

NOW_MS = 1706745600000
MAX_BATCH_BYTES = 2000


@query("high_watermarks", with_views("marks", then="SELECT * FROM marks"))
def high_watermarks(spark, folder):
    return ingest.high_watermarks(t.stored_events(spark, folder), t.users(spark, folder))


@query(
    "incremental_pull",
    with_views("pull", "marks", then=f"""SELECT event_id, p.object_id, session_id, client_ms, ts_ms FROM pull p JOIN marks m
    ON p.object_id = m.object_id WHERE CASE WHEN watermark_ms IS NOT NULL THEN client_ms > watermark_ms
    ELSE ts_ms > {NOW_MS} - 10 * 86400000::BIGINT END"""),
)
def incremental_pull(spark, folder):
    marks = ingest.high_watermarks(t.stored_events(spark, folder), t.users(spark, folder))
    rows = written(t.pull_rows(spark, folder), "pull-rows")  # as columns, so that bounds reach their scan
    return ingest.incremental_pull(rows, marks, NOW_MS, "P10D")


@query("incremental_pull_session", with_views("pull", then="SELECT * FROM pull WHERE session_id = 's8'"))
def incremental_pull_session(spark, folder):
    marks = t.users(spark, folder).withColumn("watermark_ms", F.lit(None).cast("bigint"))
    return ingest.incremental_pull(
        t.pull_rows(spark, folder), marks, NOW_MS, session_id="s8", explicit_users=True
    )


_EVENT_MS = "coalesce(client_ms, precise_ms) AS event_ms"


@query(
    "order_chronologically",
    with_views("tele", then=f"""SELECT event_id AS ord, event_ms, row_number() OVER (ORDER BY event_ms NULLS LAST, event_id) AS place
    FROM (SELECT *, {_EVENT_MS} FROM tele)"""),
)
def order_chronologically(spark, folder):
    timed = ingest.event_time_ms(t.telemetry(spark, folder)).withColumn("ts_null", F.col("_event_ms").isNull())
    placed = number_rows(timed.select("_ord", "_event_ms", "ts_null"), [], ["ts_null", "_event_ms", "_ord"], "place")
    return placed.select(F.col("_ord").alias("ord"), F.col("_event_ms").alias("event_ms"), "place")


@query(
    "chronological_rows",
    with_views("tele", then=f"SELECT event_id AS ord, {_EVENT_MS}, event_type FROM tele"),
)
def chronological_rows(spark, folder):
    ordered = ingest.order_chronologically(t.telemetry(spark, folder), ties=["_ord"])
    return ordered.select(F.col("_ord").alias("ord"), F.col("_event_ms").alias("event_ms"), "event_type")


def _respelled(spark, folder):
    """Half of the keys sit in a column whose name differs in case only."""
    rows = t.telemetry(spark, folder)
    other = F.when(F.col("_ord") % 2 == 0, F.col("sessionId"))
    return rows.select(other.alias("_a"), "*").withColumn("sessionId", F.when(F.col("_ord") % 2 == 1, F.col("sessionId"))).toDF(
        "SESSIONID", *rows.columns
    )


@query("resolve_key", with_views("tele", then="SELECT event_id AS ord, session_key AS key FROM tele WHERE session_key IS NOT NULL"))
def resolve_key(spark, folder):
    kept, _ = ingest.resolve_key(_respelled(spark, folder))
    return kept.select(F.col("_ord").alias("ord"), F.col("_key").alias("key"))


@query("resolve_key_skipped", with_views("tele", then="SELECT event_id AS ord FROM tele WHERE session_key IS NULL"))
def resolve_key_skipped(spark, folder):
    _, skipped = ingest.resolve_key(_respelled(spark, folder))
    return skipped.select(F.col("_ord").alias("ord"))


_BODY = """to_json({'sessionId': session_key, 'objectId': CAST(user_id AS VARCHAR), 'clientTime': CAST(client_ms AS VARCHAR),
    'PreciseTimeStamp': CASE WHEN event_id % 60 <> 0 THEN strftime(ts, '%-m/%-d/%Y, %-I:%M:%S.%f %p') END,
    'event_type': e.event_type, 'props': e.props})"""
_SENT = with_views("tele", then="SELECT 1").removesuffix(" SELECT 1") + f""", body AS (SELECT t.*, {_EVENT_MS},
    CAST({_BODY} AS VARCHAR) AS body FROM tele t JOIN (SELECT event_id, user_id, ts, event_type, props FROM events) e USING (event_id))"""


def _events(spark, folder):
    kept, skipped = ingest.resolve_key(ingest.event_time_ms(t.telemetry(spark, folder)))
    return ingest.rows_to_json(kept), skipped


@query("rows_to_json", _SENT + " SELECT event_id AS ord, body FROM body WHERE session_key IS NOT NULL")
def rows_to_json(spark, folder):
    events, _ = _events(spark, folder)
    return events.select(F.col("_ord").alias("ord"), F.col("_body").alias("body"))


WALK = _SENT.replace("WITH ", "WITH RECURSIVE ", 1) + f""", seq AS (SELECT session_key AS key, event_id AS ord,
      octet_length(encode(body)) AS size, row_number() OVER (PARTITION BY session_key ORDER BY event_ms NULLS LAST, event_id) AS n
      FROM body WHERE session_key IS NOT NULL),
    walk AS (SELECT key, ord, n, CASE WHEN size > {MAX_BATCH_BYTES} THEN 0 ELSE size END AS held,
        CASE WHEN size > {MAX_BATCH_BYTES} THEN 0 ELSE 1 END AS number, size > {MAX_BATCH_BYTES} AS oversize FROM seq WHERE n = 1
      UNION ALL SELECT s.key, s.ord, s.n,
        CASE WHEN s.size > {MAX_BATCH_BYTES} THEN 0 WHEN held = 0 OR held + s.size > {MAX_BATCH_BYTES} THEN s.size ELSE held + s.size END,
        number + CASE WHEN s.size > {MAX_BATCH_BYTES} THEN 0 WHEN held = 0 OR held + s.size > {MAX_BATCH_BYTES} THEN 1 ELSE 0 END,
        s.size > {MAX_BATCH_BYTES} FROM walk w JOIN seq s ON s.key = w.key AND s.n = w.n + 1)"""


def _batched(spark, folder):
    events, skipped = _events(spark, folder)
    last = F.coalesce("_event_ms", F.lit(9223372036854775807))
    return ingest.size_bounded_batches(events.withColumn("_at", last), MAX_BATCH_BYTES, ["_at", "_ord"]), skipped


@query("size_bounded_batches", WALK + " SELECT key, ord, CASE WHEN NOT oversize THEN number END AS batch FROM walk")
def size_bounded_batches(spark, folder):
    batched, _ = _batched(spark, folder)
    return batched.select(F.col("_key").alias("key"), F.col("_ord").alias("ord"), F.col("_batch").alias("batch"))


@query(
    "send_summary",
    WALK + """ SELECT (SELECT count(*) FROM body) AS rows_read,
    (SELECT CAST(sum(m) AS BIGINT) FROM (SELECT max(number) AS m FROM walk GROUP BY key)) AS batches_sent,
    (SELECT count(*) FROM body WHERE session_key IS NULL) + (SELECT count(*) FROM walk WHERE oversize) AS rows_skipped,
    (SELECT count(DISTINCT key) FROM walk) AS distinct_keys,
    (SELECT count(*) FROM body WHERE session_key IS NULL) + (SELECT count(*) FROM walk WHERE oversize) = 0 AS ok""",
)
def send_summary(spark, folder):
    return ingest.send_summary(*_batched(spark, folder))


@query(
    "write_keyed_events",
    _SENT + """ SELECT session_key AS key, event_id AS ord, event_ms, body, 1 AS partitions_of_key FROM body
    WHERE session_key IS NOT NULL""",
)
def write_keyed_events(spark, folder):
    events, _ = _events(spark, folder)
    path = new_path(spark, "keyed-events")
    ingest.write_keyed_events(events, path, partitions=8)
    back = spark.read.parquet(path)
    spread = back.groupBy("key").agg(F.count_distinct("log_partition").cast("int").alias("partitions_of_key"))
    return back.join(spread, "key").select(
        "key", F.col("_ord").alias("ord"), F.col("_event_ms").alias("event_ms"), "body", "partitions_of_key"
    )


# --- keyed tables ---------------------------------------------------------------------------


@query(
    "latest_per_key",
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
    ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def latest_per_key(spark, folder):
    orders = t.load(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return keyed.latest_per_key(orders, ["o_custkey"], F.struct("o_orderdate", "o_orderkey")).drop("o_orderdate")


_UPDATES = """(SELECT o_custkey * 2 AS id, arg_max(o_orderstatus, o_orderkey) AS segment, arg_max(o_totalprice, o_orderkey) AS amount
    FROM orders GROUP BY o_custkey)"""


@query(
    "upsert_by_key",
    f"""SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS amount FROM customer
    WHERE c_custkey NOT IN (SELECT id FROM {_UPDATES}) UNION ALL SELECT * FROM {_UPDATES}""",
)
def upsert_by_key(spark, folder):
    current = t.load(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("amount")
    )
    updates = t.load(spark, folder, "orders").select(
        (F.col("o_custkey") * 2).alias("id"), F.col("o_orderstatus").alias("segment"), F.col("o_totalprice").alias("amount"), "o_orderkey"
    )
    return keyed.upsert_by_key(current, updates, ["id"], "o_orderkey")


def _purge_tables(spark, folder):
    events = t.load(spark, folder, "events").select(
        "event_id", t.every(50, "event_id", F.col("user_id")).alias("user_id"), "event_type", "value"
    )
    return events, events.filter("value > 60").select("user_id", "event_type")


_PURGE = """WITH e AS (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN user_id END AS user_id, event_type, value FROM events),
    k AS (SELECT DISTINCT user_id, event_type FROM e WHERE value > 60)"""


@query(
    "purge_keys",
    _PURGE + """ SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.user_id IS NOT DISTINCT FROM e.user_id
    AND k.event_type = e.event_type)""",
)
def purge_keys(spark, folder):
    events, keys = _purge_tables(spark, folder)
    return keyed.purge_keys(events, keys, ["/user_id", "/event_type"])


@query("verify_purged", "SELECT true AS is_empty")
def verify_purged(spark, folder):
    events, keys = _purge_tables(spark, folder)
    rest = keyed.purge_keys(events, keys, ["/user_id", "/event_type"])
    return keyed.verify_purged(rest, keys, ["user_id", "event_type"])


@query(
    "distinct_keys",
    """SELECT DISTINCT CAST(CASE WHEN event_id % 50 <> 0 THEN user_id END AS DOUBLE) AS user_id, event_type FROM events""",
)
def distinct_keys(spark, folder):
    events, _ = _purge_tables(spark, folder)
    return keyed.distinct_keys(events, ["/user_id", "event_type"])


@query(
    "changed_files",
    """SELECT coalesce(a.p, b.p) AS path, CASE WHEN a.p IS NULL THEN 'added' WHEN b.p IS NULL THEN 'removed' ELSE 'changed' END AS change,
    b.s AS size, b.m AS modified_ms FROM (SELECT 'f' || o_orderkey AS p, o_custkey AS s, o_orderkey * 10 AS m FROM orders WHERE o_orderstatus <> 'P') a
    FULL JOIN (SELECT 'f' || o_orderkey AS p, o_custkey AS s, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey * 10 + o_orderkey % 2 END AS m
    FROM orders WHERE o_orderstatus <> 'F') b ON a.p = b.p WHERE a.p IS NULL OR b.p IS NULL OR a.m IS DISTINCT FROM b.m""",
)
def changed_files(spark, folder):
    orders = t.load(spark, folder, "orders")
    path, size = F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_custkey").alias("size")
    moved = t.every(5, "o_orderkey", F.col("o_orderkey") * 10 + F.col("o_orderkey") % 2)
    before = orders.filter("o_orderstatus <> 'P'").select(path, size, (F.col("o_orderkey") * 10).alias("modified_ms"))
    after = orders.filter("o_orderstatus <> 'F'").select(path, size, moved.alias("modified_ms"))
    return keyed.changed_files(before, after)


# --- payloads -------------------------------------------------------------------------------


@query(
    "message_fields",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 7 = 0 THEN '(unmapped)' ELSE 'type-' || event_type END
      WHEN event_id % 3 = 0 THEN event_type ELSE event_type || '/' || user_id END AS label,
    CASE WHEN event_id % 4 <> 0 THEN 'view-' || user_id END AS view_id, CASE WHEN event_id % 4 <> 0 THEN 'i' || event_id END AS instance_id,
    CASE WHEN event_id % 2 = 0 THEN value END AS dwell_ms, 'doc-' || event_id AS doc_id,
    CASE WHEN event_id % 6 <> 0 THEN value END AS perf_a FROM events""",
)
def message_fields(spark, folder):
    e = F.col("event_id")
    text = lambda c: F.col(c).cast("string")
    context = F.to_json(
        F.struct(F.struct(F.concat(F.lit("view-"), text("user_id")).alias("id"), F.concat(F.lit("i"), text("event_id")).alias("instanceId")).alias("Blade"))
    )
    record = F.struct(
        F.when(e % 7 != 0, F.concat(F.lit("type-"), "event_type")).alias("eventType"),
        F.struct(
            F.when(e % 5 != 0, F.col("event_type")).alias("action"),
            F.when(e % 3 != 0, text("user_id")).alias("actionModifier"),
            F.when(e % 4 == 0, "not json").otherwise(context).alias("context"),
        ).alias("payload"),
    )
    number = F.when(e % 2 == 0, F.col("value"))
    document = F.struct(
        F.concat(F.lit("doc-"), text("event_id")).alias("id"), number.alias("dwellMs"),
        F.when(e % 6 != 0, F.struct(F.col("value").alias("a"))).alias("perf"),
    )
    parsed = t.load(spark, folder, "events").select(
        "event_id", F.try_parse_json(F.to_json(record)).alias("record"), F.try_parse_json(F.to_json(document)).alias("document")
    )
    view = payloads.view_ref(F.try_variant_get("record", "$.payload", "variant"))
    doc = payloads.doc_fields(F.col("document"))
    return parsed.select(
        "event_id", payloads.message_label(F.col("record")).alias("label"), view["id"].alias("view_id"),
        view["instance_id"].alias("instance_id"), doc["dwell_ms"].alias("dwell_ms"), doc["doc_id"].alias("doc_id"), doc["perf"]["a"].alias("perf_a"),
    )


# --- multi-part envelopes -------------------------------------------------------------------

LIFECYCLES = assembly.read_lifecycles(CONFIG)
AS_OF_MS = 36 * 3600000


def _projected(spark, folder):
    return assembly.project_envelopes(t.envelopes(spark, folder), LIFECYCLES)


@query(
    "project_envelopes",
    with_views("env", then="""SELECT seq AS sequence_number, session_id, event_id, part, CASE WHEN NOT notice THEN dedupe_key END AS dedupe_key,
    CASE WHEN NOT notice THEN CAST(received_ms AS VARCHAR) END AS timestamp, conv_id % 5 = 0 AS priority, mapped AS is_mapped FROM env"""),
)
def project_envelopes(spark, folder):
    return _projected(spark, folder).select(
        "sequence_number", "session_id", "event_id", "part", "dedupe_key", "timestamp", "priority", "is_mapped"
    )


@query("dedupe_envelopes", with_views("env_d", then="SELECT seq AS sequence_number, part, is_duplicate FROM env_d"))
def dedupe_envelopes(spark, folder):
    deduped = assembly.dedupe_envelopes(_projected(spark, folder), LIFECYCLES)
    return deduped.select("sequence_number", "part", "is_duplicate")


_DECIDED = with_views("asm", then="SELECT 1").removesuffix(" SELECT 1") + f""", dec AS (SELECT *,
    CASE WHEN notice THEN CASE WHEN conv_id % 5 = 0 THEN 'priority' ELSE 'full' END
    WHEN has_opening AND has_question THEN 'full' WHEN {AS_OF_MS} - first_ms >= 43200000 THEN 'partial' ELSE 'incomplete' END AS decision
    FROM asm)"""


def _assembled(spark, folder):
    return assembly.assemble_events(assembly.dedupe_envelopes(_projected(spark, folder), LIFECYCLES), LIFECYCLES, AS_OF_MS)


@query(
    "assemble_events",
    _DECIDED + """ SELECT session_id, event_id, part_count, first_ms AS first_received_ms, last_ms AS last_received_ms, decision,
    decision <> 'incomplete' AND NOT notice AND NOT (has_opening AND has_question) AS is_partial,
    CASE WHEN notice THEN '' WHEN NOT has_opening AND NOT has_question THEN 'opening,question' WHEN NOT has_opening THEN 'opening'
         WHEN NOT has_question THEN 'question' ELSE '' END AS missing FROM dec""",
)
def assemble_events(spark, folder):
    return _assembled(spark, folder).select(
        "session_id", "event_id", "part_count", "first_received_ms", "last_received_ms", "decision", "is_partial",
        F.array_join("missing_parts", ",").alias("missing"),
    )


@query(
    "assembled_parts",
    with_views("env_d", then="SELECT session_id, event_id, part, seq AS sequence_number, chars FROM env_d WHERE NOT is_duplicate"),
)
def assembled_parts(spark, folder):
    deduped = assembly.dedupe_envelopes(_projected(spark, folder), LIFECYCLES)
    chars = F.try_variant_get(F.try_parse_json("payload"), "$.chars", "bigint").alias("chars")
    return assembly.assembled_parts(deduped).select("session_id", "event_id", "part", "sequence_number", chars)


@query(
    "write_previews",
    _DECIDED + """ SELECT CASE WHEN notice THEN 'notice-' || event_id ELSE 'conversation/' || session_id || '/' || event_id END AS id,
    CASE WHEN notice THEN 'other' ELSE session_id END AS partition_key,
    CASE decision WHEN 'full' THEN 'RequiredPartsPresent' WHEN 'priority' THEN 'Priority' ELSE 'PartialTimeout' END AS reason,
    CASE WHEN NOT notice THEN question_chars END AS question_length, CASE WHEN NOT notice THEN answer_chars END AS reply_length,
    CASE WHEN NOT notice THEN answer_tag END AS reply_tag, CASE WHEN NOT notice THEN 7 END AS table_number,
    CASE WHEN notice THEN opening_tag END AS tag, CASE WHEN notice OR has_question THEN 0 ELSE 1 END AS missing_required
    FROM dec WHERE decision <> 'incomplete'""",
)
def write_previews(spark, folder):
    shown = assembly.write_previews(_assembled(spark, folder), LIFECYCLES)
    body = F.try_parse_json("payload")
    whole = lambda path: F.try_variant_get(body, path, "bigint")
    text = lambda path: F.try_variant_get(body, path, "string")
    return shown.select(
        "id", "partition_key", "reason", whole("$.question.length").alias("question_length"), whole("$.reply.first.length").alias("reply_length"),
        text("$.reply.first.tag").alias("reply_tag"), whole("$.table").alias("table_number"), text("$.tag").alias("tag"),
        F.size("missing_targets").alias("missing_required"),
    )


@query(
    "batch_summary",
    _DECIDED + """ SELECT (SELECT count(*) FROM env) AS messages_read, (SELECT count(*) FROM env_d WHERE is_duplicate) AS duplicates,
    (SELECT count(*) FROM env WHERE NOT mapped) AS skipped, count(*) AS assemblies, count(*) FILTER (decision <> 'incomplete') AS flushed,
    count(*) FILTER (decision = 'incomplete') AS incomplete FROM dec""",
)
def batch_summary(spark, folder):
    projected = _projected(spark, folder)
    deduped = assembly.dedupe_envelopes(projected, LIFECYCLES)
    return assembly.batch_summary(projected, deduped, assembly.assemble_events(deduped, LIFECYCLES, AS_OF_MS))
