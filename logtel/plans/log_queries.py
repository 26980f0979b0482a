"""Queries over the message log and debug dumps."""

from __future__ import annotations

from pyspark.sql import functions as F

from logtel.operators import dumps, messages
from logtel.plans import tables as t
from logtel.plans.registry import query
from logtel.plans.views import with_views
from logtel.session import new_path

# Of the two bounded reads only; small enough to bind on every table size.
READ_CAP = 400


@query(
    "partition_backlog",
    with_views("heads", "ckpt", then="""SELECT h.partition_id, begin_seq, last_seq, c.seq AS checkpoint_seq,
    greatest(0, CASE WHEN c.seq IS NOT NULL THEN last_seq - c.seq ELSE last_seq - begin_seq + 1 END) AS backlog,
    CASE WHEN c.seq IS NOT NULL THEN last_seq - c.seq <= 0 ELSE false END AS effectively_empty
    FROM heads h LEFT JOIN ckpt c ON h.partition_id = c.partition_id"""),
)
def partition_backlog(spark, folder):
    log = t.messages(spark, folder)
    return messages.partition_backlog(messages.partition_heads(log), t.checkpoints(spark, folder))


@query(
    "backlog_total",
    with_views("heads", "ckpt", then="""SELECT CAST(sum(greatest(0, CASE WHEN c.seq IS NOT NULL THEN last_seq - c.seq
    ELSE last_seq - begin_seq + 1 END)) AS BIGINT) AS total_backlog
    FROM heads h LEFT JOIN ckpt c ON h.partition_id = c.partition_id"""),
)
def backlog_total(spark, folder):
    return messages.backlog_total(partition_backlog(spark, folder))


@query(
    "checkpoint_report",
    with_views("heads", "ckpt", then="""SELECT h.partition_id, last_seq, c.seq AS checkpoint_seq,
    CASE WHEN c.seq IS NULL THEN 0 ELSE greatest(0, last_seq - c.seq) END AS unprocessed,
    CASE WHEN c.seq IS NULL THEN 'no_checkpoint' END AS status
    FROM heads h LEFT JOIN ckpt c ON h.partition_id = c.partition_id"""),
)
def checkpoint_report(spark, folder):
    log = t.messages(spark, folder)
    return messages.checkpoint_report(messages.partition_heads(log), t.checkpoints(spark, folder))


@query(
    "checkpoint_report_totals",
    with_views("heads", "ckpt", then="""SELECT CAST(sum(CASE WHEN c.seq IS NULL THEN 0 ELSE greatest(0, last_seq - c.seq) END)
    AS BIGINT) AS total_unprocessed, max(c.seq) AS total_checkpointed
    FROM heads h LEFT JOIN ckpt c ON h.partition_id = c.partition_id"""),
)
def checkpoint_report_totals(spark, folder):
    return messages.checkpoint_report_totals(checkpoint_report(spark, folder))


_READ = """(SELECT m.*, row_number() OVER (ORDER BY m.partition_id, m.seq) AS idx
    FROM msg m LEFT JOIN ckpt c ON m.partition_id = c.partition_id WHERE c.seq IS NULL OR m.seq > c.seq)"""


def _read(spark, folder, max_events=None):
    log = t.messages(spark, folder)
    return messages.bounded_read(log, messages.partition_heads(log), t.checkpoints(spark, folder), max_events)


@query(
    "bounded_read",
    with_views("msg", "ckpt", then=f"SELECT idx AS index, partition_id, seq, msg_offset, partition_key FROM {_READ} WHERE idx <= {READ_CAP}"),
)
def bounded_read(spark, folder):
    return _read(spark, folder, READ_CAP).select("index", "partition_id", "seq", "msg_offset", "partition_key")


@query(
    "bounded_read_earliest",
    with_views("msg", then=f"""SELECT * FROM (SELECT row_number() OVER (ORDER BY partition_id, seq) AS index, partition_id, seq
    FROM msg) WHERE index <= {READ_CAP // 2}"""),
)
def bounded_read_earliest(spark, folder):
    log = t.messages(spark, folder)
    read = messages.bounded_read(log, messages.partition_heads(log), None, READ_CAP // 2)
    return read.select("index", "partition_id", "seq")


@query(
    "message_metadata",
    with_views("msg", "ckpt", then=f"""SELECT idx AS index, CAST(partition_id AS VARCHAR) AS partition_id,
    seq AS sequence_number, msg_offset AS offset, partition_key, 'm' || seq AS message_id,
    CASE WHEN seq % 3 <> 0 THEN event_type END AS correlation_id, octet_length(encode(props)) AS body_bytes,
    enqueued_ms, CAST(seq AS VARCHAR) AS x_seq, event_type AS kind,
    CASE WHEN length(props) > 8 THEN substr(props, 1, 8) || '…(+' || (length(props) - 8) || ' more chars)' ELSE props END
    AS preview FROM {_READ}"""),
)
def message_metadata(spark, folder):
    shown = messages.message_metadata(_read(spark, folder), preview=8)
    return shown.select(
        "index", "partition_id", "sequence_number", "offset", "partition_key", "message_id", "correlation_id",
        F.col("body_bytes").cast("bigint").alias("body_bytes"),
        F.unix_millis(F.to_timestamp("enqueued_time_utc")).alias("enqueued_ms"),
        F.col("system_properties")["x-seq"].alias("x_seq"),
        F.col("app_properties")["kind"].alias("kind"),
        "preview",
    )


@query(
    "export_message_metadata",
    with_views("msg", "ckpt", then=f"""SELECT idx AS index, CAST(partition_id AS VARCHAR) AS partition_id, seq AS sequence_number,
    CASE WHEN seq % 3 <> 0 THEN event_type END AS correlation_id, props AS body FROM {_READ}"""),
)
def export_message_metadata(spark, folder):
    path = new_path(spark, "metadata")
    messages.export_message_metadata(messages.message_metadata(_read(spark, folder)), path)
    fields = "index bigint, partition_id string, sequence_number bigint, correlation_id string, body string"
    return spark.read.schema(fields).json(path)


@query(
    "advance_checkpoints",
    with_views("msg", "ckpt", then=f"""SELECT coalesce(c.partition_id, r.partition_id) AS partition_id,
    CASE WHEN r.s > coalesce(c.seq, -1) THEN r.s ELSE c.seq END AS seq,
    CASE WHEN r.s > coalesce(c.seq, -1) THEN CAST(r.s * 128 AS VARCHAR) ELSE CAST(c.seq * 128 AS VARCHAR) END AS msg_offset,
    coalesce(r.n, 0) AS events_read, r.s IS NOT NULL AND r.s > coalesce(c.seq, -1) AS advanced
    FROM ckpt c FULL JOIN (SELECT partition_id, max(seq) AS s, count(*) AS n FROM {_READ} GROUP BY partition_id) r
    ON c.partition_id = r.partition_id"""),
)
def advance_checkpoints(spark, folder):
    log, marks = t.messages(spark, folder), t.checkpoints(spark, folder)
    return messages.advance_checkpoints(marks, messages.unread(log, messages.partition_heads(log), marks))


# --- debug dumps ----------------------------------------------------------------------------


@query(
    "checkpoint_frontier",
    with_views("dump", then="""SELECT d.run_id, coalesce(max(CASE WHEN p.stop IS NULL OR seq < p.stop THEN seq END), -1) AS frontier
    FROM dump d LEFT JOIN (SELECT run_id, min(seq) AS stop FROM dump WHERE final_status = 'Pending' GROUP BY run_id) p
    ON d.run_id = p.run_id GROUP BY d.run_id"""),
)
def checkpoint_frontier(spark, folder):
    return dumps.checkpoint_frontier(t.dump_messages(spark, folder, final=True), t.dump_start(spark, folder))


_PROGRESSION = """, pm AS (SELECT run_id, seq, max(coalesce(terminal, 1000000000000)) OVER (PARTITION BY run_id ORDER BY seq) AS reach
    FROM terminal), gain AS (SELECT run_id, greatest(reach, 1) AS ordinal, max(seq) AS gain FROM pm WHERE reach < 1000000000000
    GROUP BY run_id, greatest(reach, 1))"""


@query(
    "checkpoint_progression",
    with_views("terminal", "occ_n", then="SELECT 1").removesuffix(" SELECT 1") + _PROGRESSION
    + """ SELECT o.run_id, o.ordinal, o.occurrence_id,
    coalesce(max(gain) OVER (PARTITION BY o.run_id ORDER BY o.ordinal), -1) AS frontier
    FROM (SELECT run_id, ordinal, occurrence_id FROM occ_n UNION ALL
          SELECT run_id, max(ordinal) + 1, NULL FROM occ_n GROUP BY run_id) o
    LEFT JOIN gain g ON o.run_id = g.run_id AND o.ordinal = g.ordinal""",
)
def checkpoint_progression(spark, folder):
    return dumps.checkpoint_progression(
        t.dump_messages(spark, folder), t.dump_occurrences(spark, folder), t.dump_sources(spark, folder),
        t.dump_start(spark, folder), t.dump_marked(spark, folder),
    )


def _state_sql(n: str) -> str:
    return with_views("terminal", "occ_n", "src", then=f"""SELECT c.run_id, pending, done, skipped, documents_written,
    messages_drained, coalesce(f.frontier, -1) AS frontier FROM (
      SELECT run_id, count(*) FILTER (s = 'p') AS pending, count(*) FILTER (s = 'd') AS done, count(*) FILTER (s = 's') AS skipped
      FROM (SELECT run_id, CASE WHEN at_ord <= {n} OR (is_marked AND last_ord + 1 <= {n} AND loaded_status <> 'Skipped') THEN 'd'
                   WHEN loaded_status = 'Skipped' THEN 's' ELSE 'p' END AS s FROM terminal) GROUP BY run_id) c
    JOIN (SELECT run_id, count(*) FILTER (kind = 'Emit' AND ordinal <= {n}) AS documents_written FROM occ_n GROUP BY run_id) w
      ON c.run_id = w.run_id
    JOIN (SELECT s.run_id, count(*) FILTER (o.kind <> 'Emit' AND o.ordinal <= {n}) AS messages_drained FROM src s JOIN occ_n o
          ON s.run_id = o.run_id AND s.occurrence_id = o.occurrence_id GROUP BY s.run_id) d ON c.run_id = d.run_id
    LEFT JOIN (SELECT t.run_id, max(seq) AS frontier FROM terminal t LEFT JOIN (SELECT run_id, min(seq) AS stop FROM terminal
          WHERE terminal IS NULL OR terminal > {n} GROUP BY run_id) p ON t.run_id = p.run_id
          WHERE p.stop IS NULL OR seq < p.stop GROUP BY t.run_id) f ON c.run_id = f.run_id""")


def _state(spark, folder, ordinal):
    return dumps.state_at(
        t.dump_messages(spark, folder), t.dump_occurrences(spark, folder), t.dump_sources(spark, folder),
        t.dump_start(spark, folder), ordinal, t.dump_marked(spark, folder),
    )


@query("state_at_step", _state_sql("40"))
def state_at_step(spark, folder):
    return _state(spark, folder, 40)


@query("state_at_end", _state_sql("1000000000"))
def state_at_end(spark, folder):
    return _state(spark, folder, None)


@query(
    "dispositions",
    with_views("dump", "occ", "src", "marked", then="""SELECT d.run_id, d.seq, CASE
    WHEN d.event_id % 23 = 0 THEN 'rehydrated' WHEN e.em THEN 'emitted' WHEN e.ac THEN 'acknowledged'
    WHEN d.loaded_status = 'Skipped' THEN 'skipped' WHEN m.seq IS NOT NULL THEN 'residual-drain' ELSE 'pending' END AS disposition
    FROM dump d LEFT JOIN (SELECT s.run_id, s.seq, bool_or(kind = 'Emit') AS em, bool_or(kind <> 'Emit') AS ac FROM src s JOIN occ o
      ON s.run_id = o.run_id AND s.occurrence_id = o.occurrence_id GROUP BY s.run_id, s.seq) e
      ON d.run_id = e.run_id AND d.seq = e.seq
    LEFT JOIN marked m ON d.run_id = m.run_id AND d.seq = m.seq"""),
)
def dispositions(spark, folder):
    ended = dumps.dispositions(
        t.dump_messages(spark, folder), t.dump_occurrences(spark, folder), t.dump_sources(spark, folder),
        t.dump_marked(spark, folder), t.dump_final(spark, folder),
    )
    return ended.select("run_id", "seq", "disposition")


@query(
    "session_groups",
    with_views("dump", then="""SELECT run_id, session_id, seq, authoritative,
    min(seq) OVER (PARTITION BY run_id, session_id) AS first_seq, count(*) OVER (PARTITION BY run_id, session_id) AS members
    FROM (SELECT run_id, session_id, seq, false AS authoritative FROM dump WHERE run_id <> 'run-3' AND loaded_status = 'Pending'
          AND label <> '(unmapped)' UNION ALL SELECT run_id, session_id, seq, true FROM dump WHERE run_id = 'run-3')"""),
)
def session_groups(spark, folder):
    rows = t.dump_messages(spark, folder)
    return dumps.session_groups(rows, rows.filter("run_id = 'run-3'"))


@query(
    "anchors",
    with_views("dump", "flush", then="""SELECT d.run_id, CASE WHEN d.run_id = 'run-0' THEN lo + 3 ELSE lo - 1 END AS starting_checkpoint,
    CASE WHEN d.run_id = 'run-1' THEN hi - 1 ELSE coalesce(f.checkpoint_seq, hi) END AS final_checkpoint,
    CASE WHEN d.run_id = 'run-1' THEN lo - 10 ELSE lo END AS range_min,
    CASE WHEN d.run_id = 'run-1' THEN hi + 10 ELSE hi END AS range_max
    FROM (SELECT run_id, min(seq) AS lo, max(seq) AS hi FROM dump GROUP BY run_id) d LEFT JOIN flush f ON d.run_id = f.run_id"""),
)
def anchors(spark, folder):
    return dumps.anchors(t.dump_messages(spark, folder), t.dump_meta(spark, folder), t.dump_flush(spark, folder))


@query(
    "order_messages",
    with_views("dump", then="SELECT run_id, seq, loaded_status AS status, session_id, timestamp_ms, label FROM dump"),
)
def order_messages(spark, folder):
    return dumps.order_messages(t.dump_messages(spark, folder))


@query(
    "order_occurrences",
    with_views("occ_n", then="SELECT run_id, occurrence_id, session_id, kind, last_activity, ordinal FROM occ_n"),
)
def order_occurrences(spark, folder):
    return dumps.order_occurrences(t.dump_occurrences(spark, folder))


@query(
    "written_documents",
    with_views("occ", then="""SELECT run_id, occurrence_id, coalesce(doc_id, occurrence_id) AS document_id,
    coalesce(doc_type, 'event') AS document_type, substr(blade_name, 5) AS blade FROM occ WHERE kind = 'Emit'"""),
)
def written_documents(spark, folder):
    return dumps.written_documents(t.dump_occurrences(spark, folder))


@query(
    "reconcile_flush",
    with_views("flush", "occ", "marked", "terminal", then="""SELECT f.run_id, f.events_written AS declared_written, w.n AS found_written,
    f.events_written = w.n AS written_match, f.messages_marked_done AS declared_done, m.n AS found_done,
    f.messages_marked_done = m.n AS done_match, f.checkpoint_seq AS declared_checkpoint, c.frontier AS found_checkpoint,
    f.checkpoint_seq IS NOT DISTINCT FROM c.frontier AS checkpoint_match
    FROM flush f JOIN (SELECT run_id, count(*) AS n FROM occ WHERE kind = 'Emit' GROUP BY run_id) w ON f.run_id = w.run_id
    JOIN (SELECT run_id, count(DISTINCT seq) AS n FROM marked GROUP BY run_id) m ON f.run_id = m.run_id
    JOIN (SELECT t.run_id, coalesce(max(CASE WHEN p.stop IS NULL OR seq < p.stop THEN seq END), -1) AS frontier
      FROM terminal t LEFT JOIN (SELECT run_id, min(seq) AS stop FROM terminal WHERE terminal IS NULL GROUP BY run_id) p
      ON t.run_id = p.run_id GROUP BY t.run_id) c ON f.run_id = c.run_id"""),
)
def reconcile_flush(spark, folder):
    return dumps.reconcile_flush(
        t.dump_messages(spark, folder), t.dump_occurrences(spark, folder), t.dump_sources(spark, folder),
        t.dump_start(spark, folder), t.dump_flush(spark, folder), t.dump_marked(spark, folder),
    )
