"""The same inputs as SQL common table expressions, for the engine that checks the results."""

from __future__ import annotations

MS = "(epoch_us({}) // 1000)"


def _every(n: int, c: str, value: str) -> str:
    return f"CASE WHEN {c} % {n} <> 0 THEN {value} END"


_STATUS = (
    "CASE WHEN event_type = 'error' THEN 'Skipped' "
    "WHEN event_type = 'signup' AND event_id % 97 = 0 THEN 'Pending' ELSE 'Done' END"
)
_SESSION = "'s' || user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR)"
_E = MS.format("ts")
_O = MS.format("o_orderdate")


def _mod(n: int, name: str) -> str:
    return f"CAST(o_orderkey % {n} AS DOUBLE) AS {name}"


_WINDOW_END = _every(7, "o_orderkey", f"{_O} - (o_orderkey % 3) * 100000")

VIEWS: dict[str, str] = {
    "msg": f"""SELECT user_id % 4 AS partition_id, event_id AS seq, CAST(event_id * 128 AS VARCHAR) AS msg_offset,
        {_E} AS enqueued_ms, {_SESSION} AS partition_key, props, event_type FROM events""",
    "heads": "SELECT partition_id, min(seq) AS begin_seq, max(seq) AS last_seq FROM msg GROUP BY partition_id",
    "ckpt": """SELECT partition_id, CAST(floor(max(seq) * 0.5) AS BIGINT) AS seq FROM msg WHERE partition_id <> 3
        GROUP BY partition_id""",
    "dump": f"""SELECT 'run-' || (user_id % 4) AS run_id, event_id AS seq, event_id, event_type, {_E} AS ms,
        {_SESSION} AS session_id, {_SESSION} || ':' || (event_id % 2) AS occurrence_id, {_STATUS} AS final_status,
        CASE WHEN event_type = 'error' THEN 'Skipped' ELSE 'Pending' END AS loaded_status,
        {_every(31, 'event_id', _E)} AS timestamp_ms,
        CASE WHEN event_id % 17 = 0 THEN '(unmapped)' ELSE event_type END AS label FROM events""",
    "occ": """SELECT run_id, session_id, occurrence_id, CASE WHEN occurrence_id LIKE '%:0' THEN 'Emit' ELSE 'Acknowledge'
        END AS kind, CAST(max(ms) AS VARCHAR) AS last_activity,
        CASE WHEN min(event_type) <> 'click' THEN 'd-' || session_id END AS doc_id,
        CASE WHEN min(event_type) = 'purchase' THEN 'sale' END AS doc_type, 'Ext/' || min(event_type) AS blade_name
        FROM dump WHERE final_status = 'Done' GROUP BY run_id, session_id, occurrence_id""",
    "occ_n": """SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY last_activity, session_id, occurrence_id)
        AS ordinal FROM occ""",
    "src": "SELECT run_id, occurrence_id, seq FROM dump WHERE final_status = 'Done'",
    "marked": """SELECT run_id, seq FROM dump WHERE final_status = 'Done'
        OR (final_status = 'Pending' AND event_id % 194 = 0)""",
    "flush": """SELECT a.run_id, n + CASE WHEN a.run_id = 'run-2' THEN 1 ELSE 0 END AS events_written,
        m AS messages_marked_done, CASE WHEN hi % 5 <> 0 THEN hi END AS checkpoint_seq
        FROM (SELECT run_id, count(*) AS n FROM occ WHERE kind = 'Emit' GROUP BY run_id) a
        JOIN (SELECT run_id, count(*) AS m FROM marked GROUP BY run_id) b ON a.run_id = b.run_id
        JOIN (SELECT run_id, max(seq) AS hi FROM dump GROUP BY run_id) c ON a.run_id = c.run_id""",
    "terminal": """SELECT d.run_id, d.seq, d.loaded_status, s.at_ord, l.last_ord, m.seq IS NOT NULL AS is_marked,
        CASE WHEN d.loaded_status = 'Skipped' THEN 0 WHEN s.at_ord IS NOT NULL THEN s.at_ord
             WHEN m.seq IS NOT NULL THEN l.last_ord + 1 END AS terminal
        FROM dump d
        LEFT JOIN (SELECT s.run_id, s.seq, min(o.ordinal) AS at_ord FROM src s JOIN occ_n o
                   ON s.run_id = o.run_id AND s.occurrence_id = o.occurrence_id GROUP BY s.run_id, s.seq) s
          ON d.run_id = s.run_id AND d.seq = s.seq
        LEFT JOIN marked m ON d.run_id = m.run_id AND d.seq = m.seq
        LEFT JOIN (SELECT run_id, max(ordinal) AS last_ord FROM occ_n GROUP BY run_id) l ON d.run_id = l.run_id""",
    "cyc": f"""SELECT CAST(event_id AS VARCHAR) AS run_id, 'src-' || (user_id % 3) AS source,
        CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'success' END AS outcome,
        {_E} AS started_ms, {_E} + (event_id % 7) * 500 AS completed_ms,
        CAST((event_id % 7) * 500 AS DOUBLE) AS total_ms, CAST(event_id % 41 AS DOUBLE) AS records,
        CASE WHEN event_id % 7 > 0 THEN CAST(event_id % 41 AS DOUBLE) / (CAST((event_id % 7) * 500 AS DOUBLE) / 1000)
             ELSE CAST(0 AS DOUBLE) END AS records_per_sec,
        {_every(8, 'event_id', 'CAST(user_id % 10 AS DOUBLE)')} AS users,
        CASE WHEN event_id % 3 = 0 THEN value END AS cursor_lag_sec,
        {_every(4, 'event_id', 'value * 10')} AS query_ms, {_every(4, 'event_id', 'value')} AS map_ms,
        {_every(9, 'event_id', 'value * 2')} AS write_ms,
        {_every(7, 'event_id', 'CAST(event_id % 13 AS DOUBLE)')} AS advance_ms,
        {_every(2, 'event_id', 'value')} AS write_units,
        {_every(5, 'event_id', 'CAST((event_id % 97) * 10 AS DOUBLE)')} AS input_rows,
        CASE WHEN event_id % 10 >= 3 THEN CAST(event_id % 3 AS DOUBLE) END AS store_retries,
        CASE WHEN event_id % 10 >= 3 THEN CAST(event_id % 11 AS DOUBLE) END AS store_throttled,
        CASE WHEN event_id % 10 >= 3 THEN CAST(event_id % 50 AS DOUBLE) END AS store_attempted,
        CASE WHEN event_id % 10 >= 3 THEN CAST(event_id % 40 AS DOUBLE) END AS store_succeeded,
        CASE WHEN event_id % 10 >= 3 THEN CAST(event_id % 4 AS DOUBLE) END AS store_failed,
        CASE WHEN event_id % 10 >= 3 THEN CAST(event_id % 2 AS DOUBLE) END AS store_cancelled,
        {_every(6, 'event_id', _E + ' - 300000')} AS window_start_ms, {_E} - (event_id % 3) * 150000 AS window_end_ms,
        event_id AS arrival FROM events""",
    "cyc_adv": """SELECT *, CASE WHEN outcome = 'success' AND window_start_ms IS NOT NULL
        THEN greatest(0, (window_end_ms - window_start_ms) / 1000.0::DOUBLE) ELSE 0 END AS advance_s FROM cyc""",
    "stage": f"""SELECT 'r' || (user_id % 50) AS run_id,
        CASE event_id % 3 WHEN 0 THEN 'seal' WHEN 1 THEN 'write' ELSE 'cursorRead' END AS stage,
        CASE WHEN event_type IN ('purchase', 'error') THEN 'end' ELSE 'start' END AS ev,
        CAST(({_E} - 1704067200000) // 3600000 * 3600000 AS DOUBLE) AS at_ms,
        CASE WHEN event_type IN ('purchase', 'error') THEN value END AS dur_ms,
        {_every(9, 'event_id', _E)} AS ts_ms, event_id AS arrival FROM events""",
    "iter": f"""SELECT o_orderpriority AS run_id, CAST(o_orderkey AS VARCHAR) AS iteration_id,
        'c' || (o_custkey % 3) AS client_id, 'shard-' || (o_custkey % 12) AS shard_id, o_orderkey AS arrival,
        {_every(101, 'o_orderkey', _O)} AS started_ms, {_every(103, 'o_orderkey', _O + ' + o_orderkey % 1000')} AS completed_ms,
        {_every(7, 'o_orderkey', _O + ' - 300000')} AS window_start_ms, {_WINDOW_END} AS window_end_ms,
        {', '.join(_mod(n, c) for n, c in (
            (1000, 'total_ms'), (100, 'lease_acquire'), (300, 'poll_source'), (20, 'store_setup'), (30, 'rehydrate_state'),
            (10, 'duplicate_rows'), (250, 'process_events'), (90, 'flush'), (15, 'advance_checkpoint'),
            (5, 'query_build'), (50, 'first_row'), (200, 'stream_rows'), (45, 'map_rows'), (500, 'rows_fetched'),
            (450, 'messages_processed'), (50, 'events_finalized'), (70, 'flush_documents'), (2, 'checkpoint_advancements'),
            (11, 'backlog_messages'), (37, 'blocked_ms')))},
        CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END AS full_flushes,
        CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0 END AS partial_flushes,
        CASE WHEN o_orderkey % 19 = 0 THEN 1.0::DOUBLE ELSE 0 END AS blocked_messages,
        CAST(o_orderkey * 1024 AS DOUBLE) AS managed_bytes, CAST(o_custkey * 2048 AS DOUBLE) AS working_set_bytes,
        CAST(floor(o_totalprice) AS DOUBLE) AS gc_heap_bytes,
        {_every(13, 'o_orderkey', f'CAST({_O} AS DOUBLE)')} AS previous, CAST({_O} + 10000 AS DOUBLE) AS upper_ms,
        {_every(17, 'o_orderkey', f'CAST({_O} + (o_orderkey % 5) * 1000 - 1000 AS DOUBLE)')} AS advanced_to,
        o_orderkey AS k, {_O} AS ms, o_orderkey % 3 <> 0 AS has_pipe FROM orders""",
    "run": f"""SELECT o_orderpriority AS run_id, 'label ' || o_orderpriority AS label,
        CASE WHEN o_orderpriority NOT LIKE '1%' THEN {MS.format('min(o_orderdate)')} - 1000 END AS started_ms,
        CASE WHEN o_orderpriority NOT LIKE '2%' THEN {MS.format('max(o_orderdate)')} + 5000 END AS completed_ms,
        CAST(count(*) AS DOUBLE) AS duration_ms FROM orders GROUP BY o_orderpriority""",
    "mem": f"""SELECT o_orderpriority AS run_id, CAST(o_orderkey AS VARCHAR) AS iteration_id,
        {_every(29, 'o_orderkey', _O + ' + 500')} AS at_ms, CAST(o_orderkey * 4096 AS DOUBLE) AS managed_bytes,
        CAST(o_custkey * 8192 AS DOUBLE) AS working_set_bytes, CAST(floor(o_totalprice) AS DOUBLE) AS gc_heap_bytes
        FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
    "times": """SELECT r.run_id, coalesce(r.started_ms, i.s, 0) AS t0,
        coalesce(r.completed_ms, i.c, coalesce(r.started_ms, i.s, 0)) AS t1 FROM run r LEFT JOIN (
        SELECT run_id, min(started_ms) AS s, arg_min(completed_ms, {'a': coalesce(started_ms, 0), 'b': arrival})
        FILTER (completed_ms IS NOT NULL) AS c FROM iter GROUP BY run_id) i ON r.run_id = i.run_id""",
    "sized": """SELECT i.*, t.t0, t.t1,
        lease_acquire + poll_source + store_setup + rehydrate_state + duplicate_rows + process_events + flush
          + advance_checkpoint AS measured,
        CASE WHEN total_ms > 0 THEN total_ms WHEN completed_ms >= started_ms THEN CAST(completed_ms - started_ms AS DOUBLE)
             ELSE lease_acquire + poll_source + store_setup + rehydrate_state + duplicate_rows + process_events + flush
               + advance_checkpoint END AS total FROM iter i JOIN times t ON i.run_id = t.run_id""",
    "spanned": """SELECT *, CASE WHEN total - measured > 0.5 THEN total ELSE measured END AS span FROM sized""",
    "placed": """SELECT *, CASE WHEN started_ms IS NOT NULL THEN greatest(0, CAST(started_ms - t0 AS DOUBLE)) ELSE
        coalesce(sum(CASE WHEN started_ms IS NULL THEN span END) OVER (PARTITION BY run_id, started_ms IS NULL
          ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS st FROM spanned""",
    "axis": """SELECT *, coalesce(CAST(started_ms AS DOUBLE), t0 + st) AS st_at,
        CASE WHEN completed_ms IS NOT NULL THEN greatest(0, CAST(completed_ms - t0 AS DOUBLE)) ELSE st + total END AS done_rel,
        coalesce(CAST(window_end_ms AS DOUBLE), CAST(completed_ms AS DOUBLE), t0 + st + total) AS x_at FROM placed""",
    "points": """SELECT *, greatest(0, x_at - t0) AS x, events_finalized / greatest(total / 1000, 0.001) AS eps FROM axis""",
    "mem_points": """SELECT m.run_id, iteration_id, CAST(coalesce(greatest(0, at_ms - t0), 0) AS DOUBLE) AS x_ms,
        CAST(coalesce(at_ms, t0) AS DOUBLE) AS x_at_ms, managed_bytes / 1048576 AS managed_mib,
        working_set_bytes / 1048576 AS working_set_mib, gc_heap_bytes / 1048576 AS gc_heap_mib
        FROM mem m JOIN times t ON m.run_id = t.run_id
        UNION ALL SELECT run_id, iteration_id, done_rel, coalesce(CAST(completed_ms AS DOUBLE), done_rel),
        managed_bytes / 1048576, working_set_bytes / 1048576, gc_heap_bytes / 1048576
        FROM axis WHERE run_id NOT IN (SELECT run_id FROM mem)""",
    "snap": f"""SELECT i.*, CASE WHEN has_pipe THEN 'pipeline' ELSE 'aggregate' END AS snapshot_source,
        CASE WHEN has_pipe THEN coalesce(CASE WHEN k % 11 <> 0 THEN ms + k % 800 END, ms + k % 700)
             ELSE coalesce(completed_ms, started_ms, 0) END AS observed_ms,
        CASE WHEN has_pipe AND k % 5 <> 0 AND k % 25 <> 1 THEN window_end_ms - (k % 4) * 1000 END AS checkpoint_ms,
        CASE WHEN has_pipe THEN CAST(k % 6 AS DOUBLE) ELSE rows_fetched END AS window_messages,
        CASE WHEN has_pipe THEN CAST(k % 5000 AS DOUBLE)
             ELSE sum(rows_fetched) OVER (PARTITION BY run_id, shard_id) END AS total_shard_messages,
        CASE WHEN has_pipe THEN CAST(k % 9 AS DOUBLE) ELSE backlog_messages END AS backlog,
        CASE WHEN has_pipe THEN CASE WHEN k % 8 = 1 THEN 2.0 ELSE 0 END ELSE blocked_messages END AS blocked,
        CASE WHEN has_pipe THEN CASE WHEN k % 2 = 1 THEN 0 ELSE CAST(k % 4 AS DOUBLE) END ELSE backlog_messages END AS pending,
        CASE WHEN has_pipe THEN CAST(k % 12 AS DOUBLE) ELSE messages_processed END AS done,
        CASE WHEN has_pipe THEN CAST(k % 3 AS DOUBLE) ELSE greatest(0, rows_fetched - messages_processed) END AS skipped,
        CASE WHEN has_pipe THEN CAST(k % 2 AS DOUBLE) ELSE 0 END AS duplicate_acknowledged, CAST(0 AS DOUBLE) AS poisoned,
        CASE WHEN NOT has_pipe THEN false
             WHEN (k % 2 = 0 AND k % 4 > 0) OR k % 8 = 1 OR k % 5 = 0 THEN true
             WHEN k % 25 <> 1 AND window_end_ms IS NOT NULL THEN (k % 4) > 0
             ELSE coalesce(coalesce(CASE WHEN k % 11 <> 0 THEN ms + k % 800 END, ms + k % 700) < completed_ms, false) END
          AS is_incomplete FROM iter i""",
    "tele": f"""SELECT event_id, {_every(50, 'event_id', "'s' || user_id")} AS session_key,
        {_every(20, 'event_id', _E)} AS client_ms, {_every(60, 'event_id', _E)} AS precise_ms, event_type, props FROM events""",
    "pull": f"""SELECT event_id, CAST(user_id AS VARCHAR) AS object_id, 's' || user_id AS session_id,
        {_every(40, 'event_id', _E)} AS client_ms, {_E} + 60000 AS ts_ms FROM events""",
    "marks": f"""SELECT CAST(c_custkey AS VARCHAR) AS object_id, w AS watermark_ms FROM customer LEFT JOIN (
        SELECT user_id, CASE WHEN user_id % 10 <> 7 THEN max({_E}) END AS w FROM events
        WHERE event_type <> 'purchase' GROUP BY user_id) s ON c_custkey = s.user_id""",
    "env": """SELECT 's' || conv_id AS session_id, 'e' || conv_id AS event_id, conv_id, turn,
        CASE role WHEN 'system' THEN 'opening' WHEN 'user' THEN 'question' ELSE 'answer' END AS part,
        conv_id * 1000 + turn AS seq, CAST(conv_id % 4 AS VARCHAR) AS partition_id,
        conv_id * 3600000 + turn * 60000 AS received_ms, role || '-' || (length(text) % 7) AS dedupe_key, length(text) AS chars,
        conv_id % 13 = 0 AS notice, conv_id % 13 <> 0 OR role = 'system' AS mapped FROM conversations""",
    "env_d": """SELECT *, rep OR (part <> 'answer' AND row_number() OVER (PARTITION BY conv_id, part, rep ORDER BY seq) > 1)
        AS is_duplicate FROM (SELECT *, NOT notice AND row_number() OVER (PARTITION BY conv_id, dedupe_key ORDER BY seq) > 1 AS rep
        FROM env WHERE mapped)""",
    "asm": """SELECT session_id, event_id, conv_id, notice, count(*) AS part_count, min(received_ms) AS first_ms, max(received_ms) AS last_ms,
        bool_or(part = 'opening') AS has_opening, bool_or(part = 'question') AS has_question,
        arg_min(dedupe_key, seq) FILTER (part = 'opening') AS opening_tag,
        arg_min(dedupe_key, seq) FILTER (part = 'answer') AS answer_tag,
        arg_min(chars, seq) FILTER (part = 'answer') AS answer_chars,
        arg_min(chars, seq) FILTER (part = 'question') AS question_chars FROM env_d WHERE NOT is_duplicate
        GROUP BY session_id, event_id, conv_id, notice""",
}


def with_views(*names: str, then: str) -> str:
    """``then`` with the named views, and those they read, in front of it."""
    needed: list[str] = []

    def add(name: str) -> None:
        text = VIEWS[name]
        for other in VIEWS:
            if other != name and _reads(text, other):
                add(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed) + " " + then


def _reads(text: str, view: str) -> bool:
    words = text.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return any(a.upper() in ("FROM", "JOIN") and b == view for a, b in zip(words, words[1:]))
