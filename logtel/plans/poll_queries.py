"""Queries over poll telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from logtel.operators import polls
from logtel.plans import tables as t
from logtel.plans.registry import query, rounded
from logtel.plans.views import with_views

_COUNTERS = ", ".join(f"sum({c}) AS total_{c}" for c in polls.STORE_COUNTERS)


@query(
    "source_metrics",
    with_views("cyc_adv", then=f"""SELECT source, count(*) AS cycle_count, count(*) FILTER (outcome = 'success') AS success_count,
    count(*) FILTER (outcome = 'skipped') AS skipped_count, count(*) FILTER (outcome = 'failed') AS failed_count,
    sum(records) AS total_records, sum(input_rows) AS total_input_rows, count(*) FILTER (advance_s > 0) AS checkpoint_count,
    sum(users) AS total_users, round(avg(records_per_sec) FILTER (outcome = 'success'), 6) AS avg_success_records_per_sec,
    round(avg(total_ms), 6) AS avg_cycle_ms,
    arg_max(cursor_lag_sec, completed_ms * 1000000 - arrival) FILTER (cursor_lag_sec IS NOT NULL) AS latest_cursor_lag_sec,
    round(sum(write_units), 6) AS total_write_units, {_COUNTERS},
    CASE WHEN count(*) FILTER (store_retries IS NOT NULL) > 0 THEN count(*) FILTER (store_retries > 0 OR store_throttled > 0
      OR store_failed > 0 OR store_cancelled > 0) END AS store_affected_cycles,
    max(completed_ms) - min(started_ms) AS duration_ms FROM cyc_adv GROUP BY source"""),
)
def source_metrics(spark, folder):
    ordered = t.cycles(spark, folder).withColumn("run_order", F.struct("arrival"))
    return rounded(polls.source_metrics(ordered))


_STATS = """round(avg(v), 6) AS avg, min(v) AS min, round(quantile_cont(v, 0.5), 6) AS p50,
    quantile_disc(v, 0.95) AS p95, max(v) AS max, count(v) AS count"""


@query(
    "duration_stats",
    with_views("cyc", then=f"""SELECT source, measure, {_STATS} FROM (
    SELECT source, 'query_ms' AS measure, query_ms AS v FROM cyc UNION ALL SELECT source, 'map_ms', map_ms FROM cyc
    UNION ALL SELECT source, 'write_ms', write_ms FROM cyc UNION ALL SELECT source, 'advance_ms', advance_ms FROM cyc)
    WHERE v IS NOT NULL GROUP BY source, measure"""),
)
def duration_stats(spark, folder):
    return rounded(polls.duration_stats(t.cycles(spark, folder)))


@query(
    "descriptive_stats",
    f"""SELECT l_returnflag, {_STATS} FROM (SELECT l_returnflag, l_extendedprice AS v FROM lineitem) GROUP BY l_returnflag""",
)
def descriptive_stats(spark, folder):
    return rounded(polls.descriptive_stats(t.load(spark, folder, "lineitem"), "l_extendedprice", ["l_returnflag"]))


@query(
    "poll_throughput",
    with_views("cyc_adv", then="""SELECT source,
    round(CASE WHEN rd > 0 THEN rw / (rd / 1000) ELSE 0 END, 6) AS read_rows_per_sec,
    round(CASE WHEN busy > 0 THEN rw / (busy / 1000) ELSE 0 END, 6) AS processing_rows_per_sec,
    round(CASE WHEN busy > 0 THEN rec / (busy / 1000) ELSE 0 END, 6) AS events_per_sec,
    round(CASE WHEN rec > 0 THEN rw / rec END, 6) AS rows_per_event, round(adv, 6) AS advance_seconds,
    round(CASE WHEN wall > 0 THEN adv / (wall / 1000) ELSE 0 END, 6) AS checkpoint_velocity FROM (
      SELECT source, sum(CASE WHEN q THEN input_rows ELSE 0 END) AS rw, sum(CASE WHEN q THEN records ELSE 0 END) AS rec,
      sum(CASE WHEN q THEN coalesce(query_ms, 0) + coalesce(map_ms, 0) ELSE 0 END) AS rd,
      sum(CASE WHEN q THEN total_ms ELSE 0 END) AS busy, sum(total_ms) AS wall, sum(advance_s) AS adv
      FROM (SELECT *, outcome = 'success' AND input_rows IS NOT NULL AS q FROM cyc_adv) GROUP BY source)"""),
)
def poll_throughput(spark, folder):
    return rounded(polls.poll_throughput(t.cycles(spark, folder)))


@query(
    "poll_throughput_per_cycle",
    with_views("cyc_adv", then="""SELECT source, run_id,
    round(CASE WHEN coalesce(query_ms, 0) + coalesce(map_ms, 0) > 0
      THEN input_rows / ((coalesce(query_ms, 0) + coalesce(map_ms, 0)) / 1000) ELSE 0 END, 6) AS read_rows_per_sec,
    round(CASE WHEN total_ms > 0 THEN input_rows / (total_ms / 1000) ELSE 0 END, 6) AS processing_rows_per_sec,
    round(CASE WHEN total_ms > 0 THEN records / (total_ms / 1000) ELSE 0 END, 6) AS events_per_sec,
    round(CASE WHEN records > 0 THEN input_rows / records END, 6) AS rows_per_event, advance_s AS advance_seconds,
    round(CASE WHEN total_ms > 0 THEN advance_s / (total_ms / 1000) ELSE 0 END, 6) AS checkpoint_velocity
    FROM cyc_adv WHERE outcome = 'success' AND input_rows IS NOT NULL"""),
)
def poll_throughput_per_cycle(spark, folder):
    return rounded(polls.poll_throughput_per_cycle(t.cycles(spark, folder)))


_MIXED = """, mc AS (SELECT 'r' || (arrival // 3) AS run_id, * EXCLUDE (run_id) FROM cyc WHERE outcome = 'success'),
    ms AS (SELECT 'r' || (arrival // 3) AS run_id, arrival % 50 AS at_ms, CASE WHEN arrival % 4 <> 0 THEN started_ms END AS ts_ms,
      arrival FROM cyc WHERE outcome <> 'success')"""


@query(
    "resolve_cycles",
    with_views("cyc", then="SELECT 1").removesuffix(" SELECT 1") + _MIXED + """ SELECT c.run_id, source, started_ms, records, arrival,
    CASE WHEN s.f IS NULL THEN 1 ELSE 0 END AS late, coalesce(s.f, c.f) AS first_at
    FROM (SELECT run_id, max(arrival) AS arrival, min(arrival) AS f FROM mc GROUP BY run_id) c
    JOIN (SELECT arrival, source, started_ms, records FROM mc) x USING (arrival)
    LEFT JOIN (SELECT run_id, min(arrival) AS f FROM ms GROUP BY run_id) s ON c.run_id = s.run_id""",
)
def resolve_cycles(spark, folder):
    resolved, _ = polls.resolve_cycles(t.mixed_stages(spark, folder), t.mixed_cycles(spark, folder))
    return resolved.select(
        "run_id", "source", "started_ms", "records", "arrival",
        F.col("run_order.late").alias("late"), F.col("run_order.at").alias("first_at"),
    )


@query(
    "unresolved_cycles",
    with_views("cyc", then="SELECT 1").removesuffix(" SELECT 1") + _MIXED + """ SELECT run_id, 'in-progress' AS outcome,
    CAST(coalesce(min(ts_ms - at_ms), 0) AS DOUBLE) AS started_ms, min(arrival) AS first_arrival FROM ms
    WHERE run_id NOT IN (SELECT run_id FROM mc) GROUP BY run_id""",
)
def unresolved_cycles(spark, folder):
    _, unresolved = polls.resolve_cycles(t.mixed_stages(spark, folder), t.mixed_cycles(spark, folder))
    return unresolved.select("run_id", "outcome", "started_ms", "first_arrival")


@query(
    "unresolved_start",
    with_views("stage", then="SELECT run_id, coalesce(min(ts_ms - at_ms), 0) AS started_ms FROM stage GROUP BY run_id"),
)
def unresolved_start(spark, folder):
    return polls.unresolved_start(t.stage_events(spark, folder))


_SPANS = """, bal AS (SELECT *, sum(CASE ev WHEN 'start' THEN 1 ELSE -1 END) OVER w AS b,
      sum(CASE ev WHEN 'start' THEN 1 ELSE 0 END) OVER w AS ns, sum(CASE ev WHEN 'start' THEN 0 ELSE 1 END) OVER w AS ne
      FROM stage WINDOW w AS (PARTITION BY run_id, stage ORDER BY at_ms, arrival)),
    orph AS (SELECT *, greatest(0, -min(b) OVER (PARTITION BY run_id, stage ORDER BY at_ms, arrival)) AS o FROM bal),
    marked2 AS (SELECT *, ev = 'end' AND o > coalesce(lag(o) OVER (PARTITION BY run_id, stage ORDER BY at_ms, arrival), 0) AS lone FROM orph),
    span AS (SELECT s.run_id, s.stage, s.at_ms AS start_ms, e.dur_ms, s.at_ms AS created_ms, s.arrival FROM marked2 s
      LEFT JOIN marked2 e ON e.ev = 'end' AND NOT e.lone AND s.run_id = e.run_id AND s.stage = e.stage AND s.ns = e.ne - e.o
      WHERE s.ev = 'start' UNION ALL SELECT run_id, stage, at_ms - dur_ms, dur_ms, at_ms, arrival FROM marked2 WHERE lone)"""


@query(
    "pair_stage_spans",
    with_views("stage", then="SELECT 1").removesuffix(" SELECT 1") + _SPANS
    + " SELECT run_id, stage, round(start_ms, 6) AS start_ms, dur_ms, created_ms, arrival, dur_ms IS NOT NULL AS completed FROM span",
)
def pair_stage_spans(spark, folder):
    return rounded(polls.pair_stage_spans(t.stage_events(spark, folder)))


@query(
    "span_lanes",
    with_views("stage", then="SELECT 1").removesuffix(" SELECT 1") + _SPANS + """ SELECT run_id, lane, f IS NOT NULL AS recorded,
    f IS NOT NULL AND f.d IS NULL AS open, round(coalesce(f.s, CASE WHEN lane IN ('kusto', 'map') THEN seal_start END, 0), 6) AS start_ms, coalesce(f.d, 0) AS dur_ms
    FROM (SELECT r.run_id, l.lane, f.f, max(CASE WHEN lane = 'seal' THEN f.f.s END) OVER (PARTITION BY r.run_id) AS seal_start FROM (SELECT DISTINCT run_id FROM span) r
      CROSS JOIN (SELECT unnest(['cursorRead', 'kusto', 'map', 'seal', 'write', 'advance']) AS lane) l
      LEFT JOIN (SELECT run_id, stage, arg_min({'s': start_ms, 'd': dur_ms}, created_ms * 1000000 + arrival) AS f FROM span
        GROUP BY run_id, stage) f ON r.run_id = f.run_id AND l.lane = f.stage)""",
)
def span_lanes(spark, folder):
    return rounded(polls.span_lanes(polls.pair_stage_spans(t.stage_events(spark, folder))))


_LANES = """, base AS (SELECT run_id, source, arrival % 6 <> 0 AS sealed, coalesce(query_ms, 0) AS q, coalesce(map_ms, 0) AS m,
      query_ms IS NOT NULL AS has, CASE WHEN arrival % 6 <> 0 THEN arrival % 5 ELSE 0 END AS s0,
      CASE WHEN arrival % 6 <> 0 THEN coalesce(query_ms, 0) + coalesce(map_ms, 0) + arrival % 11 ELSE 0 END AS sd, arrival AS a FROM cyc),
    lanes AS (SELECT run_id, source, 'cursorRead' AS lane, true AS recorded, 0 AS start_ms, a % 5 AS dur_ms FROM base
      UNION ALL SELECT run_id, source, 'kusto', has, s0, q FROM base
      UNION ALL SELECT run_id, source, 'map', has, s0 + q, m FROM base
      UNION ALL SELECT run_id, source, 'seal', sealed, s0 + q + m, greatest(sd - q - m, 0) FROM base
      UNION ALL SELECT run_id, source, 'write', true, a % 100, a % 23 FROM base
      UNION ALL SELECT run_id, source, 'advance', true, a % 200, a % 3 FROM base)"""


@query(
    "stage_lanes",
    with_views("cyc", then="SELECT 1").removesuffix(" SELECT 1") + _LANES + """ SELECT run_id, source, lane, recorded, false AS open,
    round(start_ms, 6) AS start_ms, round(dur_ms, 6) AS dur_ms FROM lanes""",
)
def stage_lanes(spark, folder):
    return rounded(polls.stage_lanes(t.cycles(spark, folder)))


@query(
    "lane_stats",
    with_views("cyc", then="SELECT 1").removesuffix(" SELECT 1") + _LANES + """ SELECT source, lane, round(avg(v), 6) AS avg,
    round(min(v), 6) AS min, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_disc(v, 0.95), 6) AS p95,
    round(max(v), 6) AS max, count(v) AS count FROM (SELECT source, lane, CAST(dur_ms AS DOUBLE) AS v FROM lanes WHERE recorded)
    GROUP BY source, lane""",
)
def lane_stats(spark, folder):
    return rounded(polls.lane_stats(polls.stage_lanes(t.cycles(spark, folder))))


@query(
    "trend_series",
    with_views("cyc", then="""SELECT source, run_id, completed_ms AS at_ms, 'throughput' AS series,
    round(input_rows / (total_ms / 1000), 6) AS value FROM cyc WHERE outcome = 'success' AND input_rows IS NOT NULL AND total_ms > 0
    UNION ALL SELECT source, run_id, completed_ms, 'records', records FROM cyc WHERE outcome = 'success'"""),
)
def trend_series(spark, folder):
    return rounded(polls.trend_series(t.cycles(spark, folder)))


@query(
    "cycle_elapsed",
    with_views("cyc", then="""SELECT run_id, round(CASE WHEN total_ms > 0 THEN total_ms ELSE greatest(arrival % 5,
    CASE WHEN arrival % 6 <> 0 THEN arrival % 5 + coalesce(query_ms, 0) + coalesce(map_ms, 0) + arrival % 11 ELSE 0 END,
    arrival % 100 + arrival % 23, arrival % 200 + arrival % 3) END, 6) AS elapsed_ms FROM cyc"""),
)
def cycle_elapsed(spark, folder):
    return rounded(polls.cycle_elapsed(t.cycles(spark, folder)))


@query(
    "select_source",
    with_views("cyc", then="SELECT source, false AS is_pending FROM cyc GROUP BY source ORDER BY min(started_ms), source LIMIT 1"),
)
def select_source(spark, folder):
    resolved, unresolved = polls.resolve_cycles(t.mixed_stages(spark, folder), t.cycles(spark, folder))
    return polls.select_source(resolved, unresolved, preferred="no such source")


@query(
    "select_cycle",
    with_views("cyc", then="SELECT source, arg_max(run_id, started_ms) AS run_id FROM cyc GROUP BY source"),
)
def select_cycle(spark, folder):
    return polls.select_cycle(t.cycles(spark, folder))
