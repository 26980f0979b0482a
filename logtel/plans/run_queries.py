"""Queries over benchmark runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from logtel.functions.scalars import natural_sort_key
from logtel.operators import runs
from logtel.operators.layout import counted
from logtel.plans import tables as t
from logtel.plans.registry import query, rounded
from logtel.plans.views import with_views


def _times(spark, folder):
    return runs.run_times(t.runs(spark, folder), t.iterations(spark, folder))


def _timed_axis(spark, folder):
    """Run times, computed once for all that needs them, and the axis made with them."""
    times = counted(_times(spark, folder))
    return times, runs.on_time_axis(t.iterations(spark, folder), times)


def _axis(spark, folder):
    return _timed_axis(spark, folder)[1]


@query(
    "run_times",
    with_views("times", then="SELECT run_id, t0 AS run_started_ms, t1 AS run_completed_ms FROM times"),
)
def run_times(spark, folder):
    return _times(spark, folder)


_STAGES = list(runs.STAGES)
_SEGMENTS = " UNION ALL ".join(
    f"""SELECT run_id, iteration_id, client_id, shard_id, '{s}' AS stage, {' + '.join(['0', *_STAGES[:i]])} AS b, {s} AS d, st, st_at
    FROM axis""" for i, s in enumerate(_STAGES)
) + " UNION ALL SELECT run_id, iteration_id, client_id, shard_id, 'unaccounted', measured, total - measured, st, st_at FROM axis WHERE total - measured > 0.5"


@query(
    "stage_timeline",
    with_views("axis", then=f"""SELECT run_id, iteration_id, client_id, shard_id, stage, st + b AS start_ms, st + b + d AS end_ms,
    st_at + b AS start_at_ms, st_at + b + d AS end_at_ms, d AS duration_ms, d AS original_duration_ms FROM ({_SEGMENTS})"""),
)
def stage_timeline(spark, folder):
    return rounded(runs.stage_timeline(_axis(spark, folder)))


_SERIES = " UNION ALL ".join(
    f"SELECT run_id, iteration_id, x AS x_ms, x_at AS x_at_ms, '{n}' AS series, CAST({c} AS DOUBLE) AS value FROM points"
    for n, c in (
        ("events_per_sec", "round(eps, 6)"), ("backlog", "backlog_messages"), ("blocked_ms", "blocked_ms"),
        ("advanced_to", "advanced_to"), ("upper", "upper_ms"), ("full_flushes", "full_flushes"),
        ("partial_flushes", "partial_flushes"), ("flush_documents", "flush_documents"),
    )
) + "".join(
    f" UNION ALL SELECT run_id, iteration_id, x_ms, x_at_ms, '{n}', round({n}, 6) FROM mem_points"
    for n in ("managed_mib", "working_set_mib", "gc_heap_mib")
)


@query(
    "iteration_series",
    with_views("points", "mem_points", then=f"SELECT * FROM ({_SERIES}) WHERE value IS NOT NULL"),
)
def iteration_series(spark, folder):
    times, axis = _timed_axis(spark, folder)
    return rounded(runs.iteration_series(axis, t.memory_samples(spark, folder), times))


@query(
    "checkpoint_series",
    with_views("points", then="""SELECT run_id, iteration_id, x AS x_ms, x_at AS x_at_ms, 'advanced_to' AS series, advanced_to AS value
    FROM points WHERE advanced_to IS NOT NULL UNION ALL SELECT run_id, iteration_id, x, x_at, 'upper', upper_ms FROM points"""),
)
def checkpoint_series(spark, folder):
    return runs.checkpoint_series(runs.iteration_points(_axis(spark, folder)))


@query(
    "flush_volume",
    with_views("points", then="""SELECT run_id, iteration_id, x_at AS x_at_ms, flush_documents, full_flushes, partial_flushes,
    round(flush_documents / greatest(1, max(flush_documents) OVER (PARTITION BY run_id)) * 100, 6) AS height_pct FROM points
    WHERE partial_flushes > 0"""),
)
def flush_volume(spark, folder):
    points = runs.iteration_points(_axis(spark, folder))
    return rounded(runs.flush_volume(points, show_full=False, show_partial=True))


_BOUNDS = """, part AS (SELECT run_id, max(st + span) AS seg_end, min(st_at) AS seg_lo, max(st_at + span) AS seg_hi, max(x) AS x_max,
      min(x_at) AS x_lo, max(x_at) AS x_hi FROM points GROUP BY run_id),
    memb AS (SELECT run_id, min(x_at_ms) AS m_lo, max(x_at_ms) AS m_hi FROM mem_points GROUP BY run_id),
    shot AS (SELECT run_id, min(coalesce(window_start_ms, observed_ms)) AS s_lo, max(observed_ms) AS s_hi,
      min(window_start_ms) AS d_lo, max(window_end_ms) AS d_hi FROM snap GROUP BY run_id),
    bounds AS (SELECT t.run_id, t0, t1, greatest(0, t1 - t0) AS duration_ms, greatest(r.duration_ms, t1 - t0, seg_end, x_max) AS tl_end,
      least(CAST(t0 AS DOUBLE), seg_lo, x_lo, m_lo, CAST(s_lo AS DOUBLE)) AS lo,
      greatest(CAST(t1 AS DOUBLE), seg_hi, x_hi, m_hi, CAST(s_hi AS DOUBLE)) AS hi, d_lo, d_hi
      FROM times t JOIN run r ON t.run_id = r.run_id JOIN part p ON t.run_id = p.run_id JOIN memb m ON t.run_id = m.run_id
      JOIN shot s ON t.run_id = s.run_id)"""
_WITH_BOUNDS = with_views("points", "mem_points", "snap", "run", "times", then="SELECT 1").removesuffix(" SELECT 1") + _BOUNDS


def _bounds(spark, folder):
    return _bounds_of(spark, folder, *_timed_axis(spark, folder))


def _bounds_of(spark, folder, times, axis):
    shots = runs.pipeline_snapshots(t.iterations(spark, folder))
    return runs.run_bounds(
        t.runs(spark, folder), times, axis, t.memory_samples(spark, folder), shots
    )


@query(
    "run_bounds",
    _WITH_BOUNDS + """ SELECT run_id, t0 AS run_started_ms, t1 AS run_completed_ms, duration_ms, tl_end AS timeline_end_ms,
    lo AS timeline_start_ms, hi AS latest_observed_ms, CASE WHEN d_hi > d_lo THEN CAST(d_lo AS DOUBLE) ELSE lo END AS domain_start_ms,
    CASE WHEN d_hi > d_lo THEN CAST(d_hi AS DOUBLE) ELSE hi END AS domain_end_ms FROM bounds""",
)
def run_bounds(spark, folder):
    return _bounds(spark, folder)


RANGE_MINUTES = 60 * 24 * 400


@query(
    "points_in_range",
    _WITH_BOUNDS + f""" SELECT p.run_id, iteration_id, x_at AS x_at_ms, backlog_messages AS backlog FROM points p JOIN bounds b
    ON p.run_id = b.run_id WHERE x_at BETWEEN greatest(lo, hi - {RANGE_MINUTES} * 60000.0::DOUBLE) AND hi""",
)
def points_in_range(spark, folder):
    times, axis = _timed_axis(spark, folder)
    points = runs.iteration_points(axis)
    return runs.points_in_range(points, _bounds_of(spark, folder, times, axis), RANGE_MINUTES).select(
        "run_id", "iteration_id", "x_at_ms", "backlog"
    )


@query(
    "segments_in_range",
    _WITH_BOUNDS + f""" SELECT s.run_id, iteration_id, client_id, shard_id, stage, greatest(sa, f) - t0 AS start_ms,
    least(ea, hi) - t0 AS end_ms, greatest(sa, f) AS start_at_ms, least(ea, hi) AS end_at_ms,
    greatest(0, least(ea, hi) - greatest(sa, f)) AS duration_ms, d AS original_duration_ms FROM (
      SELECT q.*, st_at + q.b AS sa, st_at + q.b + d AS ea FROM ({_SEGMENTS}) q) s
    JOIN (SELECT *, greatest(lo, hi - {RANGE_MINUTES} * 60000.0::DOUBLE) AS f FROM bounds) w ON s.run_id = w.run_id
    WHERE ea >= f AND sa <= hi""",
)
def segments_in_range(spark, folder):
    times, axis = _timed_axis(spark, folder)
    segments = runs.stage_timeline(axis)
    return rounded(runs.segments_in_range(segments, _bounds_of(spark, folder, times, axis), RANGE_MINUTES))


_READ = "(query_build + first_row + stream_rows + map_rows)"
_ADV = "CASE WHEN previous IS NULL OR advanced_to IS NULL THEN 0 ELSE greatest(0, (advanced_to - previous) / 1000) END"
_DIAL_SQL = """round(CASE WHEN rd > 0 THEN rw / (rd / 1000) ELSE 0 END, 6) AS read_rows_per_sec,
    round(CASE WHEN tot > 0 THEN rw / (tot / 1000) ELSE 0 END, 6) AS processing_rows_per_sec,
    round(CASE WHEN tot > 0 THEN ev / (tot / 1000) ELSE 0 END, 6) AS events_per_sec,
    round(CASE WHEN ev > 0 THEN rw / ev END, 6) AS rows_per_event, round(adv, 6) AS advance_seconds,
    round(CASE WHEN tot > 0 THEN adv / (tot / 1000) ELSE 0 END, 6) AS checkpoint_velocity"""


@query(
    "run_throughput",
    with_views("iter", then=f"""SELECT run_id, {_DIAL_SQL} FROM (SELECT run_id, sum({_READ}) AS rd, sum(rows_fetched) AS rw,
    sum(total_ms) AS tot, sum(events_finalized) AS ev, sum({_ADV}) AS adv FROM iter GROUP BY run_id)"""),
)
def run_throughput(spark, folder):
    return rounded(runs.run_throughput(t.iterations(spark, folder)))


_PER_ITERATION = f"""(SELECT run_id, iteration_id, {_DIAL_SQL} FROM (SELECT run_id, iteration_id, {_READ} AS rd, rows_fetched AS rw,
    total_ms AS tot, events_finalized AS ev, {_ADV} AS adv FROM iter))"""


@query("iteration_throughput", with_views("iter", then=f"SELECT * FROM {_PER_ITERATION}"))
def iteration_throughput(spark, folder):
    return rounded(runs.iteration_throughput(t.iterations(spark, folder)))


def _trend(per_iteration: str) -> str:
    return " UNION ALL ".join(
        f"SELECT run_id, iteration_id, '{d}' AS metric, {d} AS value FROM {per_iteration}" for d in runs.DIALS
    )


_TREND = _trend(_PER_ITERATION)
# The same without rounding.
_EXACT_TREND = _trend(_PER_ITERATION.replace("round(", "(").replace(", 6)", ")"))


@query(
    "trend_points",
    with_views("points", then=f"""SELECT m.run_id, m.iteration_id, metric, value, p.iteration_id || ' · ' || shard_id AS label,
    x_at AS x_at_ms FROM ({_TREND}) m JOIN points p ON m.run_id = p.run_id AND m.iteration_id = p.iteration_id
    WHERE value IS NOT NULL"""),
)
def trend_points(spark, folder):
    its = t.iterations(spark, folder)
    return rounded(runs.trend_points(runs.iteration_throughput(its), runs.iteration_points(_axis(spark, folder))))


@query(
    "dial_ranges",
    with_views("iter", then=f"""SELECT run_id, metric, round(greatest(0, lo - hi * 0.1::DOUBLE), 5) AS range_min,
    round(greatest(hi + hi * 0.1::DOUBLE, greatest(0, lo - hi * 0.1::DOUBLE) + 1), 5) AS range_max, round(p, 5) AS p95 FROM (
      SELECT run_id, metric, min(value) AS lo, max(value) AS hi, quantile_disc(value, 0.95) AS p FROM ({_EXACT_TREND})
      WHERE value IS NOT NULL GROUP BY run_id, metric)"""),
)
def dial_ranges(spark, folder):
    its = t.iterations(spark, folder)
    return rounded(runs.dial_ranges(runs.iteration_throughput(its), runs.run_throughput(its)), 5)


_ORDER = "coalesce(started_ms, -1) * 10000000 + arrival"
_SUMMARY = f"""(SELECT run_id, count(*) AS iteration_count,
    {', '.join(f'sum({c}) AS {c}' for c in ('rows_fetched', 'messages_processed', 'events_finalized', 'flush_documents',
                                            'full_flushes', 'partial_flushes', 'checkpoint_advancements'))},
    greatest(0, arg_max_null(completed_ms, {{'a': coalesce(started_ms, -1), 'b': iteration_id}})
      - arg_min_null(started_ms, {{'a': coalesce(started_ms, -1), 'b': iteration_id}})) AS duration_ms,
    {', '.join(f'avg({s}) AS avg_{s}' for s in _STAGES)}, avg(total_ms) AS avg_total_ms,
    avg(backlog_messages) AS avg_backlog, greatest(0, max(backlog_messages)) AS max_backlog, sum(blocked_ms) AS blocked_ms
    FROM iter GROUP BY run_id)"""
_SUMMARY_EPS = "CASE WHEN duration_ms > 0 THEN events_finalized / (duration_ms / 1000) ELSE 0 END"


@query("summarize_iterations", with_views("iter", then=f"""SELECT * REPLACE (round(avg_total_ms, 6) AS avg_total_ms,
    round(avg_backlog, 6) AS avg_backlog, {', '.join(f'round(avg_{s}, 6) AS avg_{s}' for s in _STAGES)}),
    round({_SUMMARY_EPS}, 6) AS events_per_sec FROM {_SUMMARY}"""))
def summarize_iterations(spark, folder):
    return rounded(runs.summarize_iterations(t.iterations(spark, folder)))


def _summary_rows(spark, folder):
    own = runs.summarize_iterations(t.iterations(spark, folder))
    per_shard = runs.summarize_iterations(t.iterations(spark, folder), by=("shard_id",))
    as_runs = own.select("*", F.col("run_id").alias("id"), F.concat(F.lit("label "), "run_id").alias("label"), F.lit("bench").alias("source"))
    as_summaries = per_shard.select("*", F.col("shard_id").alias("id"), F.col("shard_id").alias("label"), F.col("iteration_count").alias("run_count"))
    return runs.summary_rows(as_runs, as_summaries)


_ROWS = f""", own AS (SELECT *, {_SUMMARY_EPS} AS events_per_sec FROM {_SUMMARY}),
    shardly AS (SELECT *, {_SUMMARY_EPS} AS events_per_sec FROM {_SUMMARY.replace('run_id', 'shard_id')}),
    sumrow AS (SELECT 'run' AS kind, run_id AS id, 'label ' || run_id AS label, 'bench' AS source,
      {', '.join(runs.SUMMARY_MEASURES)} FROM own UNION ALL SELECT 'summary', shard_id, shard_id || ' (' || iteration_count
      || CASE WHEN iteration_count = 1 THEN ' run average)' ELSE ' runs average)' END, 'summary', {', '.join(runs.SUMMARY_MEASURES)} FROM shardly),
    base AS (SELECT count(*) AS run_count, {', '.join(f'avg({m}) AS {m}' for m in runs.SUMMARY_MEASURES if m != 'max_backlog')},
      max(max_backlog) AS max_backlog FROM sumrow WHERE kind = 'run')"""
_WITH_ROWS = with_views("iter", then="SELECT 1").removesuffix(" SELECT 1") + _ROWS


@query("summary_rows", _WITH_ROWS + " SELECT kind, id, label, source, "
    + ", ".join(f"round({m}, 6) AS {m}" for m in runs.SUMMARY_MEASURES) + " FROM sumrow")
def summary_rows(spark, folder):
    return rounded(_summary_rows(spark, folder))


@query(
    "average_baseline",
    _WITH_ROWS + f" SELECT run_count, {', '.join(f'round({m}, 5) AS {m}' for m in runs.SUMMARY_MEASURES)} FROM base",
)
def average_baseline(spark, folder):
    return rounded(runs.average_baseline(_summary_rows(spark, folder)), 5)


@query(
    "percent_delta",
    _WITH_ROWS + " SELECT s.kind, s.id, " + ", ".join(
        f"round(CASE WHEN b.{m} <> 0 THEN (s.{m} - b.{m}) / b.{m} END, 5) AS {m}_delta" for m in runs.SUMMARY_MEASURES
    ) + " FROM sumrow s CROSS JOIN base b",
)
def percent_delta(spark, folder):
    rows = _summary_rows(spark, folder)
    return rounded(runs.percent_delta(rows, runs.average_baseline(rows)), 5)


_SNAP_COLUMNS = """run_id, iteration_id, shard_id, snapshot_source, CAST(observed_ms AS BIGINT) AS observed_ms, window_start_ms,
    window_end_ms, checkpoint_ms, window_messages, total_shard_messages, backlog, blocked, pending, done, skipped,
    duplicate_acknowledged, poisoned, is_incomplete"""
_SNAP = [
    "run_id", "iteration_id", "shard_id", "snapshot_source", "observed_ms", "window_start_ms", "window_end_ms", "checkpoint_ms",
    "window_messages", "total_shard_messages", "backlog", "blocked", "pending", "done", "skipped", "duplicate_acknowledged",
    "poisoned", "is_incomplete",
]


def _snapshots(spark, folder):
    return runs.pipeline_snapshots(t.iterations(spark, folder))


@query("pipeline_snapshots", with_views("snap", then=f"SELECT {_SNAP_COLUMNS} FROM snap"))
def pipeline_snapshots(spark, folder):
    return _snapshots(spark, folder).select(*_SNAP)


_ROLLUP = """(SELECT run_id, shard_id, count(*) AS iteration_count, CAST(max(observed_ms) AS BIGINT) AS latest_observed_ms,
    bool_or(has_pipe) AS has_pipeline, bool_or(has_pipe AND is_incomplete) AS has_incomplete FROM snap GROUP BY run_id, shard_id)"""
_NATURAL = "CAST(regexp_extract(shard_id, '[0-9]+') AS BIGINT)"


@query("shard_rollup", with_views("snap", then=f"SELECT * FROM {_ROLLUP}"))
def shard_rollup(spark, folder):
    return runs.shard_rollup(_snapshots(spark, folder))


_SELECTED = f"""(SELECT run_id, shard_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY has_incomplete DESC,
    latest_observed_ms DESC, {_NATURAL}) AS rn FROM {_ROLLUP}) WHERE rn = 1)"""


@query("select_shard", with_views("snap", then=f"SELECT * FROM {_SELECTED}"))
def select_shard(spark, folder):
    return runs.select_shard(runs.shard_rollup(_snapshots(spark, folder)), preferred="no such shard")


@query(
    "select_snapshot",
    with_views("snap", then=f"""SELECT {_SNAP_COLUMNS} FROM (SELECT s.*, row_number() OVER (PARTITION BY s.run_id
    ORDER BY (has_pipe AND is_incomplete) DESC, observed_ms DESC, arrival) AS rn FROM snap s JOIN {_SELECTED} c
    ON s.run_id = c.run_id AND s.shard_id = c.shard_id) WHERE rn = 1"""),
)
def select_snapshot(spark, folder):
    shots = _snapshots(spark, folder)
    return runs.select_snapshot(shots, runs.select_shard(runs.shard_rollup(shots))).select(*_SNAP)


@query(
    "natural_order",
    """SELECT name, row_number() OVER (ORDER BY CAST(regexp_extract(name, '[0-9]+') AS HUGEINT), name) AS place FROM (
    SELECT DISTINCT 'shard-' || head || (o_custkey % 12) AS name
    FROM orders, (VALUES (''), ('0'), ('00'), ('7777777777777777777777777'), ('7777777777777777777777778')) AS heads(head))""",
)
def natural_order(spark, folder):
    from logtel.operators.layout import number_rows

    shards = t.iterations(spark, folder).select("shard_id").distinct()
    # with leading zeros, and with more digits than any number type has
    heads = F.array(*[F.lit(h) for h in ("", "0", "00", "7" * 25, "7" * 24 + "8")])
    names = shards.select(F.explode(heads).alias("head"), F.substring_index("shard_id", "-", -1).alias("n"))
    names = names.select(F.concat(F.lit("shard-"), "head", "n").alias("name"))
    keyed = names.withColumn("_k", natural_sort_key(F.col("name")))
    return number_rows(keyed, [], ["_k"], "place").drop("_k")


@query(
    "window_coverage",
    with_views("snap", then="""SELECT run_id, iteration_id, shard_id, CASE WHEN window_end_ms IS NOT NULL THEN greatest(0, window_end_ms - window_start_ms) END AS window_ms,
    round(CASE WHEN window_end_ms >= window_start_ms AND checkpoint_ms IS NOT NULL THEN
      (greatest(window_start_ms, least(window_end_ms, checkpoint_ms)) - window_start_ms)
      / CAST(greatest(1, window_end_ms - window_start_ms) AS DOUBLE) END, 6) AS checkpoint_fraction
    FROM (SELECT * REPLACE (CASE WHEN window_start_ms IS NOT NULL AND window_end_ms IS NOT NULL THEN window_end_ms END AS window_end_ms) FROM snap)"""),
)
def window_coverage(spark, folder):
    return rounded(runs.window_coverage(_snapshots(spark, folder)))


@query(
    "queue_messages",
    with_views("snap", then="""SELECT run_id, iteration_id, shard_id, ordinal, 'row' || CAST(ordinal AS BIGINT) || '-' || k AS row_id,
    status FROM snap, (SELECT 1.0::DOUBLE AS ordinal, 'pending' AS status UNION ALL SELECT 2.0, 'done') WHERE has_pipe"""),
)
def queue_messages(spark, folder):
    return runs.queue_view(_snapshots(spark, folder))["messages"]


@query(
    "queue_events",
    with_views("snap", then="""SELECT run_id, iteration_id, shard_id, 0 AS position, ms + 5 AS at_ms, 'read' AS kind,
    CAST(k % 9 AS DOUBLE) AS message_count FROM snap WHERE has_pipe"""),
)
def queue_events(spark, folder):
    return runs.queue_view(_snapshots(spark, folder))["events"]


@query(
    "queue_status",
    with_views("snap", then="""SELECT run_id, iteration_id, shard_id, pending, done, skipped, duplicate_acknowledged, poisoned,
    2 AS sampled, CAST(greatest(0, window_messages - 2) AS DOUBLE) AS hidden FROM snap WHERE has_pipe"""),
)
def queue_status(spark, folder):
    return runs.queue_view(_snapshots(spark, folder))["status"]


@query(
    "queue_bars",
    with_views("snap", then=" UNION ALL ".join(
        f"SELECT run_id, iteration_id, shard_id, '{b}' AS bar, {b} AS value FROM snap WHERE NOT has_pipe"
        for b in ("window_messages", "done", "backlog", "blocked", "skipped")
    )),
)
def queue_bars(spark, folder):
    return runs.queue_view(_snapshots(spark, folder))["bars"]
