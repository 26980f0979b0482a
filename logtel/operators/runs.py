"""Benchmark runs: iterations, stage timelines, series, pipeline snapshots and run summaries.

Iterations carry run_id, iteration_id, client_id, shard_id, arrival, times in
epoch ms (started_ms, completed_ms, window_start_ms, window_end_ms, NULL when
unreadable), the stage timings STAGES with total_ms, the read timings
READ_TIMINGS, the counts COUNTS, the memory readings MEMORY, the checkpoint
values previous, upper, advanced_to (comparable doubles) with blocked_ms, and an
optional ``pipeline`` struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtel.functions.scalars import finite, finite_or_zero, mib, natural_sort_key, ratio
from logtel.operators.keyed import latest_per_key
from logtel.operators.layout import BLOCK, Running, attach, lay_out, running, values_at_ranks, without

# The eight stages of an iteration, in the order they run.
STAGES = (
    "lease_acquire", "poll_source", "store_setup", "rehydrate_state",
    "duplicate_rows", "process_events", "flush", "advance_checkpoint",
)
UNACCOUNTED = "unaccounted"
# Fixed value: time outside the stages below this is not shown.
UNACCOUNTED_MIN_MS = 0.5
READ_TIMINGS = ("query_build", "first_row", "stream_rows", "map_rows")
COUNTS = (
    "rows_fetched", "messages_processed", "events_finalized", "flush_documents", "full_flushes",
    "partial_flushes", "checkpoint_advancements", "blocked_messages", "backlog_messages",
)
MEMORY = ("managed_bytes", "working_set_bytes", "gc_heap_bytes")
# The throughput measures of a run and of an iteration.
DIALS = ("read_rows_per_sec", "processing_rows_per_sec", "events_per_sec", "rows_per_event", "checkpoint_velocity")
SUMMARY_MEASURES = (
    "iteration_count", "duration_ms", "events_per_sec", "events_finalized", "flush_documents", "full_flushes",
    "partial_flushes", "avg_total_ms", "avg_backlog", "max_backlog", "blocked_ms",
)


def _num(name: str) -> Column:
    return finite_or_zero(F.col(name))


def _sum_of(names: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for name in names:
        total = total + _num(name)
    return total


# --- time axis ------------------------------------------------------------------------------


def run_times(runs: DataFrame, iterations: DataFrame) -> DataFrame:
    """Start and completion per run: its own, else the first readable one among its iterations."""
    order = F.struct(F.coalesce("started_ms", F.lit(0)).alias("at"), F.col("arrival"))

    def first(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), order)).alias(f"_{name}")

    names = ("started_ms", "window_start_ms", "completed_ms", "window_end_ms")
    found = iterations.groupBy("run_id").agg(*[first(n) for n in names])
    start = F.coalesce("started_ms", "_started_ms", "_window_start_ms", F.lit(0).cast("bigint"))
    return (
        runs.select("run_id", "started_ms", "completed_ms")
        .join(found, "run_id", "left")
        .select(
            "run_id",
            start.alias("run_started_ms"),
            F.coalesce("completed_ms", "_completed_ms", "_window_end_ms", start).alias("run_completed_ms"),
        )
    )


def _plain_sum(names: Sequence[str]) -> Column:
    total = F.col(names[0])
    for name in names[1:]:
        total = total + F.col(name)
    return total


def _with_lengths(iterations: DataFrame) -> DataFrame:
    """Stage timings cleaned once, their sum, the iteration's total and the span its segments cover."""
    clean = iterations.withColumns({name: _num(name) for name in (*STAGES, "total_ms")})
    clean = clean.withColumn("_measured", _plain_sum(STAGES))
    elapsed = F.col("completed_ms") - F.col("started_ms")
    total = (
        F.when(F.col("total_ms") > 0, F.col("total_ms"))
        .when(elapsed >= 0, elapsed.cast("double"))
        .otherwise(F.col("_measured"))
    )
    clean = clean.withColumn("_total", total)
    spare = F.col("_total") - F.col("_measured") > UNACCOUNTED_MIN_MS
    return clean.withColumn("_span", F.when(spare, F.col("_total")).otherwise(F.col("_measured")))


def on_time_axis(iterations: DataFrame, times: DataFrame) -> DataFrame:
    """Iterations with their place on the run's axis.

    Iterations without a readable start come first and follow one another;
    only these need a pass over the run.
    """
    sized = attach(_with_lengths(iterations), times, ["run_id"], ["iteration_id"])
    placed = sized.filter(F.col("started_ms").isNotNull()).withColumn(
        "_start", F.greatest(F.lit(0.0), (F.col("started_ms") - F.col("run_started_ms")).cast("double"))
    )
    unplaced = sized.filter(F.col("started_ms").isNull())
    keys, order = ["run_id"], ["arrival", "iteration_id"]
    chained = running(lay_out(unplaced, keys, order), keys, order, {"_before": Running("sum", F.col("_span"), before=True)})
    placed = placed.unionByName(chained.withColumn("_start", F.coalesce("_before", F.lit(0.0))).drop("_before", BLOCK))
    origin = F.col("run_started_ms").cast("double")
    start_at = F.coalesce(F.col("started_ms").cast("double"), origin + F.col("_start"))
    since = F.col("completed_ms") - origin
    relative = F.when(since.isNotNull(), F.greatest(F.lit(0.0), since)).otherwise(F.col("_start") + F.col("_total"))
    completed_at = F.coalesce(F.col("completed_ms").cast("double"), origin + relative)
    return (
        placed.withColumns({"_start_at": start_at, "_completed_rel": relative, "_completed_at": completed_at})
        .withColumn("x_at_ms", F.coalesce(F.col("window_end_ms").cast("double"), F.col("_completed_at")))
        .withColumn("x_ms", F.greatest(F.lit(0.0), F.col("x_at_ms") - origin))
    )


def stage_timeline(axis: DataFrame) -> DataFrame:
    """Stage segments laid end to end from each iteration's start, and a ninth for unaccounted time.

    ``axis`` here and below is the result of on_time_axis.
    """
    segments: list[Column] = []

    def segment(stage: str, begin: Column, length: Column) -> Column:
        return F.struct(
            F.lit(stage).alias("stage"),
            (F.col("_start") + begin).alias("start_ms"),
            (F.col("_start") + begin + length).alias("end_ms"),
            (F.col("_start_at") + begin).alias("start_at_ms"),
            (F.col("_start_at") + begin + length).alias("end_at_ms"),
            length.alias("duration_ms"),
        )

    for i, stage in enumerate(STAGES):
        segments.append(segment(stage, _plain_sum(STAGES[:i]) if i else F.lit(0.0), F.col(stage)))
    spare = F.greatest(F.lit(0.0), F.col("_total") - F.col("_measured"))
    rest = segment(UNACCOUNTED, F.col("_measured"), spare)
    every = F.array(*segments)
    shown = F.when(spare > UNACCOUNTED_MIN_MS, F.concat(every, F.array(rest))).otherwise(every)
    return axis.select("run_id", "iteration_id", "client_id", "shard_id", F.inline(shown)).withColumn(
        "original_duration_ms", F.col("duration_ms")
    )


# --- series ---------------------------------------------------------------------------------


def iteration_points(axis: DataFrame) -> DataFrame:
    """One row per iteration with the values of every point series at the iteration's anchor time."""
    seconds = F.greatest(F.col("_total") / 1000, F.lit(0.001))
    return axis.select(
        "run_id",
        "iteration_id",
        "shard_id",
        F.concat_ws(" · ", "iteration_id", "shard_id").alias("label"),
        "x_ms",
        "x_at_ms",
        (_num("events_finalized") / seconds).alias("events_per_sec"),
        _num("backlog_messages").alias("backlog"),
        _num("blocked_ms").alias("blocked_ms"),
        "advanced_to",
        "upper",
        _num("full_flushes").alias("full_flushes"),
        _num("partial_flushes").alias("partial_flushes"),
        _num("flush_documents").alias("flush_documents"),
    )


def memory_points(axis: DataFrame, memory: DataFrame, times: DataFrame) -> DataFrame:
    """Memory in MiB over time: the run's samples, or its iterations where it has none."""

    def row(x: Column, at: Column) -> list[Column]:
        return [
            F.col("run_id"), F.col("iteration_id"), x.cast("double").alias("x_ms"), at.cast("double").alias("x_at_ms"),
            mib(F.col("managed_bytes")).alias("managed_mib"),
            mib(F.col("working_set_bytes")).alias("working_set_mib"),
            mib(F.col("gc_heap_bytes")).alias("gc_heap_mib"),
        ]

    origin = F.col("run_started_ms")
    sampled = attach(memory, times, ["run_id"], ["iteration_id"]).select(
        *row(F.coalesce(F.greatest(F.lit(0), F.col("at_ms") - origin), F.lit(0)), F.coalesce("at_ms", origin))
    )
    fallback = without(axis, memory, ["run_id"]).select(*row(F.col("_completed_rel"), _finished()))
    return sampled.unionByName(fallback)


def _finished() -> Column:
    """When an iteration without memory samples counts as measured."""
    return F.coalesce(F.col("completed_ms").cast("double"), F.col("_completed_rel"))


def iteration_series(axis: DataFrame, memory: DataFrame, times: DataFrame) -> DataFrame:
    """All point series in long form: (run, series, iteration, x, value), NULL values left out."""
    points = iteration_points(axis)
    names = (
        "events_per_sec", "backlog", "blocked_ms", "advanced_to", "upper",
        "full_flushes", "partial_flushes", "flush_documents",
    )
    mem = ("managed_mib", "working_set_mib", "gc_heap_mib")

    def long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("series"), F.col(n).cast("double").alias("value")) for n in columns])
        return df.select("run_id", "iteration_id", "x_ms", "x_at_ms", F.inline(pairs))

    both = long(points, names).unionByName(long(memory_points(axis, memory, times), mem))
    return both.filter(F.col("value").isNotNull())


def checkpoint_series(points: DataFrame) -> DataFrame:
    """Two series, the checkpoint reached and its upper bound, without their gaps."""
    pairs = F.array(
        F.struct(F.lit("advanced_to").alias("series"), F.col("advanced_to").cast("double").alias("value")),
        F.struct(F.lit("upper").alias("series"), F.col("upper").cast("double").alias("value")),
    )
    long = points.select("run_id", "iteration_id", "x_ms", "x_at_ms", F.inline(pairs))
    return long.filter(F.col("value").isNotNull())


def flush_volume(points: DataFrame, show_full: bool = True, show_partial: bool = True) -> DataFrame:
    """Visible flush points with their height in percent of the run's largest visible one."""
    neither = (F.col("full_flushes") == 0) & (F.col("partial_flushes") == 0) & F.lit(show_full and show_partial)
    visible = points.filter(
        (F.lit(show_full) & (F.col("full_flushes") > 0))
        | (F.lit(show_partial) & (F.col("partial_flushes") > 0))
        | neither
    ).select("run_id", "iteration_id", "x_at_ms", "flush_documents", "full_flushes", "partial_flushes")
    most = visible.groupBy("run_id").agg(F.greatest(F.lit(1.0), F.max("flush_documents")).alias("_most"))
    return attach(visible, most, ["run_id"], ["iteration_id"]).withColumn(
        "height_pct", F.col("flush_documents") / F.col("_most") * 100
    ).drop("_most")


def _range(bounds: DataFrame, minutes: float | None, *more: Column) -> DataFrame:
    end = F.col("latest_observed_ms")
    start = F.col("timeline_start_ms")
    if minutes is not None:
        start = F.greatest(start, end - F.lit(minutes * 60000.0))
    return bounds.select("run_id", start.alias("_from"), end.alias("_to"), *more)


def points_in_range(points: DataFrame, bounds: DataFrame, minutes: float | None) -> DataFrame:
    """Points of the last minutes before each run's latest observation, both ends included."""
    inside = (F.col("x_at_ms") >= F.col("_from")) & (F.col("x_at_ms") <= F.col("_to"))
    return attach(points, _range(bounds, minutes), ["run_id"], ["iteration_id"]).filter(inside).drop("_from", "_to")


def segments_in_range(segments: DataFrame, bounds: DataFrame, minutes: float | None) -> DataFrame:
    """Segments overlapping the trailing range, clipped to it; the original duration is kept."""
    ranged = _range(bounds, minutes, F.col("run_started_ms").alias("_origin"))
    start = F.greatest("start_at_ms", "_from")
    end = F.least("end_at_ms", "_to")
    overlapping = (F.col("end_at_ms") >= F.col("_from")) & (F.col("start_at_ms") <= F.col("_to"))
    if minutes is None:
        return segments
    return (
        attach(segments, ranged, ["run_id"], ["iteration_id", "stage"])
        .filter(overlapping)
        .select(
            "run_id", "iteration_id", "client_id", "shard_id", "stage",
            (start - F.col("_origin")).alias("start_ms"),
            (end - F.col("_origin")).alias("end_ms"),
            start.alias("start_at_ms"),
            end.alias("end_at_ms"),
            F.greatest(F.lit(0.0), end - start).alias("duration_ms"),
            "original_duration_ms",
        )
    )


# --- throughput and summaries ---------------------------------------------------------------


def _advance_seconds() -> Column:
    moved = (F.col("advanced_to") - F.col("previous")) / F.lit(1000.0)
    return F.when(moved.isNotNull(), F.greatest(F.lit(0.0), moved)).otherwise(F.lit(0.0))


def _dials(rows: Column, events: Column, total: Column, read: Column, advance: Column) -> list[Column]:
    return [
        ratio(rows, read / 1000).alias("read_rows_per_sec"),
        ratio(rows, total / 1000).alias("processing_rows_per_sec"),
        ratio(events, total / 1000).alias("events_per_sec"),
        ratio(rows, events, F.lit(None)).alias("rows_per_event"),
        advance.alias("advance_seconds"),
        ratio(advance, total / 1000).alias("checkpoint_velocity"),
    ]


def run_throughput(iterations: DataFrame) -> DataFrame:
    """Weighted throughput per run: sums over sums."""
    sums = iterations.groupBy("run_id").agg(
        F.sum(_num("rows_fetched")).alias("rows"),
        F.sum(_num("events_finalized")).alias("events"),
        F.sum(_num("total_ms")).alias("total"),
        F.sum(_sum_of(READ_TIMINGS)).alias("read"),
        F.sum(_advance_seconds()).alias("advance"),
    )
    c = F.col
    return sums.select("run_id", *_dials(c("rows"), c("events"), c("total"), c("read"), c("advance")))


def iteration_throughput(iterations: DataFrame) -> DataFrame:
    return iterations.select(
        "run_id",
        "iteration_id",
        *_dials(
            _num("rows_fetched"), _num("events_finalized"), _num("total_ms"), _sum_of(READ_TIMINGS), _advance_seconds()
        ),
    )


def trend_points(metrics: DataFrame, points: DataFrame) -> DataFrame:
    """Per-iteration metrics at their iteration's anchor time; the last anchor of an iteration to arrive counts."""
    last = "arrival" if "arrival" in points.columns else "x_at_ms"
    anchors = latest_per_key(
        points.select("run_id", "iteration_id", "label", "x_at_ms", F.col(last).alias("_last")), ["run_id", "iteration_id"], "_last"
    ).drop("_last")
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), finite(F.col(n)).alias("value")) for n in DIALS])
    long = metrics.select("run_id", "iteration_id", F.inline(pairs)).filter(F.col("value").isNotNull())
    return long.join(anchors, ["run_id", "iteration_id"])


def summarize_iterations(iterations: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Totals and means per run; duration runs from the first iteration's start to the last one's end."""
    order = F.struct("started_ms", "iteration_id")
    totals = [c for c in COUNTS if c not in ("blocked_messages", "backlog_messages")]
    duration = F.greatest(
        F.lit(0).cast("bigint"), F.max_by("completed_ms", order) - F.min_by("started_ms", order)
    )
    out = iterations.groupBy(*by).agg(
        F.count(F.lit(1)).alias("iteration_count"),
        *[F.sum(_num(c)).alias(c) for c in totals],
        duration.alias("duration_ms"),
        *[F.avg(_num(s)).alias(f"avg_{s}") for s in STAGES],
        F.avg(_num("total_ms")).alias("avg_total_ms"),
        F.avg(_num("backlog_messages")).alias("avg_backlog"),
        F.greatest(F.lit(0.0), F.max(_num("backlog_messages"))).alias("max_backlog"),
        F.sum(_num("blocked_ms")).alias("blocked_ms"),
    )
    return out.withColumn("events_per_sec", ratio(F.col("events_finalized"), F.col("duration_ms") / 1000))


def summary_rows(runs: DataFrame, summaries: DataFrame) -> DataFrame:
    """One comparable row per run and per summary artifact, missing numbers as zero."""
    measures = [finite_or_zero(F.col(m)).alias(m) for m in SUMMARY_MEASURES]
    many = F.when(F.col("run_count") == 1, " run average)").otherwise(" runs average)")
    label = F.concat(F.col("label"), F.lit(" ("), F.col("run_count").cast("bigint").cast("string"), many)
    return runs.select(F.lit("run").alias("kind"), "id", "label", "source", *measures).unionByName(
        summaries.select(F.lit("summary").alias("kind"), "id", label.alias("label"), F.lit("summary").alias("source"), *measures)
    )


def average_baseline(rows: DataFrame) -> DataFrame:
    """Mean of each measure over runs, but the greatest of the greatest backlogs; no row without runs."""
    means = [F.avg(m).alias(m) for m in SUMMARY_MEASURES if m != "max_backlog"]
    return (
        rows.filter("kind = 'run'")
        .agg(F.count(F.lit(1)).alias("run_count"), *means, F.max("max_backlog").alias("max_backlog"))
        .filter("run_count > 0")
    )


def percent_delta(rows: DataFrame, baseline: DataFrame, measures: Sequence[str] = SUMMARY_MEASURES) -> DataFrame:
    """Relative difference of every measure from the baseline; NULL where the baseline is zero or unusable."""
    base = baseline.select(F.struct(*[finite(F.col(m)).alias(m) for m in measures]).alias("base")).scalar()
    with_base = rows.withColumn("_base", base)
    deltas = []
    for m in measures:
        against = F.col("_base")[m]
        delta = (finite(F.col(m)) - against) / against
        deltas.append(F.when(against != 0, delta).alias(f"{m}_delta"))
    return with_base.select("kind", "id", *deltas)


def dial_ranges(items: DataFrame, run_metrics: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Display range and nearest-rank p95 of each dial over a run's items; the run itself stands in for none."""
    by = list(by)

    def long(df: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("metric"), finite(F.col(n)).alias("value")) for n in DIALS])
        return df.select(*by, F.inline(pairs))

    alone = run_metrics.join(items.select(*by).distinct(), by, "left_anti")
    values = long(items).unionByName(long(alone)).filter(F.col("value").isNotNull())
    stats = values_at_ranks(values, [*by, "metric"], "value", {"p95": lambda n: F.floor((n * 95 + 99) / F.lit(100))})
    padding = F.col("max") * 0.1
    low = F.greatest(F.lit(0.0), F.col("min") - padding)
    high = F.greatest(F.col("max") + padding, low + 1)
    shown = stats.select(*by, "metric", low.alias("range_min"), high.alias("range_max"), "p95")
    dials = long(run_metrics).select(*by, "metric")
    return dials.join(shown, [*by, "metric"], "left").select(
        *by,
        "metric",
        F.coalesce("range_min", F.lit(0.0)).alias("range_min"),
        F.coalesce("range_max", F.lit(1.0)).alias("range_max"),
        "p95",
    )


# --- pipeline snapshots ---------------------------------------------------------------------


def pipeline_snapshots(iterations: DataFrame) -> DataFrame:
    """One window snapshot per iteration: its pipeline record, or a fallback made from its counts."""
    totals = iterations.groupBy("run_id", "shard_id").agg(F.sum(_num("rows_fetched")).alias("_shard_total"))
    p = F.col("pipeline")
    has = p.isNotNull()

    def pick(from_pipeline: Column, fallback: Column) -> Column:
        return F.when(has, from_pipeline).otherwise(fallback)

    def whole(c: Column) -> Column:
        return finite_or_zero(c)

    stuck = (whole(p["pending"]) > 0) | (whole(p["blocked_messages"]) > 0) | ~p["has_checkpoint"]
    comparable = p["checkpoint_ms"].isNotNull() & p["window_end_ms"].isNotNull()
    seen = F.coalesce(p["observed_ms"], p["current_ms"])
    early = F.coalesce(seen < F.col("completed_ms"), F.lit(False))
    incomplete = F.when(
        has, F.when(stuck, True).when(comparable, p["checkpoint_ms"] < p["window_end_ms"]).otherwise(early)
    ).otherwise(False)
    processed = _num("messages_processed")
    checkpoint_text = F.col("advanced_to_ms") if "advanced_to_ms" in iterations.columns else F.lit(None).cast("bigint")
    zero = F.lit(0.0)
    return attach(iterations, totals, ["run_id", "shard_id"], ["iteration_id"]).select(
        "run_id",
        "iteration_id",
        "client_id",
        "shard_id",
        "arrival",
        F.when(has, "pipeline").otherwise("aggregate").alias("snapshot_source"),
        F.coalesce(
            pick(F.coalesce(p["observed_ms"], p["current_ms"], F.col("completed_ms")), F.coalesce("completed_ms", "started_ms")),
            F.lit(0),
        ).cast("bigint").alias("observed_ms"),
        pick(p["window_start_ms"], F.col("window_start_ms")).alias("window_start_ms"),
        pick(p["window_end_ms"], F.col("window_end_ms")).alias("window_end_ms"),
        p["watermark_ms"].alias("watermark_ms"),
        p["candidate_watermark_ms"].alias("candidate_watermark_ms"),
        pick(p["checkpoint_ms"], checkpoint_text).alias("checkpoint_ms"),
        pick(whole(p["window_messages"]), _num("rows_fetched")).alias("window_messages"),
        pick(whole(p["total_shard_messages"]), F.col("_shard_total")).alias("total_shard_messages"),
        pick(whole(p["backlog_messages"]), _num("backlog_messages")).alias("backlog"),
        pick(whole(p["blocked_messages"]), _num("blocked_messages")).alias("blocked"),
        pick(whole(p["pending"]), _num("backlog_messages")).alias("pending"),
        pick(whole(p["done"]), processed).alias("done"),
        pick(whole(p["skipped"]), F.greatest(zero, _num("rows_fetched") - processed)).alias("skipped"),
        pick(whole(p["duplicate_acknowledged"]), zero).alias("duplicate_acknowledged"),
        pick(whole(p["poisoned"]), zero).alias("poisoned"),
        incomplete.alias("is_incomplete"),
        p["messages"].alias("messages"),
        p["events"].alias("events"),
    )


def shard_rollup(snapshots: DataFrame) -> DataFrame:
    """Snapshot count, latest observation and completeness per shard, in natural shard order."""
    is_pipeline = F.col("snapshot_source") == "pipeline"
    return (
        snapshots.groupBy("run_id", "shard_id")
        .agg(
            F.count(F.lit(1)).alias("iteration_count"),
            F.max("observed_ms").alias("latest_observed_ms"),
            F.bool_or(is_pipeline).alias("has_pipeline"),
            F.bool_or(is_pipeline & F.col("is_incomplete")).alias("has_incomplete"),
        )
        .orderBy("run_id", natural_sort_key(F.col("shard_id")))
    )


def select_shard(rollup: DataFrame, preferred: str | None = None) -> DataFrame:
    """Per run: the preferred shard if present, else incomplete first, then latest, then by name."""
    wanted = F.when(F.col("shard_id") == preferred, 0).otherwise(1) if preferred is not None else F.lit(1)
    order = F.struct(
        wanted.alias("a"), (~F.col("has_incomplete")).alias("b"), (-F.col("latest_observed_ms")).alias("c"),
        natural_sort_key(F.col("shard_id")).alias("d"),
    )
    return rollup.groupBy("run_id").agg(F.min_by("shard_id", order).alias("shard_id"))


def select_snapshot(snapshots: DataFrame, selected: DataFrame) -> DataFrame:
    """Per run, of the selected shard: the latest incomplete pipeline snapshot, else the latest one."""
    done = ~((F.col("snapshot_source") == "pipeline") & F.col("is_incomplete"))
    order = F.struct(done.alias("a"), (-F.col("observed_ms")).alias("b"), F.col("arrival").alias("c"))
    chosen = attach(snapshots, selected, ["run_id", "shard_id"], ["iteration_id"])
    picked = chosen.groupBy("run_id").agg(F.min_by(F.struct(*[F.col(c) for c in snapshots.columns if c != "run_id"]), order).alias("_s"))
    return picked.select("run_id", "_s.*")


def window_coverage(snapshots: DataFrame) -> DataFrame:
    """Window length, and how far into the window the checkpoint has come, as a fraction."""
    start, end, mark = F.col("window_start_ms"), F.col("window_end_ms"), F.col("checkpoint_ms")
    inside = F.greatest(start, F.least(end, mark)) - start
    share = F.when(mark.isNotNull() & (end >= start), inside / F.greatest(F.lit(1), end - start))
    return snapshots.select(
        "run_id",
        "iteration_id",
        "shard_id",
        F.when(start.isNotNull() & end.isNotNull(), F.greatest(F.lit(0), end - start)).cast("bigint").alias("window_ms"),
        share.alias("checkpoint_fraction"),
    )


def queue_view(snapshots: DataFrame) -> dict[str, DataFrame]:
    """Sampled messages, events and status totals of pipeline snapshots, and bars for the others."""
    ids = ["run_id", "iteration_id", "shard_id"]
    real = snapshots.filter("snapshot_source = 'pipeline'")
    status = ("pending", "done", "skipped", "duplicate_acknowledged", "poisoned")
    hidden = F.greatest(F.lit(0.0), F.col("window_messages") - F.coalesce(F.size("messages"), F.lit(0)))
    bars = ("window_messages", "done", "backlog", "blocked", "skipped")
    return {
        "messages": real.select(*ids, F.inline("messages")),
        "events": real.select(*ids, F.posexplode("events").alias("position", "_e")).select(*ids, "position", "_e.*"),
        "status": real.select(*ids, *status, F.size("messages").alias("sampled"), hidden.alias("hidden")),
        "bars": snapshots.filter("snapshot_source <> 'pipeline'").select(
            *ids, F.inline(F.array(*[F.struct(F.lit(b).alias("bar"), F.col(b).alias("value")) for b in bars]))
        ),
    }


def run_bounds(
    runs: DataFrame, times: DataFrame, axis: DataFrame, memory: DataFrame, snapshots: DataFrame
) -> DataFrame:
    """Observed extent of every run, and the time domain of its charts."""
    parts = axis.groupBy("run_id").agg(
        F.max(F.col("_start") + F.col("_span")).alias("_seg_end"),
        F.min("_start_at").alias("_seg_start_at"),
        F.max(F.col("_start_at") + F.col("_span")).alias("_seg_end_at"),
        F.max("x_ms").alias("_x_max"),
        F.min("x_at_ms").alias("_x_at_min"),
        F.max("x_at_ms").alias("_x_at_max"),
        F.min(_finished()).alias("_finished_min"),
        F.max(_finished()).alias("_finished_max"),
    )
    # samples without a time of their own count from the run's start; runs without samples count their iterations
    mem = memory.groupBy("run_id").agg(
        F.min("at_ms").cast("double").alias("_mem_first"), F.max("at_ms").cast("double").alias("_mem_last"), F.count_if(F.col("at_ms").isNull()).alias("_untimed")
    )
    shots = snapshots.groupBy("run_id").agg(
        F.min(F.coalesce("window_start_ms", "observed_ms")).alias("_shot_start"),
        F.max("observed_ms").alias("_shot_max"),
        F.min("window_start_ms").alias("_domain_start"),
        F.max("window_end_ms").alias("_domain_end"),
    )
    declared = runs.select("run_id", finite_or_zero(F.col("duration_ms")).alias("_declared"))
    joined = times.join(parts, "run_id", "left").join(mem, "run_id", "left").join(shots, "run_id", "left").join(declared, "run_id")
    started, completed = F.col("run_started_ms").cast("double"), F.col("run_completed_ms").cast("double")
    untimed = F.when(F.col("_untimed") > 0, started)
    sampled = F.col("_untimed").isNotNull()
    joined = joined.withColumns(
        {
            "_mem_min": F.when(sampled, F.least("_mem_first", untimed)).otherwise(F.col("_finished_min")),
            "_mem_max": F.when(sampled, F.greatest("_mem_last", untimed)).otherwise(F.col("_finished_max")),
        }
    )
    first = F.least(started, "_seg_start_at", "_x_at_min", "_mem_min", F.col("_shot_start").cast("double"))
    last = F.greatest(completed, "_seg_end_at", "_x_at_max", "_mem_max", F.col("_shot_max").cast("double"))
    windowed = F.col("_domain_end") > F.col("_domain_start")
    return joined.select(
        "run_id",
        "run_started_ms",
        "run_completed_ms",
        F.greatest(F.lit(0), F.col("run_completed_ms") - F.col("run_started_ms")).cast("bigint").alias("duration_ms"),
        F.greatest(F.col("_declared"), completed - started, "_seg_end", "_x_max").alias("timeline_end_ms"),
        first.alias("timeline_start_ms"),
        last.alias("latest_observed_ms"),
        F.when(windowed, F.col("_domain_start").cast("double")).otherwise(first).alias("domain_start_ms"),
        F.when(windowed, F.col("_domain_end").cast("double")).otherwise(last).alias("domain_end_ms"),
    )
