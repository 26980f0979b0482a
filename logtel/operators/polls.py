"""Poll telemetry: cycles and stage events joined by run, and their metrics per source.

Stage events: run_id, stage, ev (start or end), at_ms, dur_ms, ts_ms, arrival.
Cycles: run_id, source, outcome, started_ms, completed_ms, total_ms, records,
records_per_sec, the optional measures in OPTIONAL_MEASURES, window_start_ms,
window_end_ms, timeline array<struct<stage, start_ms, dur_ms>>, arrival.
``arrival`` is any orderable value that gives the position in the log.
NULL means absent and is never read as zero unless said so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtel.functions.scalars import finite, ratio
from logtel.operators.keyed import latest_per_key
from logtel.operators.layout import brackets, lay_out, values_at_ranks

OPTIONAL_MEASURES = (
    "users", "cursor_lag_sec", "query_ms", "map_ms", "write_ms", "advance_ms", "write_units", "input_rows",
    "store_retries", "store_throttled", "store_attempted", "store_succeeded", "store_failed", "store_cancelled",
)
STORE_COUNTERS = (
    "store_retries", "store_throttled", "store_attempted", "store_succeeded", "store_failed", "store_cancelled",
)
# The stage lanes, in display order.
LANES = ("cursorRead", "kusto", "map", "seal", "write", "advance")

def _succeeded() -> Column:
    return F.col("outcome") == "success"


def resolve_cycles(stages: DataFrame, cycles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved): the last cycle of every run, and runs that have stage events only.

    ``run_order`` gives the order in which runs first appear: runs with stage
    events by their first one, then the others by their first cycle.
    """
    seen = stages.groupBy("run_id").agg(
        F.min("arrival").alias("_first_stage"),
        F.coalesce(F.min(F.col("ts_ms") - F.col("at_ms")), F.lit(0.0)).alias("started_ms"),
    )
    latest = latest_per_key(cycles, ["run_id"], "arrival")
    first = cycles.groupBy("run_id").agg(F.min("arrival").alias("_first_cycle"))
    position = F.coalesce("_first_stage", "_first_cycle")
    order = F.struct(F.when(F.col("_first_stage").isNull(), 1).otherwise(0).alias("late"), position.alias("at"))
    resolved = (
        latest.join(first, "run_id")
        .join(seen.select("run_id", "_first_stage"), "run_id", "left")
        .select(*latest.columns, order.alias("run_order"))
    )
    unresolved = seen.join(latest.select("run_id"), "run_id", "left_anti").select(
        "run_id",
        F.lit(None).cast("string").alias("source"),
        F.lit("in-progress").alias("outcome"),
        "started_ms",
        F.lit(None).cast("double").alias("completed_ms"),
        F.lit(None).cast("double").alias("total_ms"),
        F.lit(None).cast("double").alias("records"),
        F.lit(None).cast("double").alias("records_per_sec"),
        F.col("_first_stage").alias("first_arrival"),
    )
    return resolved, unresolved


def unresolved_start(stages: DataFrame) -> DataFrame:
    """Estimated start per run: least time stamp minus offset over readable events, else 0."""
    return stages.groupBy("run_id").agg(
        F.coalesce(F.min(F.col("ts_ms") - F.col("at_ms")), F.lit(0.0)).alias("started_ms")
    )


def pair_stage_spans(stages: DataFrame) -> DataFrame:
    """Spans per (run, stage): each end closes the oldest open start.

    A start without an end stays open (NULL duration); an end without a start
    gives a span from its own duration. ``created_ms, arrival`` order the spans
    of a run as they were created.
    """
    keys, order = ["run_id", "stage"], ["at_ms", "arrival"]
    is_start = F.col("ev") == "start"
    one = F.lit(1).cast("bigint")
    events = stages.filter(is_start | F.col("dur_ms").isNotNull()).select(*keys, "ev", *order, "dur_ms")
    placed = brackets(lay_out(events, keys, order), keys, order, F.when(is_start, one).otherwise(-one))
    floor = F.least(F.lit(0), F.coalesce("low_before", F.lit(0)))
    orphan = ~is_start & (F.col("balance") < floor)
    # a start and the end that closes it have one number; an end without a start has a number of its own, below zero
    number = F.when(is_start, F.col("ups")).when(orphan, -F.col("downs")).otherwise(F.col("downs") + F.least(F.col("balance"), floor))
    creates = is_start | orphan
    began = F.when(is_start, F.col("at_ms")).when(orphan, F.col("at_ms") - F.col("dur_ms"))
    spans = placed.groupBy(*keys, number.alias("_number")).agg(
        F.max(began).alias("start_ms"),
        F.max(F.when(~is_start, F.col("dur_ms"))).alias("dur_ms"),
        F.max(F.when(creates, F.col("at_ms"))).alias("created_ms"),
        F.max(F.when(creates, F.col("arrival"))).alias("arrival"),
    )
    return spans.drop("_number").withColumn("completed", F.col("dur_ms").isNotNull())


def advance_seconds() -> Column:
    """Source seconds a successful cycle moved its window forward, never negative."""
    moved = (F.col("window_end_ms") - F.col("window_start_ms")) / F.lit(1000.0)
    return F.when(_succeeded() & moved.isNotNull(), F.greatest(F.lit(0.0), moved)).otherwise(F.lit(0.0))


def source_metrics(cycles: DataFrame) -> DataFrame:
    """Totals, means and counts per source over the given (already resolved) cycles."""
    counters = [F.col(c) for c in STORE_COUNTERS]
    reports = F.coalesce(*counters).isNotNull()
    troubled = F.lit(False)
    for name in ("store_retries", "store_throttled", "store_failed", "store_cancelled"):
        troubled = troubled | (F.coalesce(F.col(name), F.lit(0)) > 0)
    order = F.col("run_order") if "run_order" in cycles.columns else F.struct(F.col("run_id").alias("at"))
    recency = F.struct((-F.coalesce("completed_ms", F.lit(0))).alias("back"), order.alias("order"))
    lag = F.col("cursor_lag_sec")
    return cycles.groupBy("source").agg(
        F.count(F.lit(1)).alias("cycle_count"),
        F.count_if(_succeeded()).alias("success_count"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped_count"),
        F.count_if(F.col("outcome") == "failed").alias("failed_count"),
        F.sum("records").alias("total_records"),
        F.sum("input_rows").alias("total_input_rows"),
        F.count_if(advance_seconds() > 0).alias("checkpoint_count"),
        F.sum("users").alias("total_users"),
        F.avg(F.when(_succeeded(), F.col("records_per_sec"))).alias("avg_success_records_per_sec"),
        F.avg("total_ms").alias("avg_cycle_ms"),
        F.min_by(lag, F.when(lag.isNotNull(), recency)).alias("latest_cursor_lag_sec"),
        F.sum("write_units").alias("total_write_units"),
        *[F.sum(c).alias(f"total_{c}") for c in STORE_COUNTERS],
        F.when(F.count_if(reports) > 0, F.count_if(reports & troubled)).alias("store_affected_cycles"),
        F.greatest(F.lit(0), F.max("completed_ms") - F.min("started_ms")).alias("_duration"),
        F.max("completed_ms").alias("_last"),
        F.min("started_ms").alias("_first"),
    ).withColumn(
        "duration_ms", F.when(F.col("_last").isNotNull() & F.col("_first").isNotNull(), F.col("_duration"))
    ).drop("_duration", "_last", "_first")


def descriptive_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean, least, median, nearest-rank p95, greatest and count over finite values, exact for any group size."""
    usable = df.select(*by, finite(F.col(value)).alias("_value")).filter(F.col("_value").isNotNull())
    half = F.lit(2)
    picked = values_at_ranks(
        usable,
        by,
        "_value",
        {
            "_low": lambda n: F.floor((n + 1) / half),
            "_high": lambda n: F.floor(n / half) + 1,
            "p95": lambda n: F.floor((n * 95 + 99) / F.lit(100)),
        },
    )
    return picked.select(
        *by,
        (F.col("sum") / F.col("count")).alias("avg"),
        "min",
        ((F.col("_low") + F.col("_high")) / 2).alias("p50"),
        "p95",
        "max",
        "count",
    )


def _long(df: DataFrame, ids: Sequence[str], names: Sequence[str], label: str) -> DataFrame:
    """One row per (id, measure) for the named columns."""
    pairs = F.array(*[F.struct(F.lit(n).alias(label), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(*ids, F.inline(pairs))


def duration_stats(cycles: DataFrame) -> DataFrame:
    """Descriptive statistics of the four stage durations per source."""
    long = _long(cycles, ["source"], ("query_ms", "map_ms", "write_ms", "advance_ms"), "measure")
    return descriptive_stats(long, "value", ["source", "measure"])


def _counts_for_throughput() -> Column:
    return _succeeded() & finite(F.col("input_rows")).isNotNull()


def _read_ms() -> Column:
    return F.coalesce("query_ms", F.lit(0.0)) + F.coalesce("map_ms", F.lit(0.0))


def _dials(rows: Column, records: Column, read_sec: Column, busy_sec: Column, advance: Column, wall_sec: Column) -> list[Column]:
    return [
        ratio(rows, read_sec).alias("read_rows_per_sec"),
        ratio(rows, busy_sec).alias("processing_rows_per_sec"),
        ratio(records, busy_sec).alias("events_per_sec"),
        ratio(rows, records, F.lit(None)).alias("rows_per_event"),
        advance.alias("advance_seconds"),
        ratio(advance, wall_sec).alias("checkpoint_velocity"),
    ]


def poll_throughput(cycles: DataFrame) -> DataFrame:
    """Weighted throughput per source: sums over sums, zero where the denominator is zero."""
    counted = _counts_for_throughput()

    def total(value: Column, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, value.cast("double"))), F.lit(0.0))

    every = F.lit(True)
    sums = cycles.groupBy("source").agg(
        total(F.col("input_rows"), counted).alias("rows"),
        total(F.col("records"), counted).alias("records"),
        total(_read_ms(), counted).alias("read_ms"),
        total(F.col("total_ms"), counted).alias("busy_ms"),
        total(F.col("total_ms"), every).alias("wall_ms"),
        total(advance_seconds(), every).alias("advance"),
    )
    c = F.col
    return sums.select(
        "source",
        *_dials(c("rows"), c("records"), c("read_ms") / 1000, c("busy_ms") / 1000, c("advance"), c("wall_ms") / 1000),
    )


def poll_throughput_per_cycle(cycles: DataFrame) -> DataFrame:
    """The same measures for each successful cycle that reports its input rows."""
    seconds = F.col("total_ms") / F.lit(1000.0)
    rows, records = F.col("input_rows").cast("double"), F.col("records").cast("double")
    return cycles.filter(_counts_for_throughput()).select(
        "source", "run_id", *_dials(rows, records, _read_ms() / 1000, seconds, advance_seconds(), seconds)
    )


def stage_lanes(cycles: DataFrame) -> DataFrame:
    """Six fixed lanes per cycle; query and map run inside seal, which keeps the remainder."""

    def entry(stage: str) -> Column:
        return F.get(F.filter("timeline", lambda s: s["stage"] == stage), 0)

    lanes = cycles.select(
        "run_id",
        *[c for c in ("source",) if c in cycles.columns],
        "query_ms",
        "map_ms",
        *[entry(s).alias(f"_{s}") for s in ("cursorRead", "seal", "write", "advance")],
    )
    return _lanes(lanes, [c for c in ("run_id", "source") if c in lanes.columns])


def _lanes(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    zero = F.lit(0.0)

    def lane(stage: str, recorded: Column, is_open: Column, start: Column, dur: Column) -> Column:
        return F.struct(
            F.lit(stage).alias("lane"),
            recorded.alias("recorded"),
            F.coalesce(is_open, F.lit(False)).alias("open"),
            start.cast("double").alias("start_ms"),
            dur.cast("double").alias("dur_ms"),
        )

    def plain(stage: str) -> Column:
        found = F.col(f"_{stage}")
        return lane(
            stage,
            found.isNotNull(),
            found.isNotNull() & found["dur_ms"].isNull(),
            F.coalesce(found["start_ms"], zero),
            F.coalesce(found["dur_ms"], zero),
        )

    seal = F.col("_seal")
    query = F.greatest(F.coalesce(finite(F.col("query_ms")), zero), zero)
    mapped = F.greatest(F.coalesce(finite(F.col("map_ms")), zero), zero)
    start = F.coalesce(seal["start_ms"].cast("double"), zero)
    remainder = F.greatest(F.coalesce(seal["dur_ms"].cast("double"), zero) - query - mapped, zero)
    closed = F.lit(False)
    frames = F.array(
        plain("cursorRead"),
        lane("kusto", F.col("query_ms").isNotNull(), closed, start, query),
        lane("map", F.col("map_ms").isNotNull(), closed, start + query, mapped),
        lane("seal", seal.isNotNull(), seal.isNotNull() & seal["dur_ms"].isNull(), start + query + mapped, remainder),
        plain("write"),
        plain("advance"),
    )
    return df.select(*ids, F.inline(frames))


def span_lanes(spans: DataFrame) -> DataFrame:
    """Lanes of runs still in progress, from their paired spans; the first span per stage counts."""
    order = F.struct("created_ms", "arrival")

    def first(stage: str) -> Column:
        return F.min_by(F.struct("start_ms", "dur_ms"), F.when(F.col("stage") == stage, order)).alias(f"_{stage}")

    wide = spans.groupBy("run_id").agg(*[first(s) for s in ("cursorRead", "seal", "write", "advance")])
    absent = F.lit(None).cast("double")
    return _lanes(wide.withColumns({"query_ms": absent, "map_ms": absent}), ["run_id"])


def lane_stats(lanes: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """Descriptive statistics of recorded, closed lanes."""
    return descriptive_stats(lanes.filter("recorded AND NOT open"), "dur_ms", [*by, "lane"])


def trend_series(cycles: DataFrame) -> DataFrame:
    """Successful cycles at completion time: raw rows per second, and records."""
    rate = F.when(F.col("total_ms") > 0, finite(F.col("input_rows")) / (F.col("total_ms") / F.lit(1000.0)))
    at = F.coalesce("completed_ms", F.lit(0)).alias("at_ms")
    long = cycles.filter(_succeeded()).select(
        "source",
        "run_id",
        at,
        F.inline(
            F.array(
                F.struct(F.lit("throughput").alias("series"), rate.alias("value")),
                F.struct(F.lit("records").alias("series"), F.col("records").cast("double").alias("value")),
            )
        ),
    )
    return long.filter(F.col("value").isNotNull()).orderBy("source", "series", "at_ms", "run_id")


def cycle_elapsed(cycles: DataFrame) -> DataFrame:
    """Total when positive, else the latest stage end (its start while open), else 0."""
    end = F.transform("timeline", lambda s: s["start_ms"] + F.coalesce(s["dur_ms"], F.lit(0.0)))
    total = finite(F.col("total_ms"))
    latest = F.greatest(F.lit(0.0), F.coalesce(F.array_max(end), F.lit(0.0)))
    return cycles.select("run_id", F.when(total > 0, total).otherwise(latest).alias("elapsed_ms"))


def select_source(resolved: DataFrame, unresolved: DataFrame, preferred: str | None = None) -> DataFrame:
    """One row: the preferred source if present, else the earliest-starting one, else the pending group."""
    starts = resolved.groupBy("source").agg(F.min("started_ms").cast("double").alias("start"), F.lit(0).alias("rank"))
    pending = unresolved.select(
        F.lit(None).cast("string").alias("source"), F.lit(0.0).alias("start"), F.lit(1).alias("rank")
    ).limit(1)
    wanted = F.when(F.col("source") == preferred, 0).otherwise(1) if preferred is not None else F.lit(1)
    order = F.struct(wanted.alias("a"), F.col("rank"), F.col("start"), F.coalesce("source", F.lit("")).alias("b"))
    return starts.unionByName(pending).agg(
        F.min_by("source", order).alias("source"), (F.min_by("rank", order) == 1).alias("is_pending")
    )


def select_cycle(cycles: DataFrame, preferred: str | None = None, by: Sequence[str] = ("source",)) -> DataFrame:
    """Per source, the preferred run if present, else the one that started last."""
    wanted = F.when(F.col("run_id") == preferred, 1).otherwise(0) if preferred is not None else F.lit(0)
    order = F.struct(wanted.alias("a"), F.col("started_ms"), F.col("run_id"))
    return cycles.groupBy(*by).agg(F.max_by("run_id", order).alias("run_id"))


def recent_warnings(warnings: DataFrame, n: int = 5) -> DataFrame:
    """The last n warnings in line order."""
    return warnings.orderBy(F.col("file").desc(), F.col("line").desc()).limit(n).orderBy("file", "line")
