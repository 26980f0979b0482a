"""Poll telemetry lines: stage events, cycle rollups and warnings from NDJSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtel.functions import variants as v
from logtel.functions.scalars import is_text, iso_ms
from logtel.session import written
from logtel.sources import checks
from logtel.sources.lines import read_numbered_lines

# Member names and words of the line format.
OUTCOMES = ("success", "skipped", "failed")
STAGE_KINDS = ("start", "end")
OPTIONAL_NUMBERS = {
    "users": "users",
    "cursorLagSec": "cursor_lag_sec",
    "kustoMs": "query_ms",
    "mapMs": "map_ms",
    "writeMs": "write_ms",
    "advanceMs": "advance_ms",
    "writeInteractionsRu": "write_units",
    "cosmosRetryCount": "store_retries",
    "cosmos429Count": "store_throttled",
    "cosmosWriteAttempted": "store_attempted",
    "cosmosWriteSucceeded": "store_succeeded",
    "cosmosWriteFailed": "store_failed",
    "cosmosWriteCancelled": "store_cancelled",
}
OPTIONAL_TEXTS = {"failingStage": "failing_stage", "error": "error"}
# What is read of a line, of either type.
_ENTRY = v.shape(**v.leaves("stage", "startMs", "durMs"))
_LINE = v.shape(
    **v.leaves("type", "ts", "runId", "stage", "ev", "atMs", "durMs", "source", "outcome", "startedAtUtc", "completedAtUtc"),
    **v.leaves("totalMs", "records", "recordsPerSec", "inputRows", "windowStartUtc", "windowEndUtc", *OPTIONAL_NUMBERS, *OPTIONAL_TEXTS),
    timeline=f"array<{_ENTRY}>",
)


def _stage_error(root: Column, where: Column) -> Column:
    closing = F.coalesce(v.text(root["ev"]) == "end", F.lit(False))
    return F.coalesce(
        checks.moment(root, "ts", where),
        checks.text(root, "runId", where),
        checks.text(root, "stage", where),
        checks.one_of(root, "ev", where, STAGE_KINDS),
        checks.number(root, "atMs", where),
        F.when(closing, checks.number(root, "durMs", where)).otherwise(
            checks.number(root, "durMs", where, nullable=True, optional=True)
        ),
    )


def _entry_error(entry: Column, where: Column) -> Column:
    return F.coalesce(
        checks.an_object(entry, where),
        checks.text(entry, "stage", where),
        checks.number(entry, "startMs", where),
        checks.number(entry, "durMs", where),
    )


# The numbers of a cycle and its timeline, for a quick look.
_NEEDED = ("totalMs", "records", "recordsPerSec")
_QUICK = ", ".join(
    ["timeline array<struct<stage:string,startMs:double,durMs:double>>", *[f"{name} double" for name in (*_NEEDED, *OPTIONAL_NUMBERS)]]
)


def _sure_cycle(root: Column, read: Column, where: Column) -> Column:
    """True only for a good cycle: its texts are checked as ever, its numbers and timeline as ``read`` with a schema."""
    entries = read["timeline"]
    texts = F.coalesce(
        *[checks.moment(root, key, where) for key in ("ts", "startedAtUtc", "completedAtUtc")],
        *[checks.text(root, key, where) for key in ("runId", "source")],
        checks.one_of(root, "outcome", where, OUTCOMES),
        checks.texts(root, tuple(OPTIONAL_TEXTS), where, nullable=True, optional=True),
    )
    numbers = checks.sure(read, [read[key] for key in _NEEDED], [read[key] for key in OPTIONAL_NUMBERS])
    timeline = checks.sure_words(entries["stage"]) & checks.sure_numbers(entries["startMs"]) & checks.sure_numbers(entries["durMs"])
    return numbers & timeline & texts.isNull()


def _cycle_error(root: Column, where: Column) -> Column:
    timeline = checks.at(where, "timeline")
    return F.coalesce(
        checks.moment(root, "ts", where),
        checks.text(root, "runId", where),
        checks.text(root, "source", where),
        checks.one_of(root, "outcome", where, OUTCOMES),
        checks.moment(root, "startedAtUtc", where),
        checks.moment(root, "completedAtUtc", where),
        checks.numbers(root, _NEEDED, where),
        checks.an_array(root["timeline"], timeline),
        checks.each(root["timeline"], _entry_error, timeline),
        checks.numbers(root, tuple(OPTIONAL_NUMBERS), where, nullable=True, optional=True),
        checks.texts(root, tuple(OPTIONAL_TEXTS), where, nullable=True, optional=True),
    )


def tagged_lines(lines: DataFrame) -> DataFrame:
    """Every non-blank line once: ``facts``, the parsed line, its ``type``, and its first ``problem`` (with ``raw``) if it has one.

    The line is parsed here and nowhere else; the results are filters over this table.
    """
    facts, root, where = F.col("facts"), F.col("_shaped"), F.concat(F.lit("line "), F.col("line").cast("string"))
    kind = v.text(root["type"])
    label = F.coalesce(F.concat(F.lit('"'), kind, F.lit('"')), F.lit("missing"))
    problem = (
        F.when(facts.isNull(), F.concat(where, F.lit(": invalid JSON.")))
        .when(root.isNull(), F.lit("event must be an object."))
        .when(kind == "stage", _stage_error(root, where))
        .when(kind == "cycle", F.when(~_sure_cycle(root, F.col("_quick"), where), _cycle_error(root, where)))
        .otherwise(F.concat(where, F.lit(": unknown event type "), label, F.lit(".")))
    )
    used = lines.filter(is_text(F.col("value"))).select("file", "line", F.col("value").alias("raw"))
    parsed = v.with_value(v.with_parsed(used, "raw", "facts"), v.shaped(facts, _LINE), "_shaped")
    parsed = v.with_value(parsed, F.when(kind == "cycle", checks.quick(F.col("raw"), _QUICK)), "_quick")
    tagged = parsed.select("file", "line", "raw", "facts", kind.alias("type"), problem.alias("problem"))
    bad = F.col("problem").isNotNull()
    return tagged.select("file", "line", F.when(bad, F.col("raw")).alias("raw"), F.when(~bad, facts).alias("facts"), "type", "problem")


def parse_poll_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stages, cycles, warnings) of numbered lines (file, line, value); a bad line never stops the rest."""
    return of_tagged_lines(written(tagged_lines(lines), "poll-lines"))


def of_tagged_lines(tagged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    root = F.col("_shaped")
    parsed = tagged.withColumn("arrival", F.struct("file", "line"))

    def good(kind: str) -> DataFrame:
        return v.with_value(parsed.filter(F.col("problem").isNull() & (F.col("type") == kind)), v.shaped(F.col("facts"), _LINE), "_shaped")

    stages = good("stage").select(
        v.text(root["runId"]).alias("run_id"),
        v.text(root["stage"]).alias("stage"),
        v.text(root["ev"]).alias("ev"),
        v.number(root["atMs"]).alias("at_ms"),
        v.number(root["durMs"]).alias("dur_ms"),
        iso_ms(v.text(root["ts"])).alias("ts_ms"),
        "arrival",
    )
    spans = F.transform(
        root["timeline"],
        lambda e: F.struct(
            v.text(e["stage"]).alias("stage"),
            v.number(e["startMs"]).alias("start_ms"),
            v.number(e["durMs"]).alias("dur_ms"),
        ),
    )
    cycles = good("cycle").select(
        v.text(root["runId"]).alias("run_id"),
        v.text(root["source"]).alias("source"),
        v.text(root["outcome"]).alias("outcome"),
        iso_ms(v.text(root["startedAtUtc"])).alias("started_ms"),
        iso_ms(v.text(root["completedAtUtc"])).alias("completed_ms"),
        v.number(root["totalMs"]).alias("total_ms"),
        v.number(root["records"]).alias("records"),
        v.number(root["recordsPerSec"]).alias("records_per_sec"),
        spans.alias("timeline"),
        *[v.number(root[key]).alias(name) for key, name in OPTIONAL_NUMBERS.items()],
        *[v.text(root[key]).alias(name) for key, name in OPTIONAL_TEXTS.items()],
        v.number(root["inputRows"]).alias("input_rows"),
        iso_ms(v.text(root["windowStartUtc"])).alias("window_start_ms"),
        iso_ms(v.text(root["windowEndUtc"])).alias("window_end_ms"),
        "facts",
        "arrival",
    )
    warnings = parsed.filter(F.col("problem").isNotNull()).select("file", "line", F.col("problem").alias("message"), "raw")
    return stages, cycles, warnings


def read_poll_ndjson(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stages, cycles, warnings) of all lines of the files under ``path``."""
    return parse_poll_lines(read_numbered_lines(spark, path))
