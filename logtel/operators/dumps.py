"""Debug dumps: how each message ended, session groups, and how far a checkpoint may move.

Messages: run_id, seq, status, session_id, timestamp_ms, label. Occurrences:
run_id, session_id, position, occurrence_id, kind (Emit or Acknowledge),
last_activity (text). Sources: run_id, occurrence_id, seq, one row per reference.
Lists of any length stay in rows, never in arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtel.operators.keyed import latest_per_key
from logtel.operators.layout import BLOCK, Running, attach, lay_out, running
from logtel.session import cut

UNMAPPED = "(unmapped)"
UNKNOWN_SESSION = "unknown-session"
OCCURRENCE_ORDER = ("_final", "last_activity", "session_id", "occurrence_id")
_NEVER = 9223372036854775807


def order_messages(messages: DataFrame) -> DataFrame:
    """Messages by event time, those without one last, then by sequence number."""
    return messages.orderBy("run_id", F.col("timestamp_ms").asc_nulls_last(), "seq")


def _lay_out_occurrences(occurrences: DataFrame, marked_done: DataFrame | None) -> DataFrame:
    """Occurrences in replay order with their 1-based ordinal; a last step applies ``marked_done``."""
    columns = ["run_id", "occurrence_id", "session_id", "kind", "last_activity"]
    steps = occurrences.select(*columns, F.lit(0).alias("_final"))
    if marked_done is not None:
        blank = F.lit(None).cast("string")
        last = marked_done.select("run_id").distinct().select(
            "run_id", *[blank.alias(c) for c in columns[1:]], F.lit(1).alias("_final")
        )
        steps = steps.unionByName(last)
    laid = lay_out(steps, ["run_id"], OCCURRENCE_ORDER)
    one = F.lit(1).cast("bigint")
    return running(laid, ["run_id"], OCCURRENCE_ORDER, {"ordinal": Running("sum", one)})


def order_occurrences(occurrences: DataFrame) -> DataFrame:
    """Occurrences with their ordinal per run, by last activity, session and id as text."""
    return _lay_out_occurrences(occurrences, None).drop(BLOCK, "_final").orderBy("run_id", "ordinal")


def dispositions(
    messages: DataFrame,
    occurrences: DataFrame,
    sources: DataFrame,
    marked_done: DataFrame | None = None,
    final_messages: DataFrame | None = None,
) -> DataFrame:
    """How each message ended, by the strongest evidence there is."""
    kinds = occurrences.select("run_id", "occurrence_id", "kind")
    evidence = (
        sources.join(kinds, ["run_id", "occurrence_id"])
        .groupBy("run_id", "seq")
        .agg(
            F.bool_or(F.col("kind") == "Emit").alias("_emitted"),
            F.bool_or(F.col("kind") != "Emit").alias("_acknowledged"),
        )
    )
    out = messages.join(evidence, ["run_id", "seq"], "left")
    if marked_done is not None:
        drained = marked_done.select("run_id", "seq").distinct().withColumn("_drained", F.lit(True))
        out = out.join(drained, ["run_id", "seq"], "left")
    else:
        out = out.withColumn("_drained", F.lit(False))
    if final_messages is not None:
        said = final_messages.filter(F.length("disposition") > 0)
        said = latest_per_key(said, ["run_id", "seq"], "position").select("run_id", "seq", F.col("disposition").alias("_said"))
        out = out.join(said, ["run_id", "seq"], "left")
    else:
        out = out.withColumn("_said", F.lit(None).cast("string"))
    ended = F.coalesce(
        F.col("_said"),
        F.when(F.col("_emitted"), "emitted"),
        F.when(F.col("_acknowledged"), "acknowledged"),
        F.when(F.col("status") == "Skipped", "skipped"),
        F.when(F.col("_drained"), "residual-drain"),
        F.lit("pending"),
    )
    return out.select(*messages.columns, ended.alias("disposition"))


def session_groups(messages: DataFrame, authoritative: DataFrame | None = None) -> DataFrame:
    """Members of every session group, one row each, with the group's first member and size.

    Runs with recorded groups keep those; in other runs the pending, mapped
    messages of a known session form a group. Groups order by ``first_seq``.
    """
    derived = messages.filter(
        (F.col("status") == "Pending") & (F.col("label") != UNMAPPED) & (F.col("session_id") != UNKNOWN_SESSION)
    ).select("run_id", "session_id", "seq", F.lit(False).alias("authoritative"))
    if authoritative is not None:
        recorded = authoritative.select("run_id", "session_id", "seq", F.lit(True).alias("authoritative"))
        derived = derived.join(recorded.select("run_id").distinct(), "run_id", "left_anti").unionByName(recorded)
    heads = derived.groupBy("run_id", "session_id").agg(F.min("seq").alias("first_seq"), F.count("seq").alias("members"))
    return derived.join(heads, ["run_id", "session_id"])


def anchors(messages: DataFrame, meta: DataFrame, flush: DataFrame) -> DataFrame:
    """Starting and final checkpoint and the sequence range of each run."""
    extent = messages.groupBy("run_id").agg(F.min("seq").alias("_min"), F.max("seq").alias("_max"))
    least, most = F.coalesce("_min", F.lit(0)), F.coalesce("_max", F.lit(0))
    known = meta.select("run_id", "starting_checkpoint", "final_checkpoint", "range_min", "range_max")
    declared = flush.select("run_id", F.col("checkpoint_seq").alias("_flushed"))
    ranged = F.col("range_min").isNotNull()
    return (
        extent.join(known, "run_id", "full_outer")
        .join(declared, "run_id", "full_outer")
        .select(
            "run_id",
            F.coalesce("starting_checkpoint", least - 1).cast("bigint").alias("starting_checkpoint"),
            F.coalesce("final_checkpoint", "_flushed", most).cast("bigint").alias("final_checkpoint"),
            F.when(ranged, F.col("range_min")).otherwise(least).cast("bigint").alias("range_min"),
            F.when(ranged, F.col("range_max")).otherwise(most).cast("bigint").alias("range_max"),
        )
    )


def checkpoint_frontier(messages: DataFrame, start: DataFrame) -> DataFrame:
    """Highest seq up to which every present message is Done or Skipped; gaps do not stop it.

    ``start`` has one row per run: run_id, start_seq. Messages are not moved:
    two scans of three columns, each aggregated before it is exchanged.
    """
    facts = messages.select("run_id", "seq", F.col("status").isin("Done", "Skipped").alias("_closed"))
    beyond = attach(facts, start.select("run_id", "start_seq"), ["run_id"], ["seq"]).filter("seq > start_seq")
    stops = beyond.groupBy("run_id").agg(F.min(F.when(~F.coalesce("_closed", F.lit(False)), F.col("seq"))).alias("_stop"))
    reached = attach(beyond, stops, ["run_id"], ["seq"]).filter("_stop IS NULL OR seq < _stop").groupBy("run_id").agg(F.max("seq").alias("_reached"))
    return start.join(reached, "run_id", "left").select("run_id", F.coalesce("_reached", "start_seq").alias("frontier"))


@dataclass(frozen=True)
class Replay:
    """What the frontier operators share, each part materialised once.

    ``steps``: numbered occurrences, and one last step for each run that marks
    messages done. ``references``: the ordinal and kind of every source
    reference. ``passed``: each message with the ordinal at which it becomes
    terminal (0 at load, null never) and ``passed_at``, the greatest of these up
    to it among the messages beyond the run's start: the frontier after step n
    is the last of them whose ``passed_at`` is at most n.
    """

    steps: DataFrame
    references: DataFrame
    passed: DataFrame
    start: DataFrame

    def frontier(self, upto: Column) -> DataFrame:
        reached = self.passed.filter((F.col("seq") > F.col("start_seq")) & (F.col("passed_at") <= upto))
        reached = reached.groupBy("run_id").agg(F.max("seq").alias("_reached"))
        return self.start.join(reached, "run_id", "left").select("run_id", F.coalesce("_reached", "start_seq").alias("frontier"))


def replay(
    messages: DataFrame, occurrences: DataFrame, sources: DataFrame, start: DataFrame, marked_done: DataFrame | None = None
) -> Replay:
    """One narrow fact for each message, in blocks by (run, seq); messages are read once."""
    steps = cut(_lay_out_occurrences(occurrences, marked_done).select("run_id", "occurrence_id", "kind", "ordinal", "_final", BLOCK))
    references = cut(
        sources.select("run_id", "occurrence_id", "seq").join(
            steps.filter("_final = 0").select("run_id", "occurrence_id", "kind", "ordinal"), ["run_id", "occurrence_id"]
        ).select("run_id", "seq", "kind", "ordinal")
    )
    when = references.groupBy("run_id", "seq").agg(F.min("ordinal").alias("by_occurrence"))
    facts = messages.select("run_id", "seq", "status").join(when, ["run_id", "seq"], "left")
    bounds = start.select("run_id", "start_seq")
    if marked_done is not None:
        marked = marked_done.select("run_id", "seq").distinct().withColumn("_marked", F.lit(True))
        facts = facts.join(marked, ["run_id", "seq"], "left")
        closing = steps.filter("_final = 1").select("run_id", F.col("ordinal").alias("_last"))
        bounds = bounds.join(closing, "run_id", "full_outer")
    else:
        facts = facts.withColumn("_marked", F.lit(None).cast("boolean"))
        bounds = bounds.withColumn("_last", F.lit(None).cast("bigint"))
    laid = lay_out(facts, ["run_id"], ["seq"])
    known = attach(laid, bounds, ["run_id"], ["seq"], "left").withColumn("by_mark", F.when(F.col("_marked"), F.col("_last")))
    loaded = F.col("status").isin("Done", "Skipped")
    terminal = F.when(loaded, F.lit(0).cast("bigint")).otherwise(F.coalesce("by_occurrence", "by_mark"))
    dated = known.withColumn("terminal", terminal)
    blocking = F.when(F.col("seq") > F.col("start_seq"), F.coalesce("terminal", F.lit(_NEVER)))
    passed = running(dated, ["run_id"], ["seq"], {"passed_at": Running("max", blocking)})
    return Replay(
        steps,
        references,
        cut(passed.select("run_id", "seq", "status", "start_seq", "by_occurrence", "by_mark", "terminal", "passed_at")),
        start.select("run_id", "start_seq"),
    )


def checkpoint_progression(
    messages: DataFrame, occurrences: DataFrame, sources: DataFrame, start: DataFrame, marked_done: DataFrame | None = None
) -> DataFrame:
    """The frontier after each occurrence of a run, in replay order."""
    return progression(replay(messages, occurrences, sources, start, marked_done))


def progression(found: Replay) -> DataFrame:
    gains = (
        found.passed.filter((F.col("seq") > F.col("start_seq")) & (F.col("passed_at") < _NEVER))
        .groupBy("run_id", F.greatest("passed_at", F.lit(1)).alias("ordinal"))
        .agg(F.max("seq").alias("_gain"))
    )
    stepped = found.steps.join(gains, ["run_id", "ordinal"], "left")
    out = attach(running(stepped, ["run_id"], ["ordinal"], {"_reached": Running("max", F.col("_gain"))}), found.start, ["run_id"], ["ordinal"])
    return out.select("run_id", "ordinal", "occurrence_id", F.coalesce("_reached", "start_seq").alias("frontier"))


def state_at(
    messages: DataFrame,
    occurrences: DataFrame,
    sources: DataFrame,
    start: DataFrame,
    ordinal: int | None = None,
    marked_done: DataFrame | None = None,
) -> DataFrame:
    """Counts and frontier of every run after its first ``ordinal`` occurrences (all by default)."""
    return state_of(replay(messages, occurrences, sources, start, marked_done), ordinal)


def state_of(found: Replay, ordinal: int | None = None) -> DataFrame:
    upto = F.lit(_NEVER - 1 if ordinal is None else ordinal)
    by_mark = (F.col("by_mark") <= upto) & (F.col("status") != "Skipped")
    shown = (
        F.when((F.col("by_occurrence") <= upto) | by_mark | (F.col("status") == "Done"), "done")
        .when(F.col("status") == "Skipped", "skipped")
        .otherwise("pending")
    )
    counts = found.passed.groupBy("run_id").agg(*[F.count_if(shown == s).alias(s) for s in ("pending", "done", "skipped")])
    applied = F.col("ordinal") <= upto
    written = found.steps.filter((F.col("_final") == 0) & applied).groupBy("run_id").agg(F.count_if(F.col("kind") == "Emit").alias("_written"))
    drained = found.references.filter(applied & (F.col("kind") != "Emit")).groupBy("run_id").agg(F.count("seq").alias("_drained"))
    frontier = found.start.select("run_id", F.col("start_seq").alias("frontier")) if ordinal == 0 else found.frontier(upto)
    return (
        counts.join(written, "run_id", "left")
        .join(drained, "run_id", "left")
        .join(frontier, "run_id")
        .select(
            "run_id",
            "pending",
            "done",
            "skipped",
            F.coalesce("_written", F.lit(0)).alias("documents_written"),
            F.coalesce("_drained", F.lit(0)).alias("messages_drained"),
            "frontier",
        )
    )


def written_documents(occurrences: DataFrame) -> DataFrame:
    """Documents the Emit occurrences write. Needs doc_id, doc_type and blade_name."""
    return occurrences.filter("kind = 'Emit'").select(
        "run_id",
        "occurrence_id",
        F.coalesce("doc_id", "occurrence_id").alias("document_id"),
        F.coalesce("doc_type", F.lit("event")).alias("document_type"),
        F.element_at(F.split("blade_name", "/"), -1).alias("blade"),
    )


def reconcile_flush(
    messages: DataFrame, occurrences: DataFrame, sources: DataFrame, start: DataFrame, flush: DataFrame, marked_done: DataFrame | None = None
) -> DataFrame:
    """Declared flush figures beside recomputed ones, with a match flag for each."""
    found = state_at(messages, occurrences, sources, start, None, marked_done).select(
        "run_id", F.col("documents_written").alias("found_written"), F.col("frontier").alias("found_checkpoint")
    )
    if marked_done is not None:
        done = marked_done.groupBy("run_id").agg(F.count_distinct("seq").alias("found_done"))
    else:
        done = sources.groupBy("run_id").agg(F.count_distinct("seq").alias("found_done"))
    joined = flush.join(found, "run_id", "left").join(done, "run_id", "left")
    none = F.lit(0).cast("bigint")
    written = F.coalesce("found_written", none)
    marked = F.coalesce("found_done", none)
    return joined.select(
        "run_id",
        F.col("events_written").alias("declared_written"),
        written.alias("found_written"),
        F.col("events_written").eqNullSafe(written).alias("written_match"),
        F.col("messages_marked_done").alias("declared_done"),
        marked.alias("found_done"),
        F.col("messages_marked_done").eqNullSafe(marked).alias("done_match"),
        F.col("checkpoint_seq").alias("declared_checkpoint"),
        "found_checkpoint",
        F.col("checkpoint_seq").eqNullSafe(F.col("found_checkpoint")).alias("checkpoint_match"),
    )
