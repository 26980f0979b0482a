"""Assembly of multi-part events under a declared lifecycle.

A configuration has lifecycles, tried in order: how to match a record, where in
it to find the session, event, part and so on, which parts there are, and when
an event is flushed. Everything about it is decided on the driver; what reaches
the rows is column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtel.functions.scalars import clock_duration_ms
from logtel.functions.templates import build_payload, constant, render_template
from logtel.functions.variants import with_parsed
from logtel.session import written

EVENT = ("lifecycle", "session_id", "event_id")
DEFAULT_RETENTION = "1.00:00:00"


@dataclass(frozen=True)
class Flush:
    when_required: bool = True
    priority_now: bool = True
    update_after_partial: bool = True
    max_updates: int | None = None
    partial_after_ms: int | None = None


@dataclass(frozen=True)
class Lifecycle:
    name: str
    version: str
    match: Mapping[str, Any]
    selectors: Mapping[str, str | None]
    required: tuple[str, ...]
    parts: tuple[str, ...]
    repeatable: tuple[str, ...]
    flush: Flush
    retention_ms: int
    output: Mapping[str, Any] = field(default_factory=dict)


def read_lifecycles(config: Mapping[str, Any]) -> list[Lifecycle]:
    """Lifecycles of a parsed configuration; a lifecycle's flush settings override the defaults one by one."""
    defaults = config.get("defaults", {})
    retention = clock_duration_ms(defaults.get("eventHubRetention", DEFAULT_RETENTION))
    out = []
    for item in config["lifecycles"]:
        policy = {**defaults.get("flush", {}), **item.get("flush", {})}
        waits = []
        if "partialAfterRetentionFraction" in policy:
            waits.append(round(policy["partialAfterRetentionFraction"] * retention))
        if "partialAfterMax" in policy:
            waits.append(clock_duration_ms(policy["partialAfterMax"]))
        selectors = {
            "session_id": item["sessionKeySelector"],
            "event_type": item["eventTypeSelector"],
            "event_id": item["eventKeySelector"],
            "part": item["partSelector"],
            "priority": item.get("prioritySelector"),
            "timestamp": item.get("timestampSelector"),
            "dedupe_key": item.get("dedupeKeySelector"),
        }
        parts = sorted(item["parts"], key=lambda p: p.get("order", 0))
        out.append(
            Lifecycle(
                name=item["name"],
                version=item["version"],
                match=item.get("match", {}),
                selectors=selectors,
                required=tuple(p["name"] for p in parts if p["required"]),
                parts=tuple(p["name"] for p in parts),
                repeatable=tuple(p["name"] for p in parts if p.get("allowDuplicates", False)),
                flush=Flush(
                    when_required=policy.get("whenRequiredPartsPresent", True),
                    priority_now=policy.get("priorityImmediately", True),
                    update_after_partial=policy.get("updateAfterPartial", True),
                    max_updates=policy.get("maxUpdates"),
                    partial_after_ms=min(waits) if waits else None,
                ),
                retention_ms=retention,
                output=item.get("output", {}),
            )
        )
    return out


def _selected(record: Column, selector: str | None) -> Column:
    """Text of a selected member; objects and arrays have none."""
    if selector is None:
        return F.lit(None).cast("string")
    return F.try_variant_get(record, selector, "string")


def _matches(record: Column, lifecycle: Lifecycle) -> Column:
    rule, good = lifecycle.match, F.lit(True)
    if "typeEquals" in rule:
        good = good & (_selected(record, lifecycle.selectors["event_type"]) == rule["typeEquals"])
    if "selectorExists" in rule:
        good = good & F.try_variant_get(record, rule["selectorExists"], "variant").isNotNull()
    if "selectorEquals" in rule:
        found = F.try_variant_get(record, rule["selectorEquals"]["selector"], "variant")
        wanted = constant(rule["selectorEquals"]["value"])
        good = good & (F.to_json(found) == F.to_json(wanted)) & found.isNotNull()
    return F.coalesce(good, F.lit(False))


def match_lifecycle(envelopes: DataFrame, lifecycles: Sequence[Lifecycle], record: str = "record") -> DataFrame:
    """Add ``lifecycle``, the position of the first one that matches (NULL for none)."""
    chosen = F.lit(None).cast("int")
    for i in range(len(lifecycles) - 1, -1, -1):
        chosen = F.when(_matches(F.col(record), lifecycles[i]), F.lit(i)).otherwise(chosen)
    return envelopes.withColumn("lifecycle", chosen)


def _by_lifecycle(lifecycles: Sequence[Lifecycle], value: Callable[[Lifecycle], Column]) -> Column:
    out = F.lit(None)
    for i, lifecycle in enumerate(lifecycles):
        out = F.when(F.col("lifecycle") == i, value(lifecycle)).otherwise(out)
    return out


def project_envelopes(envelopes: DataFrame, lifecycles: Sequence[Lifecycle]) -> DataFrame:
    """Envelopes with the members their lifecycle selects; ``is_mapped`` tells usable ones.

    ``envelopes``: payload (JSON text), partition_id, sequence_number, msg_offset, received_ms.
    """
    parsed = match_lifecycle(with_parsed(envelopes, "payload", "record"), lifecycles)

    def selected(name: str) -> Column:
        return _by_lifecycle(lifecycles, lambda lc: _selected(F.col("record"), lc.selectors[name]))

    names = ("session_id", "event_type", "event_id", "part", "timestamp", "dedupe_key")
    out = parsed.withColumns({n: selected(n) for n in names})
    declared = _by_lifecycle(lifecycles, lambda lc: F.col("part").isin(*lc.parts))
    complete = F.col("session_id").isNotNull() & F.col("event_id").isNotNull() & F.coalesce(declared, F.lit(False))
    return out.withColumns(
        {
            "priority": F.coalesce(selected("priority").try_cast("boolean"), F.lit(False)),
            "is_mapped": F.col("lifecycle").isNotNull() & complete,
        }
    ).drop("record")


def dedupe_envelopes(projected: DataFrame, lifecycles: Sequence[Lifecycle]) -> DataFrame:
    """Mapped envelopes with ``is_duplicate``: all but the first of a dedupe key, and of a part that may not repeat.

    The first ones are found by aggregation and joined back, so a key with very
    many copies is neither sorted nor held in one place.
    """
    place = F.struct("sequence_number", "partition_id")
    own = F.concat_ws("/", F.col("partition_id"), F.col("sequence_number").cast("string"))
    rows = projected.filter("is_mapped").withColumns({"_place": place, "_dedupe": F.coalesce("dedupe_key", own)})

    def first_of(df: DataFrame, name: str, *more: str) -> DataFrame:
        return df.groupBy(*EVENT, *more).agg(F.min("_place").alias(name))

    once = rows.join(first_of(rows, "_first", "_dedupe"), [*EVENT, "_dedupe"])
    once = once.withColumn("_repeat", F.col("_place") != F.col("_first"))
    fresh = once.filter("NOT _repeat")
    parted = once.join(first_of(fresh, "_first_part", "part"), [*EVENT, "part"], "left")
    may_repeat = F.coalesce(
        _by_lifecycle(lifecycles, lambda lc: F.col("part").isin(*lc.repeatable) if lc.repeatable else F.lit(False)),
        F.lit(False),
    )
    again = ~may_repeat & (F.col("_place") != F.col("_first_part"))
    return parted.withColumn("is_duplicate", F.col("_repeat") | again).drop(
        "_place", "_dedupe", "_first", "_first_part", "_repeat"
    )


def assembled_parts(deduped: DataFrame) -> DataFrame:
    """Every part of every event, repeated ones too: a row for each envelope that is not a duplicate."""
    return deduped.filter("NOT is_duplicate").select(
        *EVENT, "part", "sequence_number", "partition_id", "msg_offset", "event_type", "timestamp", "dedupe_key", "received_ms", "priority", "payload"
    )


def assemble_events(deduped: DataFrame, lifecycles: Sequence[Lifecycle], as_of_ms: int) -> DataFrame:
    """One row per (session, event): its parts, what is missing, and whether to flush it at ``as_of_ms``.

    ``parts`` holds the first envelope of each declared part, by sequence number,
    from which documents are written, so its length is bounded by the
    configuration. ``part_count`` counts all, and ``assembled_parts`` has them.
    """
    # written, as both the event's facts and the payloads that it needs are taken from it
    kept = written(deduped.filter("NOT is_duplicate"), "kept-envelopes").withColumn("_place", F.struct("sequence_number", "partition_id"))
    names = sorted({p for lc in lifecycles for p in lc.parts})
    piece = F.struct(
        "sequence_number", "part", "event_type", "timestamp", "partition_id", "msg_offset", "dedupe_key", "received_ms", "payload"
    )
    recency = F.struct("received_ms", (-F.col("sequence_number")).alias("back"))
    latest = F.struct("event_type", "partition_id", "sequence_number", "msg_offset")
    grouped = kept.groupBy(*EVENT).agg(
        *[F.min(F.when(F.col("part") == p, F.col("_place"))).alias(f"_first_{i}") for i, p in enumerate(names)],
        F.count(F.lit(1)).alias("part_count"),
        F.max_by(latest, recency).alias("representative"),
        F.min("received_ms").alias("first_received_ms"),
        F.max("received_ms").alias("last_received_ms"),
        F.bool_or("priority").alias("has_priority"),
    )
    # payloads are fetched for the first envelopes only: as many of an event as it has declared parts
    firsts = F.array_compact(F.array(*[F.when(F.col(f"_first_{i}").isNotNull(), F.struct(F.lit(p).alias("part"), F.col(f"_first_{i}").alias("_place"))) for i, p in enumerate(names)]))
    wanted = grouped.select(*EVENT, F.inline(firsts))
    fetched = kept.join(wanted, [*EVENT, "part", "_place"], "left_semi").select(*EVENT, piece.alias("_piece"))
    grouped = grouped.join(fetched.groupBy(*EVENT).agg(F.collect_list("_piece").alias("_pieces")), [*EVENT], "left")
    present = F.coalesce("_pieces", F.array())
    held = F.transform("parts", lambda p: p["part"])
    needed = _by_lifecycle(lifecycles, lambda lc: F.array(*[F.lit(p) for p in lc.required]).cast("array<string>"))
    out = grouped.withColumn("parts", F.array_sort(present)).withColumn("missing_parts", F.array_except(needed, held))

    def setting(value: Callable[[Lifecycle], Any], kind: str) -> Column:
        return _by_lifecycle(lifecycles, lambda lc: F.lit(value(lc)).cast(kind))

    waited = F.lit(as_of_ms) - F.col("first_received_ms") >= setting(lambda lc: lc.flush.partial_after_ms, "bigint")
    urgent = F.col("has_priority") & setting(lambda lc: lc.flush.priority_now, "boolean")
    full = (F.size("missing_parts") == 0) & setting(lambda lc: lc.flush.when_required, "boolean")
    decision = (
        F.when(urgent, "priority").when(full, "full").when(F.coalesce(waited, F.lit(False)), "partial").otherwise("incomplete")
    )
    reason = (
        F.when(F.col("decision") == "priority", "Priority")
        .when(F.col("decision") == "full", "RequiredPartsPresent")
        .when(F.col("decision") == "partial", "PartialTimeout")
        .otherwise("Incomplete")
    )
    return (
        out.drop("_pieces", *[f"_first_{i}" for i in range(len(names))])
        .withColumn("decision", decision)
        .withColumns(
            {
                "reason": reason,
                "is_partial": (F.col("decision") != "incomplete") & (F.size("missing_parts") > 0),
                "lifecycle_name": setting(lambda lc: lc.name, "string"),
                "lifecycle_version": setting(lambda lc: lc.version, "string"),
            }
        )
    )


def write_previews(assemblies: DataFrame, lifecycles: Sequence[Lifecycle]) -> DataFrame:
    """The documents that flushed assemblies would write: id, partition key, payload and missing targets."""
    rep = F.col("representative")
    values = {
        "sessionId": F.col("session_id"),
        "eventId": F.col("event_id"),
        "eventType": rep["event_type"],
        "partitionId": rep["partition_id"],
        "sequenceNumber": rep["sequence_number"],
        "offset": rep["msg_offset"],
        "lifecycleName": F.col("lifecycle_name"),
        "lifecycleVersion": F.col("lifecycle_version"),
        "flushReason": F.col("reason"),
    }

    def record(part: str) -> Column:
        return F.try_parse_json(F.get(F.filter("parts", lambda p: p["part"] == part), 0)["payload"])

    def payload(lc: Lifecycle) -> tuple[Column, Column]:
        return build_payload({p: record(p) for p in lc.parts}, lc.output["payloadMappings"])

    flushed = assemblies.filter("decision <> 'incomplete'")
    return flushed.select(
        _by_lifecycle(lifecycles, lambda lc: render_template(lc.output["idTemplate"], values)).alias("id"),
        _by_lifecycle(lifecycles, lambda lc: render_template(lc.output["partitionKeyTemplate"], values)).alias("partition_key"),
        "session_id",
        "event_id",
        "lifecycle_name",
        "lifecycle_version",
        "reason",
        "is_partial",
        _by_lifecycle(lifecycles, lambda lc: payload(lc)[0]).alias("payload"),
        _by_lifecycle(lifecycles, lambda lc: payload(lc)[1]).alias("missing_targets"),
    )


def batch_summary(projected: DataFrame, deduped: DataFrame, assemblies: DataFrame) -> DataFrame:
    """One row: messages read, duplicates, skipped, assemblies processed, flushed and incomplete."""
    none = F.lit(0).cast("bigint")

    def counts(df: DataFrame, **found: Column) -> DataFrame:
        names = ("messages_read", "duplicates", "skipped", "assemblies", "flushed", "incomplete")
        return df.agg(*[found.get(n, F.max(none)).alias(n) for n in names])

    one = F.count(F.lit(1))
    done = F.col("decision") == "incomplete"
    parts = (
        counts(projected, messages_read=one, skipped=F.count_if(~F.col("is_mapped")))
        .unionByName(counts(deduped, duplicates=F.count_if("is_duplicate")))
        .unionByName(counts(assemblies, assemblies=one, flushed=F.count_if(~done), incomplete=F.count_if(done)))
    )
    return parts.agg(*[F.sum(c).alias(c) for c in parts.columns])
