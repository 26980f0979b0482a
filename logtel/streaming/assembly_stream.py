"""Event-time assembly of multi-part events with keyed state and timers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logtel.operators.assembly import Lifecycle, project_envelopes
from logtel.session import ship_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KEYS = ["lifecycle", "session_id", "event_id"]
_COMBINED = (
    "lifecycle int, session_id string, event_id string, part string, dedupe string, sequence_number bigint, payload string, "
    "priority boolean, received_ms bigint, first_ms bigint, copies bigint, event_time timestamp"
)
_OUTPUT = (
    "lifecycle int, session_id string, event_id string, decision string, is_update boolean, "
    "parts array<struct<part:string,sequence_number:bigint,payload:string>>, missing_parts array<string>, "
    "part_count bigint, dropped bigint, at_ms bigint"
)


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per (event, dedupe key) and input batch, so that many copies of an envelope never travel."""
    for rows in batches:
        if rows.empty:
            continue
        keys = [*_KEYS, "dedupe"]
        ordered = rows.sort_values("sequence_number", kind="stable")
        first = ordered.drop_duplicates(keys)[[*keys, "part", "sequence_number", "payload"]]
        facts = ordered.groupby(keys, sort=False, as_index=False).agg(
            priority=("priority", "max"),
            received_ms=("received_ms", "max"),
            first_ms=("received_ms", "min"),
            copies=("part", "size"),
            event_time=("event_time", "max"),
        )
        yield first.merge(facts, on=keys)[
            [*_KEYS, "part", "dedupe", "sequence_number", "payload", "priority", "received_ms", "first_ms", "copies", "event_time"]
        ]


#: Rows of one event that are put in order together.
_ROWS_SORTED = 10_000
#: Dedupe keys of one event that are held in memory before they go to the state store.
_SEEN_HELD = 10_000
_FACTS = ("first_ms", "last_ms", "priority", "flushed", "updates", "dropped")


class Assembler(StatefulProcessor):
    """State of one event: its parts, when they came, and what has been flushed.

    Each use of the state store is an exchange of messages with the JVM, which
    costs more than the work on a row. So nothing is looked up for an event that
    is new, only the facts are kept of one that takes no more parts, and an event
    waits for one timer at a time. Rows are taken and given as they are: a pandas
    frame for each event costs more than all of its state.
    """

    def __init__(self, lifecycles: Sequence[Lifecycle]) -> None:
        self.lifecycles = list(lifecycles)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a part that may repeat has an entry for each of its envelopes, any other one entry
        self.parts = handle.getMapState("parts", "part string, repeat bigint", "sequence bigint, payload string")
        self.seen = handle.getMapState("seen", "dedupe string", "sequence bigint")
        self.facts = handle.getValueState(
            "facts", "first_ms bigint, last_ms bigint, priority boolean, flushed string, updates int, dropped bigint"
        )

    def _emit(self, key: tuple, decision: str, update: bool, facts: dict, parts: dict, at: int) -> Row:
        held = sorted((value[0], part[0], value[1]) for part, value in parts.items())
        names = {part for _, part, _ in held}
        return Row(
            lifecycle=key[0], session_id=key[1], event_id=key[2], decision=decision, is_update=update,
            parts=[{"part": part, "sequence_number": at, "payload": payload} for at, part, payload in held],
            missing_parts=[p for p in self.lifecycles[key[0]].required if p not in names], part_count=len(held), dropped=facts["dropped"], at_ms=at,
        )

    def _load(self) -> dict | None:
        stored = self.facts.get()
        return None if stored is None else dict(zip(_FACTS, stored))

    def _store(self, facts: dict) -> None:
        self.facts.update(tuple(facts[name] for name in _FACTS))

    def _stored_parts(self) -> dict:
        return {tuple(part): tuple(value) for part, value in self.parts.iterator()}

    def _forget_parts(self) -> None:
        self.parts.clear()
        self.seen.clear()

    @staticmethod
    def _closed(lifecycle: Lifecycle, facts: dict) -> bool:
        """Whether the event takes no more parts; nothing of it is flushed then either."""
        return facts["flushed"] in ("full", "priority") or (facts["flushed"] == "partial" and not lifecycle.flush.update_after_partial)

    @staticmethod
    def _first_wait(lifecycle: Lifecycle) -> int:
        partial = lifecycle.flush.partial_after_ms
        return lifecycle.retention_ms if partial is None else min(partial, lifecycle.retention_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        lifecycle = self.lifecycles[key[0]]
        facts = self._load()
        fresh = facts is None
        closed = not fresh and self._closed(lifecycle, facts)
        parts = {} if fresh or closed else self._stored_parts()
        added, seen, stored = {}, {}, not fresh
        for some in batched(rows, _ROWS_SORTED):
            for row in sorted(some, key=lambda r: r.sequence_number):
                at = int(row.sequence_number)
                if facts is None:
                    start = int(row.first_ms)
                    facts = {"first_ms": start, "last_ms": start, "priority": False, "flushed": "", "updates": 0, "dropped": 0}
                    begun = start
                facts["last_ms"] = max(facts["last_ms"], int(row.received_ms))
                facts["first_ms"] = min(facts["first_ms"], int(row.first_ms))
                if closed:
                    facts["dropped"] += int(row.copies)
                    continue
                slot = (row.part, at if row.part in lifecycle.repeatable else 0)
                known = slot in parts or row.dedupe in seen or (stored and self.seen.containsKey((row.dedupe,)))
                seen[row.dedupe] = at  # as in a batch, a part that came too often still uses up its dedupe key
                if len(seen) >= _SEEN_HELD:
                    self._store_seen(seen)
                    stored = True
                if known:
                    facts["dropped"] += int(row.copies)
                    continue
                parts[slot] = added[slot] = (at, row.payload)
                facts["dropped"] += int(row.copies) - 1
                facts["priority"] = bool(facts["priority"] or row.priority)
        if facts is None:
            return
        flush = None
        if added:
            names = {part for part, _ in parts}
            missing = [p for p in lifecycle.required if p not in names]
            decision = ""
            if facts["priority"] and lifecycle.flush.priority_now:
                decision = "priority"
            elif not missing and lifecycle.flush.when_required:
                decision = "full"
            elif facts["flushed"] == "partial":
                decision = "partial"
            update = facts["flushed"] == "partial"
            spent = lifecycle.flush.max_updates is not None and facts["updates"] >= lifecycle.flush.max_updates
            if decision and not (update and spent):
                facts["updates"] += int(update)
                facts["flushed"] = decision
                flush = self._emit(key, decision, update, facts, parts, facts["last_ms"])
        if self._closed(lifecycle, facts):
            if stored and not closed:
                self._forget_parts()
        else:
            for slot, value in added.items():
                self.parts.updateValue(slot, value)
            self._store_seen(seen)
        if fresh:
            self.handle.registerTimer(begun + (lifecycle.retention_ms if facts["flushed"] else self._first_wait(lifecycle)))
        self._store(facts)
        if flush is not None:
            yield flush

    def _store_seen(self, seen: dict) -> None:
        for dedupe, at in seen.items():
            self.seen.updateValue((dedupe,), (at,))
        seen.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        lifecycle, facts = self.lifecycles[key[0]], self._load()
        if facts is None:
            return
        expired = expiredTimerInfo.getExpiryTimeInMs()
        flush = None
        if not facts["flushed"] and lifecycle.flush.partial_after_ms is not None:
            facts["flushed"] = "partial"
            flush = self._emit(key, "partial", False, facts, self._stored_parts(), expired)
        # after the first deadline comes the end of retention, which may have passed too
        over = expired >= facts["first_ms"] + lifecycle.retention_ms
        end = expired + lifecycle.retention_ms - self._first_wait(lifecycle)
        if over or end < timerValues.getCurrentWatermarkInMs():
            self._forget_parts()
            self.facts.clear()
        else:
            if flush is not None:
                self._store(facts)
                if self._closed(lifecycle, facts):
                    self._forget_parts()
            self.handle.registerTimer(end)
        if flush is not None:
            yield flush

    def close(self) -> None:
        pass


def stream_assemble(envelopes: DataFrame, lifecycles: Sequence[Lifecycle], lateness: str = "1 hour") -> DataFrame:
    """Flushes of assembled events as a stream, append mode.

    An event is flushed when its required parts are in, at once when urgent, or in
    part at its deadline; later parts update a partial flush as the lifecycle
    allows. Its state goes when retention ends. Needs the RocksDB state store.
    """
    ship_package()
    envelopes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    mapped = project_envelopes(envelopes, lifecycles).filter("is_mapped")
    own = F.concat_ws("/", "partition_id", F.col("sequence_number").cast("string"))
    timed = mapped.withColumns({"event_time": F.timestamp_millis("received_ms"), "dedupe": F.coalesce("dedupe_key", own)})
    combined = timed.select(
        *_KEYS, "part", "dedupe", "sequence_number", "payload", "priority", "received_ms", "event_time"
    ).mapInPandas(_combine, _COMBINED)
    return (
        combined.withWatermark("event_time", lateness)
        .groupBy(*_KEYS)
        .transformWithState(
            statefulProcessor=Assembler(lifecycles), outputStructType=_OUTPUT, outputMode="Append", timeMode="EventTime"
        )
    )
