"""Streams give what the batch operators give, also in several batches with a restart between them."""

import dataclasses
import json

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtel.operators import assembly
from logtel.plans.sample_lifecycle import CONFIG
from logtel.session import new_path
from logtel.streaming import assembly_stream, tables
from logtel.streaming.assembly_stream import Assembler, stream_assemble

LIFECYCLES = assembly.read_lifecycles(CONFIG)
SCHEMA = "payload string, partition_id string, sequence_number bigint, msg_offset string, received_ms bigint"


def envelope(kind, event, part, dedupe, seq, at, urgent=False):
    payload = (
        f'{{"kind": "{kind}", "session": "s", "event": "{event}", "part": "{part}", "dedupe": "{dedupe}", '
        f'"urgent": {str(urgent).lower()}, "at": {at}}}'
    )
    return payload, "0", seq, str(seq), at


ROWS = [
    envelope("conversation", "e1", "answer", "a", 1, 1000),
    envelope("conversation", "e1", "answer", "a", 2, 2000),  # the same envelope again
    envelope("conversation", "e1", "answer", "b", 3, 3000),  # a part that may repeat
    envelope("conversation", "e1", "opening", "c", 4, 4000),
    envelope("conversation", "e1", "opening", "d", 5, 5000),  # a part that may not
    envelope("conversation", "e1", "answer", "d", 6, 6000),  # its key is used up
    envelope("conversation", "e1", "question", "e", 7, 7000),
    envelope("other", "n1", "opening", "f", 8, 8000, urgent=True),
    envelope("other", "n2", "opening", "g", 9, 9000),
]


def stream_rows(spark, portions, lifecycles=LIFECYCLES):
    inbox, out, checkpoint = new_path(spark, "inbox"), new_path(spark, "out"), new_path(spark, "state")
    for rows in portions:  # the query stops after each portion and goes on from its checkpoint
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
        stream = stream_assemble(spark.readStream.schema(SCHEMA).parquet(inbox), lifecycles)
        sink = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).collect()


def flushed(spark, portions):
    return {r.event_id: r for r in stream_rows(spark, portions)}


def test_late_parts_update_a_partial_flush_as_often_as_allowed(spark):
    """An event is flushed in part at its deadline; late parts update that flush, at most ``max_updates`` times."""
    wait, hour = LIFECYCLES[0].flush.partial_after_ms, 3_600_000
    after = wait + 2 * hour

    def clock(seq, at):  # another event that moves the watermark
        return envelope("conversation", f"clock{seq}", "opening", f"clock{seq}", seq, at)

    def late(part, seq):
        return envelope("conversation", "e1", part, f"late{seq}", seq, after + seq)

    portions = [
        [envelope("conversation", "e1", "opening", "a", 1, 1000)],
        [clock(2, after)],
        [late("answer", 3)],
        [late("answer", 4)],
        [late("question", 5)],
        [late("answer", 6)],
    ]
    want = {
        # as often as parts come, until the event is complete; what comes after that is dropped
        None: [("partial", False, 1), ("partial", True, 2), ("partial", True, 3), ("full", True, 4)],
        1: [("partial", False, 1), ("partial", True, 2)],
    }
    for most, flushes in want.items():
        flush = dataclasses.replace(LIFECYCLES[0].flush, max_updates=most)
        found = stream_rows(spark, portions, [dataclasses.replace(LIFECYCLES[0], flush=flush), *LIFECYCLES[1:]])
        mine = sorted((r.at_ms, r.decision, r.is_update, r.part_count) for r in found if r.event_id == "e1")
        assert [m[1:] for m in mine] == flushes
    # without updates a late part is dropped, whatever it is
    flush = dataclasses.replace(LIFECYCLES[0].flush, update_after_partial=False)
    found = stream_rows(spark, portions, [dataclasses.replace(LIFECYCLES[0], flush=flush), *LIFECYCLES[1:]])
    assert [(r.decision, r.part_count) for r in found if r.event_id == "e1"] == [("partial", 1)]


class _Store:
    """A state store in memory that counts the exchanges a processor makes with it."""

    def __init__(self):
        self.calls, self.timers, self.maps, self.value = [], [], {}, None

    def getMapState(self, name, *_):
        return _Map(self, self.maps.setdefault(name, {}))

    def getValueState(self, *_):
        return self

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.append(at)

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None


class _Map:
    def __init__(self, store, held):
        self.store, self.held = store, held

    def containsKey(self, key):
        self.store.calls.append("contains")
        return key in self.held

    def updateValue(self, key, value):
        self.store.calls.append("put")
        self.held[key] = value

    def iterator(self):
        self.store.calls.append("iterate")
        return iter(list(self.held.items()))

    def clear(self):
        self.store.calls.append("clear")
        self.held.clear()


def test_an_event_costs_few_exchanges_with_the_state_store():
    """Complete at once: its facts and one timer. Else its parts, once each, one timer at a time; nothing is left in the end."""
    lifecycle, key = LIFECYCLES[0], (0, "s", "e")
    wait, end = lifecycle.flush.partial_after_ms, lifecycle.retention_ms

    def row(part, seq, dedupe=None):
        return Row(part=part, dedupe=dedupe or f"d{seq}", sequence_number=seq, payload="{}", priority=False, received_ms=seq, first_ms=seq, copies=1)

    class At:  # timer information and timer values
        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    def started():
        store, processor = _Store(), Assembler(LIFECYCLES)
        processor.init(store)
        return store, processor

    store, processor = started()
    rows = [row("question", 3), row("answer", 2), row("opening", 1), row("answer", 4, "d2"), row("answer", 5)]
    (flush,) = processor.handleInputRows(key, iter(rows), None)
    assert (flush.decision, flush.part_count, flush.dropped) == ("full", 4, 1)
    assert [p["sequence_number"] for p in flush.parts] == [1, 2, 3, 5]
    assert sorted(store.calls) == ["get", "timer", "update"] and store.timers == [1 + end]
    assert list(processor.handleExpiredTimer(key, At(store.timers[0] + 1), At(store.timers[0]))) == []
    assert store.value is None and not any(store.maps.values())

    store, processor = started()
    assert list(processor.handleInputRows(key, iter([row("opening", 1), row("opening", 2), row("answer", 3)]), None)) == []
    assert store.calls.count("put") == 5 and "contains" not in store.calls and store.timers == [1 + wait]
    (flush,) = processor.handleExpiredTimer(key, At(wait + 2), At(1 + wait))
    assert (flush.decision, flush.part_count, flush.dropped, flush.at_ms) == ("partial", 2, 1, 1 + wait) and store.timers[1:] == [1 + end]
    # a key that a dropped part used up is known in later batches too; the event's parts go when it takes no more
    assert [f.dropped for f in processor.handleInputRows(key, iter([row("answer", 4, "d2"), row("question", 5)]), None)] == [2]
    assert store.value[3] == "full" and not any(store.maps.values())
    assert list(processor.handleInputRows(key, iter([row("answer", 6)]), None)) == [] and store.value[5] == 3
    assert list(processor.handleExpiredTimer(key, At(end + 2), At(1 + end))) == []
    assert store.value is None and len(store.timers) == 2

    store, processor = started()  # both deadlines have passed
    assert list(processor.handleInputRows(key, iter([row("opening", 1)]), None)) == []
    assert [f.decision for f in processor.handleExpiredTimer(key, At(end + 2), At(1 + wait))] == ["partial"]
    assert store.value is None and len(store.timers) == 1 and not any(store.maps.values())


def test_many_keys_of_one_event_go_to_the_store(monkeypatch):
    monkeypatch.setattr(assembly_stream, "_SEEN_HELD", 2)
    store, processor = _Store(), Assembler(LIFECYCLES)
    processor.init(store)
    rows = [
        Row(part="opening" if n < 5 else "question", dedupe=f"d{n % 4}", sequence_number=n, payload="{}", priority=False, received_ms=n, first_ms=n, copies=1)
        for n in range(1, 8)
    ]
    assert list(processor.handleInputRows((0, "s", "e"), iter(rows[:6]), None)) == []
    assert set(store.maps["seen"]) == {(f"d{n}",) for n in range(4)} and store.value[5] == 5
    rows = [rows[6], rows[6].__class__(**(rows[6].asDict() | {"dedupe": "new"}))]
    assert [f.dropped for f in processor.handleInputRows((0, "s", "e"), iter(rows), None)] == [6]
    assert not any(store.maps.values())


def test_stream_equals_batch_with_repeats_and_restart(spark):
    envelopes = spark.createDataFrame(ROWS, SCHEMA)
    deduped = assembly.dedupe_envelopes(assembly.project_envelopes(envelopes, LIFECYCLES), LIFECYCLES)
    batch = {r.event_id: r for r in assembly.assemble_events(deduped, LIFECYCLES, 10_000).collect()}
    parts = {}
    for r in assembly.assembled_parts(deduped).orderBy("sequence_number").collect():
        parts.setdefault(r.event_id, []).append((r.part, r.sequence_number, r.payload))
    for portions in ([ROWS], [ROWS[:3], ROWS[3:6], ROWS[6:]]):
        found = flushed(spark, portions)
        assert set(found) == {"e1", "n1", "n2"}
        for event, row in found.items():
            assert row.decision == batch[event].decision
            assert [tuple(p) for p in row.parts] == parts[event]
            assert row.part_count == batch[event].part_count and row.missing_parts == list(batch[event].missing_parts)
        assert found["e1"].dropped == 3 and found["n1"].decision == "priority"


def test_tables_stay_few_folders_and_take_replays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FAN", 3)
    path, schema = str(tmp_path / "t"), T.StructType().add("v", T.LongType())

    def write(batch):
        tables.write_batch(spark.range(batch, batch + 2).select(F.col("id").alias("v")).coalesce(1), path, batch)

    for batch in range(20):
        write(batch)
        if batch in (4, 8, 17):  # 8 and 17 are replayed after they were merged
            write(batch)
        rows = sorted((r.v, r["_batch_id"]) for r in tables.read_batches(spark, path, schema).collect())
        assert rows == sorted((b + k, b) for b in range(batch + 1) for k in (0, 1))
    folders = sorted(p.name for p in (tmp_path / "t").iterdir())
    assert set(folders) <= {"_span=0-8", "_span=9-17", "_span=8-8", "_span=17-17", "_span=18-18", "_span=19-19"}
    assert [r.v for r in tables.read_before(spark, path, schema, 6).orderBy("v").collect()] == [5, 6]

    for batch in range(6):
        tables.write_state(spark.range(batch, batch + 1).select(F.col("id").alias("v")), f"{path}-state", batch)
        assert [r.v for r in tables.read_before(spark, f"{path}-state", schema, batch + 1).collect()] == [batch]
    assert len(list((tmp_path / "t-state").iterdir())) == 2
    assert tables.read_before(spark, f"{path}-none", schema, 0).count() == 0


def test_poll_stream_keeps_whole_lines_over_restarts(spark, tmp_path):
    """Files arrive one after another, with a restart each time; a run's last cycle stays, with its whole line."""
    from logtel.sources.poll_lines import read_poll_ndjson
    from logtel.streaming.poll_stream import poll_tables, stream_poll

    def cycle(run, records, extra):
        return json.dumps({
            "type": "cycle", "ts": "2026-01-01T00:00:00Z", "runId": run, "source": "s", "outcome": "success", "startedAtUtc": "2026-01-01T00:00:00Z",
            "completedAtUtc": "2026-01-01T00:00:05Z", "totalMs": 5, "records": records, "recordsPerSec": 1, "timeline": [], "extra": extra,
        })

    logs, out = tmp_path / "logs", str(tmp_path / "tables")
    logs.mkdir()
    for number in range(3):
        lines = [cycle("a", number, {"at": number}), "broken", cycle(f"r{number}", 7, [number]), cycle("a", 10 + number, {"last": number})]
        (logs / f"{number}.ndjson").write_text("\n".join(lines) + "\n")
        stream_poll(spark, str(logs), out).awaitTermination()
    _, cycles, warnings = poll_tables(spark, out)
    found = {r.run_id: (r.records, json.loads(r.whole)) for r in cycles.select("run_id", "records", F.to_json("facts").alias("whole")).collect()}
    assert {k: v[0] for k, v in found.items()} == {"a": 12.0, "r0": 7.0, "r1": 7.0, "r2": 7.0}
    assert found["a"][1]["extra"] == {"last": 2} and found["r1"][1]["extra"] == [1]
    assert sorted(r.line for r in warnings.collect()) == [2, 2, 2]
    batch = read_poll_ndjson(spark, str(logs))[1]
    assert batch.count() == 9 and batch.select(F.to_json("facts")).first()[0]


def test_outputs_never_parse_again(spark, tmp_path):
    """Every output of a reader is a filter over documents that were parsed once."""
    from logtel.sources import dump_folders, poll_lines, run_artifacts

    def plans(frames):
        return [f._jdf.queryExecution().executedPlan().toString() for f in frames]

    documents = spark.createDataFrame([("/a/00-messages.json", "{}"), ("/b.json", "[")], "file string, text string")
    lines = spark.createDataFrame([("f", 1, "{}"), ("f", 2, "[")], "file string, line bigint, value string")
    found = plans(dump_folders.parse_dump_runs(documents).values()) + plans(run_artifacts.parse_run_artifacts(documents).values())
    found += plans(poll_lines.parse_poll_lines(lines)) + plans(run_artifacts.parse_iteration_lines(lines))
    assert len(found) == 9 + 5 + 3 + 2
    assert not any("parse_json" in p for p in found)


def test_batches_of_a_stream_go_on_after_restarts(spark):
    """One run of the stream over everything, and one stopped after every portion, number the same batches."""
    from logtel.operators.ingest import event_time_ms, resolve_key, rows_to_json, size_bounded_batches
    from logtel.streaming.log_stream import stream_keyed_events

    rows = [("hot" if i % 3 else f"k{i % 5}" if i % 4 else "", f"2026-01-01T00:{i:02d}:00Z", "x" * (i * 7 % 40), i) for i in range(60)]
    schema = "sessionId string, TIMESTAMP string, note string, _ord bigint"
    frame = spark.createDataFrame(rows, schema)
    events = rows_to_json(resolve_key(event_time_ms(frame), "sessionId")[0])
    want = {r._ord: r._batch for r in size_bounded_batches(events, 300).collect()}
    for portions in ([rows], [rows[:20], rows[20:25], rows[25:]]):
        inbox, out, checkpoint = new_path(spark, "in"), new_path(spark, "out"), new_path(spark, "cp")
        for part in portions:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
            stream = spark.readStream.schema(frame.schema).parquet(inbox)
            stream_keyed_events(stream, out, checkpoint, partitions=2, max_bytes=300).awaitTermination()
        assert {r["_ord"]: r["_batch"] for r in spark.read.parquet(out).collect()} == want
