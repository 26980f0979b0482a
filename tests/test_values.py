"""Scalar functions, readers and small operators on values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from logtel.functions import scalars as s
from logtel.operators import dumps, ingest, keyed, polls
from logtel.sources.dump_folders import read_dump_runs
from logtel.sources.poll_lines import read_poll_ndjson
from logtel.sources.rows import read_row_export


def values(spark, texts, function):
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    return [r[0] for r in df.select(function(F.col("c"))).collect()]


def test_times(spark):
    assert values(spark, ["1,782,496,457,655", "+5", "1.5", " ", "99999999999999999999"], s.epoch_ms_text) == [
        1782496457655, 5, None, None, None,
    ]
    us = ["6/26/2026, 5:54:27.64159 PM", "2026-06-26 17:54:27", "6/26/2026", "soon"]
    assert values(spark, us, s.datetime_ms_text) == [1782496467641, 1782496467000, 1782432000000, None]
    iso = ["2026-06-26T17:54:27.641Z", "2026-06-26T19:54:27+0200", "2026-06-26", "6/26/2026", "not-a-date"]
    assert values(spark, iso, s.iso_ms) == [1782496467641, 1782496467000, 1782432000000, None, None]


def test_comparable_values(spark):
    parse = lambda c: s.coerce_comparable(F.try_parse_json(c))
    texts = ["5", '"2026-01-01T00:00:00Z"', '"1,234.5"', '""', "null", "1e400", '"abc"']
    assert values(spark, texts, parse) == [5.0, 1767225600000.0, 1234.5, None, None, None, None]


def test_small_functions(spark):
    assert values(spark, ["1/33", "x/y", "77abc"], s.source_seq) == [33, None, 77]
    df = spark.createDataFrame([("shard-10",), ("shard-2",), ("shard-02b",)], "c string")
    assert [r.c for r in df.orderBy(s.natural_sort_key(F.col("c"))).collect()] == ["shard-2", "shard-02b", "shard-10"]
    assert [s.iso_duration_ms(t) for t in ("PT2H", "PT30M", "P1DT1S", "")] == [7200000, 1800000, 86401000, 7200000]
    assert s.clock_duration_ms("1.00:00:00") == 86400000
    with pytest.raises(ValueError):
        s.iso_duration_ms("2 hours")


def test_csv_with_line_breaks_over_blocks(spark, tmp_path):
    path = tmp_path / "a.csv"
    body = 'id,name,note\r\n1,"a ""q"" b","x,\ny"\r\n\r\n2,short\n3,long,z,extra\n4,,"multi\r\nline\n\nthree"\n'
    path.write_bytes((body + "".join(f'{i},n,"v\n{i}"\n' for i in range(5, 60))).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        rows = read_row_export(spark, str(path)).orderBy("_ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r)[:3] for r in rows[:4]] == [
        ("1", 'a "q" b', "x,\ny"), ("2", "short", None), ("3", "long", "z"), ("4", None, "multi\r\nline\n\nthree"),
    ]
    assert [r.note for r in rows[4:]] == [f"v\n{i}" for i in range(5, 60)]


CYCLE = {
    "type": "cycle", "ts": "2026-01-01T00:00:00Z", "runId": "r", "source": "a", "outcome": "success",
    "startedAtUtc": "2026-01-01T00:00:00Z", "completedAtUtc": "2026-01-01T00:00:05Z", "totalMs": 5000,
    "records": 1200, "recordsPerSec": 240, "timeline": [], "inputRows": 6000, "kustoMs": 3000, "mapMs": 200,
}


def test_poll_lines_and_throughput(spark, tmp_path):
    stage = {"type": "stage", "ts": "2026-01-01T00:00:00Z", "runId": "q", "stage": "seal", "ev": "start", "atMs": 5}
    lines = [
        json.dumps(CYCLE), "bad", "", json.dumps({"type": "x"}), json.dumps(stage), json.dumps({**stage, "ev": "end"}),
        json.dumps({**stage, "atMs": "5"}), json.dumps({**CYCLE, "timeline": [{"stage": "s", "startMs": 0}]}), json.dumps({**CYCLE, "users": "3"}),
    ]
    (tmp_path / "log.ndjson").write_text("\n".join(lines))
    stages, cycles, warnings = read_poll_ndjson(spark, str(tmp_path))
    assert {r.line: r.message for r in warnings.collect()} == {
        2: "line 2: invalid JSON.",
        4: 'line 4: unknown event type "x".',
        6: "line 6.durMs must be a finite number.",
        7: "line 7.atMs must be a finite number.",
        8: "line 8.timeline[0].durMs must be a finite number.",
        9: "line 9.users must be a finite number.",
    }
    assert stages.count() == 1
    got = polls.poll_throughput(cycles).first()
    assert (got.read_rows_per_sec, got.processing_rows_per_sec, got.events_per_sec, got.rows_per_event) == (1875, 1200, 240, 5)
    metrics = polls.source_metrics(cycles).first()
    assert metrics.store_affected_cycles is None and metrics.total_users is None and metrics.total_input_rows == 6000


def test_dump_folders(spark, tmp_path):
    def write(name, value):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(value if isinstance(value, str) else json.dumps(value))

    message = {"partitionId": "1", "sequenceNumber": 10, "status": "Pending", "record": {"sessionId": "s", "payload": {"action": "A", "actionModifier": "B"}}}
    event = {"kind": "Emit", "lastActivityUtc": "2026", "sources": ["1/10", "bad"], "document": {"id": "d1", "bladeName": "Ext/Blade"}}
    write("r1/00-MESSAGES.json", {"messages": [message]})
    write("r1/01-composed/s.json", {"sessionId": "s", "events": [event]})
    write("r1/02-flush.json", {"summary": {"eventsWritten": 1, "checkpointSequenceNumber": 10}, "markedDone": {"messages": [message]}})
    write("r2/00-messages.json", {"messages": []})
    write("r2/02-flush.json", {})
    out = read_dump_runs(spark, str(tmp_path))
    assert [(r.seq, r.label, r.session_id) for r in out["messages"].collect()] == [(10, "A/B", "s")]
    assert [r.seq for r in out["sources"].collect()] == [10]
    assert [(r.run_id[-2:], r.artifact) for r in out["errors"].collect()] == [("r2", "01-composed")]
    assert [(r.document_id, r.document_type, r.blade) for r in dumps.written_documents(out["occurrences"]).collect()] == [("d1", "event", "Blade")]


def test_null_keys_are_keys(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, None)], "k bigint, v string")
    keys = spark.createDataFrame([(None,), (2,)], "k bigint")
    assert [r.v for r in keyed.purge_keys(df, keys, ["/k"]).collect()] == ["a"]
    assert not keyed.verify_purged(df, keys, ["k"]).first().is_empty
    with pytest.raises(ValueError):
        keyed.distinct_keys(df, ["/k/x"])
    with pytest.raises(ValueError):
        keyed.distinct_keys(df, ["other"])


def test_keys_ignore_case_of_the_column(spark):
    df = spark.createDataFrame([(" ", "u", 1), ("v", "w", 2), (None, None, 3)], ["SESSIONID", "sessionId", "_ord"])
    kept, skipped = ingest.resolve_key(df)
    assert sorted((r._ord, r._key) for r in kept.select("_ord", "_key").collect()) == [(1, "u"), (2, "w")]
    assert [r._ord for r in skipped.select("_ord").collect()] == [3]
    body = ingest.rows_to_json(kept).filter("_ord = 1").select("_body").first()[0]
    assert json.loads(body) == {"SESSIONID": " ", "sessionId": "u"}


def test_no_window_over_everything(spark):
    """Row numbering over a whole table must not bring it to one partition."""
    from logtel.operators.layout import number_rows

    plan = number_rows(spark.range(1000), [], ["id"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_block" in plan and "BroadcastHashJoin" in plan


def test_natural_order_of_long_runs_and_leading_zeros(spark):
    names = ["a" + "9" * 25, "a" + "9" * 24 + "8", "a01", "a1", "a2", "a010", "a", "b1"]
    got = [r.c for r in spark.createDataFrame([(n,) for n in names], "c string").orderBy(s.natural_sort_key(F.col("c"))).collect()]
    assert got == ["a", "a01", "a1", "a2", "a010", "a" + "9" * 24 + "8", "a" + "9" * 25, "b1"]


def test_latest_row_of_a_key_without_any_order(spark):
    from logtel.operators.keyed import latest_per_key

    rows = spark.createDataFrame([("k", None, 1), ("m", None, 2), ("m", 5, 3), ("m", 4, 4)], "key string, at int, value int")
    assert sorted(map(tuple, latest_per_key(rows, ["key"], "at").collect())) == [("k", None, 1), ("m", 5, 3)]


def test_typed_properties_become_text(spark):
    import datetime

    from logtel.operators.messages import message_metadata

    typed = "struct<n: int, raw: binary, at: timestamp, none: string>"
    rows = spark.createDataFrame(
        [(1, 0, 5, "o", 0, None, "m", None, None, b"body", {"x": b"ab"}, (7, b"\x01\x02", datetime.datetime(2024, 1, 2, 3, 4, 5), None))],
        "index bigint, partition_id int, seq bigint, msg_offset string, enqueued_ms bigint, partition_key string, message_id string, "
        f"correlation_id string, content_type string, body binary, system_properties map<string, binary>, app_properties {typed}",
    )
    found = message_metadata(rows).first()
    assert found.system_properties == {"x": "YWI="}
    assert found.app_properties == {"n": "7", "raw": "AQI=", "at": "2024-01-02T03:04:05.000000Z", "none": None}


def test_a_read_has_no_cap_of_its_own(spark):
    from logtel.operators.messages import bounded_read, partition_heads

    log = spark.range(0, 3000).selectExpr("id % 3 AS partition_id", "id AS seq")
    marks = spark.createDataFrame([(0, 2000)], "partition_id bigint, seq bigint")
    heads = partition_heads(log)
    assert bounded_read(log, heads, marks).count() == 2000 + 333
    assert bounded_read(log, heads, marks, only_backlog=False).count() == 3000
    assert [r.seq for r in bounded_read(log, heads, marks, 2).orderBy("index").collect()] == [2001, 2004]


def test_every_repeated_part_is_a_row(spark):
    from logtel.operators import assembly
    from logtel.plans.sample_lifecycle import CONFIG

    lifecycles = assembly.read_lifecycles(CONFIG)
    parts = ["opening", "question", "answer", "answer", "answer", "question"]
    rows = [
        (f'{{"kind": "conversation", "session": "s", "event": "e", "part": "{p}", "dedupe": "d{i}"}}', "0", i, str(i), i) for i, p in enumerate(parts)
    ]
    envelopes = spark.createDataFrame(rows, "payload string, partition_id string, sequence_number bigint, msg_offset string, received_ms bigint")
    deduped = assembly.dedupe_envelopes(assembly.project_envelopes(envelopes, lifecycles), lifecycles)
    found = assembly.assembled_parts(deduped).orderBy("sequence_number").collect()
    assert [(r.part, r.sequence_number) for r in found] == [(p, i) for i, p in enumerate(parts[:5])]
    assert assembly.assemble_events(deduped, lifecycles, 0).first().part_count == 5


def test_checkpoints_by_group_and_hub(spark, tmp_path):
    from logtel.sources.files import read_checkpoints

    for group, body in (("g1", '{"SequenceNumber": 5}'), ("g2", '{"SequenceNumber": "x"}')):
        (tmp_path / group / "h").mkdir(parents=True)
        (tmp_path / group / "h" / "0").write_text(body)
    wanted = spark.createDataFrame([("g1", "h", "0"), ("g2", "h", "0"), ("g3", "h", "0"), ("g1", "h", "1")], "consumer_group string, hub string, partition_id string")
    found = {(r.consumer_group, r.partition_id): (r.seq, r.status) for r in read_checkpoints(spark, str(tmp_path), wanted).collect()}
    assert found == {("g1", "0"): (5, None), ("g2", "0"): (None, "error: invalid SequenceNumber"), ("g3", "0"): (None, "no_checkpoint"), ("g1", "1"): (None, "no_checkpoint")}


def test_pull_bounds_reach_the_scan(spark, tmp_path):
    from logtel.operators.ingest import incremental_pull

    path = str(tmp_path / "rows")
    spark.range(0, 1000).selectExpr("cast(id % 5 as string) AS object_id", "'s' AS session_id", "id AS client_ms", "id AS ts_ms").write.parquet(path)
    marks = spark.createDataFrame([("0", 900), ("1", 950)], "object_id string, watermark_ms bigint")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    pulled = incremental_pull(spark.read.parquet(path), marks, 1000)
    assert sorted({r.object_id for r in pulled.collect()}) == ["0", "1"] and pulled.count() == 19 + 10
    plan = pulled._jdf.queryExecution().executedPlan().toString()
    # a subquery among the pushed filters is a number by the time the scan runs
    assert "PushedFilters: [Or(GreaterThan(client_ms,ScalarSubquery" in plan and "GreaterThan(ts_ms,ScalarSubquery" in plan
    # a user without a watermark looks back from now; no user at all is an error
    back = incremental_pull(spark.read.parquet(path), marks.unionByName(spark.createDataFrame([("2", None)], marks.schema)), 1000, "PT0.01S")
    assert back.count() == 19 + 10 + 2
    with pytest.raises(ValueError, match="at least one user"):
        incremental_pull(spark.read.parquet(path), marks.limit(0), 1000)


def test_read_bounds_reach_the_scan(spark, tmp_path):
    from logtel.operators.messages import bounded_read, partition_heads

    path = str(tmp_path / "log")
    spark.range(0, 3000).selectExpr("id % 3 AS partition_id", "id AS seq", "cast(id AS string) AS body").write.parquet(path)
    log = spark.read.parquet(path)
    marks = spark.createDataFrame([(0, 2900), (1, 2950), (2, 2800)], "partition_id bigint, seq bigint")
    heads = partition_heads(log.filter("seq < 2990"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    read = bounded_read(log, heads, marks)
    rows = read.orderBy("index").collect()
    want = [(p, s) for p in range(3) for s in range({0: 2901, 1: 2951, 2: 2801}[p], 2990) if s % 3 == p]
    assert [(r["partition_id"], r["seq"], r["index"]) for r in rows] == [(*w, i + 1) for i, w in enumerate(want)]
    read.collect()
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(seq,ScalarSubquery" in plan and "LessThanOrEqual(seq,ScalarSubquery" in plan


def test_a_quote_left_open_is_one_error(spark, tmp_path):
    from logtel.sources.rows import UNTERMINATED, read_checked_rows

    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines"\n2,plain\n3,"never closed\n' + "4,more\n" * 500)
    (tmp_path / "b.csv").write_text("id,note\n" + "".join(f'{i},"a ""b"" c"\n' for i in range(10, 60)))
    rows, errors = read_checked_rows(spark, str(tmp_path))
    found = {r.id: r.note for r in rows.collect()}
    assert found == {"1": "two\nlines", "2": "plain"} | {str(i): 'a "b" c' for i in range(10, 60)}
    wrong = errors.collect()
    assert [(r._ord, r.message, r.record) for r in wrong] == [(5, UNTERMINATED, '3,"never closed')] and wrong[0]._file.endswith("a.csv")


def test_lost_batches_are_not_an_empty_table(spark, tmp_path):
    import pytest
    from pyspark.sql import types as T

    from logtel.streaming.tables import read_batches

    schema = T.StructType().add("a", T.LongType())
    assert read_batches(spark, str(tmp_path / "none"), schema).collect() == []
    (tmp_path / "bad" / "_span=0-0").mkdir(parents=True)
    (tmp_path / "bad" / "_span=0-0" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        read_batches(spark, str(tmp_path / "bad"), schema).collect()
