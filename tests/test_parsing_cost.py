"""Work on narrow rows is dealt evenly, wide rows are not moved without need, and the quick look finds what the full checks find."""

import pytest
from pyspark.sql import functions as F

from logtel.functions.scalars import iso_ms
from logtel.plans import source_queries as sources
from logtel.plans import tables as t
from logtel.sources import checks, poll_lines, run_artifacts

SMALL = "/root/testdata/sf0.01"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    path = str(tmp_path / "one.parquet")
    spark.range(100_000).withColumn("text", F.sha2(F.col("id").cast("string"), 256)).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        table = spark.read.parquet(path)
        assert table.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = [r["count"] for r in t.spread(table).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 2 * 100_000 / len(sizes)


def test_iteration_lines_are_made_without_a_join(spark):
    assert "Join" not in plan_of(sources.iteration_lines(spark, SMALL))


def test_latest_lines_of_hot_and_rare_files(spark, monkeypatch):
    good = sources.iteration_lines(spark, SMALL).filter("value <> 'nope'").select("value").first()["value"]
    rows = [("hot", n, good) for n in range(1, 400)] + [("hot", 400, "nope"), ("rare", 7, good), ("rare", 8, "  "), ("twice", 3, good), ("twice", 3, good)]
    lines = spark.createDataFrame(rows, "file string, line bigint, value string")
    for most in (1 << 18, 1):  # broadcast, and by hash
        monkeypatch.setattr("logtel.operators.keyed.BROADCAST_ROWS", most)
        found, bad = run_artifacts.parse_iteration_lines(lines, latest_only=True)
        assert sorted((r["file"], r["arrival"]) for r in found.collect()) == [("rare", 7), ("twice", 3)]
        assert [(r["file"], r["line"], r["message"]) for r in bad.collect()] == [("hot", 400, "invalid JSON.")]


ODD = [
    ('"totalMs":1', '"totalMs":"1"'), ('"totalMs":1', '"totalMs":"NaN"'), ('"totalMs":1', '"totalMs":1e999'), ('"totalMs":1', '"totalMs":null'),
    ('"totalMs":1', '"totalMs":true'), ('"totalMs":1', '"totalMs":"x","totalMs":2'), ('"totalMs":1', '"totalMs":2,"totalMs":"x"'),
    ('"totalMs":1', '"totalMs":[1]'), ('"totalMs":1', '"totalMs":{"a":1}'), ('"totalMs":1', '"totalMs":123456789012345678901234567890'),
    ('"totalMs":1,', ""), ('"users":2', '"users":null'), ('"users":2', '"users":"2"'), ('"users":2', '"users":-1e999'), ('"users":2', '"other":{}'),
    ('"stage":"a"', '"stage":5'), ('"stage":"a"', '"stage":true'), ('"stage":"a"', '"stage":"true"'), ('"stage":"a"', '"stage":" "'),
    ('"stage":"a"', '"stage":"a b"'), ('"stage":"a"', '"stage":""'), ('"stage":"a"', '"stage":null'), ('"stage":"a"', '"stage":{"a":1}'),
    ('"stage":"a"', '"stage":"a\\nb"'), ('"stage":"a",', ""), ('"startMs":3', '"startMs":"3"'), ('"startMs":3', '"startMs":null'), ('"startMs":3', '"startMs":1e999'),
    ('"timeline":[', '"timeline":[null,'), ('"timeline":[', '"timeline":[5,'), ('"timeline":[', '"timeline":[[],'), ('"timeline":[', '"timeline":[{},'),
    ('"timeline":[{"stage":"a","startMs":3,"durMs":4}]', '"timeline":[]'), ('"timeline":[{"stage":"a","startMs":3,"durMs":4}]', '"timeline":{}'),
    ('"timeline":[{"stage":"a","startMs":3,"durMs":4}],', ""), ('"ts":"2024-01-01T00:00:00Z"', '"ts":"2024-13-01T00:00:00Z"'),
    ('"ts":"2024-01-01T00:00:00Z"', '"ts":"2024-01-01"'), ('"ts":"2024-01-01T00:00:00Z"', '"ts":7'), ('"runId":"r"', '"runId":7'), ('"runId":"r"', '"runId":" "'),
    ('"source":"s"', "'source':'s'"), ('"outcome":"success"', '"outcome":"fine"'), ('"error":"e"', '"error":null'), ('"error":"e"', '"error":{}'), ("}", "} x"), ("}", "}}"), ("", ""),
]


def test_quick_look_changes_no_result(spark, monkeypatch):
    line = (
        '{"type":"cycle","ts":"2024-01-01T00:00:00Z","runId":"r","source":"s","outcome":"success","startedAtUtc":"2024-01-01T00:00:00.5Z",'
        '"completedAtUtc":"2024-01-01T00:00:01+01:00","totalMs":1,"records":2.5,"recordsPerSec":1e2,"users":2,'
        '"timeline":[{"stage":"a","startMs":3,"durMs":4}],"error":"e"}'
    )
    odd = [line[: line.rindex(old)] + new + line[line.rindex(old) + len(old):] for old, new in ODD]
    lines = spark.createDataFrame([("f", n, text) for n, text in enumerate(odd)], "file string, line bigint, value string")
    found = lambda: {r["line"]: r["problem"] for r in poll_lines.tagged_lines(lines).select("line", "problem").collect()}
    quickly = found()
    monkeypatch.setattr(checks, "sure", lambda *a: F.lit(False))
    assert quickly == found()
    assert quickly[len(odd) - 1] is None and sum(p is not None for p in quickly.values()) > 25


def test_quick_look_settles_good_cycles(spark):
    """Nearly all good cycles need no second look."""
    lines = sources.poll_text(spark, SMALL).filter(f"value LIKE '{{\"type\":\"cycle\"%' AND value LIKE '%\"records\":%'").select("value")
    read = lines.select(checks.quick(F.col("value"), poll_lines._QUICK).alias("q"))
    q = F.col("q")
    entries = q["timeline"]
    sure = checks.sure(q, [q[k] for k in poll_lines._NEEDED], [q[k] for k in poll_lines.OPTIONAL_NUMBERS])
    sure = sure & checks.sure_words(entries["stage"]) & checks.sure_numbers(entries["startMs"]) & checks.sure_numbers(entries["durMs"])
    assert read.filter(~sure).isEmpty() and not read.isEmpty()


@pytest.mark.parametrize("text, ms", [
    ("2024-01-02T03:04:05Z", 1704164645000), ("2024-01-02T03:04:05.678Z", 1704164645678), ("2024-01-02T03:04:05Z\n", 1704164645000),
    ("2024-02-30T03:04:05Z", None), ("2024-01-02T03:04:05", 1704164645000), ("2024-01-02T04:04:05+0100", 1704164645000), ("2024", 1704067200000), ("x", None), (None, None),
])
def test_whole_and_short_times(spark, text, ms):
    assert spark.createDataFrame([(text,)], "t string").select(iso_ms(F.col("t")).alias("ms")).first()["ms"] == ms


def test_published_rows_are_computed_once(spark, tmp_path):
    from logtel.streaming.log_stream import stream_keyed_events

    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    rows = spark.createDataFrame([(f"s{i % 3}", str(1700000000000 + i), i) for i in range(60)], "sessionId string, clientTime string, _ord bigint")
    rows.write.parquet(inbox)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def mark(text):
        seen.add(1)
        return text

    stream = spark.readStream.schema(rows.schema).parquet(inbox).withColumn("sessionId", mark("sessionId"))
    stream_keyed_events(stream, out, str(tmp_path / "checkpoint"), partitions=2, max_bytes=300).awaitTermination()
    assert seen.value == 60 and spark.read.parquet(out).filter("_batch IS NOT NULL").count() == 60
