"""Operators whose result has an order: the order itself, not only the set of rows."""

import random

from pyspark.sql import functions as F

from logtel.functions.scalars import natural_sort_key
from logtel.operators import dumps, ingest, keyed, polls, runs
from logtel.session import new_path

LAST = float("inf")


def collected(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_rows_by_event_time(spark):
    rng = random.Random(1)
    rows = [(f"2026-01-01T00:{rng.randint(0, 9):02d}:00Z" if i % 6 else None, "f" if i % 2 else "e", i) for i in range(200)]
    df = spark.createDataFrame(rows, "TIMESTAMP string, _file string, _ord bigint").repartition(7)
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1], r[2]))
    assert collected(ingest.order_chronologically(df), "TIMESTAMP", "_file", "_ord") == want


def test_messages_by_time_then_number(spark):
    rng = random.Random(2)
    rows = [(f"r{rng.randint(0, 2)}", i, rng.choice([None, 5, 7, 9])) for i in range(200)]
    df = spark.createDataFrame(rows, "run_id string, seq bigint, timestamp_ms bigint").repartition(6)
    want = sorted(rows, key=lambda r: (r[0], LAST if r[2] is None else r[2], r[1]))
    assert collected(dumps.order_messages(df), "run_id", "seq", "timestamp_ms") == want


def test_occurrences_by_activity_as_text(spark):
    rng = random.Random(3)
    rows = [("r", f"s{rng.randint(0, 3)}", f"o{i}", "Emit", rng.choice(["10", "9", "100", ""])) for i in range(120)]
    df = spark.createDataFrame(rows, "run_id string, session_id string, occurrence_id string, kind string, last_activity string").repartition(5)
    want = [(r[2], i + 1) for i, r in enumerate(sorted(rows, key=lambda r: (r[4], r[1], r[2])))]
    assert collected(dumps.order_occurrences(df), "occurrence_id", "ordinal") == want


def test_shards_in_natural_order(spark):
    names = ["shard-10", "shard-9", "shard-1", "shard-100", "Shard-2", "a"]
    rows = [("r", n, "pipeline", True, i) for i, n in enumerate(names)] + [("q", "shard-2", "aggregate", False, 1)]
    snapshots = spark.createDataFrame(rows, "run_id string, shard_id string, snapshot_source string, is_incomplete boolean, observed_ms bigint")
    keys = spark.createDataFrame([(n,) for n in names], "n string")
    natural = [r.n for r in keys.orderBy(natural_sort_key(F.col("n"))).collect()]
    assert natural.index("shard-1") < natural.index("shard-9") < natural.index("shard-10") < natural.index("shard-100")
    assert collected(runs.shard_rollup(snapshots), "run_id", "shard_id") == [("q", "shard-2"), *[("r", n) for n in natural]]


def test_trends_by_source_series_and_time(spark):
    rng = random.Random(4)
    rows = [(f"s{rng.randint(0, 1)}", f"r{i}", "success" if i % 5 else "failed", rng.randint(0, 30), 10.0, 100.0, float(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "source string, run_id string, outcome string, completed_ms bigint, total_ms double, input_rows double, records double")
    found = collected(polls.trend_series(df.repartition(6)), "source", "series", "at_ms", "run_id")
    assert found == sorted(found) and len(found) == 2 * sum(r[2] == "success" for r in rows)


def test_keys_are_written_in_order(spark):
    """Within a log partition, file order and then row order is event-time order; a key has one partition."""
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 9}", None if i % 17 == 0 else rng.randint(0, 40), i, f"body {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "_key string, _event_ms bigint, _ord bigint, _body string").repartition(8)
    path = new_path(spark, "keyed")
    ingest.write_keyed_events(df, path, partitions=3)
    back = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("place")).collect()
    assert len(back) == 400
    homes = {}
    for number in range(3):
        mine = sorted((r for r in back if r.log_partition == number), key=lambda r: (r.file, r.place))
        order = [(LAST if r["_event_ms"] is None else r["_event_ms"], r["_ord"]) for r in mine]
        assert order == sorted(order)
        for r in mine:
            homes.setdefault(r.key, set()).add(number)
    assert all(len(h) == 1 for h in homes.values()) and len(homes) == len({r[0] for r in rows})


def test_purged_or_not(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    gone, left = (spark.createDataFrame([(k,)], "k string") for k in ("c", "b"))
    assert keyed.verify_purged(table, gone, ["/k"]).collect()[0][0] is True
    assert keyed.verify_purged(table, left, ["/k"]).collect()[0][0] is False
    assert keyed.verify_purged(table).collect()[0][0] is False
