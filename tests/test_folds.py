"""Ordered passes against plain folds, on data where one group holds most rows."""

import random

from pyspark.sql import functions as F

from logtel.operators import dumps, keyed, polls
from logtel.operators.ingest import continued_batches, size_bounded_batches
from logtel.operators.layout import Running, attach, block_count, brackets, input_bytes, lay_out, number_rows, running, values_at_ranks
from logtel.operators.messages import bounded_read, partition_heads
from logtel.operators.keyed import latest_per_key
from logtel.session import cut
from logtel.sources.lines import NUMBERS_BROADCAST, reassemble_lines, split_chunks
from logtel.streaming.line_stream import STATE, advance_lines


def skewed(rng, n, keys="abcdef"):
    return ["hot" if rng.random() < 0.7 else rng.choice(keys) for _ in range(n)]


def test_running_aggregates_carry_over_blocks(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.randint(-5, 5)) for i, k in enumerate(skewed(rng, 400))]
    rows.append((None, 400, 7))
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    laid = lay_out(df, ["k"], ["i"], 7)
    out = running(
        laid, ["k"], ["i"],
        {"total": Running("sum", F.col("v")), "low": Running("min", F.col("v"), before=True)},
        {"all": ("sum", F.col("v"))},
    )
    got = {(r.k, r.i): (r.total, r.low, r["all"]) for r in out.collect()}
    assert laid.select("_block").distinct().count() > 3
    for k in {r[0] for r in rows}:
        mine = sorted((i, v) for kk, i, v in rows if kk == k)
        total, low = 0, None
        for i, v in mine:
            total += v
            assert got[(k, i)] == (total, low, sum(v for _, v in mine))
            low = v if low is None else min(low, v)


def test_row_numbers_without_keys(spark):
    df = spark.range(100).select(((F.col("id") * 37) % 100).alias("id"))
    got = {r.id: r.place for r in number_rows(df, [], ["id"], "place").collect()}
    assert got == {i: i + 1 for i in range(100)}


def test_exact_ranks_with_ties(spark):
    rng = random.Random(2)
    rows = [(k, float(rng.randint(0, 30))) for k in skewed(rng, 500)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in polls.descriptive_stats(df, "v", ["k"]).collect()}
    for k in {r[0] for r in rows}:
        values = sorted(v for kk, v in rows if kk == k)
        n = len(values)
        assert got[k]["p95"] == values[min(n - 1, -(-95 * n // 100) - 1)]
        assert got[k]["p50"] == (values[(n - 1) // 2] + values[n // 2]) / 2
        assert (got[k]["count"], got[k]["min"], got[k]["max"]) == (n, values[0], values[-1])
    one = values_at_ranks(df.filter("k = 'hot'"), ["k"], "v", {"last": lambda n: n}).first()
    assert one["last"] == max(v for k, v in rows if k == "hot")


def greedy(sizes, limit):
    held, number, out = 0, 0, []
    for size in sizes:
        if size > limit:
            held = 0
            out.append(None)
            continue
        if held == 0 or held + size > limit:
            held, number = 0, number + 1
        held += size
        out.append(number)
    return out


def test_batches_equal_greedy_filling(spark):
    for seed in range(4):
        rng = random.Random(seed)
        limit = rng.choice([30, 60, 200])
        rows = [(k, i, i, "x" * rng.randint(1, 70 if rng.random() < 0.1 else 12)) for i, k in enumerate(skewed(rng, 300))]
        df = spark.createDataFrame(rows, "_key string, _event_ms bigint, _ord bigint, _body string")
        got = {r._ord: r._batch for r in size_bounded_batches(df, limit, blocks=9).collect()}
        for k in {r[0] for r in rows}:
            mine = [(o, len(b)) for kk, _, o, b in rows if kk == k]
            assert [got[o] for o, _ in mine] == greedy([s for _, s in mine], limit)


def test_batches_of_repeated_rows_and_bodies_outside_python(spark):
    rows = [("hot", 1, 1, "x" * 10)] * 7 + [("hot", 1, 1, "y" * 4), ("", 1, 1, "z"), (None, 1, 1, "z"), ("big", 1, 1, "b" * 99)]
    df = spark.createDataFrame(rows, "_key string, _event_ms bigint, _ord bigint, _body string")
    batched = size_bounded_batches(df, 25, blocks=4)
    got = batched.groupBy("_key", "_batch").agg(F.count("_body").alias("n"), F.sum(F.length("_body")).alias("b")).collect()
    assert len(rows) == sum(r.n for r in got) and all(r.b <= 25 for r in got if r._batch)
    assert sorted(r._batch for r in got if r._key == "hot") == [1, 2, 3, 4]
    assert [(r._batch, r.n) for r in got if r._key == "big"] == [(None, 1)]
    plan = _plan(size_bounded_batches(df.filter("_key <> 'hot'"), 25))
    assert "_body" not in "".join(x for x in plan.splitlines() if "MapInArrow" in x or "RangePartitioning" in x or "rangepartitioning" in x)


def test_batches_go_on_over_portions(spark):
    for seed in range(3):
        rng = random.Random(seed)
        limit = rng.choice([40, 90])
        rows = [(k, i, i, "x" * rng.randint(1, 120 if rng.random() < 0.1 else 15)) for i, k in enumerate(skewed(rng, 240, ["a", "", None]))]
        cuts = sorted(rng.sample(range(240), 3))
        opened, got = spark.createDataFrame([], "_key string, held bigint, batches bigint"), {}
        for lo, hi in zip([0, *cuts], [*cuts, 240]):
            part = spark.createDataFrame(rows[lo:hi], "_key string, _event_ms bigint, _ord bigint, _body string")
            found, left = continued_batches(part, limit, ("_event_ms", "_ord"), opened, 5)
            got |= {r._ord: r._batch for r in found.collect()}
            opened = spark.createDataFrame(left.collect(), opened.schema)
        for k in {r[0] for r in rows}:
            mine = [(o, len(b)) for kk, _, o, b in rows if kk == k]
            assert [got[o] for o, _ in mine] == greedy([s for _, s in mine], limit)
        assert {r._key for r in opened.collect()} == {r[0] for r in rows}


def test_brackets_carry_over_blocks(spark):
    rng = random.Random(23)
    rows = [(k, i, rng.choice([1, -1, -1])) for i, k in enumerate(skewed(rng, 300))] + [(None, 300, -1)]
    laid = lay_out(spark.createDataFrame(rows, "k string, i bigint, s bigint"), ["k"], ["i"], 8)
    got = {(r.k, r.i): (r.balance, r.low_before, r.ups, r.downs) for r in brackets(laid, ["k"], ["i"], F.col("s")).collect()}
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        balance, low, ups, downs = 0, None, 0, 0
        for i, s in sorted((i, s) for kk, i, s in rows if kk == k):
            balance, ups, downs = balance + s, ups + (s > 0), downs + (s < 0)
            assert got[(k, i)] == (balance, low, ups, downs)
            low = balance if low is None else min(low, balance)


def fifo(events):
    """events: (at, arrival, ev, dur) of one stage; gives (start, dur, created) in creation order."""
    spans, queue = [], []
    for at, arrival, ev, dur in sorted(events):
        if ev == "start":
            queue.append(len(spans))
            spans.append([at, None, arrival])
        elif queue:
            spans[queue.pop(0)][1] = dur
        else:
            spans.append([at - dur, dur, arrival])
    return sorted(map(tuple, spans), key=str)


def test_spans_pair_first_in_first_out(spark):
    rng = random.Random(5)
    rows = []
    for i, run in enumerate(skewed(rng, 400)):
        ev = rng.choice(["start", "end"])
        rows.append((run, rng.choice("xy"), ev, float(rng.randint(0, 60)), float(rng.randint(1, 9)) if ev == "end" else None, i))
    df = spark.createDataFrame(rows, "run_id string, stage string, ev string, at_ms double, dur_ms double, arrival bigint")
    got = {}
    for r in polls.pair_stage_spans(df).collect():
        got.setdefault((r.run_id, r.stage), []).append((r.start_ms, r.dur_ms, r.arrival))
    for key in {(r[0], r[1]) for r in rows}:
        events = [(at, arr, ev, dur) for run, st, ev, at, dur, arr in rows if (run, st) == key]
        assert sorted(got[key], key=str) == fifo(events)


def test_progression_equals_fold(spark):
    rng = random.Random(6)
    runs = {"hot": 160, "b": 20}
    messages, occurrences, sources, marked = [], [], [], []
    for run, n in runs.items():
        seqs = sorted(rng.sample(range(n * 3), n))
        messages += [(run, s, rng.choice(["Pending"] * 6 + ["Skipped", "Done"])) for s in seqs]
        for o in range(n // 4):
            oid = f"s:{o}"
            occurrences.append((run, "s", oid, "Emit" if o % 2 else "Acknowledge", f"{rng.randint(0, 9)}"))
            sources += [(run, oid, s) for s in rng.sample(seqs, 4)]
        marked += [(run, s) for s in seqs if rng.random() < 0.9]
    m = spark.createDataFrame(messages, "run_id string, seq bigint, status string")
    o = spark.createDataFrame(occurrences, "run_id string, session_id string, occurrence_id string, kind string, last_activity string")
    s = spark.createDataFrame(sources, "run_id string, occurrence_id string, seq bigint")
    k = spark.createDataFrame(marked, "run_id string, seq bigint")
    start = spark.createDataFrame([(r, 2) for r in runs], "run_id string, start_seq bigint")
    got = {(r.run_id, r.ordinal): r.frontier for r in dumps.checkpoint_progression(m, o, s, start, k).collect()}
    ends = {r.run_id: r for r in dumps.state_at(m, o, s, start, None, k).collect()}
    for run in runs:
        status = {q: st for r, q, st in messages if r == run}

        def frontier():
            at = 2
            for q in sorted(status):
                if q <= 2:
                    continue
                if status[q] not in ("Done", "Skipped"):
                    break
                at = q
            return at

        steps = sorted((la, se, oid) for r, se, oid, _, la in occurrences if r == run)
        for n, (_, _, oid) in enumerate(steps, 1):
            for r, i, q in sources:
                if r == run and i == oid:
                    status[q] = "Done"
            assert got[(run, n)] == frontier()
        for r, q in marked:
            if r == run and status[q] != "Skipped":
                status[q] = "Done"
        assert got[(run, len(steps) + 1)] == frontier() == ends[run].frontier
        assert ends[run].done == sum(v == "Done" for v in status.values())


def test_lines_from_chunks(spark):
    rng = random.Random(7)
    texts = {"hot": "".join(rng.choice(["a", "é", "\n", "\r\n", "long piece "]) for _ in range(600)), "b": "x\n\ny", "c": "one\n"}
    rows = []
    for name, text in texts.items():
        at, chunk = 0, 0
        while at < len(text):
            size = rng.randint(1, 9)
            rows.append((name, chunk, text[at : at + size]))
            at, chunk = at + size, chunk + 1
    df = spark.createDataFrame(rows, "stream string, chunk bigint, text string")
    for flush, most in ((True, NUMBERS_BROADCAST), (False, NUMBERS_BROADCAST), (True, 0), (False, 0)):
        lines = reassemble_lines(df, flush, most).collect()
        got = {(r.stream, r.line): r.value for r in lines}
        assert len(got) == len(lines)
        want = {}
        for name, text in texts.items():
            parts = text.split("\n")
            kept = parts if flush and parts[-1] else parts[:-1]
            want.update({(name, i + 1): p.removesuffix("\r") for i, p in enumerate(kept)})
        assert got == want


def test_capped_read_takes_partitions_in_numeric_order(spark):
    rows = [(p, s) for p in ("10", "2", "x") for s in range(0, 60, 2)]
    log = spark.createDataFrame(rows, "partition_id string, seq bigint")
    marks = spark.createDataFrame([("2", 9)], "partition_id string, seq bigint")
    got = [(r.partition_id, r.seq) for r in bounded_read(log, partition_heads(log), marks, 40).orderBy("index").collect()]
    want = [("2", s) for s in range(10, 60, 2)] + [("10", s) for s in range(0, 30, 2)]
    assert got == want[:40]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_inside_a_chunk_are_not_exchanged(spark):
    text = "cut\n" + "".join(f"line {i} that lies within its chunk\n" for i in range(50)) + "rest"
    df = spark.createDataFrame([("a", k, text) for k in range(4)], "stream string, chunk bigint, text string")
    pieces = split_chunks(df)
    # the texts meet their numbers through a broadcast; only where those are too many are texts exchanged
    assert "SortMergeJoin" not in _plan(pieces.whole) and "SortMergeJoin" in _plan(split_chunks(df, broadcast=0).whole)
    moved = [r.value for r in pieces.seams.collect()]
    assert len(moved) == 5 and not any("within" in v for v in moved)  # 200 whole lines stay where they are
    assert pieces.whole.count() == 200


def test_short_chunks_move_once_into_pages(spark):
    """Where cuts go through most lines and the numbers are many, no text is joined, and pages give the same lines and ends."""
    rng = random.Random(23)
    text = "".join(rng.choice(["a", "bcd ", "é", "\n", "\r\n"]) for _ in range(900))
    pieces = [text[i : i + 3] for i in range(0, len(text), 3)]
    rows = [("long", n - 1, piece) for n, piece in enumerate(pieces)]  # from -1 on, as a carried line is
    rows += [(None, 1000 * n, piece) for n, piece in enumerate(pieces[:40])]  # numbers with gaps, no name
    rows += [("one", 5, "no end"), ("ends", 0, "\n"), ("ends", 1, "\n"), ("ends", 64, ""), ("none", 0, None), ("big", 1 << 62, "x\ny"), ("big", (1 << 62) + 1, "z\n")]
    df = spark.createDataFrame(rows, "stream string, chunk bigint, text string").repartition(5)
    before = spark.createDataFrame([("long", 7), (None, 2), ("idle", 3)], "stream string, n bigint")
    found = []
    for broadcast in (NUMBERS_BROADCAST, 0):
        pieces = split_chunks(df, before, broadcast)
        seams = {(r.stream, r.line): (r.value, r.ended) for r in pieces.seams.collect()}
        whole = {(r.stream, r.line): r.value for r in pieces.whole.collect()}
        assert not whole.keys() & seams.keys()
        lines = {k: v for k, (v, ended) in seams.items() if ended} | whole
        left = {k[0]: v for k, (v, ended) in seams.items() if v and not ended}
        found.append((lines, left, {r.stream: r.n or 0 for r in pieces.ends.collect()}))
    assert found[0] == found[1]
    lines, left, ends = found[1]
    parts = text.split("\n")
    assert [lines[("long", 8 + i)] for i in range(len(parts) - 1)] == parts[:-1] and left.get("long", "") == parts[-1]
    assert ends["long"] == 7 + text.count("\n") and ends["idle"] == 3 and left["one"] == "no end" and lines[("big", 2)] == "yz"
    paged = split_chunks(df, before, 0)
    assert "Join" not in _plan(paged.whole) and "Exchange" not in _plan(paged.whole) and "Join" not in _plan(paged.seams)


def test_chunks_of_a_growing_log_in_any_split(spark):
    rng = random.Random(17)
    texts = {"hot": "".join(rng.choice(["ab", "\n", "\r\n", "ü "]) for _ in range(120)), "one": "no end", None: "x\ny\n", "late": "\n\n"}
    state, lines, at = spark.createDataFrame([], STATE), [], dict.fromkeys(texts, 0)
    for step in range(4):
        rows = []
        for name, text in texts.items():
            if name == "late" and step < 2:
                continue
            end = len(text) if step == 3 else min(len(text), at[name] + rng.randint(0, 40))
            for chunk in range(3):  # the last one of a log may be empty
                size = end - at[name] if chunk == 2 else min(rng.randint(0, 9), end - at[name])
                rows.append((name, step * 10 + chunk, text[at[name] : at[name] + size]))
                at[name] += size
        found, grown = advance_lines(spark.createDataFrame(rows, "stream string, chunk bigint, text string"), state)
        lines += found.collect()
        state = spark.createDataFrame(grown.collect(), STATE)
    want = {(n, i + 1): p.removesuffix("\r") for n, t in texts.items() for i, p in enumerate(t.split("\n")[:-1])}
    assert {(r.stream, r.line): r.value for r in lines} == want and len(lines) == len(want)
    left = {r.stream: (r.carry, r.next_line) for r in state.collect()}
    assert left == {n: (t.split("\n")[-1], t.count("\n") + 1) for n, t in texts.items()}


def test_a_small_table_meets_a_hot_key(spark):
    rng = random.Random(18)
    rows = [(k, i) for i, k in enumerate(skewed(rng, 300))] + [(None, 900)]
    facts = spark.createDataFrame(rows, "k string, i bigint")
    per_key = spark.createDataFrame([(k, ord(k[0])) for k in ("hot", "a", "b", "z")], "k string, v int")
    want = {(k, i): {"hot": ord("h"), "a": ord("a"), "b": ord("b")}.get(k) for k, i in rows}
    for most in (10, 0):
        left = {(r.k, r.i): r.v for r in attach(facts, per_key, ["k"], ["i"], "left", most).collect()}
        assert left == want
        inner = attach(facts, per_key, ["k"], ["i"], "inner", most)
        assert {(r.k, r.i): r.v for r in inner.collect()} == {p: v for p, v in want.items() if v is not None}
    assert "BroadcastHashJoin" in _plan(attach(facts, per_key, ["k"], ["i"], "left", 10))
    assert "_salt" in _plan(attach(facts, per_key, ["k"], ["i"], "left", 0))


def test_latest_row_of_hot_keys_ties_and_nulls(spark, monkeypatch):
    rng = random.Random(19)
    rows = [(k, rng.choice([None, 1, 2, 3]), f"payload {i % 90}", [i % 7]) for i, k in enumerate(skewed(rng, 500))]
    rows += [(None, 5, "null key", [1]), (None, 4, "older", [1]), ("only null", None, "x", None), ("same", 1, "twice", [2]), ("same", 1, "twice", [2])]
    df = spark.createDataFrame(rows, "k string, o int, payload string, list array<int>").repartition(6)
    df = df.select("*", F.parse_json(F.lit('{"a": 1}')).alias("v"), F.create_map("payload", "o").alias("m"))
    keys = {r[0] for r in rows}
    for most, share in ((1 << 18, 1e-5), (0, 1e-5), (0, 0.3)):
        monkeypatch.setattr(keyed, "BROADCAST_ROWS", most)
        monkeypatch.setattr(keyed, "HEAVY_SHARE", share)
        latest = latest_per_key(df, ["k"], "o")
        assert latest.columns == df.columns and "SortAggregate" not in _plan(latest)
        got = {r.k: (r.o, r.payload, r.list) for r in latest.collect()}
        assert set(got) == keys and latest.count() == len(keys)
        for key in keys:
            mine = [r for r in rows if r[0] == key]
            best = max((r[1] for r in mine if r[1] is not None), default=None)
            assert got[key] in [r[1:] for r in mine if r[1] == best]
    assert latest_per_key(df.limit(0), ["k"], "o").count() == 0


def test_blocks_follow_what_is_stored(spark):
    """Estimates of joins between checkpoints are products of sizes; blocks follow the files instead."""
    wide = spark.range(2000).select("id", F.concat(F.lit("run-"), F.col("id") % 3).alias("run"))
    once = cut(wide.join(wide.select("id", F.col("run").alias("again")), "id"))
    both = once.join(once.select("id"), "id").join(once.select(F.col("id").alias("other")), F.col("id") == F.col("other"))
    assert block_count(both) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 0 < input_bytes(once) < input_bytes(both) < 1 << 20
