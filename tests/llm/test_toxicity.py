import numpy as np
from awkward import ROWS, documents
from comparing import DATA
from pyspark.sql import functions as F

from logtel.llm import queries, toxicity
from logtel.llm.common import remainder, table
from logtel.llm.words import read_words


def model(words, bias=-6.0, weight=12.0):
    hashes = np.sort(read_words(words).hashes)
    return toxicity.Model(hashes, np.full(len(hashes), weight), bias)


def brute_force(text, bad, bias=-6.0, weight=12.0):
    """Noisy-or, sentence by sentence."""
    import re

    clean = 1.0
    for sentence in re.split(r"[.!?\n\0]", (text or "").lower()):
        n = sum(w in bad for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", sentence))
        if n:
            clean *= 1 - 1 / (1 + np.exp(-(bias + weight * n)))
    return 1 - clean


BAD = ["alpha3", "two", "xxyz"]


def test_awkward_rows_against_sentence_by_sentence(spark):
    learned = model(BAD, weight=5.0)
    got = toxicity.score_documents(documents(spark), learned).collect()
    for row, (doc_id, text) in zip(got, ROWS):
        assert row.doc_id == doc_id
        assert abs(row.score - brute_force(text, BAD, weight=5.0)) < 1e-9


def test_offending_sentences_are_located(spark):
    text = "Fine here. You two!  No more\nÜber alpha3 \U0001f600 x? end two"
    found = toxicity.offending_sentences(documents(spark, [(1, text), (2, "clean. words"), (3, None)]), model(BAD)).collect()
    assert [(r.doc_id, r.sentence) for r in found] == [(1, " You two!"), (1, "Über alpha3 \U0001f600 x?"), (1, " end two")]
    assert all(text[r.start : r.end] == r.sentence and r.p > 0.9 for r in found)


def test_stage_keeps_columns_and_clean_rows(spark):
    docs = documents(spark)
    kept = toxicity.without_toxic(docs, model(BAD))
    assert kept.columns == docs.columns
    want = [(d, t) for d, t in ROWS if brute_force(t, BAD) < 0.5]
    assert [(r.doc_id, r.text) for r in kept.collect()] == want and 0 < len(want) < len(ROWS)


def test_nothing_to_learn_from(spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id bigint, toxic int")
    learned = toxicity.fit(documents(spark), labels, F.lit(True))
    assert not len(learned.features)
    assert {r.score for r in toxicity.score_documents(documents(spark), learned).collect()} == {0.0}
    assert toxicity.score_documents(documents(spark, []), learned).collect() == []


def test_the_fit_finds_the_words(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(400):
        sentences = [" ".join(f"w{k}" for k in rng.integers(0, 200, 8)) for _ in range(6)]
        if i % 4 == 0:
            sentences[i % 6] += " " + ("grblx", "fnord")[i % 8 // 4]
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(i % 4 == 0)))
    learned = toxicity.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id int, toxic int"), F.col("doc_id") >= 40)
    texts = ["w1 w2. w3 grblx w4", "fnord", "w5 w6. w7 w8"]
    score, worst, _ = toxicity.Scorer(learned).documents(texts)
    assert score[0] > 0.5 and score[1] > 0.5 and score[2] < 0.5
    assert worst[:2].tolist() == [1, 0]


def test_held_out_accuracy(spark):
    folder = f"{DATA}/sf0.1"
    found = queries.op8_toxicity(spark, folder)
    assert set(found.columns) >= {"doc_id", "held_out", "score", "predicted"}
    judged = found.filter("held_out").join(table(spark, folder, "labels"), "doc_id")
    counts = {(r.toxic, r.predicted): r["count"] for r in judged.groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] > 0.85 * (counts[1, 1] + counts.get((1, 0), 0))
    assert counts[0, 0] > 0.98 * (counts[0, 0] + counts.get((0, 1), 0))


def test_remainder_is_crc32_of_the_id_as_text(spark):
    import zlib

    ids = [0, 1, 12345, -7, None]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id bigint").select(remainder(F.col("doc_id"), 5).alias("r")).collect()
    assert [r.r for r in rows] == [zlib.crc32(b"" if i is None else str(i).encode()) % 5 for i in ids]
