import numpy as np
from awkward import documents, plain
from comparing import DATA
from pyspark.sql import functions as F

from logtel.llm import language, queries
from logtel.llm.common import table

SPEC = language.Profile(dimensions=512)
TRAIN = [("der hund und die katze schlafen nicht", "de"), ("the dog and the cat do not sleep there", "en"), (None, "en"), ("x", None), ("123", "zz")]


def vector(text, spec):
    """The bundle of one text, letter by letter."""
    letters, runs = spec.letters().astype(np.int64), language.Runs(spec)
    symbols = [0] + runs._symbols(np.array([ord(c) for c in text.lower()], dtype=np.uint32)).tolist() + [0]
    kept = [s for k, s in enumerate(symbols) if s or k == 0 or symbols[k - 1]]
    total = np.zeros(spec.dimensions)
    for at in range(len(kept) - spec.run + 1):
        bound = np.ones(spec.dimensions)
        for k in range(spec.run):
            bound = bound * np.roll(letters[kept[at + k]], spec.run - 1 - k)
        total += bound
    return total


def cosine(a, b):
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


def test_prototypes_and_cosines_match_the_definition(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(TRAIN)], "doc_id int, text string, lang string")
    learned = language.prototypes(docs, SPEC)
    assert list(learned) == ["de", "en"]  # a training text without letters has no runs
    assert np.array_equal(learned["de"], vector(TRAIN[0][0], SPEC))
    texts = ["die katze", "the cats", "Hund, hund!", "12 -", "", "я и 中文"]
    names, scores = language.Identifier(learned, SPEC).predict(texts)
    for text, name, score in zip(texts, names, scores):
        if not any(c.isalpha() for c in text):
            assert (name, score) == ("und", 0)
            continue
        want = {lang: cosine(vector(text, SPEC), v) for lang, v in learned.items()}
        assert want[name] == max(want.values())
        assert abs(score - max(0, want[name])) < 1e-5


def test_awkward_rows(spark):
    learned = {"aa": vector("alpha beta gamma", SPEC), "bb": vector("xxx yyy", SPEC)}
    got = language.identify(documents(spark), learned, SPEC).collect()
    from awkward import ROWS

    for row, (doc_id, text) in zip(got, ROWS):
        assert row.doc_id == doc_id
        assert (row.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        assert 0 <= row.score <= 1


def test_nothing_to_learn_from(spark):
    docs = documents(spark)
    assert language.prototypes(docs.filter("false"), SPEC) == {}
    assert {r.lang_pred for r in language.identify(docs, {}, SPEC).collect()} == {"und"}
    assert plain(language.identify(documents(spark, []), {}, SPEC)) == []


def test_held_out_accuracy(spark):
    folder = f"{DATA}/sf0.01"
    found = queries.op4_language(spark, folder).join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    right, n = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 200 and right > 0.98
