"""The registered queries against SQL, and the pipeline against a brute-force version."""

import hashlib
import re
import sys

import pytest
import tiktoken
from comparing import DATA, difference
from pyspark.sql import functions as F

import corpus_pipeline
from logtel.llm.common import remainder, table
from logtel.llm.queries import ORACLES, QUERIES, toxicity_model
from logtel.llm.toxicity import Scorer

FOLDER = f"{DATA}/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    wrong, rows, _ = difference(spark, FOLDER, name, QUERIES, ORACLES)
    assert wrong is None and rows > 0


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert "logtel.plans" not in sys.modules or not any(n.startswith("op") for n in sys.modules["logtel.plans"].__dict__)


def test_pipeline(spark):
    import public_tokenizers
    from test_exact_dedup import brute_force as copies
    from test_jaccard_join import brute_force as near

    from logtel.llm import bpe, queries

    docs = table(spark, FOLDER, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    score, *_ = Scorer(toxicity_model(spark, docs, FOLDER)).documents([t or "" for _, t in rows])
    rows = [r for r, s in zip(rows, score) if s < 0.5]
    kept = {c[0] for c in copies(rows) if c[3]}
    rows = [r for r in rows if r[0] in kept]
    kept = {c[0] for c in near(rows) if c[0] == c[1]}
    rows = [r for r in rows if r[0] in kept]
    # the items of this table are copied whole or not at all
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in table(spark, FOLDER, "benchmark").collect()]
    flat = {d: " ".join(re.findall(r"\w+", t.lower())) for d, t in rows}
    rows = [r for r in rows if not any(i in flat[r[0]] for i in items)]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(queries.VOCABULARY), special_tokens={})
    want = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text)
        want.append((doc_id, len(ids), *[hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), text.encode())]))
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_stages_take_awkward_rows(spark):
    from awkward import documents

    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns
        assert 0 < kept.count() <= docs.count()
        docs = kept
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()


def test_held_out_rows_are_the_contract(spark):
    rows = table(spark, FOLDER, "documents").select(remainder(F.col("doc_id"), 3).alias("r")).groupBy("r").count().collect()
    assert {r.r for r in rows} == {0, 1, 2}
