"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has the probability
sigmoid(bias + sum of the weights of its words and word beginnings), or 0 if
none of them has a weight; the document's probability is their noisy-or,
1 - product(1 - p). Only documents are labelled: the weights, none of them
negative, are learned by descending the documents' log loss, which passes to
each sentence in proportion to its share in the noisy-or. As the sentences
have probabilities of their own, the offending ones are then known.

The model is fitted on a bounded sample: at most ``most_toxic`` and
``most_other`` labelled documents, those of least hash; everything else covers
all rows. Spark counts how many of the sample each feature is in; the driver
gets the features that are evidence, and where in the sample they are.

Results by case: null and empty texts have score 0; without a toxic training
document every score is 0; repeated rows are scored one by one; a document
labelled twice counts as toxic if one label says so; null labels are ignored;
extra columns are ignored (``score_documents``) or kept (``without_toxic``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtel.llm.common import slices, stored, texts_of
from logtel.llm.words import Words, read_words

#: Lengths in bytes of the word beginnings that are features beside the words.
HEADS = (4, 5, 6, 7)
#: What ends a sentence.
_ENDS = ".!?\n"
_IS_END = np.zeros(256, dtype=bool)
_IS_END[[0, *map(ord, _ENDS)]] = True


@dataclass(frozen=True)
class Fit:
    """Parameters of the fit."""

    most_toxic: int = 2000
    most_other: int = 4000
    least_documents: int = 2
    least_ratio: float = 3.0
    rounds: int = 250
    rate: float = 0.15
    sparsity: float = 2e-5


@dataclass(frozen=True)
class Model:
    """Weights of the features, by ascending hash, and the bias of a sentence."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0


def _features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of words, hashes) by kind of feature."""
    yield np.arange(len(words.hashes)), words.hashes
    for hashes in words.heads.values():
        some = np.flatnonzero(hashes)
        yield some, hashes[some]


def _sentence_of(words: Words, places: np.ndarray) -> np.ndarray:
    """Number of the sentence, over all texts, that each of the words stands in."""
    return np.searchsorted(np.flatnonzero(_IS_END[words.blob]), words.starts[places])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, features, sentences) of labelled documents."""
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int32())]
    for batch in batches:
        found = []
        for text in batch.column("text").to_pylist():
            words = read_words([text], HEADS)
            places, hashes = (np.concatenate(x) for x in zip(*_features(words)))
            found.append((hashes.view(np.int64), _sentence_of(words, places).astype(np.int32)))
        columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
        yield pa.record_batch([batch.column("toxic"), *columns], names=["toxic", "features", "sentences"])


def _sample(docs: DataFrame, labels: DataFrame, use: Column, spec: Fit) -> DataFrame:
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & use)
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    parts = [
        known.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for toxic, most in ((1, spec.most_toxic), (0, spec.most_other))
    ]
    # the sample has a stated bound, so it can be sent to the documents
    chosen = texts_of(docs).join(F.broadcast(parts[0].unionAll(parts[1])), "doc_id").select("toxic", "text")
    return stored(chosen.mapInArrow(_hashed, "toxic int, features array<bigint>, sentences array<int>"), "sample")


def fit(docs: DataFrame, labels: DataFrame, use: Column, spec: Fit = Fit()) -> Model:
    """A model learned from the labelled documents for which ``use``, a condition on ``doc_id``, holds."""
    sample = _sample(docs, labels, use, spec)
    features = _evidence(sample, spec)
    if not len(features):
        return Model()
    broadcast = docs.sparkSession.sparkContext.broadcast(features)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = broadcast.value
        for batch in batches:
            for n, toxic in enumerate(batch.column("toxic").to_pylist()):
                row = batch.column("features")[n].values.to_numpy().view(np.uint64)
                at = np.minimum(np.searchsorted(known, row), len(known) - 1)
                true = np.flatnonzero(known[at] == row)
                sentence = batch.column("sentences")[n].values.to_numpy()[true]
                columns = [pa.array([toxic]), *[pa.array([x.astype(np.int32).tobytes()]) for x in (at[true], sentence)]]
                yield pa.record_batch(columns, names=["toxic", "features", "sentences"])

    rows = sample.mapInArrow(keep, "toxic bigint, features binary, sentences binary").toArrow()
    toxic = rows.column("toxic").to_numpy() == 1
    kept, sentences, owners, before = [], [], [], 0
    for doc, (row, places) in enumerate(zip(rows.column("features").to_pylist(), rows.column("sentences").to_pylist())):
        used, own = np.unique(np.frombuffer(places, dtype=np.int32), return_inverse=True)
        kept.append(np.frombuffer(row, dtype=np.int32))
        sentences.append(own + before)
        owners.append(np.full(len(used), doc))
        before += len(used)
    return _descend(features, np.concatenate(kept), np.concatenate(sentences), np.concatenate(owners), toxic, spec)


def _evidence(sample: DataFrame, spec: Fit) -> np.ndarray:
    """Features of several toxic documents that are in a larger part of them than of the others, in order."""
    sizes = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    toxic, other = sizes[0], sizes[1] - sizes[0]
    each = sample.select("toxic", F.explode(F.array_distinct("features")).alias("feature"))
    counts = each.groupBy("feature").agg(F.sum("toxic").alias("n"), F.count(F.lit(1)).alias("all"))
    share = (F.col("n") / max(1, toxic)) / ((F.col("all") - F.col("n") + 0.5) / (1 + other))
    found = counts.filter((F.col("n") >= spec.least_documents) & (share >= spec.least_ratio)).select("feature").toArrow()
    return np.sort(found.column("feature").to_numpy().view(np.uint64))


def _descend(features: np.ndarray, feature: np.ndarray, sentence: np.ndarray, owner: np.ndarray, toxic: np.ndarray, spec: Fit) -> Model:
    """Adam on the documents' log loss, with weights kept sparse and non-negative."""
    n, docs = len(features), len(toxic)
    weights, bias = np.zeros(n), -3.0
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, spec.rounds + 1):
        p = _sigmoid(bias + np.bincount(sentence, weights[feature], len(owner)))
        clean = np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), docs))
        total = np.maximum(1 - clean, 1e-9)
        slope = (np.where(toxic, -clean / total, 1.0) / docs)[owner] * p
        gradient = np.append(np.bincount(feature, slope[sentence], n), slope.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = spec.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        # the threshold is scaled as the step is
        give = spec.rate * spec.sparsity / (np.sqrt(second[:n] / (1 - 0.999**step)) + 1e-8)
        weights = np.maximum(weights - move[:n] - give, 0)
        bias -= move[n]
    some = np.flatnonzero(weights > 0)
    return Model(features[some], weights[some], float(bias))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Scorer:
    """Probabilities of the sentences of many texts."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[model.features >> np.uint64(44)] = True

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, number of the sentence in its text, probability) of all sentences with evidence."""
        words, model = read_words(texts, HEADS), self.model
        places, values = [], []
        for place, hashes in _features(words):
            some = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
            at = np.minimum(np.searchsorted(model.features, hashes[some]), max(0, len(model.features) - 1))
            true = model.features[at] == hashes[some] if len(some) else np.zeros(0, dtype=bool)
            places.append(place[some][true])
            values.append(model.weights[at[true]])
        place, value = np.concatenate(places), np.concatenate(values)
        sentence, at = np.unique(_sentence_of(words, place), return_inverse=True)
        p = _sigmoid(model.bias + np.bincount(at, value, len(sentence)))
        owner = np.zeros(len(sentence), dtype=np.int64)
        owner[at] = np.searchsorted(words.bounds, place, side="right") - 1
        ends = np.flatnonzero(_IS_END[words.blob])
        starts = np.concatenate([[0], np.flatnonzero(words.blob == 0) + 1])
        return owner, sentence - np.searchsorted(ends, starts[owner]), p

    def documents(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text the noisy-or, the likeliest sentence (-1: none) and how many are likelier than not."""
        score, worst, many = np.zeros(len(texts)), np.full(len(texts), -1), np.zeros(len(texts), dtype=np.int64)
        for lo, hi in slices(texts):
            owner, number, p = self.sentences(texts[lo:hi])
            score[lo:hi] = 1 - np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), hi - lo))
            many[lo:hi] = np.bincount(owner, p >= 0.5, hi - lo)
            order = np.argsort(p, kind="stable")
            worst[lo:hi][owner[order]] = number[order]
        return np.clip(score, 0, 1), worst, many


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Per row ``doc_id``, ``score``, ``worst_sentence`` (its number from 0, -1 if none has evidence) and ``n_offending``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            score, worst, many = scorer.documents(batch.column("text").to_pylist())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(score), pa.array(worst, pa.int64()), pa.array(many, pa.int64())],
                names=["doc_id", "score", "worst_sentence", "n_offending"],
            )

    return texts_of(docs).mapInArrow(run, "doc_id bigint, score double, worst_sentence bigint, n_offending bigint")


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The sentences of at least that probability: ``doc_id``, ``start`` and ``end`` in code points, ``sentence``, ``p``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            ids, texts, found = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), []
            for lo, hi in slices(texts):
                for row, number, p in zip(*scorer.sentences(texts[lo:hi])):
                    if p >= least:
                        text = texts[lo + row]
                        start, end = _span(text, int(number))
                        found.append((ids[lo + row], start, end, text[start:end], float(p)))
            columns = list(zip(*found)) if found else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "end", "sentence", "p"])

    return texts_of(docs).mapInArrow(run, "doc_id bigint, start bigint, end bigint, sentence string, p double")


def _span(text: str, number: int) -> tuple[int, int]:
    """Where the sentence stands that has so many sentence ends before it."""
    start = 0
    for _ in range(number):
        start = re.compile(f"[{_ENDS}]").search(text, start).end()
    ends = re.compile(f"[{_ENDS}]").search(text, start)
    return start, ends.end() if ends else len(text)


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a lower score than the threshold, all columns kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            score, _, _ = scorer.documents([t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
