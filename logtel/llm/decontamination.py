"""Benchmark decontamination with a BM25 index of the test items and block-max pruning.

The test items are the indexed side. A posting's weight is its BM25 weight
divided by what the item would score against itself, so 1 means that all of
the item's terms are there and one threshold serves all items. Items stand in
blocks; for every term the index keeps its largest weight in each block.

Every passage of every document is a query. A passage is 2h words, one begins
every h words, and h is at least the longest item, so an item copied anywhere
lies whole in a passage. For a passage the block maxima of its terms are added
up, and a block whose sum stays below the threshold is skipped, as no item in
it can reach the threshold (Ding and Suel's block-max bound); the items of the
other blocks are scored exactly. The sums of all passages of many documents
are taken together in arrays, in place of one cursor for each term.

All items that reach the threshold are then verified: enough of the question's
word runs and enough of the answer's must be in the passage. Where items have
no columns of their own for them, the answer is the last of several sentences.

Collection statistics cover all items, computed by Spark. The index is sent to
the documents, so it is cut into shards of at most ``shard_postings`` postings,
each of which is one pass; documents never move.

Results by case: null and empty documents and items match nothing; a null id
is passed on; repeated rows are reported once each; equal items all match;
extra columns are ignored (``find_leaks``) or kept (``without_leaks``); an
empty table of either kind gives no leaks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtel.llm.common import SLICE_CHARS, slices, stored, texts_of
from logtel.llm.words import Words, read_words, shingles


@dataclass(frozen=True)
class Leaks:
    """Parameters. ``threshold`` is a share of an item's own BM25 score, the overlaps are shares of its word runs."""

    threshold: float = 0.5
    question_overlap: float = 0.6
    answer_overlap: float = 0.5
    k1: float = 1.2
    b: float = 0.75
    run: int = 5
    answer_run: int = 3
    block: int = 8
    least_half: int = 64
    shard_postings: int = 1_000_000


_SENTENCE_END = re.compile(r"[.!?\n]+")


def parts_of(text: str) -> tuple[str, str]:
    """Question and answer of an item: the last sentence is the answer if there are several."""
    ends = [m.end() for m in _SENTENCE_END.finditer(text.rstrip(" \t\r\n.!?"))]
    return (text[: ends[-1]], text[ends[-1] :]) if ends and text[: ends[-1]].strip(" \t\r\n.!?") else (text, "")


def _read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, item_id, words of the question, words of the answer, terms, frequencies)"""
    for batch in batches:
        questions, answers = batch.column("question").to_pylist(), batch.column("answer").to_pylist()
        pairs = [parts_of(q or "") if a is None else (q or "", a) for q, a in zip(questions, answers)]
        rows = []
        for question, answer in pairs:
            both = [read_words([t]).hashes for t in (question, answer)]
            terms, times = np.unique(np.concatenate(both), return_counts=True)
            rows.append((both[0].tobytes(), both[1].tobytes(), terms.view(np.int64), times.astype(np.int32)))
        columns = [pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)]
        columns += [pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int32()))]
        yield pa.record_batch([batch.column("item"), batch.column("item_id"), *columns], names=["item", "item_id", "q", "a", "terms", "times"])


@dataclass(frozen=True)
class Index:
    """One shard: postings by term (``starts`` into ``items`` and ``weights``), block maxima likewise, and the items' words."""

    ids: list[int | None]
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    half: int
    terms: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    block_starts: np.ndarray
    blocks: np.ndarray
    block_weights: np.ndarray

    def plain(self) -> tuple:
        """The fields, so that tasks can read the broadcast without this package being installed."""
        return tuple(getattr(self, f.name) for f in fields(self))


def _indexes(items: DataFrame, spec: Leaks) -> list[Index]:
    named = items.select(
        F.monotonically_increasing_id().alias("item"),
        F.col("item_id").cast("bigint"),
        *([F.col("question"), F.col("answer")] if {"question", "answer"} <= set(items.columns) else [F.col("text").alias("question"), F.lit(None).cast("string").alias("answer")]),
    )
    schema = "item bigint, item_id bigint, q binary, a binary, terms array<bigint>, times array<int>"
    read = stored(named.mapInArrow(_read_items, schema), "items").filter(F.size("terms") > 0)
    lengths = read.select("item", (F.octet_length("q") + F.octet_length("a")).alias("bytes"))
    count, mean, longest = (lengths.agg(F.count(F.lit(1)), F.avg(F.col("bytes") / 8), F.max(F.col("bytes") / 8)).first())
    if not count:
        return []
    length = (F.octet_length("q") + F.octet_length("a")) / 8
    postings = read.select("item", length.alias("length"), F.explode(F.arrays_zip("terms", "times")).alias("p")).select(
        "item", "length", F.col("p.terms").alias("term"), F.col("p.times").alias("tf")
    )
    spread = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rare = F.log(1 + (count - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = rare * F.col("tf") * (spec.k1 + 1) / (F.col("tf") + spec.k1 * (1 - spec.b + spec.b * F.col("length") / mean))
    weighted = postings.join(spread, "term").select("item", "term", weight.alias("w"))
    own = weighted.groupBy("item").agg(F.sum("w").alias("own"))
    shards = -(-weighted.count() // spec.shard_postings)
    shard = F.pmod(F.xxhash64("item"), F.lit(shards))
    weighted = stored(weighted.join(own, "item").select("item", "term", (F.col("w") / F.col("own")).alias("w"), shard.alias("shard")), "postings")
    read = read.withColumn("shard", shard)
    half = max(spec.least_half, int(longest))
    # a shard has a bounded number of postings on average; hashing spreads items evenly
    return [
        _arranged(read.filter(F.col("shard") == n).orderBy("item").toArrow(), weighted.filter(F.col("shard") == n).toArrow(), half, spec)
        for n in range(shards)
    ]


def _arranged(items: pa.Table, postings: pa.Table, half: int, spec: Leaks) -> Index:
    numbers = items.column("item").to_numpy()
    item = np.searchsorted(numbers, postings.column("item").to_numpy())
    term, weight = postings.column("term").to_numpy().view(np.uint64), postings.column("w").to_numpy()
    order = np.lexsort((item, term))
    item, term, weight = item[order], term[order], weight[order]
    terms, starts = np.unique(term, return_index=True)
    new = np.ones(len(item), dtype=bool)
    new[1:] = (term[1:] != term[:-1]) | (item[1:] // spec.block != item[:-1] // spec.block)
    heads = np.flatnonzero(new)
    maxima = np.maximum.reduceat(weight, heads) if len(heads) else weight
    words = [[np.frombuffer(x, dtype=np.uint64) for x in items.column(c).to_pylist()] for c in ("q", "a")]
    return Index(
        items.column("item_id").to_pylist(), *words, half, terms, np.append(starts, len(item)), item, weight,
        np.append(np.searchsorted(heads, starts), len(heads)), (item // spec.block)[heads], maxima,
    )


def _expanded(starts: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of terms all their entries: (row, place of the entry)."""
    sizes = starts[terms + 1] - starts[terms]
    row = np.repeat(np.arange(len(terms)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[terms][row]


class Finder:
    """Leaks of one shard's items in many texts."""

    def __init__(self, index: Index, spec: Leaks) -> None:
        self.index, self.spec = index, spec
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[index.terms >> np.uint64(44)] = True
        self.n_blocks = -(-len(index.ids) // spec.block)
        self.at_once = max(1, (1 << 22) // self.n_blocks)  # passages

    def _queries(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (passage, term), by passage; and of every passage its text and its first word."""
        index, half = self.index, self.index.half
        at = np.flatnonzero(self.maybe[words.hashes >> np.uint64(44)])
        term = np.minimum(np.searchsorted(index.terms, words.hashes[at]), len(index.terms) - 1)
        true = index.terms[term] == words.hashes[at]
        at, term = at[true], term[true]
        sizes = np.diff(words.bounds)
        passages = np.maximum(1, -(-sizes // half) - 1)  # one for every two neighbouring halves
        first = np.cumsum(passages) - passages
        text = np.searchsorted(words.bounds, at, side="right") - 1
        segment = (at - words.bounds[text]) // half
        earlier = segment > 0
        later = segment < passages[text]
        passage = np.concatenate([(first[text] + segment)[later], (first[text] + segment - 1)[earlier]])
        key = np.unique(passage * len(index.terms) + np.concatenate([term[later], term[earlier]]))
        owner = np.repeat(np.arange(len(sizes)), passages)
        begin = words.bounds[owner] + (np.arange(len(owner)) - first[owner]) * half
        return key // len(index.terms), key % len(index.terms), owner, begin

    def find(self, texts: list[str]) -> list[tuple[int, int, int, float, float, float]]:
        """(text, item, passage's first word, score, question overlap, answer overlap): of each pair the passage with the
        largest overlaps and then score (to nine places), the later one of equals."""
        index, spec = self.index, self.spec
        words = read_words(texts)
        passage, term, owner, begin = self._queries(words)
        if not len(passage):
            return []
        # upper bounds of blocks
        row, entry = _expanded(index.block_starts, term)
        bound = np.bincount(passage[row] * self.n_blocks + index.blocks[entry], index.block_weights[entry], len(owner) * self.n_blocks)
        open_ = (bound >= spec.threshold - 1e-9).reshape(len(owner), self.n_blocks)
        # exact scores of the items in the blocks that are left
        some = open_.any(axis=1)[passage]
        passage, term = passage[some], term[some]
        row, entry = _expanded(index.starts, term)
        use = open_[passage[row], index.items[entry] // spec.block]
        pair, at = np.unique(passage[row[use]] * len(index.ids) + index.items[entry[use]], return_inverse=True)
        score = np.bincount(at, index.weights[entry[use]], len(pair))
        best: dict[tuple[int, int], tuple] = {}
        for k in np.flatnonzero(score >= spec.threshold - 1e-9):
            p, item = divmod(int(pair[k]), len(index.ids))
            text = int(owner[p])
            lo, hi = int(begin[p]), min(int(begin[p]) + 2 * index.half, int(words.bounds[text + 1]))
            overlaps = self._overlaps(words.hashes[lo:hi], item)
            found = (*overlaps, round(float(score[k]), 9), lo - int(words.bounds[text]))
            if overlaps[0] >= spec.question_overlap and overlaps[1] >= spec.answer_overlap and found > best.get((text, item), ()):
                best[text, item] = found
        return [(text, item, b[3], b[2], b[0], b[1]) for (text, item), b in sorted(best.items())]

    def slices(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """Rows to look at together: as many as keep the table of passages and blocks small."""
        return slices(texts, min(SLICE_CHARS, 4 * self.index.half * self.at_once), self.at_once)

    def _overlaps(self, passage: np.ndarray, item: int) -> tuple[float, float]:
        shares = []
        for words, run in ((self.index.questions[item], self.spec.run), (self.index.answers[item], self.spec.answer_run)):
            run = min(run, len(words))
            wanted = shingles(words, run)
            have = shingles(passage, run) if len(passage) >= run else passage[:0]
            shares.append(float(np.isin(wanted, have).mean()) if len(wanted) else 1.0)
        return shares[0], shares[1]


def find_leaks(docs: DataFrame, items: DataFrame, spec: Leaks = Leaks()) -> DataFrame:
    """Per document and item that it holds: ``doc_id``, ``item_id``, ``first_word`` of the passage, ``score`` and the overlaps."""
    schema = "doc_id bigint, item_id bigint, first_word bigint, score double, question_overlap double, answer_overlap double"
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.float64()] * 3
    context, found = docs.sparkSession.sparkContext, None
    for index in _indexes(items, spec):
        shard = context.broadcast(index.plain())

        def run(batches: Iterator[pa.RecordBatch], shard=shard) -> Iterator[pa.RecordBatch]:
            finder = Finder(Index(*shard.value), spec)
            for batch in batches:
                ids, texts, rows = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), []
                for lo, hi in finder.slices(texts):
                    rows += [(ids[lo + t], finder.index.ids[i], *rest) for t, i, *rest in finder.find(texts[lo:hi])]
                columns = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        part = texts_of(docs).mapInArrow(run, schema)
        found = part if found is None else found.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def without_leaks(docs: DataFrame, items: DataFrame, spec: Leaks = Leaks()) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])
    context = docs.sparkSession.sparkContext
    for index in _indexes(items, spec):
        shard = context.broadcast(index.plain())

        def run(batches: Iterator[pa.RecordBatch], shard=shard) -> Iterator[pa.RecordBatch]:
            finder = Finder(Index(*shard.value), spec)
            for batch in batches:
                texts, clean = [t or "" for t in batch.column("text").to_pylist()], np.ones(batch.num_rows, dtype=bool)
                for lo, hi in finder.slices(texts):
                    clean[[lo + t for t, *_ in finder.find(texts[lo:hi])]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs
