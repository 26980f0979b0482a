"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word shingles. Equal sets are merged first; each
different set gets a MinHash signature. Sets that agree in a whole band of
the signature are candidates. A candidate pair's MinHash values are compared
a few at a time: after h values with m matches the similarity has the
posterior Beta(m + 1, h - m + 1), and the pair is dropped as soon as
P(similarity >= threshold) falls below the tolerance (Chakrabarti et al.,
BayesLSH-Lite). What survives makes candidate groups; in these every pair
whose sizes allow it is verified on the shingle sets themselves.

Neither step writes a row for a pair. A task gets a bucket (or two blocks of a
large one), compares all pairs in arrays and emits one row for a set at most:
first the edges that join surviving candidates into candidate groups, then,
from the groups, how many links each set has and the edges of a spanning
forest of the links. So a group of thousands of near copies costs comparisons,
not rows, and no link inside it is lost.

Results by case: a null text is an empty one; texts without words equal each
other and nothing else; a text shorter than a shingle is one shingle; copies
and repeated rows link to each other; extra columns are ignored; an empty
table gives no rows. A row whose id is null keeps its class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtel.llm.common import components, slices, stored, texts_of
from logtel.llm.words import read_words, shingles


@dataclass(frozen=True)
class JaccardJoin:
    """Parameters. A pair at the threshold shares no band with probability (1 - threshold^rows)^bands: 3e-5 as set here."""

    shingle: int = 5
    threshold: float = 0.8
    bands: int = 20
    rows: int = 4
    step: int = 16
    tolerance: float = 1e-9
    block: int = 512
    block_shingles: int = 1 << 20

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def multipliers(self) -> np.ndarray:
        return np.random.default_rng(20).integers(1, 1 << 63, self.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def least_matches(self) -> list[int]:
        """By number of compared values h: the least m with P(similarity >= threshold | m of h) >= tolerance."""

        def reaches(m: int, h: int) -> float:  # P(Beta(m+1, h-m+1) >= t) = P(Bin(h+1, t) <= m)
            t = self.threshold
            return sum(comb(h + 1, k) * t**k * (1 - t) ** (h + 1 - k) for k in range(m + 1))

        return [next(m for m in range(h + 1) if m == h or reaches(m, h) >= self.tolerance) for h in range(self.hashes + 1)]


_SIGNED = "doc_id bigint, sid binary, size int, sig binary"


def _signer(spec: JaccardJoin):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = spec.multipliers()[:, None]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sids, sizes, sigs = [], [], []
            for lo, hi in slices(texts):
                words = read_words(texts[lo:hi])
                for a, b in zip(words.bounds[:-1], words.bounds[1:]):
                    found = shingles(words.hashes[a:b], spec.shingle)
                    sids.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    sizes.append(len(found))
                    sig = np.full(spec.hashes, 0xFFFFFFFF, dtype=np.uint64)
                    for at in range(0, len(found), 4096):
                        np.minimum(sig, ((found[None, at : at + 4096] * multipliers) >> np.uint64(32)).min(axis=1), out=sig)
                    sigs.append(sig.astype(np.uint32).tobytes())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(sids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())],
                names=["doc_id", "sid", "size", "sig"],
            )

    return sign


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``keys`` as tables of whole groups, with the number of each row's group."""
    held: pa.Table | None = None

    def numbers(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        for key in keys:
            column = t.column(key).combine_chunks()
            new[1:] |= np.asarray(pc.not_equal(column[1:], column[:-1]))
        return np.cumsum(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        group = numbers(rows)
        whole = int(np.searchsorted(group, group[-1]))
        if whole:
            yield rows.slice(0, whole), group[:whole]
        held = rows.slice(whole)
    if held is not None and held.num_rows:
        yield held, numbers(held)


def _signatures(rows: pa.Table, spec: JaccardJoin) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, spec.hashes)


def _pairs(group: np.ndarray, block: np.ndarray, crossing: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of a group, in portions; in the meeting of two blocks only those across."""
    left, right, held = [], [], 0
    at, gap = np.arange(len(group)), 0
    while True:
        gap += 1
        at = at[at + gap < len(group)]
        at = at[group[at] == group[at + gap]]
        if not len(at):
            break
        use = at[(block[at] != block[at + gap]) | ~crossing[at]]
        left.append(use)
        right.append(use + gap)
        held += len(use)
        if held >= most:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def _surviving(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int], spec: JaccardJoin) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that are never improbable while their MinHash values are compared step by step."""
    same = np.zeros(len(i), dtype=np.int32)
    for at in range(0, spec.hashes, spec.step):
        upto = min(at + spec.step, spec.hashes)
        same += (sig[i, at:upto] == sig[j, at:upto]).sum(axis=1, dtype=np.int32)
        keep = same >= least[upto]
        i, j, same = i[keep], j[keep], same[keep]
    return i, j


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the least row it is connected to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def _blocks(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return rows.column("blk").to_numpy(), rows.column("lo").to_numpy() != rows.column("hi").to_numpy()


def _candidate_edges(spec: JaccardJoin):
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = spec.least_matches()
        for rows, group in _groups(batches, ["bucket", "lo", "hi"]):
            sig, kept = _signatures(rows, spec), []
            for i, j in _pairs(group, *_blocks(rows)):
                kept.append(_surviving(sig, i, j, least, spec))
            if kept:
                root = _forest(len(sig), *(np.concatenate(x) for x in zip(*kept)))
                off = np.flatnonzero(root != np.arange(len(root)))
                sid = rows.column("sid").combine_chunks()
                yield pa.record_batch([sid.take(pa.array(off)), sid.take(pa.array(root[off]))], names=["a", "b"])

    return edges


def _verified(sets: list[np.ndarray], sizes: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs have an exact Jaccard similarity of at least the threshold."""
    if len(i) <= 8 * len(sets):
        common = np.fromiter((len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)), dtype=np.int64, count=len(i))
    else:  # many pairs of few sets: count in common by products of incidence matrices, some shingles at a time
        rows, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(rows, kind="stable")
        rows, owner = rows[order], owner[order]
        number = np.cumsum(np.concatenate([[0], (rows[1:] != rows[:-1]).astype(np.int64)]))
        shared = np.bincount(number)[number] > 1
        number, owner = np.unique(number[shared], return_inverse=True)[1], owner[shared]
        count = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for at in range(0, int(number.max(initial=-1)) + 1, 1024):
            lo, hi = np.searchsorted(number, [at, at + 1024])
            part = np.zeros((len(sets), 1024), dtype=np.float32)
            part[owner[lo:hi], number[lo:hi] - at] = 1
            count += part @ part.T
        common = count[i, j].astype(np.int64)
    return common >= threshold * (sizes[i] + sizes[j] - common) - 1e-9


def _links(spec: JaccardJoin):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in _groups(batches, ["root", "lo", "hi"]):
            block, crossing = _blocks(rows)
            weight = rows.column("m").to_numpy()
            found = rows.column("shingles").to_pylist()
            roots, counts = np.arange(len(group)), np.zeros(len(group), dtype=np.int64)
            for lo, hi in _runs(group):
                sets = [np.frombuffer(x, dtype=np.uint64) for x in found[lo:hi]]
                sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
                kept = []
                for i, j in _pairs(group[lo:hi], block[lo:hi], crossing[lo:hi]):
                    near = np.minimum(sizes[i], sizes[j]) >= spec.threshold * np.maximum(sizes[i], sizes[j]) - 1e-9
                    i, j = i[near], j[near]
                    true = _verified(sets, sizes, i, j, spec.threshold)
                    kept.append((i[true], j[true]))
                if kept:
                    i, j = (np.concatenate(x) for x in zip(*kept))
                    np.add.at(counts, i + lo, weight[j + lo])
                    np.add.at(counts, j + lo, weight[i + lo])
                    roots[lo:hi] = _forest(hi - lo, i, j) + lo
            some = pa.array(np.flatnonzero(counts))
            sid = rows.column("sid").combine_chunks()
            yield pa.record_batch([sid.take(some), sid.take(pa.array(roots).take(some)), pa.array(counts).take(some)], names=["a", "b", "links"])

    return links


def _runs(group: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)]))


def _set_reader(spec: JaccardJoin):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sids = batch.column("text").to_pylist(), batch.column("sid").to_pylist()
            keep, sets = [], []
            for lo, hi in slices(texts):
                words = read_words(texts[lo:hi])
                for row, a, b in zip(range(lo, hi), words.bounds[:-1], words.bounds[1:]):
                    data = shingles(words.hashes[a:b], spec.shingle).tobytes()
                    if hashlib.blake2b(data, digest_size=16).digest() == sids[row]:
                        keep.append(row)
                        sets.append(data)
            yield pa.record_batch([batch.column("sid").take(pa.array(keep, pa.int64())), pa.array(sets, pa.binary())], names=["sid", "shingles"])

    return read


def _meetings(df: DataFrame, blocks: str, *columns: str) -> DataFrame:
    """Each row once for every meeting of its block with another: ``lo <= hi`` number the two, ``blk`` is its own."""
    own = F.pmod(F.xxhash64("sid"), F.col(blocks)).cast("int")
    return (
        df.withColumn("blk", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
        .select(*columns, "blk", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"))
    )


def near_duplicates(docs: DataFrame, spec: JaccardJoin = JaccardJoin()) -> DataFrame:
    """Per row: ``doc_id``, ``class_id`` (least id of the rows linked to it, directly or not) and ``n_links``,
    the number of other rows whose similarity with it is at least the threshold."""
    texts = texts_of(docs)
    signed = stored(texts.mapInArrow(_signer(spec), _SIGNED), "signed")
    sets = signed.groupBy("sid").agg(F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    sets = stored(sets, "sets")

    width = 4 * spec.rows
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", b * width + 1, width)) for b in range(spec.bands)])
    banded = sets.filter("size > 0").select("sid", F.explode(bands).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = banded.join(shared, "bucket").withColumn("blocks", F.ceil(F.col("n") / spec.block))
    met = _meetings(members, "blocks", "bucket", "sid").join(sets.select("sid", "sig"), "sid")
    met = met.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    candidates = met.mapInArrow(_candidate_edges(spec), "a binary, b binary")
    groups = stored(components(candidates).withColumnRenamed("node", "sid"), "groups")

    grouped = groups.join(sets, "sid")
    sums = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    blocks = F.ceil(F.greatest(F.col("n") / spec.block, F.col("total") / spec.block_shingles))
    sums = sums.select("root", blocks.alias("blocks"))
    wanted = grouped.select("sid", "doc_id")
    read = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"])).select("sid", "text")
    read = read.mapInArrow(_set_reader(spec), "sid binary, shingles binary").dropDuplicates(["sid"])
    full = grouped.join(sums, "root").join(read, "sid")
    full = _meetings(full, "blocks", "root", "sid", "m", "shingles")
    full = full.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    linked = stored(full.mapInArrow(_links(spec), "a binary, b binary, links bigint"), "linked")

    classes = components(linked.select("a", "b"))
    counts = linked.groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))
    placed = (
        sets.select("sid", "m", "doc_id")
        .join(counts, "sid", "left")
        .join(classes.withColumnRenamed("node", "sid"), "sid", "left")
        .select("sid", "m", "doc_id", "links", F.coalesce("root", "sid").alias("root"))
    )
    names = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    placed = placed.join(names, "root").select("sid", "class_id", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.join(placed, "sid").select("doc_id", "class_id", "n_links")


def without_near_duplicates(docs: DataFrame, spec: JaccardJoin = JaccardJoin()) -> DataFrame:
    """The rows of ``docs`` that carry the least id of their class, with all their columns; rows without id stay if their class has none."""
    found = near_duplicates(docs, spec)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_kept_id"))
    return docs.join(kept, docs["doc_id"].cast("bigint").eqNullSafe(kept["_kept_id"]), "left_semi")
