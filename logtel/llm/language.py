"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A run of n letters is bound
into one vector: the letters' vectors, each permuted (rolled) as often as
letters follow it, multiplied. A text is the bundle (sum) of the vectors of its
runs, a language prototype the bundle of its training texts; a text gets the
language whose prototype has the largest cosine with it.

Bundling is linear, so prototypes are made of run counts: tasks count the runs
of each language, Spark adds the counts up, and the sum of count x vector is
the very bundle of all training texts. Nothing but the counts is shuffled.

Letters are lower-cased; whatever is not a letter separates words and is one
symbol of its own. Letters beyond the first symbols share symbols by hash.

Results by case: a null text, and one without a letter, is ``und`` with score
0; training rows without a language or text are ignored, and without any
training row every text is ``und``; equal cosines go to the first language in
order; repeated rows are predicted one by one; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtel.llm.common import slices

UNKNOWN = "und"


@dataclass(frozen=True)
class Profile:
    """Parameters: dimensions of the vectors, letters in a run, symbols of the alphabet, and the seed of the letters."""

    dimensions: int = 1024
    run: int = 3
    symbols: int = 64
    seed: int = 7

    def letters(self) -> np.ndarray:
        return np.random.default_rng(self.seed).choice(np.array([-1, 1], dtype=np.int8), (self.symbols, self.dimensions))

    def vectors(self, codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Bound vectors of coded runs."""
        bound = np.ones((len(codes), self.dimensions), dtype=np.int8)
        for place in range(self.run):  # the last letter is not permuted
            symbol = codes // self.symbols**place % self.symbols
            bound *= np.roll(letters, place, axis=1)[symbol]
        return bound


class Runs:
    """Coded letter runs of many texts."""

    def __init__(self, spec: Profile) -> None:
        self.spec = spec
        self.known = np.full(0x250, -1, dtype=np.int64)

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        """0 for what is not a letter, else 1 to ``symbols - 1``."""
        most, low = self.spec.symbols - 1, points < 0x250
        if self.known[0] < 0:
            letters = [c for c in range(0x250) if chr(c).isalpha() and chr(c).lower() == chr(c)]
            self.known[:] = 0
            self.known[letters] = np.arange(len(letters)) % most + 1
        found = np.zeros(len(points), dtype=np.int64)
        found[low] = self.known[points[low]]
        if not low.all():
            rare, at = np.unique(points[~low], return_inverse=True)
            symbols = np.array([(int(c) * 2654435761 >> 7) % most + 1 if chr(c).isalpha() else 0 for c in rare])
            found[~low] = symbols[at]
        return found

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, code) of all runs; two symbols between words are one."""
        run = self.spec.run
        joined = "\0".join(t.replace("\0", " ") for t in texts).lower()
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        text = np.cumsum(points == 0)
        symbols = self._symbols(points)
        keep = np.ones(len(symbols), dtype=bool)
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0) | (text[1:] != text[:-1])
        symbols, text = symbols[keep], text[keep]
        if len(symbols) < run:
            return text[:0], symbols[:0]
        code = symbols[: len(symbols) - run + 1].copy()
        for k in range(1, run):
            code = code * self.spec.symbols + symbols[k : len(symbols) - run + 1 + k]
        same = text[run - 1 :] == text[: len(text) - run + 1]
        return text[: len(code)][same], code[same]


def prototypes(docs: DataFrame, spec: Profile = Profile()) -> dict[str, np.ndarray]:
    """Prototype by language of the rows with ``text`` and ``lang``: one vector for each language there is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, totals = Runs(spec), {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                total = totals.setdefault(lang, np.zeros(spec.symbols**spec.run, dtype=np.int64))
                for lo, hi in slices(own):
                    # texts are padded so that their first and last letters are seen as such
                    code = runs.read([f" {t} " for t in own[lo:hi]])[1]
                    total += np.bincount(code, minlength=len(total))
        for lang, total in totals.items():
            codes = np.flatnonzero(total)
            yield pa.record_batch([pa.array([lang] * len(codes)), pa.array(codes), pa.array(total[codes])], names=["lang", "code", "n"])

    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    counted = rows.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, totals = spec.letters(), {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            codes, n = batch.column("code").to_numpy(), batch.column("n").to_numpy()
            for lang in dict.fromkeys(langs):
                own = np.flatnonzero(langs == lang)
                part = n[own].astype(np.float64) @ spec.vectors(codes[own], letters).astype(np.float64)
                totals[lang] = totals.get(lang, 0) + part
        # sums of integers, exact in doubles whatever their order
        yield pa.record_batch([pa.array(list(totals), pa.string()), pa.array([v.tobytes() for v in totals.values()], pa.binary())], names=["lang", "part"])

    found: dict[str, np.ndarray] = {}
    # one row for each language and task that had counts of it
    for lang, part in counted.mapInArrow(bundle, "lang string, part binary").collect():
        found[lang] = found.get(lang, 0) + np.frombuffer(part)
    return {lang: found[lang] for lang in sorted(found)}


class Identifier:
    """Languages of many texts by the cosine with the prototypes."""

    def __init__(self, learned: dict[str, np.ndarray], spec: Profile) -> None:
        self.spec, self.runs, self.letters = spec, Runs(spec), spec.letters()
        self.names = list(learned)
        self.prototypes = np.array([v / max(1e-12, np.linalg.norm(v)) for v in learned.values()], dtype=np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.names:
            return names, scores
        for lo, hi in slices(texts, 1 << 18, 512):
            text, code = self.runs.read([f" {t} " for t in texts[lo:hi]])
            codes, at = np.unique(code, return_inverse=True)
            counts = np.bincount(text * len(codes) + at, minlength=(hi - lo) * len(codes)).reshape(hi - lo, len(codes))
            bundles = np.zeros((hi - lo, self.spec.dimensions), dtype=np.float32)
            for k in range(0, len(codes), 4096):
                bundles += counts[:, k : k + 4096].astype(np.float32) @ self.spec.vectors(codes[k : k + 4096], self.letters).astype(np.float32)
            lengths = np.linalg.norm(bundles, axis=1)
            cosines = bundles @ self.prototypes.T / np.maximum(lengths, 1e-12)[:, None]
            lettered = np.bincount(text[code > 0], minlength=hi - lo) > 0
            best = cosines.argmax(axis=1)
            for i in np.flatnonzero(lettered):
                names[lo + i] = self.names[best[i]]
            scores[lo:hi] = np.where(lettered, np.clip(cosines[np.arange(hi - lo), best], 0, 1), 0)
        return names, scores


def identify(docs: DataFrame, learned: dict[str, np.ndarray], spec: Profile = Profile()) -> DataFrame:
    """Per row ``doc_id``, ``lang_pred`` and ``score``, the cosine with that language's prototype (0 if negative)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(learned, spec)
        for batch in batches:
            names, scores = identifier.predict([t or "" for t in batch.column("text").to_pylist()])
            yield pa.record_batch([batch.column("doc_id"), pa.array(names), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
