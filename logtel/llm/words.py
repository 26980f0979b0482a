"""Words of many texts as arrays of 64-bit hashes, without a Python step for each word.

A word is a run of ASCII letters, ASCII digits and characters beyond ASCII in
the lower-cased text. Its hash is a polynomial over its UTF-8 bytes: prefix
sums give the polynomial of any byte range, and the inverse power of the
multiplier moves it to position 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
#: Bytes hashed at once; a piece ends where a word ends.
_PIECE = 1 << 18

#: Byte → byte of a word, or 0 between words.
_WORD_BYTES = np.zeros(256, dtype=np.uint8)
for _byte in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _WORD_BYTES[_byte] = _byte


class _Powers:
    """Powers of the multiplier and of its inverse, as long as the longest piece so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, factor in (("up", _MULTIPLIER), ("down", _INVERSE)):
                steps = np.full(n, factor, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = _Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    """The hashes with their bits spread, so that any of the bits can be used."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """``hashes``, byte ``starts`` and ``ends`` of all words; those of text i are ``bounds[i]:bounds[i + 1]``.

    ``heads`` has, for each length asked for, the hashes of the words' first bytes; 0 for shorter words.
    """

    blob: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    heads: dict[int, np.ndarray]


def _pieces(blob: np.ndarray) -> list[tuple[int, int]]:
    cuts, at = [0], 0
    while at < len(blob):
        at = min(at + _PIECE, len(blob))
        while at < len(blob):  # to the end of the word
            gap = np.flatnonzero(_WORD_BYTES[blob[at : at + 256]] == 0)
            if len(gap):
                at += int(gap[0])
                break
            at = min(at + 256, len(blob))
        cuts.append(at)
    return list(zip(cuts, cuts[1:]))


def read_words(texts: Sequence[str], heads: Sequence[int] = ()) -> Words:
    blob = np.frombuffer("\0".join(t.replace("\0", " ") for t in texts).lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    hashes, starts, ends = [], [], []
    begun: dict[int, list[np.ndarray]] = {k: [] for k in heads}
    for lo, hi in _pieces(blob):
        part = _WORD_BYTES[blob[lo:hi]]
        inside = np.zeros(hi - lo + 2, dtype=bool)
        np.not_equal(part, 0, out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edges[::2], edges[1::2]
        up, down = _POWERS.upto(hi - lo)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(part * up[: hi - lo], out=sums[1:])
        hashes.append((sums[last] - sums[first]) * down[first])
        for k in heads:
            long = last - first >= k
            # another factor, so that a head is not the same feature as a word that it spells
            begun[k].append(np.where(long, mixed((sums[np.where(long, first + k, first)] - sums[first]) * down[first] + np.uint64(k)), np.uint64(0)))
        starts.append(first + lo)
        ends.append(last + lo)
    joined = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (starts, ends)]
    gaps = np.flatnonzero(blob == 0)
    bounds = np.concatenate([[0], np.searchsorted(joined[0], gaps), [len(joined[0])]]).astype(np.int64)
    spread = mixed(np.concatenate(hashes)) if hashes else np.zeros(0, dtype=np.uint64)
    empty = np.zeros(0, dtype=np.uint64)
    by_length = {k: np.concatenate(x) if x else empty for k, x in begun.items()}
    return Words(blob, spread, *joined, bounds if len(texts) else bounds[:1], by_length)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words make one run, no word none."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    run = hashes[: len(hashes) - size + 1].copy()
    for k in range(1, size):
        run = run * np.uint64(0x9FB21C651E98DF25) + hashes[k : len(hashes) - size + 1 + k]
    return np.unique(mixed(run))
