"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved until its parts are short, the parts are encoded, and
neighbours are joined up the tree. Two properties make a join exact:

- *Pieces* (matches of the pattern). Where a match starts, the rest depends
  only on the text from there on. So the left half keeps all pieces that could
  not have looked beyond its end, the text after them is matched again, and as
  soon as a new piece ends where a piece of the right half starts, the right
  half's remaining pieces stand.
- *Tokens* within a long piece. A token sequence is the encoding of its bytes
  iff every two neighbours are the encoding of theirs. So a window around the
  seam is encoded again, and grows until the pairs at both of its ends hold;
  the tokens outside then stand.

Decoding concatenates the bytes of the tokens, halves first.

Results by case: a null text has null tokens (the registered query counts it
as empty); an empty text has none; text that looks like a special token is
ordinary text; columns other than ``doc_id`` and ``text`` are ignored; an
unknown token id is an error.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a text, and bytes of a piece, that are encoded without halving.
LEAF_CHARS, LEAF_BYTES = 8192, 48
#: Encoded pieces that a task remembers, in two generations, and the length up to which one is remembered.
REMEMBERED, REMEMBERED_CHARS = 250_000, 64
#: Bytes of text, or of token ids, of the rows that are held in Python at once.
PORTION_BYTES = 1 << 21

_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
#: The same matches as the general pattern on text without the characters of ``_RARE``, found faster.
_QUICK = re.compile(rf" ?[{_LETTERS}]++| ?[0-9]++|'(?:[stmd]|re|ve|ll)| ?[^\s0-9{_LETTERS}]++|\s+(?!\S)|\s+")
_QUICK_FOR = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RARE = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]|[^\x00-ɏ]")
#: No alternative of the pattern looks further than this beyond the start, or beyond the end, of its match.
_AHEAD = 3


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file with one ``base64(token) rank`` on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merges_of(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of the token that two tokens make together, by ``first << 32 | second``."""
    found = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            first, second = ranks.get(token[:cut]), ranks.get(token[cut:])
            if first is not None and second is not None:
                found[first << 32 | second] = rank
    return found


class Remembered(dict):
    """Packed tokens of pieces, in two generations.

    When the younger generation is full it becomes the older one, which is
    forgotten; a piece met again moves to the younger, so frequent ones stay.
    """

    def __init__(self, made: Callable[[str], bytes], most: int = REMEMBERED) -> None:
        super().__init__()
        self.made, self.most, self.older = made, most // 2, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.made(piece)
            if len(piece) > REMEMBERED_CHARS:
                return found
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found


class BytePairs:
    """Encoder for one set of ranks and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, merges: dict[int, int] | None = None) -> None:
        self.ranks, self.merges = ranks, merges or merges_of(ranks)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.none = max(ranks.values()) + 1
        self.general = regex.compile(pattern)
        self.has_quick = pattern == _QUICK_FOR
        self.remembered = Remembered(lambda piece: self.piece(piece.encode("utf-8")))

    def merged(self, data: bytes) -> list[int]:
        """Tokens of a few bytes: the neighbours of least rank are merged until none can be."""
        none, rank, byte = self.none, self.merges.get, self.byte
        parts = [byte[b] for b in data]
        ranks = [rank(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < none:
            at = ranks.index(least)
            parts[at] = least
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] << 32 | least, none)
            if at < len(ranks):
                ranks[at] = rank(least << 32 | parts[at + 1], none)
        return parts

    def _data(self, tokens: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, tokens))

    def _stands(self, left: int, right: int) -> bool:
        return self.merged(self._data([left, right])) == [left, right]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two encoded byte strings put together."""
        if not left or not right:
            return left or right
        reach = 1
        while True:
            before, after = left[:-reach], right[reach:]
            window = self.merged(self._data(left[-reach:] + right[:reach]))
            if (not before or self._stands(before[-1], window[0])) and (not after or self._stands(window[-1], after[0])):
                return before + window + after
            reach *= 2

    def tokens(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merged(data)
        middle = len(data) // 2
        return self.joined(self.tokens(data[:middle]), self.tokens(data[middle:]))

    def piece(self, data: bytes) -> bytes:
        """The tokens of a piece, packed."""
        whole = self.ranks.get(data)
        return np.array([whole] if whole is not None else self.tokens(data), dtype=np.int32).tobytes()

    def _matches(self, text: str, quick: bool) -> list[str]:
        return (_QUICK if quick else self.general).findall(text)

    def joined_pieces(self, left: list[str], right: list[str], quick: bool) -> list[str]:
        """The pieces of two texts put together."""
        left = list(left)
        tail = ""
        while left and (len(tail) < _AHEAD or len(left[-1]) + len(tail) < _AHEAD):
            tail = left.pop() + tail
        starts, taken = len(tail), 0  # where the next kept piece of the right half starts in the window
        window, reach = tail, 1
        while True:
            while taken < min(reach, len(right)):
                window += right[taken]
                taken += 1
            ends = set()
            at = starts
            for p in right[:taken]:
                ends.add(at)
                at += len(p)
            at, again = 0, []
            for p in self._matches(window, quick):
                if at in ends and at + _AHEAD <= len(window) and at:
                    kept = starts
                    for n, q in enumerate(right):
                        if kept == at:
                            return left + again + right[n:]
                        kept += len(q)
                again.append(p)
                at += len(p)
            if taken == len(right):
                return left + again
            reach *= 2

    def pieces(self, text: str, quick: bool | None = None) -> list[str]:
        if quick is None:
            quick = self.has_quick and not _RARE.search(text)
        if len(text) <= LEAF_CHARS:
            return self._matches(text, quick)
        middle = len(text) // 2
        return self.joined_pieces(self.pieces(text[:middle], quick), self.pieces(text[middle:], quick), quick)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.remembered.__getitem__, self.pieces(text))), dtype=np.int32)


def decoded(ids: Sequence[int], tokens: dict[int, bytes]) -> bytes:
    if len(ids) <= LEAF_CHARS:
        return b"".join(map(tokens.__getitem__, ids))
    middle = len(ids) // 2
    return decoded(ids[:middle], tokens) + decoded(ids[middle:], tokens)


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row its id and ``token_ids``; the vocabulary is read once, by the driver, and broadcast (its size is that of the vocabulary file, not of the data)."""
    ranks = read_ranks(path)
    vocabulary = docs.sparkSession.sparkContext.broadcast((ranks, merges_of(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BytePairs(vocabulary.value[0], pattern, vocabulary.value[1])
        for batch in portions(batches, 1):
            column = batch.column(1)
            ids = [None if t is None else encoder.encode(t) for t in map(pa.StringScalar.as_py, column)]
            yield pa.record_batch([batch.column(0), _lists(ids)], names=[id_column, "token_ids"])

    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField(id_column, kind), T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    return docs.select(id_column, text_column).mapInArrow(run, schema)


def portions(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows in smaller batches, by the bytes of a text or list column; a longer row is one by itself."""
    for batch in batches:
        values = batch.columns[column]
        sizes = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
        sizes = sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // PORTION_BYTES
        cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(lo, hi - lo)


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    sizes = np.fromiter((0 if r is None else len(r) for r in rows), dtype=np.int64, count=len(rows))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = np.concatenate([r for r in rows if r is not None] or [np.zeros(0, dtype=np.int32)])
    missing = pa.array([r is None for r in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()), mask=missing)


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """Per row its id and ``decoded``, the bytes of its ``token_ids``; other columns pass if named in ``keep``."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in read_ranks(path).items()})
    columns = [id_column, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary.value
        for batch in portions(batches, -1):
            column = batch.column(batch.num_columns - 1)
            texts = [None if ids is None else decoded(ids, tokens) for ids in column.to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array(texts, pa.binary())], names=[*columns, "decoded"])

    fields = [encoded.schema[c] for c in columns]
    schema = T.StructType([*fields, T.StructField("decoded", T.BinaryType())])
    return encoded.select(*columns, F.col("token_ids").alias("_ids")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``encode`` and then ``decode`` in one pass of a task: the id, ``token_ids``, and ``decoded`` made from them."""
    ranks = read_ranks(path)
    vocabulary = docs.sparkSession.sparkContext.broadcast((ranks, merges_of(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BytePairs(vocabulary.value[0], pattern, vocabulary.value[1])
        for batch in portions(batches, 1):
            ids = [None if t is None else encoder.encode(t) for t in map(pa.StringScalar.as_py, batch.column(1))]
            texts = [None if i is None else decoded(i.tolist(), encoder.bytes_of) for i in ids]
            yield pa.record_batch([batch.column(0), _lists(ids), pa.array(texts, pa.binary())], names=[id_column, "token_ids", "decoded"])

    fields = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    return docs.select(id_column, text_column).mapInArrow(run, T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), *fields]))
