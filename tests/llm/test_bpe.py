import hashlib
import random

import public_tokenizers
import tiktoken
from awkward import ROWS, documents

from logtel.llm import bpe, queries

PATH = queries.VOCABULARY
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PARTS = ["a", "b", "e", " ", "  ", "\n", "\t", "'", "'s", "'re", "'v", "e", "1", "23", "é", "²", "½", "中", "文", "!", "?", "\x1c", "　", "\U0001f600", "the", "\r\n"]


def test_random_texts_with_small_leaves(monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_CHARS", 3)
    monkeypatch.setattr(bpe, "LEAF_BYTES", 3)
    encoder, rng = bpe.BytePairs(RANKS, public_tokenizers.PATTERN), random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60)))
        ids = encoder.encode(text).tolist()
        assert ids == LIBRARY.encode_ordinary(text)
        assert bpe.decoded(ids, encoder.bytes_of) == text.encode()


def test_long_pieces_and_long_texts():
    encoder, rng = bpe.BytePairs(RANKS, public_tokenizers.PATTERN), random.Random(2)
    for letters in ("ab", "aé中", "abcdefghijklmnopqrstuvwxyz", "x", " "):
        for size in (49, 97, 500, 3000):
            text = "".join(rng.choice(letters) for _ in range(size))
            assert encoder.encode(text).tolist() == LIBRARY.encode_ordinary(text)
    text = "".join(rng.choice(PARTS) for _ in range(60_000))
    assert encoder.encode(text).tolist() == LIBRARY.encode_ordinary(text)


def test_another_pattern_uses_the_general_matcher():
    pattern = r"\p{L}+|\P{L}+"
    encoder = bpe.BytePairs(RANKS, pattern)
    assert not encoder.has_quick
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=RANKS, special_tokens={})
    assert encoder.encode("Ab c, 12 ñ²").tolist() == library.encode_ordinary("Ab c, 12 ñ²")


def test_frequent_pieces_outlive_rare_ones():
    made = []

    def make(piece):
        made.append(piece)
        return piece.encode()

    remembered = bpe.Remembered(make, most=20)
    for k in range(500):
        assert remembered["often"] == b"often"
        assert remembered[f"rare {k}"] == f"rare {k}".encode()
        assert len(remembered) + len(remembered.older) <= 20
    assert made.count("often") == 1
    long = "x" * (bpe.REMEMBERED_CHARS + 1)
    assert remembered[long] == long.encode() and long not in remembered


def test_forgetting_does_not_change_tokens():
    encoder, rng = bpe.BytePairs(RANKS, public_tokenizers.PATTERN), random.Random(3)
    encoder.remembered.most = 3
    for _ in range(300):
        text = " ".join(rng.choice(PARTS) + rng.choice(PARTS) for _ in range(rng.randint(0, 40)))
        assert encoder.encode(text).tolist() == LIBRARY.encode_ordinary(text)


def test_awkward_rows(spark):
    got = sorted(tuple(r) for r in queries.byte_bpe(documents(spark).filter("doc_id is not null")).collect())
    want = []
    for doc_id, text in ROWS:
        if doc_id is not None:
            ids = LIBRARY.encode_ordinary(text or "")
            digests = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), (text or "").encode())]
            want.append((doc_id, len(ids), *digests))
    assert got == sorted(want)


def test_nulls_stay_null_and_round_trip(spark):
    encoded = bpe.encode(documents(spark), PATH, public_tokenizers.PATTERN)
    rows = bpe.decode(encoded, PATH, keep=["token_ids"]).collect()
    assert [r.decoded for r in rows] == [None if t is None else t.encode() for _, t in ROWS]
    assert rows[0].token_ids is None and rows[1].token_ids == []


def test_empty_table(spark):
    assert queries.byte_bpe(documents(spark, [])).collect() == []
