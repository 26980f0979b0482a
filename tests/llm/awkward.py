"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(words))


LONG = prose(1, 60_000)

#: (doc_id, text)
ROWS = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one two"),
    (5, "one two"),
    (5, "one two"),
    (6, LONG),
    (7, LONG + " tail"),
    (8, "x" * 30_000),
    (9, prose(2, 40)),
    (10, prose(2, 40).replace("\n", " ")),
    (None, "a row without id"),
    (None, prose(2, 40)),
    (11, "nul \0 inside, Ünïcode İ and \U0001f600"),
]

EXTRA = ["sid", "class_id", "kept", "score", "row", "digest", "token_ids", "_kept_id", "_kept_text", "lang", "run", "first"]


def documents(spark, rows=None):
    """A table of the rows, with extra columns whose names operators use inside."""
    rows = ROWS if rows is None else rows
    schema = "doc_id bigint, text string" + "".join(f", {name} string" for name in EXTRA)
    return spark.createDataFrame([(*r, *[f"own {name}" for name in EXTRA]) for r in rows], schema)


def plain(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
