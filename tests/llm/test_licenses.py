import re

import pytest
from awkward import documents, plain

from logtel.llm import licenses

MIT = """Copyright (c) somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""  # fmt: skip
THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""

CASES = [
    (MIT, "MIT", 2, 0),
    (BSD, "BSD-2-Clause", 3, 0),
    (BSD + THIRD, "BSD-3-Clause", 4, 0),
    (THIRD, "", 1, 1),
    ("x Released under the MIT License. y", "", 0, 0),
    ("Text. Released under the MIT License. Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0,MIT", 2, 0),
    ("a table row\nLicensed under the Apache License, Version 2.0.\nmore", "Apache-2.0", 1, 0),
    ("# SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0", 2, 0),
    ("mit", "", 0, 0),
    ("", "", 0, 0),
    (None, "", 0, 0),
]


def brute_force(text):
    """(licenses, known, unmatched), reading sentence by sentence."""
    text = text or ""
    known = {t: name for name, texts in licenses.SENTENCES.items() for t in texts}
    anchored = re.search(licenses.ANCHOR, text)
    names, counts, left = set(), [], []
    for ends in licenses.ENDS:
        ids = [known.get(re.sub("[^a-z0-9]+", " ", s.lower()).strip()) for s in re.split(ends, text)]
        ids = [i for i in ids if i and (anchored or not i.startswith("tag-"))]
        counts.append(len(ids))
        for rule, name in licenses.RULES:
            at = 0
            while at + len(rule) <= len(ids):
                if ids[at : at + len(rule)] == rule:
                    ids[at : at + len(rule)] = [None]
                    names.add(name)
                at += 1
        left.append(sum(i is not None for i in ids))
    return ",".join(sorted(names)), max(counts), min(left)


@pytest.mark.parametrize("text, names, known, unmatched", CASES)
def test_brute_force_reads_the_cases(text, names, known, unmatched):
    assert brute_force(text) == (names, known, unmatched)


def test_cases_and_awkward_rows(spark):
    from awkward import ROWS

    rows = [(i, c[0]) for i, c in enumerate(CASES)] + ROWS
    assert plain(licenses.scan_licenses(documents(spark, rows))) == sorted(((d, *brute_force(t)) for d, t in rows), key=repr)


def test_empty_table(spark):
    assert licenses.scan_licenses(documents(spark, [])).collect() == []


def test_tables_are_consistent():
    sentences = [t for texts in licenses.SENTENCES.values() for t in texts]
    assert len(sentences) == len(set(sentences))
    assert all(t == re.sub("[^a-z0-9]+", " ", t) for t in sentences)
    assert {i for rule, _ in licenses.RULES for i in rule} <= set(licenses.SENTENCES)
    # every known sentence is found by the anchor, but for tags, which count only after one that is
    assert all(re.search(licenses.ANCHOR, t) for n, texts in licenses.SENTENCES.items() for t in texts if t not in OTHER and not n.startswith("tag-"))


#: Sentences that stand in rules after one that has an anchor word.
OTHER = {
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement",
    "licensed under cc by 4 0", "licensed under cc by sa 4 0", "licensed under cc by nc 4 0", "licensed under cc0 1 0",
}


AS_IS = next(iter(licenses.SENTENCES["mit-as-is"]))
#: Known sentences in texts without an anchor word on one line: (text, licences, known, unmatched).
UNANCHORED = [
    ("Text.\nAll rights\nreserved.", "Proprietary", 1, 0),
    ("All rights  reserved.", "Proprietary", 1, 0),
    ("All rights\u00a0reserved.", "Proprietary", 1, 0),
    ("ALL RIGHTS\r\nRESERVED!\n\nmore text", "Proprietary", 1, 0),
    ("This is free and unencumbered software released into the public\ndomain.", "Unlicense", 1, 0),
    ("This program is free\nsoftware: you may read it", "", 1, 0),  # cut at lines, it is not known
    ("This program is free\u00a0software: you may read it", "", 1, 1),
    (AS_IS, "", 1, 1),
    (f"Before. {AS_IS.capitalize()}.\nAfter.\nMIT\n", "", 1, 1),
    ("MIT\nMIT", "", 0, 0),
    ("all rights are reserved", "", 0, 0),
]


def test_sentences_count_without_an_anchor_word(spark):
    rows = [(i, c[0]) for i, c in enumerate(UNANCHORED)]
    assert plain(licenses.scan_licenses(documents(spark, rows))) == sorted(((i, *c[1:]) for i, c in enumerate(UNANCHORED)), key=repr)


def test_sql_and_brute_force_agree_on_every_case(spark):
    """The SQL that checks the registered query, on texts with and without an anchor word."""
    import duckdb

    from logtel.llm.oracles import license_sql

    rows = [(i, c[0]) for i, c in enumerate(CASES + UNANCHORED)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = sorted(con.execute(license_sql()).fetchall())
    assert found == [(i, *brute_force(t)) for i, t in rows]
    assert found == sorted(plain(licenses.scan_licenses(documents(spark, rows))))


@pytest.mark.parametrize("space", [" ", "\n", "\r\n", "\u00a0", " \t "])
def test_every_sentence_counts_alone(spark, space):
    """Any sentence but a tag, over lines or with other white space, is known by itself."""
    sentences = [t for name, texts in licenses.SENTENCES.items() for t in texts if not name.startswith("tag-")]
    rows = [(i, t.replace(" ", space)) for i, t in enumerate(sentences)]
    assert [r[2] for r in plain(licenses.scan_licenses(documents(spark, rows)))] == [1] * len(rows)
