import re
from collections import Counter
from math import log

import pytest
from awkward import documents, prose

from logtel.llm import decontamination
from logtel.llm.decontamination import Leaks, find_leaks, without_leaks

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def words(text):
    return WORD.findall((text or "").replace("\0", " ").lower())


ITEMS = [(i, prose(40 + i, 12) + ". " + prose(80 + i, 6) + ".") for i in range(30)]
ITEMS += [(30, None), (31, ""), (32, "..."), (None, prose(99, 15)), (33, ITEMS[0][1]), (34, "single"), (35, prose(7, 150))]

DOCS = [
    (1, prose(1, 300) + " " + ITEMS[3][1] + " " + prose(2, 300)),
    (2, ITEMS[0][1].upper()),
    (3, prose(3, 500)),
    (4, None),
    (5, ""),
    (6, prose(4, 30) + " " + ITEMS[5][1].split(". ")[0] + " " + prose(5, 90)),  # the question without its answer
    (7, prose(6, 40) + " " + prose(7, 150) + " " + prose(8, 1000)),
    (8, "a single word " + prose(99, 15)),
    (8, "a single word " + prose(99, 15)),
    (None, ITEMS[9][1]),
]


def tables(spark, docs=DOCS, items=ITEMS):
    return documents(spark, docs), spark.createDataFrame([(*i, "own") for i in items], "item_id int, text string, score string")


def brute_force(docs, items, spec=Leaks()):
    """(doc_id, item_id, score) by scoring every item against every passage, without an index or bounds."""
    split = [tuple(map(words, decontamination.parts_of(t or ""))) for _, t in items]
    bags = [Counter(q + a) for q, a in split]
    used = [b for b in bags if b]
    n, mean = len(used), sum(sum(b.values()) for b in used) / len(used)
    df = Counter(w for b in used for w in b)
    half = max(spec.least_half, max(sum(b.values()) for b in used))

    def weights(bag):
        length = sum(bag.values())
        raw = {
            w: log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (spec.k1 + 1) / (f + spec.k1 * (1 - spec.b + spec.b * length / mean))
            for w, f in bag.items()
        }
        total = sum(raw.values())
        return {w: v / total for w, v in raw.items()}

    def share(part, passage, run):
        run = min(run, len(part))
        grams = {tuple(part[k : k + run]) for k in range(len(part) - run + 1)} if part else set()
        have = {tuple(passage[k : k + run]) for k in range(len(passage) - run + 1)}
        return len(grams & have) / len(grams) if grams else 1.0

    found = []
    for doc_id, text in docs:
        all_words = words(text)
        for (item_id, _), (question, answer), bag in zip(items, split, bags):
            if not bag:
                continue
            weight, best = weights(bag), None
            for at in range(0, max(1, len(all_words) - half), half):
                passage = all_words[at : at + 2 * half]
                score = sum(weight.get(w, 0) for w in set(passage))
                q, a = share(question, passage, spec.run), share(answer, passage, spec.answer_run)
                if score >= spec.threshold - 1e-9 and q >= spec.question_overlap and a >= spec.answer_overlap:
                    best = max(best or (0, 0, 0, 0), (q, a, round(score, 9), at))
            if best:
                found.append((doc_id, item_id, best[3], round(best[2], 9)))
    return sorted(found, key=repr)


def got(df):
    return sorted(((r.doc_id, r.item_id, r.first_word, round(r.score, 9)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("spec", [Leaks(), Leaks(block=1), Leaks(block=1000), Leaks(shard_postings=100), Leaks(threshold=0.05, question_overlap=0.0, answer_overlap=0.0)])
def test_equals_scoring_everything(spark, spec):
    found = got(find_leaks(*tables(spark), spec))
    assert found == brute_force(DOCS, ITEMS, spec)
    if spec.threshold == 0.5:
        assert {(1, 3), (2, 0), (2, 33), (7, 35), (8, None), (8, 34), (None, 9)} == {(d, i) for d, i, *_ in found}


def test_stage_keeps_clean_rows_and_columns(spark):
    docs, items = tables(spark)
    kept = without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [3, 4, 5, 6]


def test_empty_tables(spark):
    docs, items = tables(spark)
    none_docs, none_items = tables(spark, [], [])
    assert find_leaks(none_docs, items).collect() == []
    assert find_leaks(docs, none_items).collect() == []
    assert without_leaks(docs, none_items).count() == len(DOCS)


def test_columns_of_their_own_for_question_and_answer(spark):
    items = spark.createDataFrame([(1, prose(1, 10), prose(2, 5)), (2, prose(3, 10), None)], "item_id int, question string, answer string")
    docs = documents(spark, [(1, prose(1, 10) + " x " + prose(2, 5)), (2, prose(1, 10)), (3, prose(3, 10))])
    assert [(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()] == [(1, 1), (3, 2)]


def test_a_leak_at_any_place_is_found(spark):
    filler, item = prose(1, 700).split(), ITEMS[4][1]
    docs = [(at, " ".join([*filler[:at], item, *filler[at:]])) for at in range(0, 700, 23)]
    found = find_leaks(*tables(spark, docs)).filter("item_id = 4").collect()
    assert sorted(r.doc_id for r in found) == [d for d, _ in docs]
