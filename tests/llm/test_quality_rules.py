"""Quality rules against a plain count of every measure."""

import re
from collections import Counter

import pytest
from awkward import documents, plain
from comparing import DATA
from pyspark.sql import functions as F

from logtel.llm import quality_rules as q
from logtel.llm.common import table

LISTED = {w for words in q.STOP_WORDS.values() for w in words}


def brute_force(text: str | None) -> dict:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    found = {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_stop_words": sum(w.lower().strip(".,;:!?()\"'") in LISTED for w in words),
        "n_lettered": sum(any(c.isalpha() for c in w) for w in words),
        "n_shouted": sum(len(w) > 1 and w.upper() == w != w.lower() for w in words),
        "longest_word": max(map(len, words), default=0),
        "n_bullets": sum(bool(re.match(r"\s*[-*•]", x)) for x in lines),
        "n_cut_lines": sum(bool(re.search(r"(\.\.\.|…)\s*\Z", x)) for x in lines),
    }
    found["base_failed"] = found["n_words"] < 50 or 100 * found["n_repeat_words"] > 50 * found["n_words"]
    broken = []
    for rule in q.RULES:
        base = 1 if rule.base == "one" else found[rule.base]
        share = 1000 * found[rule.measure]
        if base and ((rule.at_least or 0) * base > share or rule.at_most is not None and share > rule.at_most * base):
            broken.append(rule.name)
    return found | {"broken": ",".join(broken), "kept": not found["base_failed"] and not broken}


def check(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.asDict() for r in q.judge(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, text in rows:
        want = brute_force(text)
        assert {k: got[i][k] for k in want} == want, text


def test_measures(spark):
    check(spark, [
        None, "", " \t\n\r ", "a", "a b", "a b c", "a b c a b c", "a a a", "a a a a", "x y z x y z x y z", "b a b a b a",
        "one\x0btwo\x0cthree\r\nfour five   six", "  lead and trail  ", "# * $ % & | < > #*", "naïve ÜBER \U0001f600 \U0001f600x 中文 字",
        "same\nsame\n same\nsame\r\n\n \nsame", "- one\n * two\n• three\nfour...\nfive…  \nsix ... seven", "THE The the, (of) 'and' to!",
        "NUL \0 inside \0", "word " * 49, "word " * 50, "word other " * 25, "a b c d e f g h a b c",
    ])


def test_every_window_order(spark):
    # all words of two letters up to length 7: windows overlap in every way they can
    texts = [" ".join(format(k, f"0{n}b")) for n in range(3, 8) for k in range(2**n)]
    check(spark, texts)


def test_a_long_text(spark):
    words = [f"w{(i * i) % 997}" for i in range(200_000)]
    check(spark, [" ".join(words), "\n".join(f"line {i % 5000} of many" for i in range(50_000))])


def test_awkward_rows(spark):
    docs = documents(spark)
    got = q.judge(docs)
    want = [(r.doc_id, *[brute_force(r.text)[k] for k in ("n_words", "n_repeat_words", "kept")]) for r in docs.collect()]
    assert plain(got.select("doc_id", "n_words", "n_repeat_words", "kept")) == sorted(want, key=repr)
    empty = q.judge(docs.limit(0))
    assert empty.count() == 0 and empty.columns == got.columns


def test_rules_hold_where_there_is_nothing_to_measure(spark):
    rules = [q.Rule("none", "n_dup_lines", "n_lines", at_most=0), q.Rule("some", "n_words", "one", at_least=1000)]
    got = q.judge(spark.createDataFrame([(1, "")], "doc_id int, text string"), rules)
    assert got.first().broken == "some"


def test_labelled_documents(spark):
    """Rows labelled good are kept if the base rules let them; rows labelled bad are not."""
    docs, labels = table(spark, f"{DATA}/sf0.1", "documents"), table(spark, f"{DATA}/sf0.1", "labels")
    judged = q.judge(docs).join(labels.select("doc_id", "quality"), "doc_id").filter("NOT base_failed")
    right = {r.quality: r.share for r in judged.groupBy("quality").agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")).alias("share")).collect()}
    assert right[1] > 0.998 and right[0] > 0.99


def test_one_projection_without_user_code(spark):
    plan = q.judge(documents(spark))._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Arrow", "Exchange", "Join", "Aggregate"):
        assert word not in plan


@pytest.mark.parametrize("rule", q.RULES, ids=lambda r: r.name)
def test_every_rule_names_a_measure(rule):
    known = q.measures(["the"])
    assert rule.measure in known and rule.base in known
    assert rule.at_least is not None or rule.at_most is not None
