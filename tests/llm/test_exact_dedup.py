import hashlib
import re

from awkward import ROWS, documents, plain

from logtel.llm.exact_dedup import exact_duplicates, tree_merge, without_duplicates


def brute_force(rows):
    groups = {}
    for place, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append((doc_id is None, doc_id or 0, place))
    found = []
    for text, members in groups.items():
        best = min(members)
        keep = None if best[0] else best[1]
        sha = hashlib.sha256(text.encode()).hexdigest()
        found += [(None if m[0] else m[1], keep, len(members), m == best, sha) for m in members]
    return sorted(found, key=repr)


def test_awkward_rows(spark):
    # rows that repeat an id and a text may change places
    got, want = plain(exact_duplicates(documents(spark))), brute_force(ROWS)
    assert got == want


def test_many_runs_and_rounds(spark):
    rows = [(i, f"text {i % 37}\t\n x") for i in range(600)] + [(1000 + i, "hot") for i in range(400)]
    docs = documents(spark, rows).repartition(40)
    assert plain(exact_duplicates(docs)) == brute_force(rows)


def test_entries_merge_level_by_level(spark):
    from logtel.llm.exact_dedup import _digests

    docs = documents(spark, [(i, "same" if i % 2 else f"own {i}") for i in range(64)]).repartition(16)
    entries = tree_merge(_digests(docs).checkpoint(), bits=1).collect()
    assert len(entries) == 33 and sorted(e["size"] for e in entries)[-1] == 32


def test_stage_drops_copies_and_keeps_columns(spark):
    docs = documents(spark)
    kept = without_duplicates(docs)
    assert kept.columns == docs.columns
    assert len(kept.collect()) == sum(r[3] for r in brute_force(ROWS))
    assert {r["_kept_id"] for r in kept.collect()} == {"own _kept_id"}


def test_empty_table(spark):
    assert exact_duplicates(documents(spark, [])).collect() == []
    assert without_duplicates(documents(spark, [])).collect() == []


def test_no_python_in_the_plan(spark):
    plan = exact_duplicates(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
