import re
from collections import Counter, defaultdict
from math import comb

import numpy as np
from awkward import documents, plain, prose

from logtel.llm.common import components
from logtel.llm.jaccard_join import JaccardJoin, _surviving, _verified, near_duplicates, without_near_duplicates

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def brute_force(rows, size=5, threshold=0.8):
    """(doc_id, class_id, n_links) by comparing every pair."""
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").replace("\0", " ").lower())
        n = min(size, len(words))
        sets.append(frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if words else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) >= threshold * len(a | b)):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)].append(doc_id)
    return sorted(((d, min(least[find(i)], default=None), links[i]) for i, (d, _) in enumerate(rows)), key=repr)


def changed(text, places):
    words = text.split()
    for p in places:
        words[p] = f"new{p}"
    return " ".join(words)


def test_awkward_rows(spark):
    from awkward import ROWS

    assert plain(near_duplicates(documents(spark))) == brute_force(ROWS)


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).collect() == []
    assert without_near_duplicates(documents(spark, [])).collect() == []


def test_chains_large_groups_and_blocks(spark):
    base = prose(5, 120)
    rows = [(i, changed(base, [(7 * i) % 120])) for i in range(60)]  # near copies of each other
    rows += [(100 + i, changed(base, range(3 * i, 3 * i + 3))) for i in range(20)]  # at the edge of the threshold
    rows += [(200 + i, prose(100 + i, 50)) for i in range(30)] + [(300 + i, prose(100 + i, 50)) for i in range(10)]
    spec = JaccardJoin(block=16)  # buckets and groups are cut into several blocks
    assert plain(near_duplicates(documents(spark, rows), spec)) == brute_force(rows)


def test_stage_keeps_least_id_and_columns(spark):
    rows = [(4, prose(1, 60)), (2, changed(prose(1, 60), [59])), (9, prose(2, 60)), (1, None), (3, "")]
    docs = documents(spark, rows)
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 9]


def test_pruning_keeps_pairs_at_the_threshold():
    spec = JaccardJoin()
    rng = np.random.default_rng(0)
    n = 20_000
    left = rng.integers(0, 1 << 32, (n, spec.hashes), dtype=np.uint32)
    for similarity, least_kept, most_kept in ((0.8, 0.999, 1.0), (0.3, 0.0, 0.01)):
        right = np.where(rng.random(left.shape) < similarity, left, left + np.uint32(1))
        both = np.concatenate([left, right])
        kept = len(_surviving(both, np.arange(n), np.arange(n) + n, spec.least_matches(), spec)[0]) / n
        assert least_kept <= kept <= most_kept


def test_both_ways_of_verifying_agree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    sizes = np.array([len(s) for s in sets])
    i, j = np.triu_indices(30, 1)
    many = _verified(sets, sizes, i, j, 0.5)
    assert many.tolist() == [_verified(sets, sizes, i[k : k + 1], j[k : k + 1], 0.5)[0] for k in range(len(i))]
    assert many.any() and not many.all()


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(100)] + [("hub", f"s{i}") for i in range(50)] + [("x", "x")]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {found[f"c{i:03}"] for i in range(101)} == {"c000"}
    assert {found[f"s{i}"] for i in range(50)} == {"hub"}
    assert "x" not in found


def test_pruning_loses_no_link_inside_a_group(spark):
    """Copies that differ from one text in a word of their own: 0.9 to it, and mostly 0.82 to each other."""
    rows = [(i, changed(prose(7, 104), [2 * i + 5] if i else [])) for i in range(40)]
    want = brute_force(rows)
    assert min(n for _, _, n in want) > 2
    assert plain(near_duplicates(documents(spark, rows), JaccardJoin(tolerance=0.3))) == want


def lost(spec, similarity):
    """The probability that pruning drops a pair, step by step."""
    least, alive = spec.least_matches(), {0: 1.0}
    for at in range(0, spec.hashes, spec.step):
        n, after = min(spec.step, spec.hashes - at), defaultdict(float)
        for m, p in alive.items():
            for k in range(n + 1):
                after[m + k] += p * comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
        alive = {m: p for m, p in after.items() if m >= least[at + n]}
    return 1 - sum(alive.values())


def test_pruning_loses_what_is_stated():
    assert lost(JaccardJoin(), 0.8) < 1e-8
    assert lost(JaccardJoin(), 0.9) < 1e-12
