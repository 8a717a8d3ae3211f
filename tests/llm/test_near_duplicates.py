import random

import numpy as np
import pytest

from shelfcast.llm.components import components
from shelfcast.llm.neardup import COORDINATES, _in_nodes, drop_near_duplicates, near_duplicates


def sets_of(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def expected(rows, num=85, den=100):
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and den * shared >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [min((k for k in groups[find(i)] if k is not None), default=None) for i in range(len(rows))]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        words = rng.choices(vocabulary, k=rng.choice([6, 40, 150, 400]))
        for _ in range(rng.choice([1, 4, 15])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3, " ".join(copy)))
    rows += [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "Two words"), (9005, "two WORDS"), (9006, "two words É"),
             (9007, "two words é")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"node_rows": 3, "max_depth": 2, "group_rows": 6}])
def test_components_equal_brute_force(documents, options):
    rows = corpus(5)
    got = {r.doc_id: r for r in near_duplicates(documents(rows), **options).collect()}
    assert {k: r.component for k, r in got.items()} == dict(zip((k for k, _ in rows), expected(rows), strict=True))
    assert all(got[k].n_shingles == len(sets_of(t)) for k, t in rows)
    assert {k for k, r in got.items() if r.first} == {
        k for k, r in got.items() if r.component == k}


def test_nodes_too_large_at_the_depth_limit_lose_no_link(spark):
    rng = np.random.default_rng(3)
    sketches = rng.integers(0, 1 << 16, (150, COORDINATES), dtype=np.uint16).repeat(2, axis=0)  # 150 equal pairs
    sets = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sketches)], "node long, sketch binary")
    paths = sets.selectExpr("1L AS path", "node")
    links = {(r.a, r.b) for r in _in_nodes(paths, sets, 100, 0.2, 3, 0).collect()}
    assert links == {(i, i + 1) for i in range(0, 300, 2)}


def test_null_keys_repeated_rows_and_dropping(documents):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (4, "other words stand in this row"),
            (6, ""), (6, ""), (7, None)]
    got = sorted((r.doc_id or 0, r.component or 0, r.n_shingles) for r in near_duplicates(documents(rows)).collect())
    assert got == [(0, 4, 2), (4, 4, 2), (4, 4, 2), (4, 4, 2), (6, 6, 0), (6, 6, 0), (7, 7, 0)]
    kept = drop_near_duplicates(documents(rows))
    assert kept.columns == documents(rows).columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [
        (4, "a b c d e f"), (4, "other words stand in this row"), (6, ""), (6, ""), (7, "")]
    assert near_duplicates(documents([])).collect() == []


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(3, 3), (200, 199), (199, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 60)} | {199: 199, 200: 199}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
