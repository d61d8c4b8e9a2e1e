"""Nearest neighbours where a query has copies, many vectors, or few candidates."""

import collections

import numpy as np

from folioscope.llm import ann

SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(rows, k):
    """query_id -> [(vec_id, score)], the best score of a candidate row over the query's vectors."""
    out = {}
    for q in {i for i, _ in rows if i % 20 == 0}:
        own = [v for i, v in rows if i == q]
        score = [(-max(float(np.dot(v, o)) for o in own), i) for i, v in rows if i != q]
        out[q] = [(i, -s) for s, i in sorted(score)[:k]]
    return out


def found(spark, rows, **how):
    got = collections.defaultdict(dict)
    for r in ann.search(spark.createDataFrame([(i, [float(x) for x in v], "s") for i, v in rows], SCHEMA).repartition(3), "vec_id % 20 = 0", **how).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    return {q: [x[i] for i in sorted(x)] for q, x in got.items()}


def test_a_query_with_many_copies_has_all_its_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(20, [1.0] + [0.0] * 7)] * 100 + [(1001 + 2 * i, rng.normal(size=8)) for i in range(319)]
    assert [len(x) for x in found(spark, rows).values()] == [20]


def test_equals_brute_force_where_all_lists_are_probed(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 150, rng.integers(-3, 4, 6)) for i in range(400)]  # repeated ids, ties, repeated rows
    rows = [(i, v) for i, v in rows if v.any()] + [(7, np.ones(6))] * 30
    got = found(spark, rows, recall=1.0, epsilon=50.0, chunk=8192)
    want = brute(rows, 20)
    assert set(got) == set(want)
    for q in want:
        assert [s for _, s in got[q]] == [s for _, s in want[q]] and [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_few_candidates(spark):
    assert found(spark, [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [1.0, 1.0])]) == {0: [(20, 4.0), (3, 3.0)], 20: [(0, 4.0), (3, 3.0)]}
    assert found(spark, [(0, [1.0, 2.0])]) == {}


def test_pairs_of_a_scan():
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(500, 40)), rng.normal(size=(9, 40))
    far = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    limit = np.sort(far, axis=1)[:, 10]
    i, j = ann.scan(x, q, limit, 8, 6.0)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(a.tolist() for a in np.nonzero(far <= limit[:, None] * (1 + 1e-9))), strict=True))
