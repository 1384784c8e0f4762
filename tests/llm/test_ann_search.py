import numpy as np
import pytest

from boxwright.llm import ann_search as a

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=10, every=100):
    seen = {i: np.array(v, float) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in seen:
        if q % every == 0:
            out[q] = sorted((float(np.sqrt(((v - seen[q]) ** 2).sum())), i) for i, v in seen.items() if i != q)[:k]
    return out


def found(spark, rows):
    out = {}
    for r in a.search(spark.createDataFrame(rows, SCHEMA)).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


def test_recall_and_scores(spark):
    r = np.random.default_rng(2)
    rows = [(i, (r.standard_normal(64) + (i % 7)).astype(np.float32).tolist(), 0) for i in range(3000)]
    same = rows[5][1]
    rows += [(3000 + i, same, 0) for i in range(60)]  # ties
    want, got = plain(rows), found(spark, rows)
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    assert [i for _, i in got[3000]] == [5, *range(3001, 3010)]
    exact = {i: np.array(v, float) for i, v, _ in rows}
    for q, near in got.items():
        assert near == sorted(near) and all(np.isclose(s, np.linalg.norm(exact[q] - exact[i]), rtol=1e-12) for s, i in near)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [], 1), (7, [1.0, 0.5], 1), (7, [1.0, 0.5], 1), (None, [1.0, 1.0], 1), (100, [None, 1.0], 1), (200, [1.0, 0.0], 1), (8, [1.0, 2.0, 3.0], 1)]
    got = found(spark, rows)
    assert set(got) == {0, 200}
    assert [i for _, i in got[0]] == [200, 7, 1] and got[0][0][0] == 0.0
    assert found(spark, []) == {}


def test_several_vectors_under_a_queried_id(spark):
    rows = [(0, [5.0, 5.0]), (0, [1.0, 1.0]), (1, [1.0, 2.0]), (2, [5.0, 6.0]), (3, [9.0, 9.0]), (3, [1.0, 1.5])]
    want = [(0, 1, 3, 0.5), (0, 2, 1, 1.0), (0, 3, 2, 41**0.5)]
    for some in (rows, rows[::-1]):
        got = a.search(spark.createDataFrame(some, "vec_id long, embedding array<double>"), 100, 3).collect()
        assert [tuple(r) for r in sorted(got, key=lambda r: r["rank"])] == [(*w[:3], pytest.approx(w[3])) for w in want]
