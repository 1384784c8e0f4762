import random
import re

import pytest

from boxwright.operators import aggregates, join, knn, range_query
from boxwright.plans import layout

SCHEMA = "id long, min_x double, min_y double, max_x double, max_y double"


def boxes(n, seed, big=0.02, lattice=False):
    """Small boxes, points, duplicates and a few huge ones, some with corners
    on a lattice, so on borders of cells."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.uniform(-500, 500), r.uniform(-500, 500)
        if lattice:
            x, y = round(x / 8) * 8.0, round(y / 8) * 8.0
        w, h = (r.choice([0, 1, 4, 8]), r.choice([0, 1, 4, 8])) if r.random() > big else (r.uniform(0, 900), r.uniform(0, 900))
        out.append((i, x, y, x + w, y + h) if i % 10 or not out else (i, *out[-1][1:]))
    return out


def meet(a, b):
    return a[3] >= b[1] and a[1] <= b[3] and a[4] >= b[2] and a[2] <= b[4]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def pairs_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("strategy", ["auto", "grid", "nested"])
@pytest.mark.parametrize("lattice", [False, True])
def test_join_strategies(spark, strategy, lattice):
    a, b = boxes(300, 1, lattice=lattice), boxes(200, 2, lattice=lattice)
    want = sorted((x[0], y[0]) for x in a for y in b if meet(x, y))
    assert pairs_of(join.join_pairs(frame(spark, a), frame(spark, b), strategy)) == want


@pytest.mark.parametrize("side", [0.5, 3.0, 8.0, 5000.0])
def test_grid_is_exact_for_any_cell(spark, side):
    a, b = boxes(120, 3, 0.1), boxes(120, 4, 0.1, lattice=True)
    met = join.grid_join(frame(spark, a), frame(spark, b), side).select("a_id", "b_id")
    assert pairs_of(met) == sorted((x[0], y[0]) for x in a for y in b if meet(x, y))


def test_grid_on_degenerate_sets(spark):
    same = [(i, 1.0, 1.0, 1.0, 1.0) for i in range(5)]
    assert join.join_pairs(frame(spark, same), frame(spark, same), "grid").count() == 25
    assert join.join_pairs(frame(spark, []), frame(spark, same), "grid").count() == 0
    assert join.join_pairs(frame(spark, []), frame(spark, []), "grid").count() == 0


def test_crowded_cells_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(join, "CROWD", 8)
    crowd = [(1000 + i, 3.0 + i / 1000, 3.0, 3.0 + i / 1000 + i % 3 / 900, 3.0 + i % 2) for i in range(150)]
    a, b = boxes(150, 21, lattice=True) + crowd, boxes(150, 22) + [(i + 500, *rest) for i, *rest in crowd]
    want = sorted((x[0], y[0]) for x in a for y in b if meet(x, y))
    for most in (100_000, 0):  # few crowded cells are broadcast, more are not
        monkeypatch.setattr(join, "BROADCAST_CELLS", most)
        met = join.join_pairs(frame(spark, a), frame(spark, b), "grid")
        assert pairs_of(met) == want
        assert "_a_parts" in met._jdf.queryExecution().toString()
    columns = join.grid_join(frame(spark, a), frame(spark, b), 64.0).columns
    assert columns == [f"{n}_{c}" for n in "ab" for c in ("id", "min_x", "min_y", "max_x", "max_y")]


def test_self_semi_grouped_equal(spark):
    a = boxes(200, 5)
    df = frame(spark, a)
    every = sorted((x[0], y[0]) for x in a for y in a if meet(x, y))
    assert pairs_of(join.self_join(df)) == every
    assert pairs_of(join.self_join(df, distinct_pairs=True, strategy="grid")) == [p for p in every if p[0] < p[1]]
    assert set(every) == {(y, x) for x, y in every}
    b = boxes(40, 6)
    hit = {x[0] for x in a if any(meet(x, y) for y in b)}
    assert {r.id for r in join.semi_join(df, frame(spark, b)).collect()} == hit
    assert {r.id for r in join.semi_join(df, frame(spark, b), anti=True).collect()} == {x[0] for x in a} - hit
    got = {r.id_a: r.ids_b for r in join.grouped(join.join_pairs(df, frame(spark, b))).collect()}
    assert got == {i: sorted(y[0] for y in b if meet(a[i], y)) for i in hit}
    assert pairs_of(join.equal_join(df, df)) == sorted((x[0], y[0]) for x in a for y in a if x[1:] == y[1:])


@pytest.mark.parametrize("strategy", ["grid", "nested"])
def test_range(spark, strategy):
    a, w = boxes(300, 7), boxes(40, 8, 0.3)
    data, windows = frame(spark, a), frame(spark, w).withColumnRenamed("id", "qid")
    want = sorted((q[0], x[0]) for x in a for q in w if meet(x, q))
    assert pairs_of(range_query.range_pairs(data, windows, strategy)) == want
    counts = dict(map(tuple, range_query.range_counts(data, windows, strategy).collect()))
    assert counts == {q[0]: sum(meet(x, q) for x in a) for q in w}
    within = sorted((q[0], x[0]) for x in a for q in w if q[1] <= x[1] and q[3] >= x[3] and q[2] <= x[2] and q[4] >= x[4])
    assert pairs_of(range_query.range_contained(data, windows, strategy)) == within
    empty = {r.qid for r in range_query.windows_with_hits(data, windows, anti=True).collect()}
    assert empty == {q for q, n in counts.items() if not n}
    one = w[3][1:]
    assert {r.id for r in range_query.range_single(data, one).collect()} == {x[0] for x in a if meet(x, (0, *one))}


def test_larger_window_has_no_fewer_hits(spark):
    data = frame(spark, boxes(200, 9))
    small = {r.id for r in range_query.range_single(data, (-50, -50, 50, 50)).collect()}
    assert small <= {r.id for r in range_query.range_single(data, (-90, -60, 50, 70)).collect()}


def test_points(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 0.5), (3, 0.25, 0.75)], "id long, x double, y double")
    windows = spark.createDataFrame([(7, 0.0, 0.0, 1.0, 1.0)], SCHEMA.replace("id", "qid", 1))
    assert {r.id for r in range_query.points_inside(points, windows).collect()} == {1, 3}
    assert [tuple(p) for p in range_query.point_lists(points, windows).first().points] == [(0.25, 0.75), (0.5, 0.5)]


def gap(b, x, y):
    dx, dy = max(b[1] - x, x - b[3], 0), max(b[2] - y, y - b[4], 0)
    return dx * dx + dy * dy


@pytest.mark.parametrize("k", [1, 5, 400])
@pytest.mark.parametrize(("target", "strategy"), [(16, "indexed"), (100_000, "indexed"), (16, "nested"), (16, "auto")])
def test_knn(spark, k, target, strategy):
    a, r = boxes(300, 10, lattice=True), random.Random(11)
    q = [(i, r.uniform(-600, 600), round(r.uniform(-500, 500))) for i in range(25)]
    queries = spark.createDataFrame([(i, x, float(y)) for i, x, y in q], "qid long, x double, y double")
    want = sorted((i, n + 1, b[0], gap(b, x, y)) for i, x, y in q for n, b in enumerate(sorted(a, key=lambda b: (gap(b, x, y), b[0]))[:k]))
    got = sorted((r.qid, r.rank, r.id, r.distance_sq) for r in knn.knn(frame(spark, a), queries, k, target, strategy).collect())
    assert got == want
    one = knn.knn_single(frame(spark, a), q[0][1], q[0][2], k).collect()
    assert sorted((r.rank, r.id) for r in one) == [(n, b) for i, n, b, _ in want if i == 0]


def test_knn_beyond_a_line_of_nearer_leaves(spark):
    xs = [-64 + i for i in range(64)] + [1.5 + i for i in range(64)]
    rows = [(i + 1, float(x), x / 1024, float(x), x / 1024) for i, x in enumerate(xs)]
    query = spark.createDataFrame([(0, 0.0, 0.0)], "qid long, x double, y double")
    assert [r.id for r in knn.knn(frame(spark, rows), query, 2, 16, "indexed").orderBy("rank").collect()] == [64, 65]


def test_knn_limits(spark):
    query = spark.createDataFrame([(0, 0.0, 0.0)], "qid long, x double, y double")
    with pytest.raises(ValueError):
        knn.knn(frame(spark, boxes(3, 1)), query, 0)
    assert knn.knn(frame(spark, []), query, 3).count() == 0
    assert knn.knn(frame(spark, boxes(3, 1)), query.limit(0), 3).count() == 0


@pytest.mark.parametrize("n", [0, 1, 129, 150, 192, 1500])
def test_index_keeps_every_row(spark, n):
    a = boxes(n, n)
    index = layout.build_index(frame(spark, a), 16)
    assert sorted(r.id for r in index.data.collect()) == [x[0] for x in a]
    leaves = index.leaves.collect()
    assert sum(r.n for r in leaves) == n
    assert len(leaves) <= layout.MAX_SIDE**2
    by = {r.node_id: r for r in leaves}
    for r in index.data.collect():
        leaf = by[r.node_id]
        assert leaf.min_x <= r.min_x and leaf.max_x >= r.max_x and leaf.min_y <= r.min_y and leaf.max_y >= r.max_y


def test_index_queries(spark, tmp_path):
    a, b = boxes(400, 20), boxes(300, 21)
    one, two = layout.build_index(frame(spark, a), 16), layout.build_index(frame(spark, b), 32)
    one.save(str(tmp_path / "index"))
    one = layout.load(spark, str(tmp_path / "index"))
    assert pairs_of(layout.index_join(one, two)) == sorted((x[0], y[0]) for x in a for y in b if meet(x, y))
    windows = frame(spark, b).withColumnRenamed("id", "qid")
    assert pairs_of(layout.index_range(one, windows)) == sorted((y[0], x[0]) for x in a for y in b if meet(x, y))
    assert one.stats().first().rows == 400


def test_aggregates_and_edits(spark):
    a = boxes(100, 30)
    df = frame(spark, a)
    assert tuple(aggregates.extent(df).first()) == (min(x[1] for x in a), min(x[2] for x in a), max(x[3] for x in a), max(x[4] for x in a), 100)
    assert tuple(aggregates.extent(df.limit(0)).first()) == (None, None, None, None, 0)
    groups = aggregates.mbr(df.selectExpr("*", "id % 7 AS g"), "g").collect()
    assert {r.g: r.n for r in groups} == {k: sum(x[0] % 7 == k for x in a) for k in range(7)}
    left = aggregates.delete_by_id(df, df.where("id < 10"))
    assert left.count() == 90
    assert aggregates.append(left, df.where("id < 10")).count() == 100


@pytest.mark.parametrize("held", [4, 64])
def test_descent_through_several_levels(spark, monkeypatch, tmp_path, held):
    monkeypatch.setattr(layout, "HELD_NODES", held)
    monkeypatch.setattr(layout, "FAN", 2)
    a, w = boxes(900, 31, lattice=True), boxes(25, 32, 0.3)
    data, windows = frame(spark, a), frame(spark, w).withColumnRenamed("id", "qid")
    index = layout.build_index(data, 6)
    assert index.side() == 12 and index.stats().first().rows == 900
    sizes = [index.level(up, 12).agg({"n": "sum", "*": "count"}).first() for up in range(5)]
    assert {r["sum(n)"] for r in sizes} == {900} and sizes[4]["count(1)"] == 1
    index.save(str(tmp_path / "index"))
    saved = layout.load(spark, str(tmp_path / "index"))
    want = sorted((q[0], x[0]) for x in a for q in w if meet(x, q))
    points = spark.createDataFrame([(q[0], q[1], q[2]) for q in w], "qid long, x double, y double")
    near = pairs_of(knn.nested_knn(data, points, 5))
    for one in (index, saved):
        assert pairs_of(layout.index_range(one, windows)) == want
        assert pairs_of(knn.index_knn(one, points, 5)) == near
        assert pairs_of(layout.index_join(one, layout.build_index(frame(spark, w), 3))) == sorted((x[0], y[0]) for x in a for y in w if meet(x, y))
    assert knn.index_knn(saved, points, 2000).count() == 900 * 25


def test_saved_index_is_read_by_nodes(spark, tmp_path):
    data = frame(spark, boxes(2000, 33, 0))
    layout.build_index(data, 50).save(str(tmp_path / "index"))
    index = layout.load(spark, str(tmp_path / "index"))
    window = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 5.0)], SCHEMA.replace("id", "qid", 1))
    plan = layout.index_range(index, window)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*(EqualTo|In|GreaterThanOrEqual)\(node_id", plan)
    outside = spark.createDataFrame([(1, 1e6, 1e6, 2e6, 2e6)], SCHEMA.replace("id", "qid", 1))
    assert layout.index_range(index, outside).count() == 0


def test_equal_corners_stay_in_one_leaf(spark):
    rows = [(i, 1.0, 1.0, 2.0, 2.0) for i in range(300)] + [(1000 + i, float(i), float(i % 7), float(i), float(i % 7)) for i in range(100)]
    index = layout.build_index(frame(spark, rows), 10)
    assert index.stats().first().rows == 400
    window = spark.createDataFrame([(1, 1.5, 1.5, 1.6, 1.6)], SCHEMA.replace("id", "qid", 1))
    assert layout.index_range(index, window).count() == 300


def test_knn_searches_a_point_once(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(knn, "candidate_leaves", lambda index, queries, k: asked.append(queries.count()) or layout.candidate_leaves(index, queries, k))
    data = frame(spark, boxes(300, 51, lattice=True))
    r = random.Random(52)
    places = [(r.uniform(-500, 500), float(r.randrange(-500, 500))) for _ in range(7)] + [(0.0, 0.0), (-0.0, 0.0)]
    points = spark.createDataFrame([(i, *places[i % 9]) for i in range(90)], "qid long, x double, y double")
    want = pairs_of(knn.nested_knn(data, points, 5))
    for rows in (knn.NESTED_ROWS, 10):  # joined back by broadcast, and by shuffle
        monkeypatch.setattr(knn, "NESTED_ROWS", rows)
        assert pairs_of(knn.knn(data, points, 5, 16, "indexed")) == want
    assert len(want) == 450 and asked == [8, 8]


def test_index_knn_looks_at_no_more_rows_for_more_queries_at_a_point(spark, monkeypatch):
    looked = []
    monkeypatch.setattr(knn, "pruned", lambda index, near: looked.append(near.count()) or layout.pruned(index, near))
    data = frame(spark, boxes(300, 53, lattice=True))
    index = layout.build_index(data, 16)
    r = random.Random(54)
    places = [(r.uniform(-500, 500), r.uniform(-500, 500)) for _ in range(5)]
    for copies in (1, 20):
        points = spark.createDataFrame([(i, *places[i % 5]) for i in range(5 * copies)], "qid long, x double, y double")
        assert pairs_of(knn.index_knn(index, points, 3)) == pairs_of(knn.nested_knn(data, points, 3))
    assert looked[0] == looked[1]


def test_knn_of_one_from_large_sets_searches_a_point_once(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(knn, "candidate_leaves", lambda index, queries, k: asked.append(queries.count()) or layout.candidate_leaves(index, queries, k))
    monkeypatch.setattr(knn, "NESTED_PAIRS", 0)
    data = frame(spark, boxes(300, 55, lattice=True))
    points = spark.createDataFrame([(i, float(i % 3), 2.0) for i in range(30)], "qid long, x double, y double")
    assert pairs_of(knn.knn(data, points, 1, 16)) == pairs_of(knn.nested_knn(data, points, 1))
    assert asked == [3] and knn.knn(data, points, 1, 16).count() == 30


@pytest.mark.parametrize("k", [1, 5])
def test_knn_leaves_the_rows_of_an_index_where_they_are(spark, monkeypatch, k):
    shuffled = lambda df: re.search(r"hashpartitioning\(node_id#\d+L?, \d+\), ENSURE", df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(knn, "NESTED_PAIRS", 0)
    data = frame(spark, boxes(300, 57, lattice=True))
    r = random.Random(58)
    points = spark.createDataFrame([(i, r.uniform(-500, 500), r.uniform(-500, 500)) for i in range(12)], "qid long, x double, y double")
    index = layout.build_index(data, 16)
    index.data = spark.createDataFrame(index.data.collect(), index.data.schema)  # without the exchange of its own
    want = pairs_of(knn.nested_knn(data, points, k))
    for rows in (knn.NESTED_ROWS, 0):  # leaves sent to the rows, and met by shuffle
        monkeypatch.setattr(knn, "NESTED_ROWS", rows)
        got = knn.index_knn(index, points, k)
        assert pairs_of(got) == want and bool(shuffled(got)) == (not rows)


def test_knn_deals_queries_out_once_for_all_levels(spark, monkeypatch):
    met = []
    monkeypatch.setattr(layout, "HELD_NODES", 1)
    monkeypatch.setattr(knn, "candidate_leaves", lambda index, queries, k: met.append(layout.candidate_leaves(index, queries, k)) or met[-1])
    data = frame(spark, boxes(600, 59, lattice=True))
    r = random.Random(60)
    points = spark.createDataFrame([(i, r.uniform(-500, 500), r.uniform(-500, 500)) for i in range(12)], "qid long, x double, y double")
    index = layout.build_index(data, 2)  # 17 by 17 leaves, two levels above
    for sent, often in ((layout.SENT_NODES, 1), (0, 3)):  # children sent to the queries, and met by shuffle
        monkeypatch.setattr(layout, "SENT_NODES", sent)
        assert pairs_of(knn.index_knn(index, points, 1)) == pairs_of(knn.nested_knn(data, points, 1))
        plan = met[-1]._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning\([^)]*qid#", plan)) == often, plan
