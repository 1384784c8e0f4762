"""Nearest neighbours and equal boxes over whole tables, against brute force."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwright import queries
from boxwright.operators import join, knn
from boxwright.plans import layout

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the standard tables")


def nearest(boxes, points, k, kind):
    ids, (x0, y0, x1, y1) = [r[0] for r in boxes], np.array([r[1:] for r in boxes], kind).T
    out = set()
    for qid, x, y in points:
        dx, dy = np.maximum(np.maximum(x0 - kind(x), kind(x) - x1), 0), np.maximum(np.maximum(y0 - kind(y), kind(y) - y1), 0)
        d = dx * dx + dy * dy
        out |= {(qid, ids[i], float(d[i]), rank) for rank, i in enumerate(np.lexsort((ids, d))[:k], 1)}
    return out


def test_all_customers(spark):
    parcels = queries.fixture(spark, str(DATA), "parcels")
    c = spark.read.parquet(f"{DATA}/customer.parquet")
    points = c.select(F.col("c_custkey").alias("qid"), (F.col("c_custkey") * 911 % 1109).cast("double").alias("x"), (F.col("c_custkey") * 613 % 1109).cast("double").alias("y"))
    want = nearest(*([tuple(r) for r in x.collect()] for x in (parcels, points)), 5, np.float64)
    assert len(want) == 5 * c.count()
    for got in (knn.knn(parcels, points, 5), knn.knn(parcels, points, 5, strategy="indexed"), knn.index_knn(layout.build_index(parcels, 128), points, 5)):
        assert {(r.qid, r.id, r.distance_sq, r.rank) for r in got.collect()} == want


def test_all_float_points(spark):
    v = queries.fixture(spark, str(DATA), "vec2d")
    boxes = v.select("id", F.col("x").alias("min_x"), F.col("y").alias("min_y"), F.col("x").alias("max_x"), F.col("y").alias("max_y"))
    points = v.select(F.col("id").alias("qid"), "x", "y")
    got = {(r.qid, r.id, r.distance_sq, r.rank) for r in knn.knn(boxes, points, 5).collect()}
    assert got == nearest(*([tuple(r) for r in x.collect()] for x in (boxes, points)), 5, np.float32)


def test_all_equal_boxes(spark):
    parcels = queries.fixture(spark, str(DATA), "parcels")
    got = sorted(map(tuple, join.equal_join(parcels, parcels.withColumn("id", F.col("id") + 1000000)).collect()))
    rows = [tuple(r) for r in parcels.collect()]
    assert got == sorted((a[0], b[0] + 1000000) for a in rows for b in rows if a[1:] == b[1:])
