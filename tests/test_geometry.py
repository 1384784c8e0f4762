import math

import pytest
from pyspark.sql import functions as F

from boxwright.functions import geometry as g
from boxwright.functions.sql import register_sql


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


BOXES = {"unit": (0, 0, 1, 1), "corner": (1, 1, 2, 2), "edge": (1, 0, 2, 1), "apart": (1.001, 0, 2, 1), "inner": (0.25, 0.25, 0.5, 0.5), "point": (0.5, 0.5, 0.5, 0.5), "negative": (-3, -3, -1, -2), "cover": (-9, -9, 9, 9)}


def meets(a, b):
    return not (a[2] < b[0] or a[0] > b[2] or a[3] < b[1] or a[1] > b[3])


@pytest.mark.parametrize("one", BOXES)
@pytest.mark.parametrize("two", BOXES)
def test_predicates(spark, one, two):
    a, b = BOXES[one], BOXES[two]
    x, y = g.make_box(*a), g.make_box(*b)
    row = spark.range(1).select(g.intersects(x, y), g.contains(x, y), g.equals(x, y), g.edge_overlaps(x, y)).first()
    assert row[0] == meets(a, b)
    assert row[1] == (a[0] <= b[0] and a[1] <= b[1] and a[2] >= b[2] and a[3] >= b[3])
    assert row[2] == (a == b)
    assert row[3] == any(p == q for p, q in zip(a, b, strict=True))


@pytest.mark.parametrize(("p", "d"), [((0.5, 0.5), 0), ((1, 0.5), 0), ((3, 0.5), 4), ((-3, -4), 25), ((2, 3), 5)])
def test_distance(spark, p, d):
    b = g.make_box(0, 0, 1, 1)
    assert value(spark, g.distance_sq(b, g.make_point(*p))) == d
    assert value(spark, g.distance(b, g.make_point(*p))) == pytest.approx(math.sqrt(d))


def test_float_stays_float(spark):
    row = spark.range(1).select(g.distance_sq(g.make_box(0, 0, 1, 1, "float"), g.make_point(3, 3, "float")).alias("d"), g.area(g.make_box(0, 0, 2, 1, "float")).alias("a"))
    assert [t for _, t in row.dtypes] == ["float", "float"]


def test_measures(spark):
    b = g.make_box(1, 2, 4, 3)
    row = spark.range(1).select(g.width(b), g.height(b), g.area(b), g.aspect_ratio(b), g.center(b).x, g.center(b).y).first()
    assert tuple(row) == (3, 1, 3, 3, 2.5, 2.5)
    assert value(spark, g.area(g.make_box(2, 0, 1, 1))) == -1
    assert value(spark, g.aspect_ratio(g.make_box(0, 1, 2, 1))) == math.inf
    assert value(spark, g.aspect_ratio(g.make_box(2, 1, 0, 1))) == -math.inf
    assert math.isnan(value(spark, g.aspect_ratio(g.make_box(1, 1, 1, 1))))


def test_inside_is_strict(spark):
    b = g.make_box(0, 0, 1, 1)
    assert value(spark, g.strictly_inside(g.make_point(0.5, 0.5), b))
    assert not value(spark, g.strictly_inside(g.make_point(1, 0.5), b))


def test_text(spark):
    assert value(spark, g.box_text(g.make_box(0, 1, 2, 3.5))) == "(0.000000, 1.000000, 2.000000, 3.500000)"
    assert value(spark, g.point_text(g.make_point(-1, 2))) == "(-1.000000,2.000000)"


def test_struct_and_validity(spark):
    assert value(spark, g.box_struct(g.make_box(0, 0, 1, 1))).id == 0
    assert value(spark, g.is_valid(g.make_box(0, 0, 0, 0)))
    assert not value(spark, g.is_valid(g.make_box(1, 0, 0, 1)))
    assert not value(spark, g.is_valid(g.make_box(math.nan, 0, 1, 1)))
    assert not value(spark, g.is_valid(g.make_box(-math.inf, 0, 1, 1)))
    assert value(spark, F.struct(*g.normalized(g.make_box(3, 0, 1, 1))))[0] == 1


def test_sql_functions(spark):
    names = register_sql(spark)
    assert len(names) == 15
    row = spark.sql("SELECT box_intersects(0D,0D,1D,1D,1D,1D,2D,2D), box_contains(0D,0D,3D,3D,1D,1D,2D,2D), box_distance_sq(0D,0D,1D,1D,4D,5D), box_distance(0D,0D,1D,1D,4D,5D), box_aspect_ratio(0D,0D,1D,0D), box_text(0D,0D,1D,1D), point_text(1D,2D), box_has_inside(0D,0D,1D,1D,1D,1D)").first()
    assert tuple(row) == (True, True, 25.0, 5.0, math.inf, "(0.000000, 0.000000, 1.000000, 1.000000)", "(1.000000,2.000000)", False)
