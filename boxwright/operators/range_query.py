"""Range (window) queries: one window, or a table of them at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.functions.geometry import Box, Point, box, contains, intersects, make_box, strictly_inside
from boxwright.operators.join import FIELDS, box_join


def range_single(data: DataFrame, window: tuple[float, float, float, float]) -> DataFrame:
    """Rows of ``data`` that intersect a window; the bounds reach the scan."""
    return data.where(intersects(box(), make_box(*window)))


def _met(data: DataFrame, windows: DataFrame, strategy: str) -> DataFrame:
    return box_join(data.select("id", *FIELDS), windows.select("qid", *FIELDS), strategy)


def range_pairs(data: DataFrame, windows: DataFrame, strategy: str = "auto") -> DataFrame:
    """qid, id of every hit of every window."""
    return _met(data, windows, strategy).select(F.col("b_qid").alias("qid"), F.col("a_id").alias("id"))


def range_counts(data: DataFrame, windows: DataFrame, strategy: str = "auto") -> DataFrame:
    """qid, hits of every window, 0 for those without."""
    hits = range_pairs(data, windows, strategy).groupBy("qid").agg(F.count("*").alias("hits"))
    return windows.select("qid").join(hits, "qid", "left").select("qid", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"))


def range_lists(data: DataFrame, windows: DataFrame, strategy: str = "auto") -> DataFrame:
    """qid, ids (sorted) of the windows with hits."""
    return range_pairs(data, windows, strategy).groupBy("qid").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def windows_with_hits(data: DataFrame, windows: DataFrame, anti: bool = False, strategy: str = "auto") -> DataFrame:
    """The windows with (``anti``: without) a hit.  A qid must be unique: windows
    that share one count as one."""
    met = range_pairs(data, windows, strategy).select("qid").distinct()
    return windows.join(met, "qid", "left_anti" if anti else "left_semi")


def range_contained(data: DataFrame, windows: DataFrame, strategy: str = "auto") -> DataFrame:
    """qid, id of the boxes that lie within a window."""
    return _met(data, windows, strategy).where(contains(box("b_"), box("a_"))).select(F.col("b_qid").alias("qid"), F.col("a_id").alias("id"))


def points_inside(points: DataFrame, windows: DataFrame, strategy: str = "auto") -> DataFrame:
    """qid, id, x, y of the points (id, x, y) strictly inside a window."""
    as_boxes = points.select("id", F.col("x").alias("min_x"), F.col("y").alias("min_y"), F.col("x").alias("max_x"), F.col("y").alias("max_y"))
    met = _met(as_boxes, windows, strategy).where(strictly_inside(Point(F.col("a_min_x"), F.col("a_min_y")), Box(*(F.col(f"b_{c}") for c in FIELDS))))
    return met.select(F.col("b_qid").alias("qid"), F.col("a_id").alias("id"), F.col("a_min_x").alias("x"), F.col("a_min_y").alias("y"))


def point_lists(points: DataFrame, windows: DataFrame, strategy: str = "auto") -> DataFrame:
    """qid, points (sorted array of x, y) strictly inside each window that has any."""
    return points_inside(points, windows, strategy).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("points"))
