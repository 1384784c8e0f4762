"""The geometry as SQL functions of a session; Spark inlines their bodies."""

from __future__ import annotations

from pyspark.sql import SparkSession

_TWO = "a_min_x DOUBLE, a_min_y DOUBLE, a_max_x DOUBLE, a_max_y DOUBLE, b_min_x DOUBLE, b_min_y DOUBLE, b_max_x DOUBLE, b_max_y DOUBLE"
_ONE = "min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE"
_GAP = "greatest(min_x - x, x - max_x, CAST(0 AS DOUBLE)) * greatest(min_x - x, x - max_x, CAST(0 AS DOUBLE)) + greatest(min_y - y, y - max_y, CAST(0 AS DOUBLE)) * greatest(min_y - y, y - max_y, CAST(0 AS DOUBLE))"

FUNCTIONS = {
    "box_intersects": (_TWO, "BOOLEAN", "a_max_x >= b_min_x AND a_min_x <= b_max_x AND a_max_y >= b_min_y AND a_min_y <= b_max_y"),
    "box_contains": (_TWO, "BOOLEAN", "a_min_x <= b_min_x AND a_max_x >= b_max_x AND a_min_y <= b_min_y AND a_max_y >= b_max_y"),
    "box_equals": (_TWO, "BOOLEAN", "a_min_x = b_min_x AND a_max_x = b_max_x AND a_min_y = b_min_y AND a_max_y = b_max_y"),
    "box_edge_overlaps": (_TWO, "BOOLEAN", "a_min_x = b_min_x OR a_max_x = b_max_x OR a_min_y = b_min_y OR a_max_y = b_max_y"),
    "box_distance_sq": (f"{_ONE}, x DOUBLE, y DOUBLE", "DOUBLE", _GAP),
    "box_distance": (f"{_ONE}, x DOUBLE, y DOUBLE", "DOUBLE", f"sqrt({_GAP})"),
    "box_has_inside": (f"{_ONE}, x DOUBLE, y DOUBLE", "BOOLEAN", "x > min_x AND x < max_x AND y > min_y AND y < max_y"),
    "box_area": (_ONE, "DOUBLE", "(max_x - min_x) * (max_y - min_y)"),
    "box_width": (_ONE, "DOUBLE", "max_x - min_x"),
    "box_height": (_ONE, "DOUBLE", "max_y - min_y"),
    "box_aspect_ratio": (_ONE, "DOUBLE", "CASE WHEN max_y <> min_y THEN try_divide(max_x - min_x, max_y - min_y) WHEN max_x > min_x THEN double('Infinity') WHEN max_x < min_x THEN double('-Infinity') ELSE double('NaN') END"),
    "box_center_x": (_ONE, "DOUBLE", "(min_x + max_x) / 2"),
    "box_center_y": (_ONE, "DOUBLE", "(min_y + max_y) / 2"),
    "box_text": (_ONE, "STRING", "format_string('(%.6f, %.6f, %.6f, %.6f)', min_x, min_y, max_x, max_y)"),
    "point_text": ("x DOUBLE, y DOUBLE", "STRING", "format_string('(%.6f,%.6f)', x, y)"),
}


def register_sql(spark: SparkSession) -> list[str]:
    """Create the functions in the session and return their names."""
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    return list(FUNCTIONS)
