"""Bounding boxes of sets and groups of boxes, and edits of a set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bounds() -> list[Column]:
    return [F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"), F.count("*").alias("n")]


def extent(data: DataFrame) -> DataFrame:
    """The bounding box of all rows and their number; nulls for an empty set."""
    return data.agg(*_bounds())


def mbr(data: DataFrame, *keys: str | Column) -> DataFrame:
    """The bounding box and the number of rows of each group."""
    return data.groupBy(*keys).agg(*_bounds())


def delete_by_id(data: DataFrame, ids: DataFrame) -> DataFrame:
    """``data`` without the rows whose id is in ``ids``."""
    return data.join(ids.select("id"), "id", "left_anti")


def append(data: DataFrame, more: DataFrame) -> DataFrame:
    """``data`` with the rows of ``more``, matched by name."""
    return data.unionByName(more)
