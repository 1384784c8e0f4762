"""Streams of boxes or points against a static set.

The set does not change while the query runs, so this is a stateless join of a
stream with a static table; each micro-batch is joined with the leaf table
first and with the rows of the leaves it meets then.  The index is to be one
that was saved and loaded: line numbers are not available in streaming plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.functions.geometry import box, intersects
from boxwright.operators.join import FIELDS
from boxwright.plans.layout import Index


def stream_range(windows: DataFrame, index: Index) -> DataFrame:
    """qid, id of the hits of a stream of windows (qid, box)."""
    w = windows.select("qid", *(F.col(c).alias(f"w_{c}") for c in FIELDS))
    leaves = index.leaves.select("node_id", *(F.col(c).alias(f"l_{c}") for c in FIELDS))
    near = w.join(F.broadcast(leaves), intersects(box("w_"), box("l_")))
    return near.join(index.data.select("node_id", "id", *FIELDS), "node_id").where(intersects(box(), box("w_"))).select("qid", "id")
