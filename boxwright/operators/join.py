"""Intersection joins of two sets of boxes.

Large sets meet by equi-join on the cells of grids.  There is a grid for every
power of ``RATIO``; a box belongs to the finest one whose cells are at least as
wide and high as itself, so it lies in four cells at most, there and in all
coarser grids.  Two boxes meet in the coarser of their own grids, in the cell
that holds the lower left corner of their intersection: each pair comes out
exactly once, without a distinct, whatever the sizes of the boxes are.

Where boxes crowd, a cell may hold many pairs.  Such cells are counted first,
and both sides of one are dealt into parts, each of which meets every part of
the other side in a task of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.functions.geometry import Box, box, intersects

RATIO, ROWS_PER_CELL = 4.0, 16
#: Up to this number of pairs, and of rows on the broadcast side, a nested loop is cheaper than a grid.
NESTED_PAIRS, NESTED_ROWS = 20_000_000, 50_000
#: A cell with more than ``CROWD`` squared pairs is dealt into parts of about ``CROWD`` rows; so many such cells are sent to all executors, more are joined by shuffle.
CROWD, BROADCAST_CELLS = 1 << 15, 100_000
FIELDS = Box._fields
CELL = ("_grid", "_cx", "_cy")


@dataclass(frozen=True)
class Spread:
    """What the choice of a plan needs to know about a set of boxes."""

    rows: int
    extent: tuple[float, float, float, float] | None
    side: float  # mean of the longer sides


def spread(df: DataFrame) -> Spread:
    b = box()
    longer = F.greatest(b.max_x - b.min_x, b.max_y - b.min_y)
    r = df.agg(F.count("*"), F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y"), F.avg(longer)).first()
    return Spread(r[0], None if r[0] == 0 else tuple(map(float, r[1:5])), float(r[5] or 0))


def cell_side(a: Spread, b: Spread) -> float:
    """Side of the finest cells: no less than the mean extent of the boxes, and
    so that a cell holds a few rows."""
    both = [s for s in (a, b) if s.rows]
    if not both:
        return 1.0
    low, high = (f(f(s.extent[i], s.extent[i + 1]) for s in both) for f, i in ((min, 0), (max, 2)))
    area = 1.0
    for i in (0, 1):
        area *= max(max(s.extent[i + 2] for s in both) - min(s.extent[i] for s in both), 0)
    most = max(abs(low), abs(high))
    rows = max(s.rows for s in both)
    side = max(2 * max(s.side for s in both), (area * ROWS_PER_CELL / rows) ** 0.5, most / 2**40)
    return side if side > 0 else 1.0


def _level(b: Box, side: float) -> Column:
    longer = F.greatest(b.max_x - b.min_x, b.max_y - b.min_y).cast("double")
    return F.when(longer <= side, 0).otherwise(F.ceil(F.log(longer / side) / F.log(F.lit(RATIO))).cast("int"))


def _levels(df: DataFrame) -> list[int]:
    """The grids in use, a few tens at most."""
    return sorted(r[0] for r in df.select("_level").distinct().collect())


def _crowded(x: DataFrame, y: DataFrame) -> DataFrame | None:
    """_grid, _cx, _cy, _a_parts, _b_parts of the crowded cells, if there are any."""
    cells = [df.select(*(F.col(f"_{n}{k}").alias(k) for k in CELL), F.lit(int(n == "a")).alias("a"), F.lit(int(n == "b")).alias("b")) for df, n in ((x, "a"), (y, "b"))]
    counted = cells[0].union(cells[1]).groupBy(*CELL).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    parts = (F.ceil(F.col(n) / CROWD).alias(f"_{n}_parts") for n in ("a", "b"))
    hot = counted.where(F.col("a").cast("double") * F.col("b") > float(CROWD) ** 2).select(*CELL, *parts)
    found = hot.take(BROADCAST_CELLS + 1)
    if not found:
        return None
    return hot if len(found) > BROADCAST_CELLS else F.broadcast(x.sparkSession.createDataFrame(found, hot.schema))


def _parted(df: DataFrame, hot: DataFrame, name: str, other: str) -> DataFrame:
    """``df`` with the part of each row, and a copy for each part of the other side."""
    met = df.join(hot, [F.col(f"_{name}{k}") == F.col(k) for k in CELL], "left").drop(*CELL)
    hashed = [c for c in df.columns if c.startswith(f"{name}_") and "map<" not in df.schema[c].dataType.simpleString()]
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    own = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in hashed)), F.coalesce(f"_{name}_parts", one))
    copies = F.explode(F.sequence(none, F.coalesce(f"_{other}_parts", one) - 1))
    return met.withColumn(f"_{name}_{name}", own).withColumn(f"_{name}_{other}", copies).drop("_a_parts", "_b_parts")


def cell_pairs(a: DataFrame, b: DataFrame, side: float | None = None, most: float = float("inf")) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` whose boxes meet in a cell, each once:
    all that intersect, and others.  The columns of both, those of ``a`` with
    prefix a_, those of ``b`` with prefix b_.  A condition on the boxes becomes
    part of the join.  Cells are not counted if ``most``, a bound of all pairs,
    makes none crowded."""
    side = side or cell_side(spread(a), spread(b))
    left, right = (x.withColumn("_level", _level(box(), side)) for x in (a, b))
    here, there = _levels(left), _levels(right)

    def dealt(df: DataFrame, name: str, others: list[int]) -> DataFrame:
        c = box()
        grids = F.array_distinct(F.concat(F.array("_level"), F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda g: g > F.col("_level"))))
        out = df.withColumn("_grid", F.explode(grids)).withColumn("_side", F.lit(side) * F.pow(F.lit(RATIO), F.col("_grid")))
        at = lambda v: F.floor(v / F.col("_side")).cast("bigint")
        out = out.withColumn("_cx", F.explode(F.sequence(at(c.min_x), at(c.max_x)))).withColumn("_cy", F.explode(F.sequence(at(c.min_y), at(c.max_y))))
        return out.select(*(F.col(n).alias(f"{name}_{n}") for n in df.columns), *(F.col(k).alias(f"_{name}{k}") for k in CELL))

    x, y = dealt(left, "a", there), dealt(right, "b", here)
    width = F.lit(side) * F.pow(F.lit(RATIO), F.col("_a_grid"))
    own = F.greatest("a__level", "b__level") == F.col("_a_grid")
    corner = (F.floor(F.greatest("a_min_x", "b_min_x") / width).cast("bigint") == F.col("_a_cx")) & (F.floor(F.greatest("a_min_y", "b_min_y") / width).cast("bigint") == F.col("_a_cy"))
    same = (F.col("_a_grid") == F.col("_b_grid")) & (F.col("_a_cx") == F.col("_b_cx")) & (F.col("_a_cy") == F.col("_b_cy"))
    if most > float(CROWD) ** 2 and (hot := _crowded(x, y)) is not None:
        x, y = _parted(x, hot, "a", "b"), _parted(y, hot, "b", "a")
        same &= (F.col("_a_a") == F.col("_b_a")) & (F.col("_a_b") == F.col("_b_b"))
    met = x.join(y, same & own & corner)
    return met.select(*(f"a_{n}" for n in a.columns), *(f"b_{n}" for n in b.columns))


def grid_join(a: DataFrame, b: DataFrame, side: float | None = None, most: float = float("inf")) -> DataFrame:
    """Those of ``cell_pairs`` whose boxes intersect."""
    return cell_pairs(a, b, side, most).where(intersects(box("a_"), box("b_")))


def few(rows: int, sent: int) -> bool:
    """Whether a nested loop is cheaper, with ``sent`` rows on the broadcast side."""
    return sent <= NESTED_ROWS and rows * sent <= NESTED_PAIRS


def nested_join(a: DataFrame, b: DataFrame, predicate=intersects, how: str = "inner") -> DataFrame:
    """The same by comparing all rows of ``a`` with the broadcast rows of ``b``."""
    x, y = (df.select(*(F.col(n).alias(f"{p}_{n}") for n in df.columns)) for df, p in ((a, "a"), (b, "b")))
    return x.join(F.broadcast(y), predicate(box("a_"), box("b_")), how)


def box_join(a: DataFrame, b: DataFrame, strategy: str = "auto") -> DataFrame:
    """Intersecting pairs by the cheaper plan; ``strategy`` may force one
    (auto, grid, nested)."""
    if strategy == "nested":
        return nested_join(a, b)
    sa, sb = spread(a), spread(b)
    if strategy == "auto" and few(sa.rows, sb.rows):
        return nested_join(a, b)
    return grid_join(a, b, cell_side(sa, sb), float(sa.rows) * sb.rows)


def join_pairs(a: DataFrame, b: DataFrame, strategy: str = "auto") -> DataFrame:
    """id_a, id_b of intersecting boxes, each pair once."""
    return box_join(a.select("id", *FIELDS), b.select("id", *FIELDS), strategy).select(F.col("a_id").alias("id_a"), F.col("b_id").alias("id_b"))


def self_join(a: DataFrame, distinct_pairs: bool = False, strategy: str = "auto") -> DataFrame:
    """Pairs within one set, with identity and both orders unless
    ``distinct_pairs`` (id_a < id_b)."""
    pairs = join_pairs(a, a, strategy)
    return pairs.where("id_a < id_b") if distinct_pairs else pairs


def grouped(pairs: DataFrame) -> DataFrame:
    """id_a, n, ids_b (sorted) of those with a partner."""
    return pairs.groupBy("id_a").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id_b")).alias("ids_b"))


def semi_join(a: DataFrame, b: DataFrame, anti: bool = False, strategy: str = "auto") -> DataFrame:
    """Rows of ``a`` that meet (``anti``: do not meet) a box of ``b``.  Ids of
    ``a`` must be unique: rows that share one count as one."""
    met = join_pairs(a, b, strategy).select(F.col("id_a").alias("id")).distinct()
    return a.join(met, "id", "left_anti" if anti else "left_semi")


def equal_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """id_a, id_b of equal boxes: a plain equi-join on the four bounds."""
    x, y = a.select(F.col("id").alias("id_a"), *FIELDS), b.select(F.col("id").alias("id_b"), *FIELDS)
    return x.join(y, list(FIELDS)).select("id_a", "id_b")
