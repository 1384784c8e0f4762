"""Mixing sources to target weights by balanced sampling with the cube method.

Every source has a target number of words.  Its documents are taken
``floor(target / size)`` times whole, and once more with the remaining fraction
as inclusion probability.  The cube method draws that sample: three documents
at a time, the probabilities move along the null space of the constraints
(documents and words in total) until one of them is 0 or 1.  That flight runs
in blocks of about ``BLOCK`` documents of a source, each of which leaves at most
two documents open; the open ones of all blocks fly again, in blocks, until one
block of a source remains.  There, a last step gives up the number of documents
to keep that of words, rounds the one document left over, and turns documents
whose size makes up for the rounding.

All draws come from generators seeded by source, level and block, and the
documents of a block are sorted first, so reruns agree.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwright.llm.shared import materialise, packed, small, words

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
BLOCK, BROADCAST_SOURCES = 16_384, 100_000
ROW = "id long, no_id boolean, source string, h long, copy int, size long, p double"


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, docs, target from ``sizes`` (source, source_size, docs).

    The sources share ``SHARE`` of all words by weight, but none has more than
    ``MOST`` times its own.  With the sources sorted by the level at which they
    are full, those before the first that stays below the common level are.
    One row for each source is all that meets in one place.
    """
    place = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, map(float, WEIGHTS))), ((F.row_number().over(place) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("full", F.col("source_size") * MOST)
    s = s.withColumn("at", F.col("full") / F.col("w")).withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    order = Window.orderBy("at", F.col("source").isNull(), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("all") * SHARE - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("level", level)
    common = F.first(F.when(F.col("level") <= F.col("at"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return s.select("source", "source_size", "docs", F.least("full", F.coalesce(common, F.lit(float("inf"))) * F.col("w")).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Probabilities after the flight; with ``land`` all are 0 or 1."""
    start, p, tiny = p, p.tolist(), 1e-9
    s = size.astype(float).tolist()
    draw = iter(rng.random(len(p) + 4).tolist())
    held: list[int] = []

    def move(u: list[float]) -> None:
        up = min((1 - p[k]) / x if x > 0 else -p[k] / x for k, x in zip(held, u, strict=True) if x)
        down = min(p[k] / x if x > 0 else (p[k] - 1) / x for k, x in zip(held, u, strict=True) if x)
        step = up if next(draw) * (up + down) < down else -down
        for k, x in zip(held, u, strict=True):
            p[k] = min(1.0, max(0.0, p[k] + step * x))
            p[k] = 0.0 if p[k] < tiny else 1.0 if p[k] > 1 - tiny else p[k]
        held[:] = [k for k in held if 0 < p[k] < 1]

    for i in range(len(p)):
        if 0 < p[i] < 1:
            held.append(i)
            if len(held) == 3:
                a, b, c = (s[k] for k in held)
                move([b - c, c - a, a - b] if a != b or b != c else [1.0, -1.0, 0.0])
    while len(held) == 2 and (land or s[held[0]] == s[held[1]]):
        a, b = (s[k] for k in held)
        move([b, -a] if a != b and a and b else [1.0, -1.0] if a == b else [float(a == 0), float(b == 0)])
    out = np.array(p)
    return _landed(out, start, np.array(s)) if land else out


def _landed(p: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rounds what is open and pays for the error in words by turning documents
    whose size comes nearest to it, as long as it lessens."""
    own, p = (start > 0) & (start < 1), (p >= 0.5).astype(float)
    error = float((size * (p - start)).sum())
    while True:
        after = np.where(own & (p == (error > 0)), np.abs(abs(error) - size), np.inf)
        k = int(np.argmin(after)) if len(after) else 0
        if not len(after) or after[k] >= abs(error):
            return p
        error += size[k] * (1 - 2 * p[k])
        p[k] = 1 - p[k]


def _fly(rows: DataFrame, level: int) -> DataFrame:
    """``rows`` (ROW, block, blocks) after one flight in each block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "h", "id", "no_id", "copy"], ascending=[False, True, True, True, True])
        source, block = pdf["source"].iloc[0], pdf["block"].iloc[0]
        rng = np.random.default_rng([zlib.crc32(repr(source).encode()), level, int(block)])
        p = flight(pdf["p"].to_numpy(), pdf["size"].to_numpy(), rng, land=int(pdf["blocks"].iloc[0]) == 1)
        return pdf.assign(p=p).drop(columns=["block", "blocks"])

    return rows.groupBy("source", "block").applyInPandas(run, ROW)


def _dealt(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    b = blocks.select(F.col("source").alias("_source"), "blocks")
    rows = rows.join(b, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return rows.withColumn("block", F.pmod(F.xxhash64("id", "no_id", "h", "copy"), F.col("blocks")))


def _keys(docs: DataFrame) -> list[Column]:
    """id, no_id, source and h of a packed row; h tells apart rows that differ
    in any column (maps, which have no hash, excepted)."""
    doc_id, hashed = F.col("row.doc_id"), [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    h = F.xxhash64(*(F.col(f"row.`{c}`") for c in hashed), *(F.col(f"row.`{c}`").isNull() for c in hashed))
    return [F.coalesce(doc_id.cast("long"), F.lit(0)).alias("id"), doc_id.isNull().alias("no_id"), F.col("row.source").cast("string").alias("source"), h.alias("h")]


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, no_id, source, h, copy, size, p, whole) of all documents, which
    are taken ``p + whole`` times, and the targets."""
    rows = packed(docs).select(*_keys(docs), F.size(words(F.col("row.text"))).cast("long").alias("size"))
    # Rows that are equal get a number each.
    rows = materialise(rows.groupBy("id", "no_id", "source", "h", "size").agg(F.count("*").cast("int").alias("n")), "sizes")
    total = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    plan = materialise(targets(total), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    side = small(plan.select(F.col("source").alias("_source"), rate.alias("rate"), F.ceil(F.col("docs") / BLOCK).alias("blocks")), BROADCAST_SOURCES)
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).drop("n")
    rows = rows.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("p", F.col("rate") - F.floor("rate")).withColumn("block", F.pmod(F.xxhash64("id", "no_id", "h", "copy"), F.col("blocks")))
    flown, level = materialise(_fly(rows.drop("rate"), 0), "flown"), 0
    done, is_open = flown.where("p in (0, 1)"), flown.where("p not in (0, 1)")
    while is_open.limit(1).count():
        level += 1
        blocks = small(materialise(is_open.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "blocks"), BROADCAST_SOURCES)
        flown = materialise(_fly(_dealt(is_open, blocks), level), "flown")
        done, is_open = done.union(flown.where("p in (0, 1)")), flown.where("p not in (0, 1)")
    return done, plan


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words) of every row of
    ``docs`` (doc_id, text, source).

    Null and empty texts have size 0; a null source is one of its own; repeated
    rows are drawn one by one; a source without words has target 0.
    """
    done, plan = mix(docs)
    side = small(plan.withColumnRenamed("source", "_source"), BROADCAST_SOURCES)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = done.join(side, F.col("source").eqNullSafe(F.col("_source")))
    doc_id = F.when(~F.col("no_id"), F.col("id"))
    return out.select(doc_id.alias("doc_id"), "size", "source_size", "target", (F.col("size") * (F.floor(rate) + F.col("p").cast("long"))).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` as mixed: each row, with its own columns, as often as it is
    taken.  Null and empty texts are taken or left like others; repeated rows
    are drawn one by one; an empty table stays empty."""
    done, plan = mix(docs)
    side = small(plan.withColumnRenamed("source", "_source"), BROADCAST_SOURCES)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    times = done.join(side, F.col("source").eqNullSafe(F.col("_source"))).select("id", "no_id", "source", "h", (F.floor(rate) + F.col("p").cast("long")).alias("n"))
    times = materialise(times.groupBy("id", "no_id", "source", "h").agg(F.sum("n").alias("n"), F.count("*").alias("rows")), "times").where("n > 0")
    keys = ["id", "no_id", "source", "h"]
    side = times.select(*(F.col(c).alias(f"_{c}") for c in keys), "n", "rows")
    rows = packed(docs).select("row", *_keys(docs))
    met = rows.join(side, (F.col("id") == F.col("_id")) & (F.col("no_id") == F.col("_no_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("h") == F.col("_h")))
    once = met.where("rows = 1").union(met.where("rows > 1").dropDuplicates(keys))
    return once.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).select("row.*")
