"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are dealt to lists by nearest centroid.  Centroids, the share of lists
to probe and nothing else come from a sample of at most ``SAMPLE`` vectors; all
vectors are indexed.  Long lists are cut into blocks of about ``BLOCK`` vectors
and the queries of a list into groups of about ``GROUP``, so no task holds an
unbounded list.  In a block, vectors are rotated by a random orthogonal matrix
and laid out by columns.  A query adds up squared differences over ``COLUMNS``
columns at a time; after each step a hypothesis test drops the candidates whose
full distance, judged by the partial one, exceeds the query's bound.  What
remains is measured exactly, in double precision, on the original vectors.

The bound of a query is the distance of the ``k``-th best in its nearest list,
which is scanned first; the other lists give only what comes within it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwright.llm.shared import materialise

SAMPLE, TUNING, MAX_LISTS, ROUNDS = 32_768, 256, 1024, 8
BLOCK, GROUP, COLUMNS = 4096, 1024, 16
#: Recall that the probed lists must reach on the sample, and the width of the hypothesis test.
RECALL, EPSILON = 0.97, 2.5


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v (array of double): vectors that are neither null nor zero, hold
    no null or non-finite component and have the most frequent length (the
    smallest of several), one for each row; rows without vec_id take no part."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False)))
    rows = rows.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(good, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).count().agg(F.max_by("d", F.struct("count", -F.col("d")))).first()[0]
    return rows.where(F.size("v") == (sizes or 0))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((centres**2).sum(1) - 2 * x[i : i + 1024] @ centres.T, axis=1) for i in range(0, len(x), 1024)])


def fit(vectors: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Centroids, and how many lists a query probes, from a bounded sample (the
    vectors with the smallest hashes)."""
    x = np.stack(vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["v"].to_numpy())
    k = max(1, min(MAX_LISTS, round(n**0.5), len(x) // 16))
    rng = np.random.default_rng(7)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        own = _nearest(x, centres)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], axis=1)
        held = np.bincount(own, minlength=k)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    own, tests = _nearest(x, centres), rng.choice(len(x), min(TUNING, len(x)), replace=False)
    far = (x**2).sum(1) - 2 * x[tests] @ x.T
    far[np.arange(len(tests)), tests] = np.inf
    near = np.argpartition(far, min(10, len(x) - 1), axis=1)[:, :10]
    place = np.argsort(np.argsort((centres**2).sum(1) - 2 * x[tests] @ centres.T, axis=1), axis=1)
    wanted = np.sort(place[np.arange(len(tests))[:, None], own[near]], axis=None)
    return centres, int(wanted[min(len(wanted) - 1, int(RECALL * len(wanted)))]) + 1


def scan(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, bounds: np.ndarray, k: int, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of queries and of vectors, and their distances: for each of the
    queries ``q`` the ``k`` nearest of ``x`` that the scan finds within the
    bound of the query (squared; infinite: all), and what ties with them."""
    xr, qr, d = x @ turn, q @ turn, x.shape[1]
    first = min(COLUMNS, d)
    a, b = qr[:, :first], xr[:, :first]
    part = np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0)
    scale = 1e-9 * ((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :])  # for the rounding of the sums

    def slack(done: int) -> float:
        return (1 + EPSILON / done**0.5) ** 2 * done / d if done < d else 1 + 1e-9

    i, j = np.nonzero((part - scale <= (bounds * slack(first))[:, None]) & (qids[:, None] != ids[None, :]))
    part = part[i, j]
    for at in range(first, d, COLUMNS):
        done = min(at + COLUMNS, d)
        part = part + ((xr[j, at:done] - qr[i, at:done]) ** 2).sum(axis=1)
        stay = part <= bounds[i] * slack(done) + 1e-9
        i, j, part = i[stay], j[stay], part[stay]
    score = np.sqrt(((x[j] - q[i]) ** 2).sum(axis=1))
    order = np.lexsort((ids[j], score, i))
    i, j, score = i[order], j[order], score[order]
    # the rows of one vec_id count once
    seen = np.lexsort((score, ids[j], i))
    again = np.zeros(len(i), bool)
    again[seen[1:]] = (i[seen][1:] == i[seen][:-1]) & (ids[j][seen][1:] == ids[j][seen][:-1])
    i, j, score = i[~again], j[~again], score[~again]
    begin = np.searchsorted(i, i)
    stay = np.arange(len(i)) - begin < k
    return i[stay], j[stay], score[stay]


def search(rows: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every usable
    vector whose id is divisible by ``every``, among all others.

    Ties go to the smaller vec_id; all rows of one vec_id count as one
    candidate, the nearest, and of several under a queried vec_id the smallest
    vector asks.  An empty table gives no rows; other columns are left out.
    """
    vectors = materialise(usable(rows.select("vec_id", "embedding")), "vectors")
    n = vectors.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centres, probes = fit(vectors, n)
    turn = np.linalg.qr(np.random.default_rng(11).standard_normal((centres.shape[1],) * 2))[0]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(list=_nearest(np.stack(batch["v"].to_numpy()), centres))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.iloc[i : i + 1024]
                far = (centres**2).sum(1) - 2 * np.stack(part["v"].to_numpy()) @ centres.T
                first = np.argsort(far, axis=1, kind="stable")[:, :probes]
                yield part.assign(list=list(first))

    index = materialise(vectors.mapInPandas(assign, "vec_id long, v array<double>, list long"), "index")
    # of several vectors of one query the smallest
    asked = vectors.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    queries = materialise(asked.mapInPandas(probe, "query_id long, v array<double>, list array<long>"), "queries")
    sizes = index.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))  # one row for each of at most MAX_LISTS lists
    spread = lambda x, by: F.pmod(F.xxhash64(x), F.col(by))
    each = lambda by: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(by) - 1))

    def meet(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, qids = one["vec_id"].to_numpy(), two["query_id"].to_numpy()
        i, j, score = scan(np.stack(one["v"].to_numpy()), ids, np.stack(two["v"].to_numpy()), qids, two["bound"].to_numpy(), k, turn)
        return pd.DataFrame({"query_id": qids[i], "vec_id": ids[j], "score": score})

    def scanned(queries: DataFrame) -> DataFrame:
        """What the lists of ``queries`` (query_id, v, bound, list) give."""
        plan = materialise(queries.groupBy("list").agg(F.ceil(F.count("*") / GROUP).alias("groups")).join(sizes, "list"), "lists")
        left = index.join(F.broadcast(plan), "list").select("list", spread("vec_id", "blocks").alias("block"), each("groups").alias("group"), "vec_id", "v")
        right = queries.join(F.broadcast(plan), "list").select("list", each("blocks").alias("block"), spread("query_id", "groups").alias("group"), "query_id", "v", "bound")
        keys = ["list", "block", "group"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
        return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    nearest = materialise(best(scanned(queries.select("query_id", "v", F.lit(float("inf")).alias("bound"), F.col("list")[0].alias("list")))), "nearest")
    bounds = nearest.where(F.col("rank") == k).select("query_id", (F.col("score") * F.col("score")).alias("bound"))
    others = queries.join(bounds, "query_id", "left").select("query_id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"), F.explode(F.slice("list", 2, probes)).alias("list"))
    found = nearest.select("query_id", "vec_id", "score").union(scanned(others)).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return best(found).select("query_id", "rank", "vec_id", "score")
