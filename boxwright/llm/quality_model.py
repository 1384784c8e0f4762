"""A quality classifier learnt from preference pairs (Bradley-Terry).

Each pair holds a labelled good and a labelled bad document; the weights
minimise the logistic loss of the difference of their features, so the score of
a document is the logarithm of its strength.  The scores are cut at the
quantile that the share of bad documents in the sample gives, and squeezed to
0..1 around it.  Features come from the text alone and are computed for every
document in one pass without a shuffle.  The model is fitted on at most
``LABELLED`` labelled documents (those with the smallest hashes of doc_id).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELLED, PAIRS, STEPS = 20_000, 30_000, 12
EDGES, PENALTY = 12, 1.0

_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "high": bytes(range(128, 256)), "stop": b".,;:",
    "bang": b"!?", "mark": b"#*$%&", "bar": b"|<>", "bracket": b"()[]{}", "other": b"@=+~^_/\\\"'`-",
}
_CLASS = np.zeros((256, len(_CLASSES)))
for _k, _v in enumerate(_CLASSES.values()):
    _CLASS[list(_v), _k] = 1


def features(text: str | None) -> list[float]:
    """Lengths, repetition and the mix of characters of one text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    w = text.split()
    n = len(w)
    rows = [x for x in text.split("\n") if x.strip()]
    sizes = np.fromiter(map(len, w), float, n)
    solid = max(1, len(raw) - int(counts[[32, 9, 10, 11, 12, 13]].sum()))
    echo = sum(a == b for a, b in zip(w, w[1:], strict=False))
    bigrams = len(set(zip(w, w[1:], strict=False)))
    share = counts[counts > 0] / max(1, len(raw))
    return [
        np.log1p(n), sizes.mean() if n else 0.0, sizes.std() if n else 0.0, sizes.max() if n else 0.0,
        len(set(w)) / max(1, n), np.log1p(len(set(w))) / np.log(n + 2), echo / max(1, n), bigrams / max(1, n - 1),
        np.log1p(len(rows)), n / max(1, len(rows)), 1 - len(set(rows)) / max(1, len(rows)),
        sum(x.rstrip()[-1:] in ".!?" for x in rows) / max(1, len(rows)), sum(x[:1].isupper() for x in w) / max(1, n),
        float(-(share * np.log(share)).sum()), len(zlib.compress(raw, 1)) / (len(raw) + 32), *(counts @ _CLASS / solid),
    ]


@dataclass
class Ranker:
    """Weights over features and whether they exceed the edges; the cut."""

    middle: np.ndarray
    scale: np.ndarray
    edges: list[np.ndarray]
    weights: np.ndarray
    cut: float = 0.0
    width: float = 1.0

    def spread(self, x: np.ndarray) -> np.ndarray:
        over = [x[:, [j]] > e[None, :] for j, e in enumerate(self.edges)]
        return np.concatenate([np.clip((x - self.middle) / self.scale, -4, 4), *over], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.spread(x) @ self.weights - self.cut) / self.width, -35, 35)))


def fit(x: np.ndarray, good: np.ndarray) -> Ranker | None:
    """None where there is no pair, that is, unless both labels occur."""
    if good.all() or not good.any():
        return None
    rng = np.random.default_rng(3)
    edges = [np.unique(np.quantile(np.concatenate([x[good, j], x[~good, j]] + [x[~good, j]] * 3), np.linspace(0.04, 0.96, EDGES))) for j in range(x.shape[1])]
    model = Ranker(np.median(x, axis=0), x.std(axis=0) + 1e-9, edges, np.zeros(0))
    z = model.spread(x)
    one, two = np.flatnonzero(good), np.flatnonzero(~good)
    diff = z[rng.choice(one, PAIRS)] - z[rng.choice(two, PAIRS)]
    w = np.zeros(z.shape[1])
    for _ in range(STEPS):  # Newton's method
        p = 1 / (1 + np.exp(np.clip(diff @ w, -35, 35)))
        slope = diff.T @ p - PENALTY * w
        w = w + np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff + PENALTY * np.eye(len(w)), slope)
    model.weights = w
    s = z @ w
    model.cut = float(np.quantile(s, (~good).mean()))
    # the cut lies in the middle of the gap between its neighbours
    above, below = s[s > model.cut], s[s <= model.cut]
    if len(above) and len(below):
        model.cut = float((above.min() + below.max()) / 2)
    model.width = float(max(1e-6, (s[good].mean() - s[~good].mean()) / 6))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 3 == 1, F.lit(False))


def _featured(rows: DataFrame, extra: str) -> DataFrame:
    """The features ``x`` of rows with text; ``extra``: the other columns and their types."""
    names = [c.split()[0] for c in extra.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[names].assign(x=[features(t) for t in batch["text"]])

    return rows.select(*names, "text").mapInPandas(run, f"{extra}, x array<double>")


def learn(docs: DataFrame, labels: DataFrame) -> Ranker | None:
    """Fit on ``labels`` (doc_id, quality) of documents that are not held out;
    documents whose labels contradict each other or are null teach nothing."""
    known = labels.where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z")
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(LABELLED).select("_id", F.col("y").cast("int").alias("y"))
    held = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    rows = _featured(held.select(F.col("_id").cast("long").alias("id"), "y", F.xxhash64("text").alias("h"), "text"), "id long, y int, h long")
    one = rows.groupBy("id").agg(F.min(F.struct("h", "y", "x")).alias("r")).select("id", "r.y", "r.x")  # of several texts, that of the smallest hash
    found = one.toPandas().sort_values("id")  # LABELLED rows at most, in an order that does not depend on the input's
    return fit(np.stack(found["x"].to_numpy()), found["y"].to_numpy() == 1) if len(found) else None


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text).

    Null texts are scored as empty ones.  Rows without doc_id are not held
    out.  Where no pair can be learnt from, every score is 0.5.  A score equal
    to the cut counts as good.  Repeated rows are scored alike, long texts
    whole; an empty table gives no rows; other columns are left out.
    """
    model = learn(docs, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.array([features(t) for t in batch["text"]])
                yield batch[["id", "no_id"]].assign(score=model.score(x) if model else 0.5)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text")
    out = rows.mapInPandas(run, "id long, no_id boolean, score double").withColumn("doc_id", F.when(~F.col("no_id"), F.col("id")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
