"""Near-duplicate detection with SetSketch registers.

A document's set holds its distinct shingles of ``SHINGLE`` words.  Equal sets
form a class first, so exact copies cost one grouped minimum.  Every class gets
a SetSketch: ``REGISTERS`` registers, each the minimum of a hash over the
set, turned into an exponential variable and truncated to a grid of powers of
``BASE``.  Registers of a union are the maxima of the registers.

Classes that agree on a band of registers are candidates.  In a first round
every member of a band's bucket is held against the bucket's smallest member
only, so large groups of near copies cost one pair each; a pair is dropped
without reading the sets if the sizes exclude it or, in buckets of more than
two, the likelihood of its registers.  A second round takes the buckets that still hold several
components and finds the remaining links across these exactly, by an equi-join
on the rarest shingles.  All links are confirmed on the full sets.  Components
come from joins (``shared.components``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwright.llm.shared import components, materialise, packed, small, spread_join

SHINGLE, PERCENT = 5, 85
REGISTERS = 96
#: A pair at the threshold may agree on no band with this probability at most.
MISSED = 1e-7
#: Parameters of the sketch, and how many standard errors below the threshold an estimate drops a pair.
BASE, RATE, LIMIT = 1.001, 20.0, 65534
ERRORS = 4.6
#: Ids up to this number are sent to all executors, more are joined by shuffle.
BROADCAST_IDS = 1_000_000
BLOCK = 1 << 18

U64 = np.uint64
_mixer = np.random.default_rng(20240613)
_BYTES = _mixer.integers(1, 1 << 63, 256, dtype=U64)
_KEYS = _mixer.integers(1, 1 << 63, SHINGLE, dtype=U64) | U64(1)
_SEEDS = (_mixer.integers(1, 1 << 63, REGISTERS, dtype=U64) | U64(1))[:, None]
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def band_rows(percent: int) -> int:
    """Registers of a band: as many as ``MISSED`` allows."""
    return max((r for r in range(1, 9) if REGISTERS % r == 0 and (1 - (percent / 100) ** r) ** (REGISTERS // r) <= MISSED), default=1)


def prune(percent: int) -> float:
    """The similarity below which an estimate drops a pair."""
    return int(percent - 100 * ERRORS * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5) / 100


PRUNE = prune(PERCENT)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    up = down = np.zeros(0, U64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, p, U64)])) for p in (_PRIME, _INVERSE))
        return cls.up, cls.down


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words in ``data`` (UTF-8)."""
    low = _LOWER[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[low], [True]])))
    start, end = edge[::2], edge[1::2]
    up, down = _Powers.upto(len(data))
    total = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTES[low] * up[: len(data)])])
    return _mixed((total[end] - total[start]) * down[start] + (end - start).astype(U64)), start


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, word hashes of a part of it); long texts come in
    several parts, cut between words."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > BLOCK:
            data, at = np.frombuffer(texts[i], np.uint8), 0
            gaps = np.flatnonzero(_SPACE[data])
            while at < len(data):
                k = np.searchsorted(gaps, at + BLOCK)
                to = int(gaps[k]) if k < len(gaps) else len(data)
                yield i, _word_hashes(data[at:to])[0]
                at = to
            i += 1
            continue
        size, j = 0, i
        while j < len(texts) and (size == 0 or size + len(texts[j]) < BLOCK) and len(texts[j]) <= BLOCK:
            size += len(texts[j]) + 1
            j += 1
        hashes, start = _word_hashes(np.frombuffer(b"\n".join(texts[i:j]), np.uint8))
        first = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts[i:j])]))
        for k in range(i, j):
            yield k, hashes[first[k - i] : first[k - i + 1]]
        i = j


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    parts: dict[int, list[np.ndarray]] = {}
    done = 0

    def finish(k: int) -> np.ndarray:
        own = parts.pop(k, [])
        w = own[0] if len(own) == 1 else np.concatenate(own) if own else np.zeros(0, U64)
        n = len(w)
        if n == 0:
            return w
        if n < SHINGLE:
            return _mixed(np.array([(w * _KEYS[:n]).sum() + U64(n)], U64))
        s = sum(w[j : n - SHINGLE + 1 + j] * _KEYS[j] for j in range(SHINGLE))
        return np.unique(_mixed(s))

    for k, w in _blocks([(t or "").encode("utf-8", "replace") for t in texts]):
        while done < k:
            yield finish(done)
            done += 1
        parts.setdefault(k, []).append(w)
    while done < len(texts):
        yield finish(done)
        done += 1


def registers(shingles: np.ndarray) -> np.ndarray:
    """The SetSketch of a set that is not empty."""
    least = np.full(len(_SEEDS), (1 << 64) - 1, U64)
    for at in range(0, len(shingles), 1024):
        x = shingles[None, at : at + 1024] * _SEEDS
        x ^= x >> U64(29)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(32)
        np.minimum(least, x.min(axis=1), out=least)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def likely(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float = PRUNE) -> np.ndarray:
    """Whether the similarity of greatest likelihood is ``least`` or more.

    The likelihood of the counts of registers that are larger, smaller and
    equal is concave in the similarity, so its slope at ``least`` tells.
    """
    more, less = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    same = ra.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    part = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-x * part) / np.log(BASE)
    slope = lambda x: part / np.log(BASE) / (1 - x * part)
    up, down = np.maximum(u - v * least, 1e-9), np.maximum(v - u * least, 1e-9)
    return same * (v * slope(up) + u * slope(down)) / (1 - p(up) - p(down)) >= more * v * slope(up) / p(up) + less * u * slope(down) / p(down)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), h1 and h2 (hash of the set), regs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for s in shingle_sets(batch["text"].tolist()):
                h1, h2 = (int(_mixed(s * U64(k) + U64(k)).sum().astype(np.int64)) for k in (3, 5)) if len(s) else (0, 0)
                rows.append((len(s), h1, h2, registers(s).tobytes() if len(s) else b""))
            out = pd.DataFrame(rows, columns=["n", "h1", "h2", "regs"])
            yield pd.concat([batch[["id", "no_id"]].reset_index(drop=True), out], axis=1)

    # pandas has no null integers; a flag keeps the ids exact
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text")
    rows = named.mapInPandas(run, "id long, no_id boolean, n long, h1 long, h2 long, regs binary")
    return rows.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "n", "h1", "h2", "regs")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, set (a hash), shingles of those documents that ``nodes`` names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch["text"].tolist())]
            yield pd.DataFrame({"node": batch["node"], "set": [int(s.sum()) for s in sets], "shingles": sets})

    wanted = small(nodes, BROADCAST_IDS).select(F.col("node").alias("_node"))
    return docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(wanted, F.col("node") == F.col("_node"), "left_semi").mapInPandas(run, "node long, set long, shingles array<long>")


def _plausible(pairs: DataFrame, percent: int) -> DataFrame:
    """a, b of those pairs (a, b, alone, na, nb, ra, rb) that sizes and, unless
    they are ``alone``, registers allow."""
    least = prune(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ra, rb = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(len(batch), -1) for c in ("ra", "rb"))
            yield batch.loc[batch["alone"].to_numpy(bool) | likely(ra, rb, batch["na"].to_numpy(float), batch["nb"].to_numpy(float), least), ["a", "b"]]

    fit = pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return fit.select("a", "b", "alone", "na", "nb", "ra", "rb").mapInPandas(run, "a long, b long")


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full ``sets`` are similar enough."""
    of = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    rows = spread_join(pairs.join(of("b"), "b"), of("a"), "a", "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return rows.where(F.col("both") * 100 >= (F.size("sa") + F.size("sb") - F.col("both")) * percent).select("a", "b").distinct()


def _across(sets: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """a, b: all pairs across components (``comps``: node, comp) that can be
    similar enough, and few others.

    With shingles in order of frequency, similar sets share one among their
    rarest; its place in both bounds what they can share after it.  A shingle's
    largest component is not held against itself.
    """
    tokens = sets.select("node", "set", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    shared = tokens.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    place = F.row_number().over(Window.partitionBy("node", "set").orderBy(F.coalesce("df", F.lit(1)), "s"))
    upto = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    first = tokens.join(shared, "s", "left").withColumn("i", place).where((F.col("i") <= upto) & F.col("df").isNotNull())
    first = materialise(first.join(comps, "node").select("s", "node", "comp", "n", "i"), "prefixes")
    main = first.groupBy("s", "comp").agg(F.count("*").alias("k")).groupBy("s").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    first = materialise(first.join(main.select("s", "main"), "s"), "prefixes")
    x = first.where("comp <> main").select("s", *(F.col(c).alias(f"{c}_a") for c in ("node", "comp", "n", "i")))
    y = first.select("s", "main", *(F.col(c).alias(f"{c}_b") for c in ("node", "comp", "n", "i")))
    rest = 1 + F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))
    enough = rest * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    once = (F.col("comp_b") == F.col("main")) | (F.col("node_a") < F.col("node_b"))
    return x.join(y, "s").where((F.col("comp_a") != F.col("comp_b")) & once & enough).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _without_repeats(docs: DataFrame, named: DataFrame) -> DataFrame:
    """``docs`` with equal rows once; only documents with several rows are
    shuffled for it."""
    twice = materialise(named.groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id"), "twice")
    if not twice.limit(1).count():
        return docs
    twice = small(twice, BROADCAST_IDS)
    docs = docs.select("doc_id", "text")
    several = docs.join(twice, docs["doc_id"] == F.col("_id"), "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(twice, docs["doc_id"] == F.col("_id"), "left_anti").union(several)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id,
    text); sets are linked whose similarity is ``percent`` per cent or more.

    Null and empty texts have an empty set and are linked with nothing.  Rows
    without doc_id are linked with nothing, have no component and are kept.
    Rows with one doc_id count as one document.  An empty table gives no rows;
    other columns are left out, whatever their names.
    """
    docs = docs.select("doc_id", "text")
    sk = materialise(sketch(docs), "sketches")
    named = sk.where("n > 0 and doc_id is not null")
    docs = _without_repeats(docs, named)
    classes = named.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "n", "regs")).alias("c"))
    nodes = materialise(classes.select("h1", "h2", F.col("c.doc_id").alias("node"), "c.n", "c.regs"), "classes")
    rows = band_rows(percent)
    keys = F.array(*(F.xxhash64(F.lit(k), F.substring("regs", 2 * rows * k + 1, 2 * rows)) for k in range(REGISTERS // rows)))
    buckets = nodes.select(F.explode(keys).alias("key"), "node")
    heads = buckets.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1")
    members = materialise(buckets.join(heads, "key"), "buckets")

    of = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    # the second round passes over buckets of two, so no estimate may drop their only pair
    stars = members.where("node <> head").groupBy(F.col("head").alias("a"), F.col("node").alias("b")).agg((F.min("size") == 2).alias("alone"))
    stars = materialise(_plausible(spread_join(stars.join(of("b"), "b"), of("a"), "a", "b"), percent), "stars")
    sets = materialise(_sets(docs, materialise(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")), "sets")
    found = materialise(components(materialise(_confirmed(sets, stars, percent), "links")), "components")

    # Buckets of two have had their only pair, on the full sets.
    held = members.where("size > 2").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    mixed = held.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    held = materialise(held.join(mixed, "key").select("node", "comp").distinct(), "mixed")
    sets = materialise(_sets(docs, held.select("node")), "sets")
    more = materialise(_confirmed(sets, materialise(_across(sets, held, percent), "across"), percent), "links")
    if more.limit(1).count():
        found = materialise(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "components")

    whole = nodes.join(found, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component_id"))
    out = sk.join(whole, ["h1", "h2"], "left")
    own = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one
    with the smallest doc_id (and one row of it).  Documents without words or
    without doc_id stay; other columns keep their values, whatever their names."""
    seen = materialise(near_duplicates(docs, percent), "near")
    gone = small(materialise(seen.where("not kept").select(F.col("doc_id").alias("_id")).distinct(), "gone"), BROADCAST_IDS)
    twice = small(materialise(seen.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).count().where("count > 1"), "twice"), BROADCAST_IDS)
    stay = packed(docs).join(gone, F.col("row.doc_id") == F.col("_id"), "left_anti")
    one = stay.join(twice, F.col("row.doc_id") == F.col("_id"), "left_anti")
    several = stay.join(twice, F.col("row.doc_id") == F.col("_id"), "left_semi").withColumn("doc_id", F.col("row.doc_id"))
    return one.union(several.dropDuplicates(["doc_id"]).select("row")).select("row.*")
