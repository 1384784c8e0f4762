"""SentencePiece encoding and decoding as relations.

A text, with a space put before it, is cut into units wherever no piece can
reach across, judged by the two characters at a place and one more on either
side, so no piece crosses a cut.  Every
distinct unit is encoded once: its substrings of bounded length are exploded
and met with the piece table by an equi-join, the edges found are grouped by
unit, and a fold over them gives the pieces.  The fold follows the model.  For
a unigram model it keeps the best path to every position (Viterbi).  The
scores of a model trained by merges are only the order of the merges, and the
greatest sum of them is not what the model means; there the fold takes the
first edge that joins two neighbours, again and again, as the merges do.  Units
of more than ``LONGEST`` characters are walked one by one to the same result,
in time close to linear in their length.  A character without a piece is
written as its bytes.

Texts are neither shuffled nor taken apart into rows.  The units that are
frequent in a sample of the texts form a cache of bounded size, which every
executor gets; a text becomes runs of cached units, with a row each, and single
rows for its other units, and only these meet the rest of the lexicon.  What
the sample is decides how many rows are shuffled, never what comes out.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.llm.shared import let, materialise

MARK = "▁"
#: Longer units are walked; in an edge, starts and ends take 6 bits.
LONGEST, PENALTY = 60, 10.0
BROADCAST_PIECES = 1_000_000
#: The cache holds the units that are most frequent in about so many bytes of text: at most so many, of so many bytes.
SAMPLE_BYTES, CACHE_UNITS, CACHE_BYTES = 1 << 27, 1 << 18, 1 << 23
#: Distinct units in a task that makes their lattice, which has about 40 rows for each.
UNITS = 1 << 15
#: Bits of the tables of neighbours; where pairs or triples of characters share one, units are longer than they need be.
TABLE = 1 << 21
#: Characters of a text that are cut at a time, distinct units that are counted at a time, and ids of a batch of rows.
BLOCK, COUNTED, BATCH = 1 << 20, 1 << 17, 1 << 20
#: Texts go to Python in batches of so many rows and about so many bytes at most, as the JVM and Python both hold a batch outside the heap.
SENT = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 23}


@dataclass
class Pieces:
    """A model: its normal pieces in order of their scores (a piece's number is
    its place in that order), and what decoding needs."""

    spark: SparkSession
    pieces: list[str]
    ids: list[int]
    scores: list[float]  # and, last, that of a character without a piece
    ranks: list[int]  # of the scores, also with that; equal scores have one rank
    merges: bool
    bytes_at: list[int]
    hexes: list[str]

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))

    def _small(self, rows: list[tuple], schema: str) -> DataFrame:
        df = self.spark.createDataFrame(rows, schema)
        return F.broadcast(df) if len(rows) <= BROADCAST_PIECES else df

    def table(self) -> DataFrame:
        return self._small(list(zip(self.pieces, self.ids, self.ranks, strict=False)), "piece string, id int, rank int")

    def heads(self) -> DataFrame:
        """Of all pieces that begin with the same three characters, the length of the longest."""
        longest: dict[str, int] = {}
        for p in self.pieces:
            if len(p) > 2:
                longest[p[:3]] = max(len(p), longest.get(p[:3], 0))
        return self._small(list(longest.items()), "head string, most int")


def load(spark: SparkSession, path: str) -> Pieces:
    """Read a model with byte fallback from a file on the driver."""
    from sentencepiece import SentencePieceProcessor

    return from_processor(spark, SentencePieceProcessor(model_file=path))


def from_processor(spark: SparkSession, m) -> Pieces:
    """The pieces of a ``SentencePieceProcessor``."""
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    kind = ModelProto.FromString(m.serialized_model_proto()).trainer_spec.model_type
    if kind not in (1, 2):
        raise ValueError("neither a unigram model nor one trained by merges")
    ids = range(m.get_piece_size())
    byte = {int(m.id_to_piece(i)[1:-1], 16): i for i in ids if m.is_byte(i)}
    if len(byte) != 256:
        raise ValueError("the model has no byte pieces, so not every text can be encoded")
    normal = sorted((-float(m.get_score(i)), i) for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)))
    own = {i: f"{b:02X}" for b, i in byte.items()}
    hexes = [own.get(i, "" if m.is_control(i) or m.is_unknown(i) else m.id_to_piece(i).replace(MARK, " ").encode().hex().upper()) for i in ids]
    scores = [-c for c, _ in normal]
    scores.append(min(scores) - PENALTY)
    ranks = {x: k for k, x in enumerate(sorted(set(scores), reverse=True))}
    return Pieces(spark, [m.id_to_piece(i) for _, i in normal], [i for _, i in normal], scores, [ranks[x] for x in scores], kind == 2, [byte[b] for b in range(256)], hexes)


class Cutter:
    """Cuts texts into units."""

    def __init__(self, pieces: list[str]) -> None:
        chars = {c: k + 1 for k, c in enumerate(sorted({c for p in pieces for c in p}))}
        self.codes, self.many = np.zeros(0x110000, np.int32), len(chars) + 1
        self.codes[[ord(c) for c in chars]] = list(chars.values())
        self.codes[32], self.codes[ord(MARK)] = chars.get(MARK, 0), 0
        # pairs that pieces hold, pairs that are pieces, and triples that pieces hold
        self.pairs, self.whole, self.triples = (np.zeros(TABLE, bool) for _ in range(3))
        for p in pieces:
            c = [chars[x] for x in p]
            for i in range(len(c) - 1):
                pair = c[i] * self.many + c[i + 1]
                self.pairs[pair % TABLE] = True
                self.whole[pair % TABLE] |= len(c) == 2
                if i + 2 < len(c):
                    self.triples[(pair * self.many + c[i + 2]) % TABLE] = True

    def units(self, text: str) -> list[str]:
        """The units of a text that is not empty."""
        s, cuts = " " + text, [0]
        for at in range(0, len(s), BLOCK):
            # one character more on the left, two on the right; the code 0 stands for none
            codes = np.zeros(min(BLOCK, len(s) - at) + 3, np.int64)
            part = s[max(0, at - 1) : at + BLOCK + 2]
            first = 1 if at == 0 else 0
            own = self.codes[np.frombuffer(part.encode("utf-32-le"), np.uint32)]
            codes[first : first + len(own)] = own[: len(codes) - first]
            pairs = codes[:-1] * self.many + codes[1:]
            triples = self.triples[(pairs[:-1] * self.many + codes[2:]) % TABLE]
            here, a, b = pairs[1:-1] % TABLE, codes[1:-2], codes[2:-1]
            joined = (a > 0) & (b > 0) & self.pairs[here] & (self.whole[here] | triples[:-1] | triples[1:])
            n = min(BLOCK, len(s) - at - 1)
            cuts += (np.flatnonzero(~joined[:n]) + (at + 1)).tolist()
        return [s[i:j] for i, j in zip(cuts, [*cuts[1:], len(s)], strict=True)]


def best_path(s: str, places: dict[str, int], scores: list[float], longest: int) -> list[tuple[int, int]]:
    """(end, place) of the pieces on the path of greatest total score; of equal
    paths to a position the one whose last piece is longest."""
    unknown = len(scores) - 1
    best, starts, taken = np.zeros(len(s) + 1), np.zeros(len(s) + 1, np.int64), np.zeros(len(s) + 1, np.int64)
    for end in range(1, len(s) + 1):
        top, at, piece = float("-inf"), end - 1, unknown
        for start in range(max(0, end - longest), end):
            k = places.get(s[start:end], unknown if start == end - 1 else None)
            if k is not None and best[start] + scores[k] > top:
                top, at, piece = best[start] + scores[k], start, k
        best[end], starts[end], taken[end] = top, at, piece
    out, end = [], len(s)
    while end:
        out.append((end, int(taken[end])))
        end = int(starts[end])
    return out[::-1]


def merged(s: str, places: dict[str, int], ranks: list[int]) -> list[tuple[int, int]]:
    """(end, place) of the pieces left by merging the neighbours that make the
    piece of the first rank, the leftmost of several, until none do."""
    n, unknown = len(s), len(places)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int, to: int) -> None:
        if (k := places.get(s[i:to])) is not None:
            heapq.heappush(heap, (ranks[k], i, to))

    for i in range(n - 1):
        offer(i, i + 2)

    while heap:
        _, i, to = heapq.heappop(heap)
        if (middle := end[i]) >= to or middle < 0 or end[middle] != to:
            continue  # one of the two has been merged meanwhile
        end[i], end[middle] = to, -1
        if to < n:
            before[to] = i
            offer(i, end[to])
        if before[i] >= 0:
            offer(before[i], to)
    out, i = [], 0
    while i < n:
        out.append((end[i], places.get(s[i : end[i]], unknown)))
        i = end[i]
    return out


def walked(unit: str, places: dict[str, int], pieces: Pieces | dict) -> list[int]:
    """The ids of one unit."""
    p = pieces if isinstance(pieces, dict) else plain_parts(pieces)
    s = unit.replace(" ", MARK) if unit != MARK else "\n"  # neither mark nor line feed has a piece
    found = merged(s, places, p["ranks"]) if p["merges"] else best_path(s, places, p["scores"], p["longest"])
    unknown = len(p["ids"])
    return [i for end, k in found for i in ([p["ids"][k]] if k < unknown else [p["bytes_at"][b] for b in unit[end - 1].encode()])]


def plain_parts(pieces: Pieces) -> dict:
    """What ``walked`` needs, without the session."""
    return {"merges": pieces.merges, "scores": pieces.scores, "ranks": pieces.ranks, "longest": pieces.longest, "ids": pieces.ids, "bytes_at": pieces.bytes_at}


def _long_lexicon(units: DataFrame, pieces: Pieces) -> DataFrame:
    parts, places = plain_parts(pieces), {p: k for k, p in enumerate(pieces.pieces)}
    table = [bytes.fromhex(h) for h in pieces.hexes]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for unit in batch["unit"]:
                ids = walked(unit, places, parts)
                yield pd.DataFrame({"unit": [unit], "ids": [ids], "exact": [_text_of(ids, table) == unit]})

    return units.mapInPandas(run, "unit string, ids array<int>, exact boolean")


def _shift(x: Column, by: int) -> Column:
    return F.shiftleft(x.cast("bigint"), by)


def _bits(x: Column, right: int, bits: int) -> Column:
    return F.shiftright(x, right).bitwiseAND((1 << bits) - 1).cast("int")


#: An edge is one number: the rank of its piece, its start, its end and the id, in so many bits; a step of a path: its start and the id.
RANK, START, ID = 24, 6, 24
#: Stands for the id of a character without a piece.
NO_PIECE = (1 << ID) - 1


def _start(edge: Column) -> Column:
    return _bits(edge, START + ID, START)


def _end(edge: Column) -> Column:
    return _bits(edge, ID, START)


def _merges(edges: Column, length: Column) -> Column:
    """The steps that merging leaves.  ``edges`` are sorted, so the first that
    joins two neighbours is the next merge; the boundaries of what has been
    merged so far are the bits of one number."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)

    def cut(e: Column) -> Column:
        start, end = _start(e), _end(e)
        return F.struct((bit(start) + bit(end)).alias("ends"), (bit(end) - bit(start + 1)).alias("within"), (_shift(start, ID) + _bits(e, 0, ID)).alias("step"))

    def fold(all_edges: Column) -> Column:
        stands = lambda bounds, e: bounds.bitwiseAND(e["ends"]) == e["ends"]

        def over(wide: Column) -> Column:
            def step(bounds: Column, _: Column) -> Column:
                first = F.filter(wide, lambda e: stands(bounds, e) & (F.bit_count(bounds.bitwiseAND(e["within"])) == 1))
                return bounds - F.coalesce(bounds.bitwiseAND(F.get(first, F.lit(0))["within"]), F.lit(0).cast("bigint"))

            single = bit(length + 1) - 1
            return F.when(F.size(wide) == 0, single).otherwise(F.aggregate(F.sequence(F.lit(1), F.least(length - 1, F.size(wide))), single, step))  # no edge merges twice

        left = lambda bounds: F.sort_array(F.transform(F.filter(all_edges, lambda e: stands(bounds, e) & (bounds.bitwiseAND(e["within"]) == 0)), lambda e: e["step"]))
        return let(let(F.filter(all_edges, lambda e: e["within"] != 0), over), left)

    return let(F.transform(edges, cut), fold)


def _best_path(edges: Column, scores: Column) -> Column:
    """The steps of the path of greatest score (``scores``: by rank).  Edges are
    taken in order of their ends, the longest of an end first."""
    by_end = F.sort_array(F.transform(edges, lambda e: _shift(_end(e), START + RANK + ID) + _shift(_start(e), RANK + ID) + _shift(_bits(e, 2 * START + ID, RANK), ID) + _bits(e, 0, ID)))
    end = lambda e: _bits(e, START + RANK + ID, START)
    start = lambda e: _bits(e, RANK + ID, START)

    def step(best: Column, e: Column) -> Column:
        score = F.get(best, start(e))["score"] + F.get(scores, _bits(e, ID, RANK))
        new = F.array(F.struct(score.alias("score"), e.alias("edge")))
        better = score > F.element_at(best, -1)["score"]
        return F.when(F.size(best) <= end(e), F.concat(best, new)).when(better, F.concat(F.slice(best, F.lit(1), F.size(best) - 1), new)).otherwise(best)

    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).cast("bigint").alias("edge")))

    def back(best: Column) -> Column:
        last = F.struct((F.size(best) - 1).alias("at"), F.array().cast("array<bigint>").alias("out"))

        def one(a: Column, i: Column) -> Column:
            e = F.get(best, i)["edge"]
            step = _shift(start(e), ID) + _bits(e, 0, ID)
            return F.when(a["at"] == i, F.struct(start(e).alias("at"), F.concat(F.array(step), a["out"]).alias("out"))).otherwise(a)

        return F.aggregate(F.sequence(F.size(best) - 1, F.lit(1)), last, one)["out"]

    return let(F.aggregate(by_end, first, step), back)


def _short_lexicon(units: DataFrame, pieces: Pieces) -> DataFrame:
    length = F.length("unit")
    marked = F.when(F.col("unit") != MARK, F.replace("unit", F.lit(" "), F.lit(MARK)))
    starts = units.withColumn("s", marked).select("unit", "s", F.explode(F.sequence(F.lit(1), length)).alias("start")).withColumn("head", F.substring("s", F.col("start"), F.lit(3)))
    # a piece of more than two characters has a head
    width = F.least(F.coalesce("most", F.lit(2)), length + 1 - F.col("start"))
    # substrings are taken after the explode, by generated code: a lambda over the lengths is interpreted
    spans = starts.join(pieces.heads(), "head", "left").select("unit", "s", "start", F.explode(F.sequence(F.lit(0), width - 1)).alias("k"))
    subs = spans.select("unit", "start", "k", F.substring("s", F.col("start"), F.col("k") + 1).alias("piece"))
    met = subs.join(pieces.table(), "piece", "left").where("id is not null or k = 0")
    edge = _shift(F.coalesce("rank", F.lit(pieces.ranks[-1])), 2 * START + ID) + _shift(F.col("start") - 1, START + ID) + _shift(F.col("start") + F.col("k"), ID) + F.coalesce("id", F.lit(NO_PIECE))
    # the hash leads the key, so that sorting compares numbers
    lattice = met.select(F.xxhash64("unit").alias("h"), "unit", edge.alias("edge")).groupBy("h", "unit").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    if pieces.merges:
        steps = _merges(F.col("edges"), length)
    else:
        scores = sorted(set(pieces.scores), reverse=True)
        steps = _best_path(F.col("edges"), F.split(F.lit(",".join(map(repr, scores))), ",").cast("array<double>"))
    at = F.array(*map(F.lit, pieces.bytes_at))

    def ids_of(step: Column) -> Column:
        raw = lambda h: F.transform(F.sequence(F.lit(0), (F.length(h) / 2).cast("int") - 1), lambda i: F.get(at, F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))
        char, own = F.substring("unit", _bits(step, ID, START) + 1, F.lit(1)), _bits(step, 0, ID)
        return F.when(own == NO_PIECE, let(F.hex(F.encode(char, "UTF-8")), raw)).otherwise(F.array(own))

    return lattice.select("unit", F.flatten(F.transform(steps, ids_of)).alias("ids"))


def lexicon(units: DataFrame, pieces: Pieces) -> DataFrame:
    """unit, ids, exact (whether decoding them gives the unit again) of the
    distinct ``units`` (unit), which have been materialised.

    No task feeds one Python worker from another: executors keep all workers
    and use them in turn, so twice as many would each grow to full size."""
    long = F.length("unit") > LONGEST
    dealt = units.where(~long).repartition(units.count() // UNITS + 1, "unit")
    short = _with_text(_short_lexicon(dealt, pieces), pieces, "unit string, ids array<int>, text string")
    return short.select("unit", "ids", (F.col("text") == F.col("unit")).alias("exact")).union(_long_lexicon(units.where(long), pieces))


def _text_of(ids: list[int], table: list[bytes]) -> str:
    return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


def _with_text(coded: DataFrame, pieces: Pieces, schema: str) -> DataFrame:
    """``coded`` with the text that its ``ids`` stand for.  The table is sent
    with the function, so that plans stay small."""
    table = [bytes.fromhex(h) for h in pieces.hexes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_text_of(x.as_py(), table) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return coded.mapInArrow(run, schema)


class Cache:
    """The ids of frequent units, sent as columns; workers make a dictionary of it."""

    def __init__(self, units: list[str], ids: np.ndarray, sizes: np.ndarray, pieces: list[str]) -> None:
        self.units, self.ids, self.sizes = units, ids, sizes
        self.pieces = pieces
        self.made: tuple[Cutter, dict[str, tuple[int, ...]]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": None}

    def ready(self) -> tuple[Cutter, dict[str, tuple[int, ...]]]:
        if not self.made:
            flat, at = self.ids.tolist(), np.concatenate([[0], np.cumsum(self.sizes)]).tolist()
            one: dict[int, int] = {}
            flat = [one.setdefault(i, i) for i in flat]
            self.made = Cutter(self.pieces), {u: tuple(flat[at[k] : at[k + 1]]) for k, u in enumerate(self.units)}
        return self.made


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Holds ``SENT`` for the plans that run meanwhile."""
    before = {k: spark.conf.get(k) for k in SENT}
    try:
        for k, v in SENT.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def counts(texts: DataFrame, pieces: Pieces) -> DataFrame:
    """unit, n of the units of ``texts`` (text)."""
    cutter = Cutter(pieces.pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        told = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["unit", "n"])
        for batch in batches:
            for text in batch.column("text"):
                seen.update(cutter.units(text.as_py()))
                if len(seen) > COUNTED:
                    yield told()
                    seen.clear()
        yield told()

    return texts.mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def cache(docs: DataFrame, pieces: Pieces) -> Cache:
    """The units most frequent in documents of about ``SAMPLE_BYTES``."""
    texts = docs.where(F.col("text") != "")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, SAMPLE_BYTES / max(total, 1))
    sample = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    with small_batches(docs.sparkSession):
        counted = materialise(counts(sample.select("text"), pieces).where("n > 1"), "units")
    # the least count with which the cache keeps within its bounds; 10,000 rows at most
    levels = counted.groupBy(F.least("n", F.lit(10_000)).alias("least")).agg(F.count("*").alias("units"), F.sum(F.octet_length("unit")).alias("bytes"))
    least, units, size = 10_001, 0, 0
    for r in sorted(levels.collect(), reverse=True):
        units, size = units + r["units"], size + r["bytes"]
        if units > CACHE_UNITS or size > CACHE_BYTES:
            break
        least = r["least"]
    held = lexicon(counted.where(F.col("n") >= least).select("unit"), pieces).where("exact").select("unit", "ids").toArrow()
    ids = held.column("ids").combine_chunks()
    return Cache(held.column("unit").to_pylist(), ids.flatten().to_numpy().astype(np.int32), ids.value_lengths().to_numpy(), pieces.pieces)


def _packed(pieces: Pieces) -> type:
    return np.uint16 if len(pieces.hexes) <= 1 << 16 else np.uint32


def _runs(docs: DataFrame, known: Cache, kind: type) -> DataFrame:
    """doc_id, h, pos, ids, unit: the rows of every text; ids are packed as
    numbers of the given ``kind``; a unit that is not in the cache has a row of
    its own, without ids."""
    sent, size = docs.sparkSession.sparkContext.broadcast(known), np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, look = sent.value.ready()
        for batch in batches:
            who, pos, ends, flat, others = [], [], [0], [], []

            def told() -> pa.RecordBatch:
                row = pa.array(who, pa.int64())
                ids = pa.Array.from_buffers(pa.binary(), len(who), [None, pa.py_buffer(np.array(ends, np.int32) * size), pa.py_buffer(np.array(flat, kind))])
                return pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("h").take(row), pa.array(pos, pa.int32()), ids, pa.array(others, pa.string())], names=["doc_id", "h", "pos", "ids", "unit"])  # noqa: B023

            for k, text in enumerate(batch.column("text")):
                text, first, begun = text.as_py(), len(who), len(flat)
                for unit in cutter.units(text) if text else ():
                    ids = look.get(unit)
                    if ids is not None:
                        flat += ids
                        continue
                    if len(flat) > begun:
                        who.append(k)
                        ends.append(len(flat))
                        others.append(None)
                        begun = len(flat)
                    who.append(k)
                    ends.append(begun)
                    others.append(unit)
                if len(flat) > begun or len(who) == first:
                    who.append(k)
                    ends.append(len(flat))
                    others.append(None)
                pos += range(len(who) - first)
                if len(flat) > BATCH:
                    yield told()
                    who, pos, ends, flat, others = [], [], [0], [], []
            yield told()

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(run, "doc_id long, h long, pos int, ids binary, unit string")


def _unpacked(coded: DataFrame, kind: type) -> DataFrame:
    """doc_id, h, pos, ids of the rows that hold a run."""
    size = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column("ids")
            ends = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, 4 * packed.offset)
            data = np.frombuffer(packed.buffers()[2] or b"", kind, (ends[-1] - ends[0]) // size, ends[0]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array((ends - ends[0]) // size, pa.int32()), pa.array(data, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h", "pos")), ids], names=["doc_id", "h", "pos", "ids"])

    return coded.where("unit is null").select("doc_id", "h", "pos", "ids").mapInArrow(run, "doc_id long, h long, pos int, ids array<int>")


def encode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, h, pos, ids, exact: the ids of every text (doc_id, text) in parts,
    in the order of pos; ``exact`` tells whether decoding gives the part again.

    Null and empty texts have one part without ids.  Repeated rows repeat
    theirs; texts that share a doc_id, or have none, are told apart by ``h``, a
    hash of the text.  Of equal choices the longest piece, or the leftmost
    merge, is taken.  Texts of any length are encoded whole; an empty table
    gives no rows.  Other columns are left out, whatever their names.
    """
    docs = docs.select("doc_id", "text")
    kind = _packed(pieces)
    known = cache(docs, pieces)
    with small_batches(docs.sparkSession):
        coded = materialise(_runs(docs, known, kind), "coded", "zstd")
    others = coded.where("unit is not null")
    lex = materialise(lexicon(materialise(others.select("unit").distinct(), "units"), pieces), "lexicon")
    met = others.drop("ids").join(lex, "unit")
    return _unpacked(coded, kind).withColumn("exact", F.lit(True)).union(met.select("doc_id", "h", "pos", "ids", "exact"))


def gathered(encoded: DataFrame) -> DataFrame:
    """doc_id, h, ids, exact: the whole sequence of every text, as often as the
    text was encoded."""
    # a text that was encoded several times has its parts once in the set
    whole = encoded.groupBy("doc_id", "h").agg(F.sum((F.col("pos") == 0).cast("bigint")).alias("n"), F.sort_array(F.collect_set(F.struct("pos", "ids"))).alias("parts"), F.min("exact").alias("exact"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    return whole.select("doc_id", "h", ids.alias("ids"), "exact", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).drop("col")


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, h, text of ``encoded``: the exact texts that were encoded, as
    often as they were (null ones are empty)."""
    whole = _with_text(gathered(encoded).select("doc_id", "h", "ids"), pieces, "doc_id long, h long, ids array<int>, text string")
    return whole.select("doc_id", "h", F.substring("text", F.lit(2), F.length("text")).alias("text"))
