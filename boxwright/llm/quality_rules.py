"""Quality rules with adaptive thresholds.

Fixed rules reject a text with fewer than ``MIN_WORDS`` words or with more than
``REPEAT_PERCENT`` per cent of its words in repeated windows.  Every other text
is held against thresholds learnt from the corpus itself: per language and
source, each measure is summarised in a quantile sketch, counts in ``TOP`` bins
of fixed width ``WIDTH`` and, above these, in bins of fixed relative width
without an upper end.  Such sketches merge by addition, so they are combined
before the shuffle, and those of small groups give way to
the merged sketch of their language, or of the whole corpus.  Texts beyond
``FENCE`` quartile distances from the quartiles are rejected.

Everything is a DataFrame expression; the documents are never shuffled while
the thresholds have at most ``BROADCAST_ROWS`` rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm.shared import SPACE, let, materialise, packed, small, words

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Bins of a sketch; those of larger values are each wider than the one before by a share of 1 / TOP.
WIDTH, TOP = 5, 1000
FENCE, MIN_DOCS, BROADCAST_ROWS = 3, 50, 100_000
#: Measure: the smallest quartile distance that counts, and whether low values are rejected too.
MEASURES = {"marks": (33, False), "length": (50, True), "lines": (200, False), "echoes": (33, False)}
SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[!?#*$%&|<>=+~^@_{}\[\]/\\]"


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _repeated(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more, from word hashes."""
    windows = F.when(
        F.size(hashes) > WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(w: Column) -> Column:
        def spread(s: Column) -> Column:
            again = F.filter(s, lambda p, i: F.coalesce(p["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(p["h"] == F.get(s, i + 1)["h"], F.lit(False)))
            at = F.sort_array(F.transform(again, lambda p: p["i"]))
            return let(at, lambda q: F.aggregate(F.transform(q, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(q, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x))

        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(ordered, spread))

    return let(windows, covered).cast("long")


def measured(docs: DataFrame, repeats: bool = True) -> DataFrame:
    """``docs`` with a struct ``_m`` of what the rules need.

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words as in the
    fixed rules (the last only if ``repeats``), and the adaptive measures:
    marks and echoes (words equal to the one before) per 1,000 words, mean
    word length in hundredths, repeated lines per 1,000.  A null text counts
    as an empty one; measures of a text without words are null.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def of(w: Column) -> Column:
        def lines_of(lines: Column) -> Column:
            n, chars = F.size(w).cast("long"), F.length(F.array_join(w, "")).cast("long")
            dup = (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

            def of_hashes(h: Column) -> Column:
                echo = F.size(F.filter(h, lambda x, i: F.coalesce(x == F.get(h, i - 1), F.lit(False)))).cast("long")
                rate = lambda x, y: F.when(y > 0, F.floor(x / y)).cast("long")
                return F.struct(
                    n.alias("n_words"), chars.alias("word_chars"), _count(text, SYMBOLS).cast("long").alias("n_symbols"), dup.alias("n_dup_lines"),
                    (_repeated(h) if repeats else F.lit(0).cast("long")).alias("n_repeat_words"),
                    rate(_count(text, MARKS).cast("long") * 1000, n).alias("marks"), rate(chars * 100, n).alias("length"),
                    rate(dup * 1000, F.size(lines).cast("long")).alias("lines"), rate(echo * 1000, n).alias("echoes"),
                )

            return let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes)

        return let(F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACE.replace("[", "[^"))), lines_of)

    return docs.withColumn("_m", let(words(F.col("text")), of))


def _bin(value: Column) -> Column:
    above = TOP + F.floor(F.log(value / (WIDTH * TOP)) / math.log1p(1 / TOP))
    return F.when(value < WIDTH * TOP, F.floor(value / WIDTH)).otherwise(above).cast("int")


def _edge(b: Column, upper: bool = False) -> Column:
    """The lower edge of a bin; of wide ones the upper edge if ``upper``, so that fences leave out no value of the bin."""
    above = F.pow(F.lit(1 + 1 / TOP), b - TOP + int(upper)) * (WIDTH * TOP)
    return F.when(b <= TOP, b * WIDTH).otherwise((F.ceil if upper else F.floor)(above)).cast("long")


def sketches(docs: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: the mergeable sketches of all documents."""
    pairs = F.array(*(F.struct(F.lit(k).alias("measure"), _bin(F.col(f"_m.{k}")).alias("bin")) for k in MEASURES))
    rows = measured(docs.select("lang", "source", "text"), repeats=False).where("_m.n_words > 0")
    rows = rows.select("lang", "source", F.explode(pairs).alias("p")).select("lang", "source", "p.*")
    return rows.groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source and, per measure, ``<measure>_lo`` and ``<measure>_hi``.

    Each group takes the first of its own sketch, its language's and the whole
    corpus's that holds ``MIN_DOCS`` documents (the last one in any case).
    """
    levels = []
    for depth, keys in enumerate(([], ["lang"], ["lang", "source"])):
        merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
        ordered = ", ".join([*keys, "measure"])
        ranked = merged.withColumns({
            "upto": F.expr(f"sum(n) over (partition by {ordered} order by bin)"),
            "total": F.expr(f"sum(n) over (partition by {ordered})"),
        })
        at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bin")))
        levels.append(ranked.groupBy(*keys, "measure").agg(_edge(at(1)).alias(f"q1_{depth}"), _edge(at(3), upper=True).alias(f"q3_{depth}"), F.max("total").alias(f"n_{depth}")))
    own = levels[2]
    joined = own.join(levels[1].withColumnRenamed("lang", "_lang").withColumnRenamed("measure", "_measure"), own["lang"].eqNullSafe(F.col("_lang")) & (own["measure"] == F.col("_measure"))).drop("_lang", "_measure")
    joined = joined.join(levels[0], "measure")
    pick = lambda q: F.when(F.col("n_2") >= MIN_DOCS, F.col(f"{q}_2")).when(F.col("n_1") >= MIN_DOCS, F.col(f"{q}_1")).otherwise(F.col(f"{q}_0"))
    joined = joined.select("lang", "source", "measure", pick("q1").alias("q1"), pick("q3").alias("q3"))
    out = []
    for k, (least, both) in MEASURES.items():
        reach = FENCE * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        of = lambda x: F.max(F.when(F.col("measure") == k, x))  # noqa: B023, E731
        out += [of(F.col("q1") - reach if both else F.lit(None)).cast("long").alias(f"{k}_lo"), of(F.col("q3") + reach).cast("long").alias(f"{k}_hi")]
    return joined.groupBy("lang", "source").agg(*out)


def judge(docs: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``_m``, ``_base_failed`` and ``_kept``.

    Needs text, lang and source; other columns and their names do not matter
    (names that begin with an underscore excepted).  Null and empty texts fail
    the fixed rules.  Repeated rows are judged alike.
    """
    if limits is None:
        limits = small(materialise(thresholds(sketches(docs)), "thresholds"), BROADCAST_ROWS)
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.struct(*(F.col(c) for c in limits.columns[2:])).alias("_t"))
    m = F.col("_m")
    base = (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * REPEAT_PERCENT)
    beyond = F.lit(False)
    for k, (_, both) in MEASURES.items():
        beyond = beyond | F.coalesce(m[k] > F.col(f"_t.{k}_hi"), F.lit(False))
        if both:
            beyond = beyond | F.coalesce(m[k] < F.col(f"_t.{k}_lo"), F.lit(False))
    held = measured(docs).join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return held.withColumn("_base_failed", base).withColumn("_kept", ~base & ~beyond).drop("_lang", "_source", "_t")


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: the counts of the fixed rules and both verdicts."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    held = judge(docs.select("doc_id", "text", "lang", "source"))
    return held.select("doc_id", *(F.col(f"_m.{k}").alias(k) for k in names), F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    rows = packed(docs).select("row", *(F.col(f"row.{c}").alias(c) for c in ("text", "lang", "source")))
    return judge(rows).where("_kept").select("row.*")
