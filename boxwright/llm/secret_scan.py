"""Secret scans by linking the parts of credentials.

Three strong patterns are reported wherever they stand.  Weak candidates
(identifiers, bare keys, service addresses) are common in clean text, so they
are reported only when parts that complement each other co-occur: a locator
(identifier or address) within ``SCOPE`` code points of a secret, in the same
document.  That is an interval join: both sides are dealt into cells of
``SCOPE`` code points and met by an equi-join on document and cell, as a semi-
join, so no pairs are emitted and a cell holds no more candidates than fit into
its ``SCOPE`` characters.

Everything is a DataFrame expression.  Texts are read once and never shuffled;
only the spans are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm.shared import let, materialise, packed, small

SCOPE = 240
#: Linked spans up to this number are sent to all executors, more are joined by shuffle.
BROADCAST_SPANS = 500_000
#: In the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")


def _either(word: str) -> str:
    """Letters in either case, spelt out: regex engines differ on case folding beyond ASCII."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _assigned(names: list[str], value: str) -> str:
    return f"(?:{'|'.join(map(_either, names))})" + r"""["']?\x20*[:=]\x20*["']?""" + value


#: Kind: pattern, the least length of its value (its group 1 if it has one).  Runs that are matched whole carry
#: their least length in the pattern itself; an assignment must be matched first and dropped then, as what a
#: failing one covers is not searched again.
STRONG = {
    "assign": (_assigned(["password", "passwd", "secret", "token", "api_?key"], "([A-Za-z0-9+/_.=-]+)"), 8),
    "access": ("(AKIA[A-Z0-9]{12,})", 16),
    "hex": ("([0-9a-f]{32,})", 32),
}
WEAK = {
    "id": (_assigned(["access_?key_?id", "client_?id", "account_?id", "user_?name", "login"], "([A-Za-z0-9@._-]+)"), 4),
    "key": ("([A-Za-z0-9+/]{40,})", 40),
    "endpoint": (r"((?:https?|jdbc:[a-z]+|postgresql|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9@:%._/?=&+-]+|[A-Za-z0-9.-]{1,99}\.amazonaws\.com)", 8),
}
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, kind: str, pattern: str, least: int) -> Column:
    """All spans of a kind, leftmost first.  Offsets are sums of the lengths of
    the matches and of what lies between them."""

    def of(found: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(a: Column, x: Column) -> Column:
            begin = a["at"] + F.length(x["gap"])
            end = begin + F.length(x["all"])
            good = F.length(x["value"]) >= least
            if kind == "key":
                for some in ("[A-Z]", "[a-z]", "[0-9]"):
                    good = good & x["value"].rlike(some)
            span = F.array(F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(good, F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

        parts = F.arrays_zip(F.slice(F.split(text, pattern), 1, F.size(found)).alias("gap"), found.alias("all"), F.regexp_extract_all(text, F.lit(pattern), 1).alias("value"))
        return F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(F.aggregate(parts, start, step)["out"])

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), of)


def _all(text: Column, patterns: dict) -> Column:
    return F.sort_array(F.concat(*(_spans(text, k, *v) for k, v in patterns.items())))


def _is(kinds: tuple[str, ...], span: Column) -> Column:
    return span["kind"].isin([KINDS.index(k) for k in kinds])


LOCATORS, SECRETS = ("access", "id", "endpoint"), ("assign", "hex", "key")


def link_weak(digest: DataFrame) -> DataFrame:
    """doc_id, h, linked: the weak spans of a document that have a complement.

    ``digest`` has doc_id, h (hash of the text), strong and weak (spans).
    """
    rows = digest.where(F.size("weak") > 0).select("doc_id", "h", F.explode(F.concat("strong", "weak")).alias("s")).distinct()
    rows = rows.select(F.struct("doc_id", "h").alias("d"), "s")

    def side(kinds: tuple[str, ...], reach: int, name: str) -> DataFrame:
        cells = F.sequence(F.floor((F.col("s.start") - reach) / SCOPE), F.floor((F.col("s.end") + reach) / SCOPE))
        return rows.where(_is(kinds, F.col("s"))).select(F.col("d").alias(f"{name}_d"), F.col("s").alias(name), F.explode(cells).alias(f"{name}_cell"))

    found = []
    for own, other, reach in ((LOCATORS, SECRETS, 0), (SECRETS, LOCATORS, SCOPE)):
        a, b = side(own, reach, "a"), side(other, SCOPE - reach, "b")
        near = (F.col("a.start") <= F.col("b.end") + SCOPE) & (F.col("a.end") >= F.col("b.start") - SCOPE)
        met = a.where(F.col("a.kind") >= len(STRONG)).join(b, F.col("a_d").eqNullSafe(F.col("b_d")) & (F.col("a_cell") == F.col("b_cell")) & near, "left_semi")
        found.append(met.select("a_d.doc_id", "a_d.h", "a"))
    return found[0].union(found[1]).groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("a")).alias("linked"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, h, strong, weak of every row; a null text counts as an empty one.

    A weak candidate that overlaps a strong span is none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    apart = lambda w, strong: ~F.exists(strong, lambda s: (s["start"] < w["end"]) & (s["end"] > w["start"]))
    weak = let(_all(text, STRONG), lambda s: F.struct(s.alias("strong"), F.filter(_all(text, WEAK), lambda w: apart(w, s)).alias("weak")))
    return docs.select("doc_id", F.xxhash64(text).alias("h"), weak.alias("s")).select("doc_id", "h", "s.*")


def _listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts and spans.

    Null or empty texts have no spans.  Rows with one doc_id and one text get
    one and the same result; rows without doc_id are judged like others.
    An empty table gives no rows; other columns are left out.
    """
    d = materialise(digests(docs), "secrets")
    linked = link_weak(d).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "linked")
    d = d.join(linked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    count = lambda k: F.size(F.filter("strong", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    spans = F.when(F.col("linked").isNull(), F.col("strong")).otherwise(F.sort_array(F.concat("strong", "linked")))
    return d.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in STRONG), F.sha2(_listed(F.col("strong")), 256).alias("base_sha256"), _listed(spans).alias("spans")
    )


def mask_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with ``mark`` in place of every span (overlapping ones become
    one) and n_chars, where there is such a column, counted anew.

    Null texts stay null; texts without spans stay as they are.  Repeated rows
    stay and are masked alike, rows without doc_id like others; an empty table
    stays empty.  Other columns keep their values, whatever their names.
    """
    d = materialise(digests(docs).where(F.size("weak") > 0), "secrets")
    linked = small(materialise(link_weak(d), "linked"), BROADCAST_SPANS, F.size("linked"))
    text = F.col("row.text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        upto = F.when(s["start"] >= a["at"], F.concat(a["out"], text.substr(a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), upto.alias("out"))

    end = lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text)))
    spans = F.sort_array(F.concat(_all(text, STRONG), F.coalesce(F.col("linked"), F.array().cast(SPAN))))
    masked = let(spans, lambda s: F.when(F.size(s) > 0, F.aggregate(s, start, step, end)).otherwise(text))
    met = packed(docs).join(linked, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("h")), "left")
    out = met.select("row", masked.alias("masked"))
    new = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("masked").cast(docs.schema["n_chars"].dataType)
    return out.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))
