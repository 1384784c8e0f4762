"""URL filters that see through redirects and canonical links.

Rules name a host and the beginning of a path.  A url takes the verdict of the
longest rule that fits it.  A url without a rule takes the verdict of its
aliases, the urls connected with it by redirects or canonical links: allowed if
a rule allows one of them, else blocked if a rule blocks one, else allowed.
Aliases are the connected components of the link graph, found by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm.shared import components, materialise, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES_SCHEMA = "verdict string, host string, path string"
#: More rules than this are joined by shuffle.
BROADCAST_RULES = 100_000
#: What a comment holds is no markup; the name of an attribute has white space or a quote before it.
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
TAGS = r"<(?:[Ll][Ii][Nn][Kk]|[Mm][Ee][Tt][Aa])\s[^>]*>"
CANONICAL = r"""[\s"'][Rr][Ee][Ll]\s*=\s*["']?[Cc][Aa][Nn][Oo][Nn][Ii][Cc][Aa][Ll]\b"""
HREF = r"""[\s"'][Hh][Rr][Ee][Ff]\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""[\s"'][Hh][Tt][Tt][Pp]-[Ee][Qq][Uu][Ii][Vv]\s*=\s*["']?[Rr][Ee][Ff][Rr][Ee][Ss][Hh]\b"""
TARGET = r"""[Uu][Rr][Ll]\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """Between the first :// and the next of / ? #, A-Z lowered; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _without_dots(path: Column) -> Column:
    """A path without its . and .. segments."""
    step = lambda a, s: F.when(s == "..", F.regexp_replace(a, "/[^/]*$", "")).when(s == ".", a).otherwise(F.concat(a, F.lit("/"), s))
    parts = F.split(path, "/")
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.lit(""), step)
    return F.when(path.contains("/."), F.concat(kept, F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(path)


def key_of(url: Column) -> Column:
    """What makes two urls the same page: host, path (/ if empty, . and ..
    followed) and query; null without a host."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*[^?#]*(\?[^#]*)", 1)
    path = _without_dots(path_of(url))
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(path == "", F.lit("/")).otherwise(path), query))


def _resolved(href: Column, url: Column) -> Column:
    href = F.replace(href, F.lit("&amp;"), F.lit("&"))
    site = F.concat(F.lit("http://"), host_of(url))
    folder = F.regexp_replace(path_of(url), "[^/]*$", "")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.lit("http:"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("#"), url)
        .when(href.startswith("?"), F.concat(site, path_of(url), href))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """a, b: the keys of pages and of what their canonical links and refreshes name."""
    tags = pages.select("url", F.explode(F.regexp_extract_all(F.regexp_replace(F.coalesce("html", F.lit("")), COMMENT, " "), F.lit(TAGS), 0)).alias("tag"))
    href = F.when(F.col("tag").rlike(CANONICAL), F.regexp_extract("tag", HREF, 1)).when(F.col("tag").rlike(REFRESH), F.regexp_extract("tag", TARGET, 1))
    found = tags.select("url", href.alias("href")).where("href <> ''")
    return found.select(key_of(F.col("url")).alias("a"), key_of(_resolved(F.col("href"), F.col("url"))).alias("b")).where("a <> b")


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, verdict of those distinct ``places(host, path)`` that a
    rule fits: rules meet the suffixes of the host by equi-join."""
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    suffixes = places.where("host <> ''").distinct().select("host", "path", F.explode(ends).alias("_end"))
    r = rules.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.concat("host", "path").alias("rule"), "verdict")
    fits = suffixes.join(small(r, BROADCAST_RULES), (F.col("_end") == F.col("_host")) & F.col("path").startswith(F.col("_path")))
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "rule", "verdict"))
    return fits.groupBy("host", "path").agg(best.alias("r")).select("host", "path", "r.*")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id,
    url, html).

    A url that is null or has no :// has empty host and path, no rule and no
    aliases, and is allowed; a null html has no links.  Of equally long rules
    that fit, the one whose text comes last counts, then block.  Repeated rows
    stay; an empty table gives no rows, and without rules all is allowed.
    Other columns are left out.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key_of(F.col("url")).alias("key"))
    alias = materialise(components(materialise(link_edges(pages), "links"), "aliases"), "alias")
    ends = alias.select("node", "component", F.regexp_extract("node", "^([^/?]*)", 1).alias("host"), F.regexp_extract("node", r"^[^/?]*([^?]*)", 1).alias("path"))
    ruled = materialise(match_rules(rows.select("host", "path").union(ends.select("host", "path")), rules), "ruled")
    is_ = lambda v: F.max(F.when(F.col("verdict") == v, 1)).alias(v)
    groups = ends.join(ruled, ["host", "path"]).groupBy("component").agg(is_("allow"), is_("block"))
    via = alias.join(groups, "component").select(F.col("node").alias("key"), F.when(F.col("allow") == 1, "allow").otherwise("block").alias("via"))
    out = rows.join(ruled, ["host", "path"], "left").join(via, "key", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "via", F.lit("allow")).alias("verdict"))
