"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines (one per block element).  A line weighs as many
characters as it has outside links, nothing if it stands in an element that
announces furniture (menus, adverts, forms, comments and the like), and
``BONUS`` more in an article element.  The weights are summed over sliding
windows of ``WINDOW`` lines, which do not reach across the edge of an article.
Text surges where a window reaches ``SURGE`` and dives where one is empty or an
article begins or ends; all lines that weigh something between a surge and the
next dive are kept.  If nothing surges, the lines in articles are kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WINDOW, SURGE, BONUS = 3, 60, 20

# Elements by their role.
RAW = "script|style|noscript|template|iframe|svg|canvas|object|textarea|select|title|math|audio|video"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul caption".split()
)
FURNITURE = frozenset("head nav header footer aside form button menu dialog fieldset label search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role that announce furniture, and those that do so for an article element too.
NAMES = frozenset(
    "nav navigation navbar menu menubar header masthead topbar footer sidebar aside complementary ad ads advert adverts advertisement advertising "
    "sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations teaser breadcrumb "
    "breadcrumbs pagination pager toolbar widget contentinfo search searchbox".split()
)
ARTICLE_NAMES = frozenset("comment comments reply replies teaser related recommended promo promoted ad advert advertisement sponsored".split())
WHOLE = frozenset("html body main".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<raw>{RAW})\b(?:\"[^\"]*\"|'[^']*'|[^\"'<>])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^\"'<>])*)>",
    re.S | re.I,
)
NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?<![\w-])(?:hidden(?=[\s/]|$|=)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)


def _furniture(tag: str, attrs: str) -> bool:
    if tag in WHOLE:
        return False
    if tag in FURNITURE:
        return True
    if not attrs:
        return False
    if HIDDEN.search(attrs):
        return True
    names = {w for found in NAMED.findall(attrs) for w in re.split(r"[^a-z0-9]+", "".join(found).lower())}
    return not names.isdisjoint(ARTICLE_NAMES if tag == "article" else NAMES)


def lines(page: str) -> tuple[list[tuple[str, int, bool]], bool]:
    """(text, characters outside links, in an article) of every line that is
    not furniture ('' stands for a furniture line), and whether there is an
    article element with text."""
    out: list[tuple[str, int, bool]] = []
    open_tags: list[tuple[str, bool]] = []
    opened: Counter[str] = Counter()  # open elements by tag, and furniture among them
    furniture: Counter[str] = Counter()
    dull = links = articles = headings = 0
    parts: list[str] = []
    plain = 0
    was_dull = within = False

    def flush() -> None:
        nonlocal parts, plain, was_dull
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, plain, within))
        elif was_dull:
            out.append(("", 0, False))
        parts, plain, was_dull = [], 0, False

    def leave(tag: str, is_dull: bool) -> None:
        nonlocal dull, links, articles, headings
        opened[tag] -= 1
        furniture[tag] -= is_dull
        dull -= is_dull
        links -= tag == "a"
        articles -= tag in ("article", "main")
        headings -= tag in HEADINGS

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            raw = page[at : m.start()]
            title = headings and articles and dull == 1 and furniture["header"]
            if dull and not title:
                was_dull = was_dull or not raw.isspace()
            else:
                text = html.unescape(raw) if "&" in raw else raw
                parts.append(text)
                within = articles > 0
                if not links:
                    plain += len("".join(text.split()))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "td", "th"):
            parts.append(" ")
        if m["close"]:
            if opened[tag]:
                while True:
                    t, d = open_tags.pop()
                    leave(t, d)
                    if t == tag:
                        break
        elif tag not in VOID and not m["attrs"].endswith("/"):
            if tag in BLOCKS and opened["p"] and dull == furniture["p"]:
                while opened["p"]:  # a block ends an open paragraph and what is open in it
                    leave(*open_tags.pop())
            is_dull = _furniture(tag, m["attrs"])
            open_tags.append((tag, is_dull))
            opened[tag] += 1
            furniture[tag] += is_dull
            dull += is_dull
            links += tag == "a"
            articles += tag in ("article", "main")
            headings += tag in HEADINGS
    if at < len(page):
        rest = page[at:]
        if not dull:
            text = html.unescape(rest)
            parts.append(text)
            within = articles > 0
            plain += len("".join(text.split()))
    flush()
    return out, any(inside for _, _, inside in out)


def main_text(page: str | None) -> str:
    """The kept lines, joined by line feeds; empty for null or if nothing
    surges and there is no article."""
    if not page:
        return ""
    found, _ = lines(page)
    stretches: list[list[tuple[str, int]]] = []
    before = None
    for text, n, within in found:
        if text and within != before:
            stretches.append([])
            before = within
        if stretches:
            stretches[-1].append((text, n + BONUS * within if text else 0))
    kept = []
    for stretch in stretches:
        inside = False
        for i, (text, weight) in enumerate(stretch):
            window = sum(w for _, w in stretch[i : i + WINDOW])
            inside = window >= SURGE or inside and window > 0
            if inside and weight:
                kept.append(text)
    return "\n".join(kept or [text for text, _, within in found if within])


@F.pandas_udf(StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    Null and empty pages, and those without a surge or an article, give an
    empty text.  Long pages are read whole, in time linear in their length.
    Repeated rows stay; other columns are left out; an empty table gives no
    rows.
    """
    return pages.select("page_id", "url", _main_text(F.coalesce("html", F.lit(""))).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
