import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boxwright.llm import quality_rules as q


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = {k for k, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, x in enumerate(windows) if x in often for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, text string, lang string, source string"


def report(spark, texts):
    return q.quality_report(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], SCHEMA)).collect()


TEXTS = [None, "", " \n\t", "one", "a b c d e f g h " * 2, "x " * 30, "a b c d e f g h i a b c d e f g h", "l1\nl1\n \nl2\nl1", "é# *ü|<>", " ".join(map(str, range(5000))), "\x0b a\x1cb  c", "ab " * 20_000]


def test_counts(spark):
    for r in report(spark, TEXTS):
        want = plain(TEXTS[r.doc_id])
        assert tuple(r[c] for c in COUNTS) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "\n", "#"]), max_size=60).map(" ".join), min_size=1, max_size=20))
def test_counts_of_any_text(spark, texts):
    for r in report(spark, texts):
        assert tuple(r[c] for c in COUNTS) == plain(texts[r.doc_id])


def words(n, seed, end=""):
    return " ".join(f"w{(i * 7919 + seed * 104729) % 99991}{end}" for i in range(n))


def test_thresholds_adapt_to_groups(spark):
    clean = [(i, words(60, i), "en", "web") for i in range(200)]
    marked = [(1000 + i, words(60, i, "##"), "en", "code") for i in range(200)]
    odd = [(5000, words(60, 5, "##"), "en", "web"), (5001, words(60, 6), "en", "web"), (5002, words(60, 7, "##"), "en", "new"), (5003, words(60, 8), None, None)]
    df = spark.createDataFrame(clean + marked + odd, SCHEMA)
    kept = {r.doc_id: r.kept for r in q.quality_report(df).collect()}
    assert all(kept[r[0]] for r in clean)
    assert all(kept[r[0]] for r in marked)  # usual in their own source
    assert not kept[5000] and kept[5001] and kept[5003]
    assert {r.doc_id for r in q.keep_good(df).collect()} == {k for k, v in kept.items() if v}


def test_sketches_merge(spark):
    df = spark.createDataFrame([(i, words(30 + i % 50, i), "en", f"s{i % 3}") for i in range(300)], SCHEMA)
    whole = {tuple(r)[:4]: r.n for r in q.sketches(df).collect()}
    parts = Counter()
    for half in (df.where("doc_id < 100"), df.where("doc_id >= 100")):
        parts.update({tuple(r)[:4]: r.n for r in q.sketches(half).collect()})
    assert whole == dict(parts)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)] * 3])
def test_empty_and_null(spark, rows):
    got = q.quality_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and not any(r.kept for r in got)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, words(50, 1), "en", "s", 7, True)], SCHEMA + ", n_words int, kept boolean")
    assert q.keep_good(df).columns == df.columns
    assert q.quality_report(df).first().n_words == 50


def test_groups_of_large_values(spark):
    long = lambda i, n: " ".join("語" * n + str(i * 100 + k) for k in range(25))
    marked = lambda i, n: " ".join(f"w{i * 100 + k}" + "|" * n for k in range(25))
    rows = [(i, long(i, 60 + i % 40), "ja", "web") for i in range(100)] + [(100 + i, long(i, 3000), "th", "web") for i in range(60)] + [(200 + i, marked(i, 6 + i % 5), "en", "tables") for i in range(100)]
    odd = [(900, long(9, 2000), "ja", "web"), (901, marked(9, 200), "en", "tables"), (902, long(9, 30_000), "th", "web"), (903, words(60, 3), "th", "web")]
    kept = {r.doc_id: r.kept for r in q.quality_report(spark.createDataFrame(rows + odd, SCHEMA)).collect()}
    assert all(kept[r[0]] for r in rows) and not any(kept[r[0]] for r in odd)
