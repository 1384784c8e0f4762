import random
import re

import numpy as np
import pytest

from boxwright.llm import near_dup as n

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain(rows):
    sets = [plain_set(t) for _, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                root[y] = x
    return {d: (len(s), find(d), find(d) == d) for (d, _), s in zip(rows, sets, strict=True)}


def text(r, n_words):
    return [f"w{r.randrange(10**6)}" for _ in range(n_words)]


def edited(r, words, k):
    words = list(words)
    for i in r.sample(range(len(words)), k):
        words[i] = f"e{r.randrange(10**9)}"
    return words


def corpus(seed):
    r = random.Random(seed)
    rows = [" ".join(text(r, r.choice([1, 3, 5, 40, 200]))) for _ in range(60)]
    for _ in range(4):  # groups of exact and near copies, some of which link through others only
        base = text(r, 150)
        rows += [" ".join(base)] * 5 + [" ".join(edited(r, base, r.choice([1, 2, 3, 4, 6]))) for _ in range(40)]
    base = text(r, 120)
    for _ in range(25):  # a chain
        base = edited(r, base, 1)
        rows.append(" ".join(base).upper())
    r.shuffle(rows)
    return list(enumerate(rows)) + [(9001, None), (9002, ""), (9003, " \n"), (9004, "One two"), (9005, "one  TWO"), (9006, "É é"), (9007, "é é")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: tuple(r)[1:] for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain(rows)


def test_long_texts_cut_into_blocks(monkeypatch):
    r = random.Random(3)
    long = " ".join(text(r, 3000))
    whole = [s.tolist() for s in n.shingle_sets([long, None, "a b", long + " end"])]
    monkeypatch.setattr(n, "BLOCK", 1000)
    assert [s.tolist() for s in n.shingle_sets([long, None, "a b", long + " end"])] == whole
    assert len(whole[0]) == len(plain_set(long)) and whole[1] == []


def test_registers_merge_and_tell_similarity():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 1 << 63, 800, dtype=np.uint64), r.integers(0, 1 << 63, 800, dtype=np.uint64)
    assert (n.merged(n.registers(a), n.registers(b)) == n.registers(np.concatenate([a, b]))).all()
    for share, said in ((0.97, True), (0.3, False)):
        k = int(800 * share)
        c = np.concatenate([a[:k], b[k:]])
        assert n.likely(n.registers(a)[None], n.registers(c)[None], np.array([800.0]), np.array([800.0]))[0] == said


def test_nulls_repeats_and_keeping(spark):
    long = " ".join(text(random.Random(5), 60))
    rows = [(5, long, "x"), (5, long, "x"), (3, long, "y"), (None, long, "z"), (None, None, "z"), (7, "short text", "z"), (2**60 + 1, "other words here", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((tuple(r) for r in n.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(5, 56, 3, False)] * 2 + [(3, 56, 3, True), (None, 56, None, True), (None, 0, None, True), (7, 1, 7, True), (2**60 + 1, 1, 2**60 + 1, True)], key=repr)
    kept = n.keep_one(df)
    assert kept.columns == df.columns and sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, [3, None, None, 7, 2**60 + 1]))
    assert n.near_duplicates(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (7, "quite another text it is")], "doc_id long, text string")
    assert n.keep_one(twice.where("text like 'a%'")).count() == 1
    assert {r.component_id for r in n.near_duplicates(twice).collect()} == {7}


def test_pipeline_stage_links_from_80_per_cent(spark):
    import corpus_pipeline as c

    r = random.Random(11)
    rows = []
    for k in (1, 2, 3, 4, 5, 6):  # single pairs on either side of both thresholds
        for _ in range(12):
            base = text(r, r.choice([90, 130, 200]))
            rows += [" ".join(base), " ".join(edited(r, base, k))]
    rows = list(enumerate(rows))
    sets = [plain_set(t) for _, t in rows]
    alike = [(len(a & b), len(a | b)) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    gone = [2 * i + 1 for i, (both, either) in enumerate(alike) if 100 * both >= 80 * either]
    assert any(80 * either <= 100 * both < 85 * either for both, either in alike)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in c.one_of_each(spark, docs, "").collect()) == sorted({d for d, _ in rows} - set(gone))
    assert (n.band_rows(85), n.PRUNE) == (4, 0.68) and (n.band_rows(80), n.prune(80)) == (3, 0.61)


def test_no_estimate_drops_the_only_pair_of_a_bucket(spark, monkeypatch):
    r = random.Random(13)
    rows = []
    for _ in range(20):
        base = text(r, 200)
        rows += [" ".join(base), " ".join(edited(r, base, 2))]
    rows = list(enumerate(rows))
    monkeypatch.setattr(n, "ERRORS", -3)  # the estimate drops nearly all of these pairs
    got = {x.doc_id: tuple(x)[1:] for x in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain(rows)
