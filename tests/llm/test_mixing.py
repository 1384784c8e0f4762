import numpy as np
import pytest

from boxwright.llm import mixing as m

SCHEMA = "doc_id long, text string, source string"


def plain_targets(sizes):
    """By refilling: sources above their limit stop there, the rest shares."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, full, out = 1.5 * sum(sizes.values()), set(), {}
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            return out
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            full.add(s)
            out[s] = 2.0 * sizes[s]
            left -= out[s]


def test_mix(spark):
    r = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(r.integers(0, 120))), ["a", "b", "é", "😀", "z", None][int(r.integers(0, 6))]) for i in range(1500)]
    rows += [(7, "same row here", "b")] * 5 + [(None, None, "a"), (None, "x y", "only")]
    got = m.mix_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = plain_targets(sizes)
    by = {}
    for x in got:
        assert 0 <= x.taken <= 2 * x.size and (x.size == 0 or x.taken % x.size == 0)
        by.setdefault((x.source_size, round(x.target, 6)), []).append(x)
    assert sorted(by) == sorted((sizes[s], round(t, 6)) for s, t in want.items())
    for (_, target), xs in by.items():
        assert abs(sum(x.taken for x in xs) - target) <= 3
    again = m.mix_report(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mixed_rows_follow_the_report(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 9 + 1)), "ab"[i % 2]) for i in range(80)] + [(500, "twice", "a")] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    taken = sum(r.taken for r in m.mix_report(df).collect())
    out = m.mixed(df)
    assert out.columns == df.columns and sum(len(r.text.split()) for r in out.collect()) == taken


def test_several_levels_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 20)
    df = spark.createDataFrame([(i, " ".join(["w"] * (i * 37 % 101 + 1)), "a" if i % 3 else "b") for i in range(900)], SCHEMA)
    got = m.mix_report(df).collect()
    for target in {r.target for r in got}:
        assert abs(sum(r.taken for r in got if r.target == target) - target) <= 60


@pytest.mark.parametrize("seed", range(5))
def test_flight_keeps_both_totals(seed):
    r = np.random.default_rng(seed)
    size, p = r.integers(1, 500, 400), np.full(400, 0.3)
    flown = m.flight(p, size, r, land=False)
    assert ((flown > 0) & (flown < 1)).sum() <= 2
    assert abs(flown.sum() - p.sum()) < 1e-6 and abs((flown * size).sum() - (p * size).sum()) < 1e-3
    landed = m.flight(p, size, r, land=True)
    assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - (p * size).sum()) <= 5 and abs(landed.sum() - 120) <= 6


def test_empty(spark):
    assert m.mix_report(spark.createDataFrame([], SCHEMA)).count() == 0
    only = m.mix_report(spark.createDataFrame([(1, None, None, "x"), (2, "", None, "y")], SCHEMA + ", size string")).collect()
    assert [(r.size, r.target, r.taken) for r in only] == [(0, 0, 0)] * 2
