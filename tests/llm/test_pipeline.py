import re
from pathlib import Path

import pytest

from boxwright.llm import near_dup, quality_rules, secret_scan

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the standard tables")


def kept_by_brute_force(rows, percent):
    """The smallest doc_id of each group, all pairs of sets compared."""
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate({k: k + 32 for k in range(65, 91)}))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    low = {k: k for k in sets}

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {k for k in low if low[k] == k}


def test_stages(spark, tmp_path):
    from sentencepiece import SentencePieceProcessor

    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["quality rules", "near duplicates", "secret scan", "source mixing", "sentence pieces"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, []
    for name, stage in c.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held.append(docs)
    good, single, masked, mixed, coded = held
    assert all(d.columns == columns for d in held[:-1])
    report = quality_rules.quality_report(spark.read.parquet(f"{SF}/documents.parquet"))
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    assert ids(good) == ids(report.where("kept"))
    assert ids(single) == ids(near_dup.near_duplicates(good, c.NEAR_PERCENT).where("kept")) and c.NEAR_PERCENT == 80
    assert set(ids(single)) == kept_by_brute_force(good.collect(), 80)
    assert ids(masked) == ids(single)
    assert secret_scan.secret_report(masked).where("n_assign + n_access + n_hex > 0").count() == 0
    assert masked.where("text like '%[SECRET]%'").count() == secret_scan.secret_report(single).where("spans <> ''").count()
    assert coded.columns == ["doc_id", "h", "ids", "exact"] and coded.where("not exact").count() == 0
    library = SentencePieceProcessor(model_file=c.PIECE_MODEL)
    assert sorted((r.doc_id, list(r.ids)) for r in coded.collect()) == sorted((r.doc_id, library.encode(r.text)) for r in mixed.collect())
    assert mixed.count() > mixed.select("doc_id").distinct().count()
