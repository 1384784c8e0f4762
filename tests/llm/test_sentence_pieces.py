import random
import string
from pathlib import Path

import pytest

from boxwright.llm import sentence_pieces as s
from boxwright.llm.queries import PIECE_MODEL

pytestmark = pytest.mark.skipif(not Path(PIECE_MODEL).exists(), reason="needs a piece model")
SF = "/root/testdata/sf0.001"
TEXTS = [
    (1, " lead  two   spaces\n\n▁mark 漢字 😀 tab\tend "), (2, None), (3, ""), (4, "x" * 1000 + " 漢" * 300), (5, "a"), (5, "a"), (None, "Hello the world, hello.\n"),
    (6, "Être où, çà là " * 20), (7, " " * 61 + "a" * 59 + " " + "b" * 60 + "information we have" + "=" * 200), (8, "<0x41></s><unk> ▁▁ a"),
]


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PIECE_MODEL)


@pytest.fixture(scope="module")
def pieces(spark):
    return s.load(spark, PIECE_MODEL)


@pytest.fixture(scope="module")
def unigram():
    """The library with the same pieces as a unigram model."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    m = ModelProto.FromString(Path(PIECE_MODEL).read_bytes())
    m.trainer_spec.model_type = 1
    r = random.Random(3)
    for i, p in enumerate(m.pieces):
        if p.type == 1:
            p.score = -5 - 8 * (i / len(m.pieces)) ** 0.5 - r.random() / 8
    return SentencePieceProcessor(model_proto=m.SerializeToString())


def rows(df):
    return sorted(map(repr, df.collect()))


def literal_marks(text):
    """The library takes a piece mark in a text for a space; here it stays what it is."""
    return "▁" in text


def held_against(docs, pieces, library):
    """Ids are equal, or for best paths as good: the library chooses otherwise among equal ones."""
    coded = s.encode(docs, pieces).cache()
    want = {(r.doc_id, r.text or "") for r in docs.collect()}
    got = [(r.doc_id, r.text) for r in s.decode(coded, pieces).collect()]
    assert sorted(map(repr, got)) == sorted(repr((r.doc_id, r.text or "")) for r in docs.collect())
    assert coded.where("not exact").count() == 0
    ids = {(r.doc_id, r.h): list(r.ids) for r in s.gathered(coded).collect()}
    texts = {(r.doc_id, r.h): r.text for r in s.decode(coded, pieces).collect()}
    assert len(ids) == len(want)
    score = dict(zip(pieces.ids, pieces.scores, strict=False))
    for k, text in texts.items():
        if not literal_marks(text):
            other = library.encode(text)
            total = lambda x: sum(score.get(i, pieces.scores[-1]) for i in x)
            assert ids[k] == other or not pieces.merges and len(ids[k]) == len(other) and total(ids[k]) == pytest.approx(total(other)), text[:200]


def test_ids_are_those_of_the_library(spark, pieces, library):
    assert pieces.merges
    held_against(spark.createDataFrame(TEXTS, "doc_id long, text string"), pieces, library)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the standard tables")
def test_ids_of_the_standard_documents(spark, pieces, library):
    held_against(spark.read.parquet(f"{SF}/documents.parquet"), pieces, library)


def test_best_paths_of_a_unigram_model(spark, unigram, monkeypatch):
    pieces = s.from_processor(spark, unigram)
    assert not pieces.merges
    docs = spark.createDataFrame([t for t in TEXTS if t[0] != 8], "doc_id long, text string")
    held_against(docs, pieces, unigram)
    want = rows(s.gathered(s.encode(docs, pieces)))
    monkeypatch.setattr(s, "LONGEST", 4)  # more units are walked
    assert rows(s.gathered(s.encode(docs, pieces))) == want


def test_literal_marks_are_bytes(spark, pieces):
    docs = spark.createDataFrame([(1, "▁a"), (2, " a")], "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in s.gathered(s.encode(docs, pieces)).collect()}
    assert [pieces.hexes[i] for i in got[1][1:4]] == ["E2", "96", "81"] and got[1] != got[2]


@pytest.mark.parametrize("names", [{"CACHE_UNITS": 0, "LONGEST": 4}, {"CACHE_UNITS": 3, "BROADCAST_PIECES": 0}, {"CACHE_BYTES": 10, "SAMPLE_BYTES": 200, "TABLE": 97}, {"BLOCK": 7, "BATCH": 5, "COUNTED": 2}])
def test_bounds_change_nothing(spark, pieces, monkeypatch, names):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    want = rows(s.gathered(s.encode(docs, pieces)))
    for k, v in names.items():
        monkeypatch.setattr(s, k, v)
    assert rows(s.gathered(s.encode(docs, pieces))) == want


def test_long_runs_are_one_unit(spark, pieces, library):
    r = random.Random(7)
    runs = ["".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(1200)) for _ in range(6)]
    runs += ["".join(r.choice("aeinorst") for _ in range(3000)), "a " + "word" * 5_000, " " * 1300 + "end", "漢字かな交じり文😀" * 150, "=" * 5000]
    assert max(map(len, s.Cutter(pieces.pieces).units(runs[7]))) > 10_000
    held_against(spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string"), pieces, library)


def test_no_python_worker_feeds_another(spark, pieces):
    units = spark.createDataFrame([(u,) for u in (" the", "a" * 70, " b" * 40 + "\ufffd", "漢" * 61)], "unit string")
    found = s.lexicon(units, pieces)

    def below(node) -> int:
        """Python nodes on the way down that meet in one task, at most."""
        kids = node.children()
        most = max((below(kids.apply(i)) for i in range(kids.size())), default=0)
        return most + int("MapIn" in node.nodeName())

    assert below(found._jdf.queryExecution().optimizedPlan()) == 1
    table = [bytes.fromhex(h) for h in pieces.hexes]
    rows = found.collect()
    assert len(rows) == 4 and all(r.exact == (b"".join(table[i] for i in r.ids).decode("utf-8", "replace") == r.unit) for r in rows)


def test_repeats_empty_tables_and_clashing_columns(spark, pieces):
    schema = "doc_id long, text string, h int, pos int, ids int, unit string, exact int, s string, start int, n int"
    docs = spark.createDataFrame([(1, "two words", *[1] * 3, "u", 1, "s", 1, 1)] * 3 + [(None, None, *[1] * 3, "u", 1, "s", 1, 1)], schema)
    coded = s.encode(docs, pieces)
    assert coded.columns == ["doc_id", "h", "pos", "ids", "exact"]
    assert sorted((r.doc_id or 0, r.text) for r in s.decode(coded, pieces).collect()) == [(0, "")] + [(1, "two words")] * 3
    empty = s.encode(docs.limit(0), pieces)
    assert empty.count() == 0 and s.decode(empty, pieces).count() == 0


def test_a_model_without_bytes_is_refused(spark, library):
    class Without:
        def get_piece_size(self):
            return 3

        def __getattr__(self, name):
            return lambda i=0: library.serialized_model_proto() if name == "serialized_model_proto" else False

    with pytest.raises(ValueError):
        s.from_processor(spark, Without())


def test_substrings_are_taken_by_generated_code(spark, pieces):
    units = spark.createDataFrame([(" information",), ("é",), (s.MARK,), (" ",)], "unit string")
    lexicon = s._short_lexicon(units, pieces)
    plan = lexicon._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "lambda" not in plan.partition("Generate")[2]
    places = {p: k for k, p in enumerate(pieces.pieces)}
    assert {r.unit: r.ids for r in lexicon.collect()} == {r.unit: s.walked(r.unit, places, pieces) for r in units.collect()}
