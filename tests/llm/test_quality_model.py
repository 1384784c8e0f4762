import random
import zlib

import numpy as np

from boxwright.llm import quality_model as q


def data(n):
    r = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(5, 80))]
        good = r.random() < 0.7
        if not good:
            words = r.choice([lambda w: [x + "###" for x in w], lambda w: [x for x in w for _ in range(6)], lambda w: [x.upper() + "!!" for x in w]])(words)
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_rows(spark):
    docs, labels = data(600)
    docs += [(None, "some text", "en", "s"), (10_000, None, None, None), (10_001, "", "en", "s"), docs[0]]
    known = labels[:500] + [(3, 1 - labels[3][1], 0), (4, None, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score string")
    lab = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    got = q.classify(d, lab).collect()
    assert len(got) == len(docs)
    truth = dict((i, y) for i, y, _ in labels)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, *_ in docs if i is not None and zlib.crc32(str(i).encode()) % 3 == 1}
    tested = [r for r in held if r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    # labels of held-out documents teach nothing
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y, t) for i, y, t in labels[:500]]
    same = q.classify(d, spark.createDataFrame(turned + known[500:], lab.schema)).collect()
    assert [r.score for r in same] == [r.score for r in got]


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in q.classify(d, lab).collect()] == [0.5, 0.5]
    assert q.fit(np.zeros((3, 2)), np.array([True] * 3)) is None
    assert q.classify(d.limit(0), lab).count() == 0


def test_features_of_odd_texts():
    for text in (None, "", " ", "\n\n", "x" * 300_000, "é😀", "a b " * 50_000):
        assert np.isfinite(q.features(text)).all()
