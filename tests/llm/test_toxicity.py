import random
import zlib

import numpy as np
import pytest

from auditspark.llm import toxicity

BAD = ["scoundrel", "blockhead", "numskull", "dimwit", "rapscallion"]


def corpus(seed, n=900):
    rnd = random.Random(seed)
    syllables = ["ta", "ren", "lo", "mi", "sha", "ve", "dor", "ing", "est", "qua", "pel"]
    words = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(500)]
    docs, labels = [], []
    for k in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        toxic = int(rnd.random() < 0.3)
        for _ in range(rnd.randint(2, 4) * toxic):
            text.insert(rnd.randrange(len(text)), rnd.choice(BAD) + rnd.choice(["", ",", "."]))
        docs.append((k, " ".join(text)))
        labels.append((k, 1, toxic))
    return docs, labels


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def held_out(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


def test_held_out_accuracy(docs, labels):
    rows, known = corpus(1)
    df = docs(rows + [(2000, None), (2001, ""), (2001, "repeated id"), (None, "no id")])
    model = toxicity.fit(df, labels(known + [(5000, 1, 1), (None, 1, 1), (3, None, None)]))
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    truth = {d: t for d, _, t in known}
    held = [r for r in got if r["doc_id"] in truth and r["held_out"]]
    assert all(r["held_out"] == held_out(r["doc_id"]) for r in got if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    empty = {r["score"] for r in got if r["doc_id"] in (2000,)} | {r["score"] for r in got if r["doc_id"] == 2001}
    assert all(s < 0.5 for s in empty)
    kept = toxicity.accepted(df, model)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(
        r["doc_id"] for r in got if r["predicted"] == 0 and r["doc_id"] is not None
    )


def test_labels_of_held_out_rows_are_not_used(docs, labels):
    rows, known = corpus(2, 400)
    df = docs(rows)
    flipped = [(d, q, 1 - t if held_out(d) else t) for d, q, t in known]
    assert toxicity.fit(df, labels(known)) == toxicity.fit(df, labels(flipped))


def test_without_labels_or_rows(docs, labels):
    df = docs([(1, "text"), (2, "more")])
    for known in ([], [(1, 1, 0)], [(1, 1, 1), (2, 1, 1)]):
        model = toxicity.fit(df, labels(known))
        assert {r["score"] for r in toxicity.score(df, model).collect()} == {0.0}
        assert toxicity.accepted(df, model).count() == 2
    none = docs([])
    assert toxicity.score(none, toxicity.fit(none, labels([]))).collect() == []


def test_longest_parts():
    assert toxicity.longest([("trash ", 9), ("tras", 9), ("stemm", 20), ("stem", 40), ("stemmed ", 5)]) == [b"trash ", b"stemm", b"stem", b"stemmed "]
