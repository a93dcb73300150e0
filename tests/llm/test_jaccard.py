import random
import resource

import numpy as np
import pytest

from auditspark.llm import jaccard

from .conftest import collected


def shingles(text):
    words = bytes(text or "", "utf-8").lower().split()
    return {b" ".join(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else ({b" ".join(words)} if words else set())


def brute(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    key = lambda d: (d is None, d or 0)
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, (True, 1 << 62)), key(d))
    out = []
    for i, (d, _) in enumerate(rows):
        none, least_id = least[find(i)]
        out.append((d, len(sets[i]), None if none else least_id))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    rows, base = [], []
    for _ in range(12):
        base.append([rnd.choice(vocabulary) for _ in range(rnd.randint(20, 150))])
    for k in range(150):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        if rnd.random() < 0.3:
            words += passage
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(docs, seed):
    rows = corpus(seed) + [(900, None), (901, ""), (902, "two words"), (903, "TWO words"), (904, "two words x"), (905, " \n")]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs(rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_large_groups_are_compared_in_blocks(docs, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(jaccard.links, "__defaults__", (7,))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs(rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_repeated_and_missing_ids(docs):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "x y z"), (3, "x y z"), (4, "q r s t")]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs(rows)).collect()]
    assert sorted(got, key=str) == brute(rows)
    kept = [r for r in collected(jaccard.representatives(docs(rows)), "doc_id")]
    assert [(r["doc_id"], r["text"]) for r in kept] == [(1, "a b c d e"), (3, "x y z"), (4, "q r s t")]
    assert set(kept[0]) == {"doc_id", "text", "lang", "source", "n_chars", "chunk", "t"}


def test_works_on_a_table_that_is_not_in_files(spark):
    df = spark.range(6).selectExpr("id as doc_id", "concat('same words all over ', cast(id % 2 as string)) as text")
    assert sorted(r["component_id"] for r in jaccard.join(df).collect()) == [0, 0, 0, 1, 1, 1]


def test_empty_table(docs):
    assert jaccard.join(docs([])).collect() == []
    assert jaccard.representatives(docs([])).collect() == []


def test_blocks_are_bounded_in_shingles(docs, monkeypatch):
    rows = corpus(6)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 500)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs(rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_memory_of_a_group_of_long_texts():
    """1024 sets of 1500 shingles of their own and 500 common ones: dense rows of them took 6 GB."""
    rnd = np.random.default_rng(1)
    common = rnd.integers(0, 1 << 62, 500).astype(np.uint64)
    sets = [np.sort(np.r_[common, rnd.integers(0, 4_000_000, 1500).astype(np.uint64)]) for _ in range(1024)]
    prefixes = [None, *([s[:20] for s in sets] for _ in jaccard.ORDERS[1:])]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    jaccard.compare([bytes([k >> 8, k & 255]) for k in range(1024)], sets, prefixes, np.zeros(1024, int), 9, 10)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400 << 10
