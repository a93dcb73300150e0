import random

import numpy as np
import pytest

from auditspark.llm import substring
from auditspark.llm.chunks import lookup, pack, pack_sorted, unpack, unpack_sorted


def brute(rows, width):
    seen, out = {}, []
    key = lambda d: (d is None, d or 0)
    for d, t in rows:
        words = (t or "").encode().split()
        for i in range(len(words) - width + 1):
            w = b" ".join(words[i : i + width])
            seen[w] = min(seen.get(w, key(d)), key(d))
    for d, t in rows:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            if seen[b" ".join(words[i : i + width])] < key(d):
                gone[i : i + width] = [True] * width
        kept = " ".join(w.decode() for w, g in zip(words, gone) if not g)
        out.append((d, len(words), sum(gone), kept))
    return sorted(out, key=str)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = ["the"] * 30 + ["of"] * 15 + ["w%d" % k for k in range(60)]
    passages = [[rnd.choice(words) for _ in range(rnd.randint(5, 40))] for _ in range(8)]
    rows = []
    for k in range(n):
        text = []
        for _ in range(rnd.randint(0, 5)):
            text += rnd.choice(passages) if rnd.random() < 0.4 else [rnd.choice(words) for _ in range(rnd.randint(1, 30))]
        rows.append((k * 7 % n, " \n".join(text)))
    return rows


@pytest.mark.parametrize("seed, width, limit", [(1, 13, 1 << 20), (2, 5, 200), (3, 3, 50), (4, 1, 10), (5, 13, 20)])
def test_equals_brute_force(docs, seed, width, limit):
    rows = corpus(seed) + [(500, None), (501, ""), (None, "the of " * 20), (502, "the of " * 20), (502, "the of " * 20)]
    got = [tuple(r) for r in substring.dedup(docs(rows), width=width, limit=limit).collect()]
    assert sorted(got, key=str) == brute(rows, width)


def test_frequent_prefixes_are_extended():
    total = np.zeros((4, 4096), np.int64)
    total[0, 7], total[0, 8], total[1, 3] = 500, 40, 60
    group, bits = substring.groups_of(total, 100)
    assert group[0, 7] == -1 and group[0, 8] >= 0 and group[1, 3] >= 0


def test_rows_keep_their_columns(docs):
    passage = " ".join("p%d" % k for k in range(20))
    rows = [(1, passage + " one", "en", "s", 5, "mine", 9), (2, "lead  in " + passage, "de", "s", 5, "yours", 8), (3, None)]
    got = {r["doc_id"]: r for r in substring.without_repeats(docs(rows)).collect()}
    assert got[1].asDict() == dict(doc_id=1, text=passage + " one", lang="en", source="s", n_chars=5, chunk="mine", t=9)
    assert got[2].asDict() == dict(doc_id=2, text="lead in", lang="de", source="s", n_chars=7, chunk="yours", t=8)
    assert got[3]["text"] is None


def test_packed_columns():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 63, 50, np.uint64))
    assert (unpack_sorted(pack_sorted(keys)) == keys).all() and (unpack(pack(keys)) == keys).all()
    checks = np.arange(50)
    twice = np.r_[keys, keys[:3]]
    order = np.argsort(twice, kind="stable")
    found = lookup(keys[:3], np.asarray([0, 77, 2]), twice[order], np.r_[checks, 77, 77, 5][order])
    assert found[0] >= 0 and found[1] >= 0 and found[2] >= 0 and lookup(keys[:1], checks[9:10], keys, checks)[0] == -1


def test_empty_table(docs):
    assert substring.dedup(docs([])).collect() == []
