import hashlib
import random
import zlib

import numpy as np
import pytest

from auditspark.llm import periodic

from .conftest import collected


def brute(words):
    """Every run, by trying every period at every place."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(24, 3 * q):
                if not any(all(words[k] == words[k + d] for k in range(s, e - d)) for d in range(1, q)):
                    found.append((s, e - s, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
    return {
        "doc_id": doc_id, "n_runs": len(found),
        "start": best and best[0], "length": best and best[1], "period": best and best[2],
        "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    }


def texts(seed, n=60):
    rnd, out = random.Random(seed), []
    for _ in range(n):
        words = []
        while len(words) < rnd.choice([10, 60, 200]):
            kind = rnd.randrange(4)
            period = [rnd.choice("abc") for _ in range(rnd.choice([1, 2, 3, 5, 8, 13, 16, 17, 31, 40]))]
            if kind == 0:
                words += [rnd.choice("abcdefgh") + str(rnd.randrange(20)) for _ in range(rnd.randint(1, 30))]
            elif kind == 1:
                words += (period * 9)[: rnd.randint(1, 8 * len(period))]
            elif kind == 2:
                words += (["x"] * rnd.randint(1, 30) + ["y"]) * rnd.randint(1, 5)
            else:
                words += [rnd.choice("ab") for _ in range(rnd.randint(1, 40))]
        out.append(rnd.choice([" ", "\n", " \t"]).join(words))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_runs_equal_trying_every_period(seed):
    rows = texts(seed)
    got = periodic.of_texts([None] * len(rows), [t.encode() for t in rows], False)
    for text, (words, found) in zip(rows, got):
        assert words == text.encode().split()
        assert found == brute(words)


def test_every_period_and_place():
    rnd = random.Random(5)
    for q in range(1, 70):
        period = [f"w{k}" for k in range(q)]
        lead, length = rnd.randrange(40), max(24, 3 * q) + rnd.randrange(3)
        words = [f"l{k}" for k in range(lead)] + (period * 30)[:length] + ["end"]
        for short, want in ((0, [(lead, length, q)]), (length - max(24, 3 * q) + 1, [])):
            text = " ".join(words[: lead + length - short] + ["end"]).encode()
            assert periodic.of_texts([None], [text], False)[0][1] == want


def test_digests_equal_brute_force(docs):
    rows = [(k, t) for k, t in enumerate(texts(9, 120))]
    rows += [(None, "a " * 40), (None, None), (500, None), (501, ""), (502, " \n"), (7, "b " * 30), (7, "b " * 30), (-3, "z " * 50)]
    got = [r.asDict() for r in periodic.digests(docs(rows)).collect()]
    assert sorted(map(str, got)) == sorted(str(expected(*r)) for r in rows)


def test_batches_do_not_change_results(monkeypatch):
    rows = [t.encode() for t in texts(11)]
    whole = periodic.of_texts([None] * len(rows), rows, False)
    monkeypatch.setattr(periodic, "SLAB", 64)
    assert [periodic.of_texts([None], [t], False)[0] for t in rows] == whole


def test_transform_gives_exact_differences():
    rnd = np.random.default_rng(1)
    blocks, windows = rnd.integers(0, 1 << 20, (3, 16)).astype(np.uint64), rnd.integers(0, 1 << 20, (3, 31)).astype(np.uint64)
    for prime, root in periodic.PRIMES:
        got = periodic.differences(blocks, windows, prime, root)
        for r in range(3):
            for d in range(16):
                want = sum((int(x) - int(y)) ** 2 for x, y in zip(blocks[r], windows[r, d : d + 16]))
                assert int(got[r, d]) == want % prime


def test_long_texts():
    n = 200_000
    unique = [b"w%d" % k for k in range(n // 3)]
    assert periodic.of_texts([None], [b" ".join(unique * 3)], False)[0][1] == [(0, 3 * len(unique), len(unique))]
    assert periodic.of_texts([None], [b"a " * n], False)[0][1] == [(0, n, 1)]
    some = periodic.of_texts([None], [(b"a " * 3000 + b"b ") * 20], False)[0][1]
    assert some[:2] == [(0, 3000, 1), (0, 3001 * 20, 3001)] and len(some) == 21


def test_detect_gives_runs_and_text(docs):
    (row,) = periodic.detect(docs([(1, "x " + "a b " * 20 + "Ende é")])).collect()
    assert [tuple(r) for r in row["runs"]] == [(1, 40, 2)]
    assert row["collapsed"] == "x a b Ende é"


def test_empty_table(docs):
    assert periodic.digests(docs([])).collect() == []
    assert collected(periodic.detect(docs([])), "doc_id") == []
