import hashlib
import random

import numpy as np

from auditspark.llm import fingerprint
from auditspark.llm.common import chunks_for

from .conftest import collected


def prose(rnd, n):
    return " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 9))) for _ in range(n))


def test_equal_texts_agree_in_any_company():
    rnd = random.Random(1)
    texts = ["", "a", "ab", "a" * 50, "abc" * 100] + [prose(rnd, k) for k in (1, 2, 5, 50, 400)]
    alone = np.concatenate([fingerprint.bins([t]) for t in texts])
    shuffled = list(range(len(texts))) * 3
    rnd.shuffle(shuffled)
    assert (fingerprint.bins([texts[k] for k in shuffled]) == alone[shuffled]).all()


def test_shifted_text_keeps_its_names():
    rnd = random.Random(2)
    text = prose(rnd, 800)
    a = fingerprint.bins([text])
    assert fingerprint.likeness(a, fingerprint.bins(["QQ " + text]))[0] > 0.9
    assert fingerprint.likeness(a, fingerprint.bins([prose(rnd, 800)]))[0] < 0.15
    assert fingerprint.likeness(a, a)[0] == 1 and fingerprint.likeness(fingerprint.bins([""]), fingerprint.bins([""]))[0] == 1


def test_names_are_those_of_equal_stretches():
    rnd = random.Random(3)
    inner = prose(rnd, 200)
    names = []
    for before in ("", "xyz", prose(rnd, 9)):
        codes = np.frombuffer((before + inner).encode("utf-32-le"), np.uint32).astype(np.uint64)
        level = [n for n, _ in fingerprint.levels(fingerprint.scramble(codes + np.uint64(1)), np.asarray([0]))][2]
        names.append(level[-40:])
    assert (names[0] == names[1]).all() and (names[0] == names[2]).all()


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, changed, following = (fingerprint.bins([x]) for x in (t, edited, after))
        out.append(dict(
            doc_id=d, n_chars=len(t), edited_sha256=hashlib.sha256(edited.encode()).hexdigest(),
            fingerprint=own[0].astype(">u2").tobytes().hex(), edited_fingerprint=changed[0].astype(">u2").tobytes().hex(),
            near_edited=float(fingerprint.likeness(own, changed)[0]), near_next=float(fingerprint.likeness(own, following)[0]),
        ))
    return sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


def test_table_equals_brute_force(docs, monkeypatch):
    rnd = random.Random(4)
    rows = [(k * 13 % 200, prose(rnd, rnd.randint(0, 60))) for k in range(200)] + [(500, ""), (501, "é😀" * 9), (None, "null id")]
    rows += [(600, rows[0][1]), (601, None)]
    monkeypatch.setattr(fingerprint, "chunks_for", lambda *a: 9)
    monkeypatch.setattr(fingerprint, "BLOCK_CHARS", 700)
    assert collected(fingerprint.fingerprints(docs(rows)), "doc_id") == brute(rows)


def test_few_rows(docs):
    assert fingerprint.fingerprints(docs([])).collect() == []
    assert chunks_for(docs([]), "text") >= 1
    one = fingerprint.fingerprints(docs([(3, "only one here")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    same = fingerprint.fingerprints(docs([(3, "b"), (3, "a"), (3, "a")])).collect()
    assert len(same) == 3
