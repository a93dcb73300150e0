import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from auditspark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def exact_best(counts, space):
    reach = {0}
    for length, n in counts.items():
        for _ in range(min(n, space // length)):
            reach |= {r + length for r in reach if r + length <= space}
    return max(reach)


def test_special_tokens_are_those_of_the_tokenizer(tokenizer):
    texts = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "a <|ENDOFTEXT|> b", "<|endoftext", "plain", "<|endoftext|> " * 50]
    wanted = [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert list(packing.WordIds(PATH).encode_all([t.encode() for t in texts])) == wanted
    assert np.frombuffer(wanted[0], "<u4").tolist() == [320, 49407, 321]


def test_new_words_are_encoded_by_the_model_or_joined(tokenizer, monkeypatch):
    odd = "it's don't word'. a''s 1.5 x***y &&& 'tis, 'LL 're. \0 a\0b \0\1 é, été*** É'S \u0301a a\u0301. İ, ﬁ! ½; 日本, c++ <b>, _a_ a\u00a0b"
    texts = [odd, *(f"{w}ing*** {w}ly, {w}s!! {w}" for w in ("gro", "sta", "fli", "zzxq"))]
    wanted = [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    words, calls = packing.WordIds(PATH), []
    keep = words.ids_of
    monkeypatch.setattr(words, "ids_of", lambda text: calls.append(text) or keep(text))
    assert list(words.encode_all([t.encode() for t in texts])) == wanted
    # Words of letters never meet the whole tokenizer; the others share a call, but for those with the mark.
    assert not any("gro" in c or "zzxq" in c for c in calls) and len(calls) < 40
    assert words.joined([b"x1", b"y-z"]) == [keep("x1"), keep("y-z")]


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=8), st.integers(0, 60))
@settings(max_examples=200, deadline=None)
def test_fill_finds_the_closest_sum(counts, space):
    found = packing.fill(counts, space)
    assert all(0 < c <= counts[k] for k, c in found.items())
    assert sum(k * c for k, c in found.items()) == exact_best(counts, space)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
@settings(max_examples=100, deadline=None)
def test_plan_places_every_piece_once(counts):
    used, windows = Counter(), {}
    for length, rank, ranks, first, copies, offset in packing.plan(counts, 64):
        assert rank == used[length] and ranks % copies == 0
        used[length] += ranks
        for s in range(first, first + ranks // copies):
            windows.setdefault(s, []).append((offset, length * copies))
    assert used == Counter(counts)
    for parts in windows.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 64


WORDS = ["a", "É", "İ", "K", "it's", "'S", "Ü", "é", ".", ",", "...", " ", "\n", "\x1c", "9", "ß", "ﬁ", "日本", "<|endoftext|>", "　", "\x85"]


def test_word_ids_equal_the_tokenizer(tokenizer):
    words, rnd = packing.WordIds(PATH), random.Random(3)
    texts = ["".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 25))) for _ in range(600)]
    wanted = [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert words.encode([t.encode() for t in texts]) == wanted


def check(rows, texts, tokenizer, window):
    ids = [tuple(e.ids) + (1,) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    pieces = Counter()
    for r in rows:
        pieces[(r["doc_tokens"], r["start"], r["length"], r["ids_crc32"])] += 1
    wanted = Counter()
    for own in ids:
        for start in range(0, len(own), window):
            part = np.asarray(own[start : start + window], "<u4").tobytes()
            wanted[(len(own), start, len(part) // 4, zlib.crc32(part))] += 1
    assert pieces == wanted
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return windows


def test_pieces_and_sequences(docs, tokenizer):
    rnd = random.Random(1)
    texts = ["", "one", "one"] + ["word number %d, " % k * rnd.randint(1, 60) for k in range(60)] + ["hot copy"] * 80
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, None), (5, "one")]
    found = packing.pack(docs(rows), PATH, window=64).collect()
    windows = check(found, texts + ["", "one"], tokenizer, 64)
    total = sum(r["length"] for r in found)
    assert len(windows) <= -(-total // 64) + 1


def test_empty_table(docs):
    assert packing.pack(docs([]), PATH).collect() == []


def test_texts_are_taken_from_the_batch_slice_by_slice(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_BYTES", 100)
    words, most = packing.WordIds(PATH), []
    texts = [f"text {k} " * (k % 7) for k in range(60)]
    wanted = [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    encode = words.encode
    monkeypatch.setattr(words, "encode", lambda some: most.append(sum(map(len, some))) or encode(some))
    column = pa.array([t.encode() for t in ["before", *texts]], pa.binary())[1:]
    assert list(words.encode_all(column)) == wanted
    assert max(most) <= 100
