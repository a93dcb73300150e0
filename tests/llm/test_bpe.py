import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from auditspark.llm import bpe

from .conftest import collected

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


PARTS = ["a", "b", " ", "  ", "\n", "th", "e", "é", "\x1c", "1", "2024", ".", "'s", ",", "\t", "ñ", "the ", "\r\n", "日本", "😀", "----"]


@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join))
@settings(max_examples=400, deadline=None)
def test_ids_equal_the_library(codec, reference, text):
    n, ids, data = codec.text(text)
    wanted = reference.encode_ordinary(text)
    assert ids == " ".join(map(str, wanted)) and n == len(wanted) and data == text.encode()


@given(st.binary(max_size=200), st.integers(0, 200))
@settings(max_examples=300, deadline=None)
def test_join_equals_encoding_whole(codec, data, cut):
    left, right = data[:cut], data[cut:]
    assert codec.join(codec.merge(left), codec.merge(right)) == codec.merge(data)


@pytest.mark.parametrize("unit", ["a", "ab", "the", "=", "\n", " ", "日"])
def test_long_runs(codec, reference, unit):
    text = unit * 5000
    assert codec.text(text)[1] == " ".join(map(str, reference.encode_ordinary(text)))


def test_long_word(codec, reference):
    text = "".join(random.Random(2).choice("abcdefgh") for _ in range(20_000))
    assert codec.text(text)[1] == " ".join(map(str, reference.encode_ordinary(text)))


def test_table(docs, reference):
    texts = [(0, "Hello, world  of\n bytes"), (1, ""), (2, None), (2, "again"), (None, "no id")]
    rows = collected(bpe.encode_decode(docs(texts), PATH, public_tokenizers.PATTERN), "doc_id")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    wanted = []
    for d, t in texts:
        ids = reference.encode_ordinary(t or "")
        wanted.append((d, len(ids), sha(" ".join(map(str, ids))), sha(t or "")))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert bpe.encode_decode(docs([]), PATH, public_tokenizers.PATTERN).collect() == []
