"""Jaccard join of documents' word shingles by prefixes under several orders.

A document's set is its distinct shingles; documents with equal sets are one
class.  All shingles of all documents are counted: a chunk sends each of its
shingles once and is told which occur in more sets, and about how many.  A set
can have a partner only if enough of its shingles occur elsewhere.  Two sets
reach the threshold only if they share a shingle within their prefixes under any
global order of all shingles; here two orders by rarity with different seeds for
ties and one by seed alone.  Sets that meet in a prefix under the first order
are brought together once for each pivot (the smallest set of a bucket); pairs
whose prefixes do not meet under the other orders are left out, and the rest is
compared exactly; of the links only a spanning forest is kept, so a group of near
copies does not give all its pairs.  Large groups are compared in pairs of blocks
that are bounded in sets and in shingles.

Words and shingles are compared as 64-bit numbers.  Null, empty and wordless
texts have an empty set and link with nothing; fewer words than a shingle form
one.  A null id counts as the largest.  Rows with equal ids are documents of
their own; all rows of a component get its smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from auditspark.operators.joins import lookup_join

from .chunks import NO_ID, based, chunked, pack_sorted, row_place, unpack_sorted
from .common import block_pairs, release, row_groups, store
from .components import components
from .hashing import scramble, window_numbers, word_numbers

#: Key bits beyond those of the number of shingles: false repeats are 1 in 2**17.
SPARE_BITS = 17
GROUP_KEYS = 1 << 20
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
ORDERS = ((True, 0x51), (True, 0xA7), (False, 0x3D))


class Sets:
    """Distinct shingles of each text, sorted, one after the other."""

    def __init__(self, texts: list[bytes], width: int):
        words, counts = word_numbers(texts, lower=True)
        ends = np.cumsum(counts)
        n = np.maximum(counts - width + 1, 0)
        doc = np.repeat(np.arange(len(texts)), n)
        at = np.arange(len(doc)) - (np.cumsum(n) - n)[doc] + (ends - counts)[doc]
        number = window_numbers(words, width)[at]
        short = np.flatnonzero((counts > 0) & (counts < width))
        whole = [window_numbers(words[ends[i] - counts[i] : ends[i]], int(counts[i]), 1)[0] for i in short]
        doc, number = np.r_[doc, short], np.r_[number, np.asarray(whole, np.uint64)]
        order = np.lexsort((number, doc))
        doc, number = doc[order], number[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
        self.number, self.doc = number[new], doc[new]
        self.n = np.bincount(self.doc, minlength=len(texts))
        self.start = np.cumsum(self.n) - self.n
        self.digest = [hashlib.blake2b(self.of(i).tobytes(), digest_size=16).digest() for i in range(len(texts))]
        seen: dict[bytes, int] = {}
        self.firsts = [i for i, d in enumerate(self.digest) if self.n[i] and seen.setdefault(d, i) == i]

    def of(self, i: int) -> np.ndarray:
        return self.number[self.start[i] : self.start[i] + self.n[i]]


def needed(n, numerator: int, denominator: int):
    """Shingles that a set of n must share at least to reach the threshold."""
    return -(-n * numerator // denominator)


def frequencies(rows: DataFrame, width: int, bits: int, groups: int) -> DataFrame:
    """For each chunk, which of its shingles are in several sets, and the
    binary logarithm of how many."""
    shift, group_shift = np.uint64(64 - bits), np.uint64(64 - groups)

    def counted(chunk: int, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        s = Sets(texts, width)
        own = np.zeros(len(texts), bool)
        own[s.firsts] = True
        key, n = np.unique(s.number[own[s.doc]] >> shift, return_counts=True)
        grp = (key << shift >> group_shift).astype(np.int64) if groups else np.zeros(len(key), np.int64)
        cuts = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]]) if len(key) else []
        for a, b in zip(cuts, [*cuts[1:], len(key)]):
            row = [int(grp[a]), chunk, pack_sorted(key[a:b]), np.minimum(n[a:b], 255).astype(np.uint8).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["grp", "chunk", "keys", "counts"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        chunk, texts = None, []
        for batch in batches:
            for t, c in zip(batch.column(0), batch.column(1).to_pylist()):
                if c != chunk and texts:
                    yield from counted(chunk, texts)
                    texts = []
                chunk = c
                texts.append(t.as_buffer().to_pybytes())
        if texts:
            yield from counted(chunk, texts)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_sorted(b) for b in pdf["keys"]]
        key = np.concatenate(keys)
        distinct, at = np.unique(key, return_inverse=True)
        n = np.bincount(at, np.concatenate([np.frombuffer(b, np.uint8) for b in pdf["counts"]])).astype(np.int64)
        rank = np.log2(np.maximum(n, 1)).astype(np.uint8)[at]
        out, a = [], 0
        for chunk, part in zip(pdf["chunk"], keys):
            mine = rank[a : a + len(part)]
            a += len(part)
            if mine.any():
                out.append((chunk, pack_sorted(part[mine > 0]), mine[mine > 0].tobytes()))
        return pd.DataFrame(out, columns=["chunk", "keys", "ranks"])

    sent = rows.select("text", "chunk").mapInArrow(send, "grp long, chunk long, keys binary, counts binary")
    return sent.groupBy("grp").applyInPandas(total, "chunk long, keys binary, ranks binary")


def described(rows: DataFrame, told: DataFrame, width: int, bits: int, num: int, den: int) -> DataFrame:
    """A row for each document (doc, n, digest, place) and, once for each chunk, for each
    set that may have a partner its shingles and its prefixes."""
    shift = np.uint64(64 - bits)

    def describe(texts: pa.Table, told: pa.Table) -> pa.Table:
        release()
        s = Sets([t.as_buffer().to_pybytes() for t in texts["text"]], width)
        rank = np.zeros(len(s.number), np.uint8)
        if told.num_rows and len(rank):
            keys = np.concatenate([unpack_sorted(b) for b in told["keys"].to_pylist()])
            ranks = np.concatenate([np.frombuffer(b, np.uint8) for b in told["ranks"].to_pylist()])
            order = np.argsort(keys)
            keys, ranks = keys[order], ranks[order]
            at = np.minimum(np.searchsorted(keys, s.number >> shift), len(keys) - 1)
            hit = keys[at] == s.number >> shift
            rank[hit] = ranks[at[hit]]
        shared = np.bincount(s.doc[rank > 0], minlength=len(s.n))
        out: dict[str, list] = {k: [] for k in ("shingles", *(f"prefix{i}" for i in range(len(ORDERS))))}
        live = np.zeros(len(s.n), bool)
        live[s.firsts] = True
        live &= shared >= needed(s.n, num, den)
        for i in range(len(s.n)):
            prefixes = [None] * len(ORDERS)
            if live[i]:
                own, r = s.of(i), rank[s.start[i] : s.start[i] + s.n[i]]
                length = int(s.n[i] - needed(s.n[i], num, den) + 1)
                for k, (by_rank, seed) in enumerate(ORDERS):
                    spread = scramble(own ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                    order = np.lexsort((spread, r)) if by_rank else np.argsort(spread)
                    first = order[:length]
                    prefixes[k] = own[first[r[first] > 0]]
                live[i] = all(len(p) for p in prefixes)
            out["shingles"].append(s.of(i).tobytes() if live[i] else None)
            for k, p in enumerate(prefixes):
                out[f"prefix{k}"].append(p.view(np.int64).tolist() if live[i] else None)
        table = {
            "doc": texts["doc"], "n": pa.array(s.n, pa.int64()), "digest": pa.array(s.digest, pa.binary()),
            "chunk": texts["chunk"], "f": texts["f"], "r": texts["r"], "shingles": pa.array(out["shingles"], pa.binary()),
        }
        return pa.table(table | {k: pa.array(v, pa.list_(pa.int64())) for k, v in out.items() if k != "shingles"})

    schema = "doc long, n long, digest binary, chunk long, f long, r long, shingles binary" + "".join(
        f", prefix{k} array<long>" for k in range(len(ORDERS))
    )
    return rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(describe, schema)


def bit_rows(member: np.ndarray, column: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """A row of bits for each member, as 64-bit words, with its columns set."""
    rows = np.zeros((shape[0], -(-shape[1] // 64) * 8), np.uint8)
    # Each (member, column) is there once, so the bits of a byte add up.
    np.add.at(rows, (member, column >> 3), np.left_shift(1, column & 7).astype(np.uint8))
    return rows.view(np.uint64)


def compare(digests, sets, prefixes, side, num: int, den: int) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the pairs of one group that reach the threshold.
    ``side`` numbers the blocks: with two of them only pairs across are compared.
    Sets are rows of bits over the shingles that two of them hold."""
    n = np.asarray([len(s) for s in sets])
    member = np.repeat(np.arange(len(sets)), n)
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    keep = count[at] > 1
    has = bit_rows(member[keep], column[at[keep]], (len(sets), int((count > 1).sum())))
    del member, at, keep
    meets = []
    for own in prefixes[1:]:
        v, pos = np.unique(np.concatenate(own), return_inverse=True)
        meets.append(bit_rows(np.repeat(np.arange(len(own)), [len(p) for p in own]), pos, (len(own), len(v))))
    root, edges, split = list(range(len(sets))), [], len(set(side)) > 1

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(1, len(sets)):
        other = np.flatnonzero(side[:i] != side[i]) if split else np.arange(i)
        for m in meets:  # the prefixes meet under every order
            other = other[(m[other] & m[i]).any(axis=1)]
        linked = []
        for a in range(0, len(other), 64):  # a few rows at a time
            some = other[a : a + 64]
            both = np.bitwise_count(has[some] & has[i]).sum(axis=1, dtype=np.int64)
            # I / (a + b - I) >= num / den
            linked += some[(num + den) * both >= num * (n[some] + n[i])].tolist()
        for j in linked:
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                edges.append((digests[i], digests[j]))
    return edges


def links(sets: DataFrame, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """Pairs of digests (a, b): enough of the similar pairs to connect each component."""
    size = (F.octet_length("shingles") / 8).cast("long").alias("n")
    entries = sets.select(F.explode("prefix0").alias("token"), "digest", size).distinct()
    buckets = entries.groupBy("token").agg(F.min("digest").alias("pivot"), F.count("*").alias("m")).where("m > 1")
    members = store(entries.join(buckets, "token").select("pivot", "digest", "n").distinct(), "members")
    # A block is of so many sets, and of so many shingles on average.
    load = F.greatest(F.lit(1.0) / block, F.col("n") / BLOCK_SHINGLES)
    placed = block_pairs(members, ["pivot"], "digest", block, load).drop("n")
    one = sets.groupBy("digest").agg(F.min("chunk").alias("chunk"))
    full = sets.join(one, ["digest", "chunk"]).select(
        "digest", "shingles", *[f"prefix{k}" for k in range(1, len(ORDERS))]
    )
    width = len(ORDERS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in row_groups(batches, 3):
            edges = compare(
                [r[4] for r in rows], [np.frombuffer(r[5], "<u8") for r in rows],
                [None, *([r[6 + k] for r in rows] for k in range(width))],
                np.asarray([r[3] for r in rows]), num, den,
            ) if len(rows) > 1 else []
            if edges:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([e[k] for e in edges], pa.binary()) for k in (0, 1)], names=["a", "b"]
                )

    brought = placed.join(full, "digest").select(
        "pivot", "i", "j", "mine", "digest", "shingles", *[f"prefix{k}" for k in range(1, len(ORDERS))]
    )
    together = brought.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "digest")
    return together.mapInArrow(run, "a binary, b binary")


def grouped(rows: DataFrame, width: int, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """The sets of all documents (doc, n, digest, place f and r) and, by digest, the
    component's root and smallest id."""
    shingles = max(1, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6)
    bits = min(64, shingles.bit_length() + SPARE_BITS)
    groups = max(0, (shingles // GROUP_KEYS).bit_length())
    told = frequencies(rows, width, bits, groups)
    known = store(described(rows, told, width, bits, *threshold), "sets")
    sets = known.where("shingles is not null")
    found = components(store(links(sets, *threshold), "similar"))
    classes = known.where("n > 0").groupBy("digest").agg(F.min("doc").alias("least"))
    rooted = store(classes.join(found.withColumnRenamed("node", "digest"), "digest", "left").select(
        "digest", "least", F.coalesce("root", "digest").alias("root")
    ), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    # A large component is one root, and copies share one digest: neither is joined in one task.
    named = store(lookup_join(rooted, least, ["root"], "inner", ["digest"]).select("digest", "root", "component"), "named")
    return known.select("doc", "n", "digest", "f", "r"), named


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
         threshold: tuple[int, int] = (9, 10)) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    known, named = grouped(chunked(based(docs), id_col, text_col, *row_place()), width, threshold)
    out = lookup_join(known, named, ["digest"], "left", ["f", "r"])
    null_if_none = lambda c: F.when(c != NO_ID, c)
    return out.select(
        null_if_none(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"),
        null_if_none(F.coalesce("component", "doc")).alias("component_id"),
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                    threshold: tuple[int, int] = (9, 10)) -> DataFrame:
    """One row of each component, all columns kept: that with the smallest id, of
    several the first by place.  Documents without a shingle are components of
    their own and all stay."""
    docs = based(docs)
    known, named = grouped(chunked(docs, id_col, text_col, *row_place()), width, threshold)
    linked = lookup_join(known.where("n > 0"), named, ["digest"], "inner", ["f", "r"])
    first = linked.groupBy("root").agg(F.min(F.struct("doc", "f", "r")).alias("p")).select("p.f", "p.r")
    kept = first.unionByName(known.where("n = 0").select("f", "r"))
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], *row_place())
    return rows.join(kept, ["f", "r"], "left_semi").select(*names).toDF(*docs.columns)
