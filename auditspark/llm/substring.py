"""Repeated passages by prefix-partitioned suffix trees.

Suffixes start at words; a tree is cut at depth ``width`` words, as deeper nodes
cannot change which words stand in a repeat of that length.  A census over all
texts counts the suffixes below each prefix of 1, 2 and 4 words (in cells of a
hash).  Prefixes whose subtree would not fit a group's memory are extended by
more words, the others are joined into groups of about that size; suffixes whose
every prefix is too frequent go by their whole depth.  Each group builds its
subtree as the sorted list of its suffixes; a run of equal ones is an internal
node of depth ``width``.  A node with leaves in several documents is a maximal
repeat's stretch, and all its leaves but those of the smallest document id are
marked.

A chunk sends each distinct suffix once, with the smallest document that has it,
so a passage that a third of all documents share is one leaf per chunk; the
answer goes back to the chunk, which finds all places itself.  Suffixes are
compared by 80 bits of hash over their words.

Null and empty texts have no words and lose none.  A null id counts as the
largest of all; rows with equal ids never remove each other's words.  Windows
are judged on the input.  An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .chunks import NO_ID, based, chunked, lookup, pack, pack_sorted, unpack, unpack_sorted
from .common import release, slices
from .hashing import window_numbers, word_numbers

WIDTH = 13
PREFIXES = (1, 2, 4)
CELL_BITS = 12
#: Text bytes that the census takes at a time.
CENSUS_BYTES = 2 << 20
#: Suffixes whose subtree one group holds (about 60 bytes each while it is built).
GROUP_SUFFIXES = 1 << 20


class Suffixes:
    """All suffixes of at least ``width`` words of some texts."""

    def __init__(self, texts: list[bytes], width: int):
        self.words, self.counts = word_numbers(texts)
        self.ends = np.cumsum(self.counts)
        doc = np.repeat(np.arange(len(texts)), np.maximum(self.counts - width + 1, 0))
        first = np.cumsum(np.maximum(self.counts - width + 1, 0)) - np.maximum(self.counts - width + 1, 0)
        self.doc = doc
        self.at = np.arange(len(doc)) - first[doc] + (self.ends - self.counts)[doc]

    def cells(self, width: int) -> np.ndarray:
        return (window_numbers(self.words, width)[self.at] >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def census(rows: DataFrame, width: int) -> np.ndarray:
    """Suffixes by prefix length and cell, over all texts."""
    prefixes = [p for p in PREFIXES if p < width]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros((len(prefixes) + 1, 1 << CELL_BITS), np.int64)
        for batch in batches:
            texts = batch.column(0)
            for a, b in slices(pc.binary_length(texts).to_pylist(), CENSUS_BYTES):
                s = Suffixes(texts[a:b].to_pylist(), width)
                for level, p in enumerate(prefixes):
                    total[level] += np.bincount(s.cells(p), minlength=1 << CELL_BITS)
                total[-1, 0] += len(s.at)
        level, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(level, pa.int32()), pa.array(cell, pa.int32()), pa.array(total[level, cell])], names=["level", "cell", "n"]
        )

    found = rows.select("text").mapInArrow(count, "level int, cell int, n long").groupBy("level", "cell").agg(F.sum("n").alias("n"))
    total = np.zeros((len(prefixes) + 1, 1 << CELL_BITS), np.int64)
    for r in found.collect():  # at most four times 4096 numbers
        total[r["level"], r["cell"]] = r["n"]
    return total


def groups_of(total: np.ndarray, limit: int) -> tuple[np.ndarray, int]:
    """Group of each (level, cell), -1 for prefixes to extend; bits for whole suffixes."""
    group = np.full((len(total) - 1, total.shape[1]), -1, np.int64)
    for level in range(len(group)):
        fits = total[level] <= limit
        size = np.cumsum(np.where(fits, total[level], 0))
        group[level, fits] = (level + 1 << 32) + (size[fits] - 1) // limit
    return group, max(0, int(total[-1, 0] // limit).bit_length())


def entries(s: Suffixes, width: int, group: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, 64-bit key and 16-bit check of every suffix; keys begin with the cell."""
    number = window_numbers(s.words, width)[s.at]
    check = (window_numbers(s.words, width, 1)[s.at] >> np.uint64(48)).astype("<u2")
    owner = np.full(len(number), -1, np.int64)
    cell = number >> np.uint64(64 - CELL_BITS)
    for level, p in enumerate([p for p in PREFIXES if p < width]):
        cells = s.cells(p)
        take = (owner < 0) & (group[level, cells] >= 0)
        owner[take] = group[level, cells[take]]
        cell[take] = cells[take]
    rest = owner < 0
    owner[rest] = (number[rest] >> np.uint64(64 - bits)).astype(np.int64) if bits else 0
    key = cell << np.uint64(64 - CELL_BITS) | (number & np.uint64((1 << 64 - CELL_BITS) - 1))
    return owner, key, check


def distinct_of(docs: list[int], texts: list[bytes], width: int, group: np.ndarray, bits: int):
    """A chunk's suffixes sorted by (group, key), with the first of each run of
    equal ones; documents must come in the order of their ids."""
    s = Suffixes(texts, width)
    owner, key, check = entries(s, width, group, bits)
    order = np.lexsort((key, owner))
    owner = owner[order]  # one by one: each old column goes before the next is copied
    key = key[order]
    check = check[order]
    first = np.ones(len(order), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    ids = np.asarray(docs, np.int64)[s.doc[order]]
    return s, order, owner, key, check, first, ids


def _sorted_docs(docs: list[int], texts: list[bytes]) -> tuple[list[int], list[bytes], np.ndarray]:
    order = np.argsort(np.asarray(docs, np.int64), kind="stable")
    return [docs[i] for i in order], [texts[i] for i in order], order


def repeats(rows: DataFrame, width: int, group: np.ndarray, bits: int) -> DataFrame:
    """For each chunk, its suffixes that a document with a smaller id elsewhere has."""
    names = ["grp", "chunk", "keys", "checks", "base", "docs"]

    def packs(chunk: int, docs: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        release()
        docs, texts, _ = _sorted_docs(docs, texts)
        _, _, owner, key, check, first, ids = distinct_of(docs, texts, width, group, bits)
        owner, key, check, ids = owner[first], key[first], check[first], ids[first]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else []
        for a, b in zip(starts, [*starts[1:], len(owner)]):
            low = int(ids[a:b].min())
            values = [int(owner[a]), chunk, pack_sorted(key[a:b]), check[a:b].astype("<u2").tobytes(), low,
                      pack((ids[a:b] - low).astype(np.uint64))]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        chunk, docs, texts = None, [], []
        for batch in batches:
            for d, t, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if c != chunk and docs:
                    yield from packs(chunk, docs, texts)
                    docs, texts = [], []
                chunk = c
                docs.append(d)
                texts.append(t.as_buffer().to_pybytes())
        if docs:
            yield from packs(chunk, docs, texts)

    def subtree(pdf: pd.DataFrame) -> pd.DataFrame:
        release()
        key = np.concatenate([unpack_sorted(b) for b in pdf["keys"]])
        check = np.concatenate([np.frombuffer(b, "<u2") for b in pdf["checks"]])
        doc = np.concatenate([unpack(b).astype(np.int64) + low for b, low in zip(pdf["docs"], pdf["base"])])
        chunk = np.repeat(np.arange(len(pdf)), [len(b) // 2 for b in pdf["checks"]])
        order = np.lexsort((check, key))
        key, check, doc, chunk = key[order], check[order], doc[order], chunk[order]
        node = np.ones(len(key), bool)
        node[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
        least = np.minimum.reduceat(doc, np.flatnonzero(node)) if len(key) else doc
        least = least[np.cumsum(node) - 1]
        told = np.flatnonzero(doc > least)
        told = told[np.argsort(chunk[told], kind="stable")]
        out = []
        for a, b in _runs(chunk[told]):
            t, low = told[a:b], int(least[told[a:b]].min())
            out.append((pdf["chunk"].iloc[chunk[t[0]]], pack_sorted(key[t]), check[t].astype("<u2").tobytes(), low,
                        pack((least[t] - low).astype(np.uint64))))
        return pd.DataFrame(out, columns=["chunk", "keys", "checks", "base", "docs"])

    sent = rows.select("doc", "text", "chunk").mapInArrow(
        send, "grp long, chunk long, keys binary, checks binary, base long, docs binary"
    )
    return sent.groupBy("grp").applyInPandas(subtree, "chunk long, keys binary, checks binary, base long, docs binary")


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    if not len(values):
        return []
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(cuts, cuts[1:]))


def marked_words(docs, texts, told: pa.Table, width: int, group: np.ndarray, bits: int):
    """Suffixes object and a mask of the words to remove, documents in id order."""
    s, order, owner, key, check, first, ids = distinct_of(docs, texts, width, group, bits)
    del owner
    run = np.cumsum(first) - 1
    least = ids[first][run] if len(ids) else ids
    if told.num_rows and len(ids):
        parts = told.to_pylist()
        keys = np.concatenate([unpack_sorted(p["keys"]) for p in parts])
        checks = np.concatenate([np.frombuffer(p["checks"], "<u2") for p in parts])
        docs_in = np.concatenate([unpack(p["docs"]).astype(np.int64) + p["base"] for p in parts])
        by = np.argsort(keys, kind="stable")
        at = lookup(key[first], check[first].astype("<u2"), keys[by], checks[by])
        outside = np.where(at >= 0, docs_in[by][at], NO_ID) if len(by) else np.full(first.sum(), NO_ID)
        least = np.minimum(least, outside[run])
    hit = s.at[order[least < ids]]
    cover = np.zeros(len(s.words) + 1, np.int64)
    cover += np.bincount(hit, minlength=len(cover)) - np.bincount(hit + width, minlength=len(cover))[: len(cover)]
    return s, np.cumsum(cover)[:-1] > 0


def _cut(rows: DataFrame, width: int, limit: int) -> DataFrame:
    """doc, n_words, n_removed, kept (words joined by one blank) and the further
    columns of ``rows``."""
    group, bits = groups_of(census(rows, width), limit)
    told = repeats(rows.select("doc", "text", "chunk"), width, group, bits)
    more = [f for f in rows.schema.fields if f.name not in ("doc", "text", "chunk")]

    def cut(texts: pa.Table, told: pa.Table) -> pa.Table:
        release()
        raw = [t.as_buffer().to_pybytes() for t in texts["text"]]
        docs, data, order = _sorted_docs(texts["doc"].to_pylist(), raw)
        s, gone = marked_words(docs, data, told, width, group, bits)
        removed, kept = [], []
        for text, a, b in zip(data, s.ends - s.counts, s.ends):
            drop = gone[a:b]
            words = text.split()
            if drop.any():
                words = [w for w, d in zip(words, drop.tolist()) if not d]
            removed.append(int(drop.sum()))
            kept.append(b" ".join(words).decode())
        out = {
            "doc": pa.array(docs, pa.int64()), "n_words": pa.array(s.counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string()),
        }
        return pa.table(out | {f.name: texts[f.name].take(pa.array(order)) for f in more})

    schema = "doc long, n_words long, n_removed long, kept string" + "".join(
        f", `{f.name}` {f.dataType.simpleString()}" for f in more
    )
    return rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(cut, schema)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
          limit: int = GROUP_SUFFIXES) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one blank."""
    found = _cut(chunked(based(docs), id_col, text_col), width, limit)
    return found.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars",
                    width: int = WIDTH, limit: int = GROUP_SUFFIXES) -> DataFrame:
    """All rows and columns; texts that lose words are their kept words joined by
    one blank, all others stay as they are.  ``chars_col`` follows, if it is there."""
    docs = based(docs)
    carried = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    found = _cut(chunked(docs, id_col, text_col, *carried), width, limit)
    changed = F.col("n_removed") > 0
    new = {text_col: F.col("kept"), chars_col: F.length("kept")}
    out = []
    for k, field in enumerate(docs.schema.fields):
        column = F.col(f"c{k}")
        if field.name in new:
            column = F.when(changed, new[field.name].cast(field.dataType)).otherwise(column)
        out.append(column.alias(field.name))
    return found.select(*out)
