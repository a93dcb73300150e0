"""Document fingerprints by locally consistent parsing.

A text is a sequence of names, at first its code points.  On each level runs of
one name become a name of their own; then deterministic coin tossing labels
every name by the lowest bit in which it differs from its left neighbour, a few
times over, until six labels are left.  Phrases begin at local minima of the
labels and are named by a hash of what they hold; they are the names of the
level above.  A phrase depends on a handful of neighbours only, so equal
stretches of text get equal names inside, wherever they stand.

The fingerprint keeps, of the names from level ``FROM_LEVEL`` on, the smallest
hash in each of 128 bins (16 bits each, 0 for an empty bin) as a hexadecimal
string.  Likeness is the share of equal bins among those filled on either side,
an unbiased estimate of the resemblance of the name sets; two empty texts are
alike.

Null texts are empty.  Documents are ordered by id; a null id is the smallest,
equal ids are ordered by text.  An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks_for
from .hashing import scramble

FROM_LEVEL = 2
BINS = 128
TOSSES = 4
BLOCK_CHARS = 1 << 19
#: Ranges of ids, at most; a range is streamed, so its size costs no memory.
MAX_RANGES = 4096
NO_ID = -(1 << 63)

_BASE = 0x9E6C63D0876A9F4B | 1
_POWERS = np.multiply.accumulate(np.r_[np.uint64(1), np.full(4095, _BASE, np.uint64)])


def _toss(label: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index and value of the lowest bit that differs from the left neighbour;
    a first symbol counts as differing in bit 0."""
    differ = label.copy()
    differ[1:] ^= label[:-1]
    differ[starts] = 1
    one = label.dtype.type(1)
    index = np.bitwise_count((differ - one) & ~differ).astype(np.uint8)
    value = (label >> index.astype(label.dtype)).astype(np.uint8) & np.uint8(1)
    return index << np.uint8(1) | value


def _collapse(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one name as one name; names that stand alone stay as they are."""
    new = np.ones(len(names), bool)
    new[1:] = names[1:] != names[:-1]
    new[starts] = True
    if new.all():
        return names, starts
    at = np.flatnonzero(new)
    length = np.diff(at, append=len(names)).astype(np.uint64)
    out = names[at]
    runs = length > 1
    out[runs] = scramble(out[runs] * np.uint64(_BASE) + length[runs])
    return out, np.searchsorted(at, starts)


def levels(names: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names and first positions of the texts on level 0, 1, ... until every text
    is one name.  No text is empty."""
    while True:
        yield names, starts
        if len(names) == len(starts):
            return
        names, starts = _collapse(names, starts)
        label = _toss(names, starts)
        for _ in range(TOSSES - 1):
            label = _toss(label, starts)
        left = np.empty_like(label)
        left[0], left[1:] = 255, label[:-1]
        right = np.empty_like(label)
        right[-1], right[:-1] = 255, label[1:]
        right[starts[1:] - 1] = 255  # what stands right of a text's end never counts
        first = (label < left) & (label < right)
        first[starts] = True
        follows = starts[starts + 1 < len(first)] + 1
        first[follows] = np.isin(follows, starts)  # no phrase of the first name alone
        at = np.flatnonzero(first)
        place = np.arange(len(names)) - np.repeat(at, np.diff(at, append=len(names)))
        weighted = names * _POWERS[np.minimum(place, len(_POWERS) - 1)]
        starts = np.searchsorted(at, starts)
        names = scramble(np.add.reduceat(weighted, at))


def bins(texts: list[str]) -> np.ndarray:
    """Fingerprints of the texts as rows of 16-bit bins."""
    out = np.zeros((len(texts), BINS), np.uint16)
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= BLOCK_CHARS):
            size += len(texts[upto])
            upto += 1
        _fill(texts[at:upto], out[at:upto])
        at = upto
    return out


def _fill(texts: list[str], out: np.ndarray) -> None:
    solid = [k for k, t in enumerate(texts) if t]
    if not solid:
        return
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.asarray([len(texts[k]) for k in solid])
    names = scramble(codes.astype(np.uint64) + np.uint64(1))
    kept_doc, kept_name, done = [], [], np.zeros(len(solid), bool)
    for level, (names, starts) in enumerate(levels(names, np.cumsum(lengths) - lengths)):
        count = np.diff(starts, append=len(names))
        # A text that became one name earlier goes on only beside the others.
        use = ~done & ((count == 1) | (level >= FROM_LEVEL))
        done |= count == 1
        take = np.repeat(use, count)
        doc = np.repeat(np.arange(len(solid)), count)
        kept_doc.append(doc[take])
        kept_name.append(names[take])
    doc, name = np.concatenate(kept_doc).astype(np.uint64), scramble(np.concatenate(kept_name) ^ np.uint64(_BASE))
    place = doc << np.uint64(7) | name >> np.uint64(57)
    order = np.sort(place << np.uint64(38) | (name >> np.uint64(19)) & np.uint64((1 << 38) - 1))
    place = order >> np.uint64(38)
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]
    value = np.maximum(order[first] & np.uint64(0xFFFF), 1).astype(np.uint16)
    spot = place[first].astype(np.int64)
    out[np.asarray(solid)[spot >> 7], spot & (BINS - 1)] = value


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of fingerprints, row by row."""
    filled = ((a > 0) | (b > 0)).sum(1)
    equal = ((a == b) & (a > 0)).sum(1)
    return np.where(filled > 0, equal / np.maximum(filled, 1), 1.0)


def _text(row: np.ndarray) -> str:
    return row.astype(">u2").tobytes().hex()


def _ranges(ids: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts between ranges of ids, and the largest id of each range (by range)."""
    share = [k / n for k in range(1, n)]
    found = ids.agg(F.percentile_approx("doc", share, 10_000).alias("q")).first()["q"] or []
    cuts = np.unique(np.asarray(found, np.int64))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            place = np.searchsorted(cuts, doc, "right")
            for p in np.unique(place).tolist():
                top[p] = max(top.get(p, NO_ID), int(doc[place == p].max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.int64()), pa.array(list(top.values()), pa.int64())], names=["p", "top"])

    rows = ids.mapInArrow(tops, "p long, top long").groupBy("p").agg(F.max("top").alias("top")).orderBy("p").collect()
    return cuts, np.asarray([(r["p"], r["top"]) for r in rows], np.int64).reshape(-1, 2)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit: the last half of its code points
    replaced by the beginning of the next document's, in descending order of ids."""
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    cuts, tops = _ranges(rows.select("doc"), min(MAX_RANGES, chunks_for(rows, "text")))
    # The document after a range's last one: the largest of the next lower range;
    # the lowest range goes on with the largest of all.
    after = {int(tops[k][1]): int(tops[(k + 1) % len(tops)][0]) for k in range(len(tops))}
    wanted = np.asarray(sorted(after), np.int64)
    goes_to = np.asarray([after[int(w)] for w in wanted], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            own = np.searchsorted(cuts, doc, "right")
            hit = np.minimum(np.searchsorted(wanted, doc), max(0, len(wanted) - 1))
            extra = np.flatnonzero(wanted[hit] == doc) if len(wanted) else np.empty(0, np.int64)
            take = pa.array(np.r_[np.arange(len(doc)), extra])
            place = np.r_[own, goes_to[hit[extra]] if len(extra) else extra]
            flag = np.r_[np.zeros(len(doc), np.int32), np.ones(len(extra), np.int32)].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place, pa.int64()), pa.array(flag), batch.column(0).take(take), batch.column(1).take(take)],
                names=["place", "carried", "doc", "text"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, str]] = []
        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                held.append(row)
                size += len(row[3])
                if size > BLOCK_CHARS:
                    yield from digest(held)
                    held, size = held[-1:], len(held[-1][3])
        yield from digest(held)

    def digest(rows: list[tuple[int, int, int, str]]) -> Iterator[pa.RecordBatch]:
        """All rows but the last and the carried ones, each with its successor."""
        at = [k for k in range(len(rows) - 1) if not rows[k][1]]
        if not at:
            return
        texts = [r[3] for r in rows]
        edited = [texts[k][: len(texts[k]) - len(texts[k]) // 2] + texts[k + 1][: len(texts[k]) // 2] for k in at]
        own = bins(texts)
        changed = bins(edited)
        mine, following = own[at], own[[k + 1 for k in at]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([None if rows[k][2] == NO_ID else rows[k][2] for k in at], pa.int64()),
                pa.array([len(texts[k]) for k in at], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array([_text(r) for r in mine]),
                pa.array([_text(r) for r in changed]),
                pa.array(likeness(mine, changed)),
                pa.array(likeness(mine, following)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    dealt = rows.mapInArrow(deal, "place long, carried int, doc long, text string")
    ordered = dealt.repartition("place").sortWithinPartitions("place", "carried", F.desc("doc"), "text")
    return ordered.mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
