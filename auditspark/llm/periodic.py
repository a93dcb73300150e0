"""Runs of repeated words, found by block convolution.

A run is a stretch of consecutive words with smallest period q and length of at
least max(24, 3 q) that no neighbouring word extends.  At each dyadic scale B the
words are cut into blocks of B.  A run with a period of B to 2B - 1 (1 to 15 at the
smallest scale) holds a whole block and its next occurrence q words later, so all
such occurrences are located: the squared differences of the block and the words
that follow, summed at every distance by number-theoretic transforms modulo two
primes, are zero there and nowhere else.  Each distance seeds an extension, word
by word, to both sides.  Blocks with a word that does not occur again within 2B
words cannot recur and are not transformed; nor is a seed extended inside a run of
a smaller period that covers the block and its occurrence, since two periods of one
stretch of that length have a common divisor as period.

Many texts are handled at a time as one array of word numbers with a number of its
own between texts, so no run crosses them and a short text costs no calls of its
own.  Memory is bounded by ``BATCH_BYTES`` of text or one longer text, and by
``SLAB`` numbers of transforms; work on a text does not depend on its batch.

Words are runs of bytes other than blank and the control characters 9 to 13, and
are compared as 64-bit numbers; a null text has none.  Rows with equal ids are
texts of their own.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import empty_if_null, release, slices
from .hashing import word_numbers

LEAST, TIMES = 24, 3
SMALLEST = 8
BATCH_BYTES = 1 << 21
SLAB = 1 << 19
#: Primes with transforms of up to 2**26 numbers, and a generator of each.
PRIMES = ((2013265921, 31), (469762049, 3))


def transform(x: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Number-theoretic transform of each row (a power of two numbers below the
    prime), in the Stockham order that needs no bit reversal."""
    rows, n = x.shape
    p, half, stride = np.uint64(prime), n // 2, 1
    x = x.reshape(rows, n, 1)
    while half:
        twiddle = powers(pow(root, (prime - 1) // (2 * half), prime), half, prime)[:, None]
        even, odd = x[:, :half], x[:, half:]
        x = np.stack([(even + odd) % p, (even + p - odd) % p * twiddle % p], axis=2).reshape(rows, half, 2 * stride)
        half, stride = half // 2, 2 * stride
    return x.reshape(rows, n)


def powers(base: int, n: int, prime: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo a prime."""
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * np.uint64(pow(base, size, prime)) % np.uint64(prime)
        size += more
    return out


def differences(blocks: np.ndarray, windows: np.ndarray, prime: int, root: int) -> np.ndarray:
    """For each block (a row of B numbers) and each place of its window at which it
    fits, the sum of squared differences modulo the prime."""
    p, width = np.uint64(prime), blocks.shape[1]
    places = windows.shape[1] - width + 1
    size = 1 << (windows.shape[1] - 1).bit_length()
    a = np.zeros((len(blocks), size), np.uint64)
    a[:, :width] = blocks[:, ::-1] % p
    b = np.zeros((len(blocks), size), np.uint64)
    b[:, : windows.shape[1]] = windows % p
    product = transform(a, prime, root) * transform(b, prime, root) % p
    cross = transform(product, prime, pow(root, -1, prime))[:, width - 1 : width - 1 + places]
    cross = cross * np.uint64(pow(size, -1, prime)) % p
    squares = np.zeros((len(blocks), windows.shape[1] + 1), np.uint64)
    square = b[:, : windows.shape[1]] * b[:, : windows.shape[1]] % p
    np.cumsum(square, axis=1, out=squares[:, 1:])  # below 2**31 summands: no overflow
    own = (a[:, :width] * a[:, :width] % p).sum(axis=1, keepdims=True) % p
    text = (squares[:, width:] - squares[:, : places]) % p
    return (own + text + (p - cross) * np.uint64(2)) % p


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """Block length, least and greatest distance of each scale for texts of so many words."""
    block, least = SMALLEST, 1
    while TIMES * least <= longest and longest >= LEAST:
        yield block, least, 2 * block - 1
        block, least = 2 * block, 2 * block


def seeds(words, again, reach, block: int, least: int, most: int) -> Iterator[tuple[int, int]]:
    """First word of each block and each distance at which the block occurs again;
    ``reach`` is, for each word, how far a known run holds it and all that follows."""
    n = len(words) // block
    recurs = (again[: n * block] <= most).reshape(n, block).all(axis=1)
    recurs &= reach[: n * block : block] < np.arange(n) * block + block + most
    at = np.flatnonzero(recurs) * block
    width = most - least + block
    per_slab = max(1, SLAB // (1 << (width - 1).bit_length()))
    for a in range(0, len(at), per_slab):
        first = at[a : a + per_slab]
        place = first[:, None] + np.arange(least, least + width)
        inside = place < len(words)
        # A number of its own beyond the end: it differs from every word.
        windows = np.where(inside, words[np.minimum(place, len(words) - 1)], np.uint64(len(words) + 1))
        blocks = words[first[:, None] + np.arange(block)]
        zero = np.ones((len(first), most - least + 1), bool)
        for prime, root in PRIMES:
            zero &= differences(blocks, windows, prime, root) == 0
        zero &= reach[first][:, None] < first[:, None] + block + np.arange(least, most + 1)
        for row, distance in zip(*np.nonzero(zero)):
            yield int(first[row]), int(distance) + least


def matched(words: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i and j > i on (step 1) or back (step -1) are equal, at most
    until the array ends."""
    total, size = 0, 64
    while True:
        if step > 0:
            size_ = min(size, len(words) - j)
            differ = words[i : i + size_] != words[j : j + size_]
            i, j = i + size_, j + size_
        else:
            size_ = min(size, i + 1)
            differ = (words[i + 1 - size_ : i + 1] != words[j + 1 - size_ : j + 1])[::-1]
            i, j = i - size_, j - size_
        if not size_:
            return total
        if differ.any():
            return total + int(differ.argmax())
        total, size = total + size_, size * 4


def runs(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of an array of ranks by start, then period; ``longest``
    bounds the words between two numbers that occur once."""
    order = np.argsort(words, kind="stable")
    again = np.full(len(words), len(words) + 1, np.int64)
    same = words[order[1:]] == words[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    found: dict[tuple[int, int], int] = {}  # (start, period): end
    for block, least, most in scales(longest):
        reach = np.zeros(len(words) + 1, np.int64)
        for (start, _), end in found.items():
            reach[start] = max(reach[start], end)
        reach = np.maximum.accumulate(reach)
        last: dict[int, int] = {}  # distance: how far its latest extension went
        for first, distance in seeds(words, again, reach, block, least, most):
            if last.get(distance, 0) >= first + block + distance:
                continue  # in the stretch that an earlier block has given
            ahead = matched(words, first, first + distance, 1)
            if ahead < block:
                continue
            back = matched(words, first - 1, first + distance - 1, -1) if first else 0
            start, end = first - back, first + distance + ahead
            last[distance] = end
            if end - start >= max(LEAST, TIMES * distance) and not shorter(words, start, distance):
                found[start, distance] = end
    return [(s, e - s, q) for (s, q), e in sorted(found.items())]


def shorter(words: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch with a period from ``start`` on has a proper divisor of it as period too."""
    q = period
    factors, f = set(), 2
    while f * f <= q:
        while q % f == 0:
            factors.add(f)
            q //= f
        f += 1
    factors |= {q} - {1}
    return any(
        (words[start : start + period - period // f] == words[start + period // f : start + period]).all() for f in factors
    )


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which original word stands at each place, or None if all stand as they were."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def summary(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    """Count, the run of greatest exponent, and both digests of one text."""
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    best = None
    for s, n, q in found:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    if found:
        drop = np.zeros(len(words) + 1, np.int64)
        for s, n, q in found:
            drop[s + q] += 1
            drop[s + n] -= 1
        keep = np.cumsum(drop[:-1]) == 0
        words = [w for w, k in zip(words, keep.tolist()) if k]
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())


def of_texts(ids: list[int | None], texts: list[bytes], plant: bool) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs (start, length, period) of each text, after the planting if asked for."""
    numbers, counts = word_numbers(texts)
    ends = np.cumsum(counts)
    ranks = np.unique(numbers, return_inverse=True)[1].astype(np.uint64)
    distinct = int(ranks.max()) + 1 if len(ranks) else 0
    whole = np.empty(len(ranks) + len(texts), np.uint64)
    words, begins = [], []
    for k, (text, n, end) in enumerate(zip(texts, counts.tolist(), ends.tolist())):
        own, row = text.split(), ranks[end - n : end]
        place = planted(n, ids[k]) if plant else None
        if place is not None:
            own, row = [own[i] for i in place.tolist()], row[place]
        begin = end - n + k
        whole[begin : begin + n] = row
        whole[begin + n] = distinct + k
        words.append(own)
        begins.append(begin)
    found: list[list] = [[] for _ in texts]
    if len(texts):
        at = np.asarray(begins)
        for s, n, q in runs(whole, int(counts.max())):
            k = int(np.searchsorted(at, s, "right")) - 1
            found[k].append((s - begins[k], n, q))
    return list(zip(words, found))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """doc_id, the runs of each text (start, length, period), and its words with all
    of a run but its first period removed, joined by a blank.  ``plant`` makes the
    contract's repetitions first."""
    schema = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

    def row(words, found):
        keep = np.ones(len(words), bool)
        for s, n, q in found:
            keep[s + q : s + n] = False
        return [{"start": s, "length": n, "period": q} for s, n, q in found], b" ".join(
            w for w, k in zip(words, keep.tolist()) if k
        ).decode()

    return _each(docs, id_col, text_col, plant, schema, row)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = True) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent and digests of runs and kept words."""
    schema = (
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string"
    )
    return _each(docs, id_col, text_col, plant, schema, summary)


def _each(docs: DataFrame, id_col: str, text_col: str, plant: bool, schema: str, make) -> DataFrame:
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices([len(t.as_buffer()) for t in column], BATCH_BYTES):
                texts = [t.as_buffer().to_pybytes() for t in column.slice(a, b - a)]
                rows = [(i, *make(*found)) for i, found in zip(ids[a:b], of_texts(ids[a:b], texts, plant))]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    text = empty_if_null(f"`{text_col}`").cast("binary")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, schema)
