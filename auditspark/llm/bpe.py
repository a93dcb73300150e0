"""Byte-level BPE as a tree reduction.

An encoding is a monoid element: its tokens.  A piece of text is encoded by
halves; two neighbours are joined by re-encoding a window of tokens around the
seam.  A token sequence is the encoding of its bytes exactly if every adjacent
pair of tokens encodes to itself, so the join is right as soon as the pairs at
both rims of the window are such pairs; until then the window doubles.  Pairs
deeper inside either neighbour were right already, hence no token outside can
change.  Matches of the splitting pattern are never merged with each other, so
above them the reduction is plain concatenation, and decoding concatenates up
the same tree.

Null texts are empty: no ids, no bytes.  Rows with equal or no id are encoded
one by one; an empty table gives no row.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import empty_if_null, per_process

LEAF = 16
SEAM = 4
CACHE_CHUNKS = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


NO_MERGE = 1 << 62


class PairRanks(dict):
    """Id that two neighbouring ids merge to, by ``left << 32 | right``."""

    def __init__(self, ranks: dict[bytes, int], tokens: dict[int, bytes]):
        self.ranks, self.tokens = ranks, tokens

    def __missing__(self, key: int) -> int:
        if len(self) > CACHE_CHUNKS:
            self.clear()
        whole = self.tokens[key >> 32] + self.tokens[key & 0xFFFFFFFF]
        self[key] = found = self.ranks.get(whole, NO_MERGE)
        return found


class Elements(dict):
    """Elements by text, made when first asked for; long ones are not kept."""

    def __init__(self, make, lead: str = ""):
        self.make, self.lead = make, lead

    def __missing__(self, text: str) -> tuple[int, str, bytes]:
        found = self.make(self.lead + text)
        if len(text) <= 64:
            if len(self) > CACHE_CHUNKS:
                self.clear()
            self[text] = found
        return found


class Codec:
    """Encoder and decoder of one rank file and splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        self.merged = PairRanks(ranks, self.tokens)
        # White space as the Unicode property; the module's own \s has more.
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        # A blank next to other white space on both sides may belong to a longer run.
        self.runs = regex.compile(r"\p{White_Space} \p{White_Space}|  ")
        self.matches = Elements(self.element)
        self.spaced = Elements(self.chunk, " ")
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Merge the pair of least rank, leftmost first, until none is left."""
        pair, ids = self.merged, [self.bytes[b] for b in data]
        ranks = [pair[l << 32 | r] for l, r in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_MERGE:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [best]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = pair[best << 32 | ids[at + 1]]
            if at:
                ranks[at - 1] = pair[ids[at - 1] << 32 | best]
        return ids

    def settled(self, left: int, right: int) -> bool:
        """Whether two tokens side by side encode to themselves."""
        key = (left, right)
        if key not in self.pairs:
            if len(self.pairs) > CACHE_CHUNKS:
                self.pairs.clear()
            self.pairs[key] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return self.pairs[key]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joined bytes of two encodings."""
        if not left or not right or self.settled(left[-1], right[0]):
            return left + right
        width = SEAM
        while True:
            head, tail = left[: max(0, len(left) - width)], right[width:]
            seam = left[len(head) :] + right[:width]
            middle = self.merge(self.decode(seam)) if len(seam) <= 8 * SEAM else self._wide(seam)
            if (not head or self.settled(head[-1], middle[0])) and (not tail or self.settled(middle[-1], tail[0])):
                return head + middle + tail
            width *= 2

    def _wide(self, seam: list[int]) -> list[int]:
        """A long window, re-encoded from its bytes in leaves from the left."""
        data, out = self.decode(seam), []
        for at in range(0, len(data), LEAF):
            out = self.join_short(out, self.merge(data[at : at + LEAF]))
        return out

    def join_short(self, left: list[int], right: list[int]) -> list[int]:
        """Join a leaf at the right: windows grow to the left only."""
        width = SEAM
        while left and not self.settled(left[-1], right[0]):
            head = left[: max(0, len(left) - width)]
            middle = self.merge(self.decode(left[len(head) :] + right))
            if not head or self.settled(head[-1], middle[0]):
                return head + middle
            width *= 2
        return left + right

    def encode_match(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.encode_match(data[:half]), self.encode_match(data[half:]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) > 1024:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join([self.tokens[i] for i in ids])

    def element(self, match: str) -> tuple[int, str, bytes]:
        """Number of ids, their text, and the bytes that they decode to."""
        ids = self.encode_match(match.encode())
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def chunk(self, text: str) -> tuple[int, str, bytes]:
        """The joined elements of the matches of a stretch between match ends."""
        parts = list(map(self.matches.__getitem__, self.split.findall(text)))
        return parts[0] if len(parts) == 1 else joined(parts)

    def text(self, text: str) -> tuple[int, str, bytes]:
        """The element of a whole text, cut before single blanks where it may be:
        a match never ends in the blank that opens the next one."""
        if self.runs.search(text):
            return self.chunk(text)
        first, *rest = text.split(" ")
        parts = [self.chunk(first)] if first else []
        parts += map(self.spaced.__getitem__, rest)
        return joined(parts)


def joined(parts: list[tuple[int, str, bytes]]) -> tuple[int, str, bytes]:
    if not parts:
        return 0, "", b""
    counts, ids, data = zip(*parts)
    return sum(counts), " ".join(ids), b"".join(data)


def encode_decode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Ids of every whole text and the bytes decoded from them, as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_process(("bpe", ranks_path, pattern), lambda: Codec(load_ranks(ranks_path), pattern), large=True)
        for batch in batches:
            rows = [codec.text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in rows], pa.string()),
                    pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("d"), empty_if_null(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The ids themselves: doc_id and an array of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_process(("bpe", ranks_path, pattern), lambda: Codec(load_ranks(ranks_path), pattern), large=True)
        for batch in batches:
            ids = [[int(i) for i in codec.text(t)[1].split()] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("d"), empty_if_null(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")
