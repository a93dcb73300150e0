"""Packing of tokenized documents into windows by minimum bin slack.

Each document is cut into whole windows and one remainder; whole windows are
sequences as they are.  Remainders are known by their lengths alone: a table of
at most ``window - 1`` counts, whatever the number of documents.  On it the
plan is made: the longest remaining length opens a window, and a subset-sum
dynamic program over bitsets finds the multiset of remaining lengths that comes
closest to the free space; its counts are read off by backtracking and the
pattern is repeated as often as the counts allow.  The plan is at most a few
entries for each pattern, and patterns are bounded by the lengths as well.
Pieces then take their places by rank within their length: a running number
inside the task that cut them plus the counts of the tasks before.

``<|startoftext|>`` and ``<|endoftext|>`` in a text have ids of their own, as the
tokenizer's default gives them.

Null texts are empty; an empty text is the closing id alone.  Rows with the
same or no id are documents of their own.  An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import empty_if_null, give_back, per_process, slices, store

WINDOW = 2048
END_ID = 1
#: Words whose ids a worker remembers (about 200 bytes each), and text split at a time.
CACHE_WORDS = 1_200_000
SLICE_BYTES = 1 << 20
#: A token of its own between blanks, and how many words go through the tokenizer at a time.
MARK = "\0"
JOINED_WORDS = 64
#: Signs that end a word; a run of them after an ASCII letter or digit is split off by the tokenizer.
ENDINGS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordIds(dict):
    """Ids of words between ASCII white space, as little-endian 32-bit numbers.

    The tokenizer drops white space and never merges across it, so a text's ids
    are those of its words in order.  Words of a-z alone pass its normalizers and its
    split unchanged, so its BPE model takes them as they are; other unknown words go
    through the whole tokenizer, joined by a mark whose token separates their ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.mark = self.ids_of(MARK)
        #: Their strings in a text are tokens of their own, as the tokenizer has it.
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def ids_of(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def joined(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, of one call; words that hold the mark are taken one by one."""
        ids = np.frombuffer(self.ids_of(f" {MARK} ".join([w.decode() for w in words])), "<u4")
        cuts = np.flatnonzero(ids == np.frombuffer(self.mark, "<u4")[0])
        if len(self.mark) != 4 or len(cuts) != len(words) - 1:
            return [self.ids_of(w.decode()) for w in words]
        data, cuts = ids.tobytes(), (4 * cuts).tolist()
        return [data[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(data)])]

    def learn(self, words: set[bytes]) -> None:
        """Ids of new words, which are in ASCII lower case already.  A run of signs
        after a letter or digit is a token run of its own, so most words with one
        need no encoding of their own."""
        new = set(filterfalse(self.__contains__, words))  # a difference would pass through all known words
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = words
        tailed = {}
        for w in new:
            if w[-1] in ENDINGS and (base := w.rstrip(ENDINGS))[-1:].isalnum():
                tailed[w] = base
        tails = {w[len(base) :] for w, base in tailed.items()}
        tokenize, rest = self.model.tokenize, []
        for w in {*tailed.values()} | tails | (new - tailed.keys()):
            if w in self:
                continue
            if w.isalpha():
                self[w] = array("I", [t.id for t in tokenize(w.decode())]).tobytes()
            else:
                rest.append(w)
        for a in range(0, len(rest), JOINED_WORDS):
            some = rest[a : a + JOINED_WORDS]
            self.update(zip(some, self.joined(some)))
        for w, base in tailed.items():
            self[w] = self[base] + self[w[len(base) :]]

    def encode_all(self, texts: list[bytes] | pa.BinaryArray) -> Iterator[bytes]:
        """Slices of about a megabyte, so that few texts and words exist at a time."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.binary())
        for a, b in slices(pc.binary_length(texts).to_pylist(), SLICE_BYTES):
            yield from self.encode(texts[a:b].to_pylist())

    def encode(self, texts: list[bytes]) -> list[bytes]:
        lowered = [t.lower() for t in texts]
        whole = {k for k, t in enumerate(lowered) if any(s in t for s in self.special)}
        split = [t.split() if k not in whole else [] for k, t in enumerate(lowered)]
        self.learn(set(chain.from_iterable(split)))
        ids = [b"".join(map(self.__getitem__, words)) for words in split]
        for k in whole:
            ids[k] = self.ids_of(texts[k].decode())
        return ids


PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]


def cut_pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, window: int, end_id: int) -> DataFrame:
    """Tokenize whole texts and cut them into windows and a remainder each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = per_process(("word ids", tokenizer), lambda: WordIds(tokenizer), large=True)
        end = np.asarray([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            give_back()
            out: list[list] = [[] for _ in range(7)]
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode_all(batch.column(1))):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    length = min(window, total - start)
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    for column, value in zip(out, (doc, start, length, crc, total, part, seen[length])):
                        column.append(value)
                    seen[length] += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [pa.array(v, t) for v, t in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=PIECES)

    rows = docs.select(F.col(id_col).cast("long").alias("d"), empty_if_null(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(
        cut, "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, nth long"
    )


def fill(counts: dict[int, int], space: int) -> dict[int, int]:
    """The multiset of lengths within the counts whose sum comes closest to
    ``space`` without exceeding it: bitset subset sums, then backtracking."""
    mask = (1 << (space + 1)) - 1
    reach, steps = 1, []
    for length in sorted((k for k, n in counts.items() if n and k <= space), reverse=True):
        left, take = min(counts[length], space // length), 1
        while left:  # binary splitting: 1, 2, 4, ... copies at once
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> space & 1:
            break
    at, found = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            found[length] = found.get(length, 0) + take
            at -= length * take
    return found


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first sequence, copies in a window, offset)."""
    left, used = {k: n for k, n in counts.items() if n}, Counter()
    rows, sequence = [], 0
    for length in sorted(left, reverse=True):
        while left[length]:
            left[length] -= 1
            pattern = Counter(fill(left, window - length))
            left[length] += 1
            pattern[length] += 1
            times = min(left[k] // c for k, c in pattern.items())
            offset = 0
            for k, c in sorted(pattern.items(), reverse=True):
                rows.append((k, used[k], c * times, sequence, c, offset))
                used[k] += c * times
                left[k] -= c * times
                offset += k * c
            sequence += times
    return rows


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    pieces = store(cut_pieces(docs, tokenizer, id_col, text_col, window, end_id), "pieces")
    per_part = store(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece_counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = np.asarray(sorted(plan(counts, window)) or np.empty((0, 6)), np.int64).reshape(-1, 6)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = rows[:, 0] << 48 | rows[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank")}
            hit = rows[np.searchsorted(key, col["length"].astype(np.int64) << 48 | col["rank"], "right") - 1]
            nth = col["rank"] - hit[:, 1]
            sequence, offset = hit[:, 3] + nth // hit[:, 4], hit[:, 5] + nth % hit[:, 4] * hit[:, 0]
            arrays = [batch.column(n) for n in names[:5]] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    # Both sides have a row for each task and length or more: neither is broadcast.
    ranked = pieces.join(bases.hint("merge"), ["length", "part"]).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("base") + F.col("nth")).alias("rank"),
    )
    return ranked.mapInArrow(place, ", ".join(f"{n} long" for n in names))
