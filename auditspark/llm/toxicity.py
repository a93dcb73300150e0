"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text.  Both begin with the
same stretch of the most common words; one goes on with the words of toxic texts
that ordinary texts hardly use, the other with as many bytes of ordinary words.
Beginnings of words count like words.  Every word of a text is a window; it is compressed with both behind a fixed lead
that both hold, as two bytes per character, so that a match weighs more than its
own cost.  The gain of a window is the ordinary length less the toxic one.  A
document's largest gains and how many windows pass the thresholds enter a
logistic model, calibrated on labelled documents that no dictionary saw.

Learning uses labelled rows whose crc32(doc_id as text) mod 5 is not 0: folds 2
to 4 for the dictionaries, fold 1 for the calibration, ``FIT_DOCS`` documents at
most in expectation, drawn by a hash of the id.  Ids, labels, languages and
sources never enter a score.

Null and empty texts have no window and get the score of zero gains.  Rows with
equal ids are scored one by one; of several labels of an id the largest counts;
a null id is in fold 0.  Without both classes in either fold group every score
is 0.  An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import empty_if_null, give_back, per_process

#: Labelled documents that the model is fitted on, at most (in expectation).
FIT_DOCS = 20_000
FOLDS = 5
LEAD = bytes(range(128, 192))
PUNCTUATION = b".,;:!?*%&$#|"
COMMON_BYTES = 64 << 10
TOXIC_BYTES = 12 << 10
MIN_ODDS = 20.0
MIN_DOCS = 3
MIN_STEM, MAX_STEM = 4, 9
CACHE_WORDS = 1 << 20
LEVEL, MIN_MATCH = 16, 3


def fold(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(0))


def two_bytes(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").encode("utf-16-le")


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...] | None

    @property
    def key(self) -> str:
        return hashlib.sha256(self.ordinary + self.toxic).hexdigest()


class Gains(dict):
    """Gain of each window, by the lower-case word as it stands in the text."""

    def __init__(self, model: Model):
        import zstandard

        def compressor(content: bytes):
            parameters = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, dict_size=len(content), source_size=80, min_match=MIN_MATCH,
                write_content_size=False, write_dict_id=False, write_checksum=False,
            )
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(dict_data=raw, compression_params=parameters)

        self.ordinary, self.toxic = compressor(model.ordinary), compressor(model.toxic)

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(PUNCTUATION)
        if bare != word:
            gain = self[bare]
        else:
            window = LEAD + two_bytes(b" " + bare + b" ")
            gain = len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = gain
        return gain


FEATURES = 7


def features(gains: list[int]) -> list[float]:
    if not gains:
        return [0.0] * FEATURES
    g = np.fromiter(gains, np.int32, len(gains))
    high = np.sort(g[g > 0])[::-1]
    top = [float(x) for x in high[:3]] + [0.0] * (3 - min(3, len(high)))
    return [*top, float(np.sqrt((g >= 4).sum())), float(np.sqrt((g >= 6).sum())), float((g >= 5).mean()),
            float(np.maximum(g - 3, 0).mean())]


def measured(rows: DataFrame, model: Model) -> DataFrame:
    """All columns of ``rows`` (text as column t) less t, plus the features f."""
    keep = [c for c in rows.columns if c != "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = per_process(("toxicity", model.key), lambda: Gains(model), large=True)
        for batch in batches:
            give_back()
            found = [
                features(list(map(gains.__getitem__, t.as_buffer().to_pybytes().lower().split())))
                for t in batch.column("t")
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(found, pa.list_(pa.float64()))], names=[*keep, "f"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", f array<double>")


def _words(text: Column) -> Column:
    parts = F.split(F.lower(text), r"[\x20\x09-\x0D]+")
    return F.array_distinct(F.transform(parts, lambda w: F.regexp_replace(w, r"^[.,;:!?*%&$#|]+|[.,;:!?*%&$#|]+$", "")))


def longest(parts: list[tuple[str, int]]) -> list[bytes]:
    """Words and stems less the stems that one longer part stands for nearly everywhere."""
    counts, shorter = dict(parts), set()
    for part, n in parts:
        stems = [part[:k] for k in range(MIN_STEM, len(part.rstrip()))]
        shorter.update(s for s in stems if n >= 0.8 * counts.get(s, n * 2))
    return [part.encode() for part, _ in parts if part not in shorter]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Weights of the raw features after the constant, by Newton steps."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / spread]
    w, penalty = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-6)[:, None]) + penalty, a.T @ (p - y) + penalty @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    raw = w[1:] / spread
    return (float(w[0] - raw @ mean), *map(float, raw))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", fit_docs: int = FIT_DOCS) -> Model:
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .where("y in (0, 1) and id is not null").groupBy("id").agg(F.max("y").alias("y"))
        .withColumn("fold", fold("id")).where("fold <> 0")
    )
    share = min(1.0, fit_docs / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    rows = docs.select(F.col(id_col).alias("id"), empty_if_null(text_col).alias("text"))
    sample = rows.join(F.broadcast(drawn), "id")  # the draw is bounded by fit_docs
    # Learn words of folds 2 to 4: in how many texts of either class they stand.
    words = sample.where("fold > 1").select("y", F.explode(_words(F.col("text"))).alias("w")).where("w <> ''")
    totals = {r["y"]: r["n"] for r in drawn.where("fold > 1").groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    counts = words.groupBy("w").agg(F.sum(1 - F.col("y")).alias("c0"), F.sum("y").alias("c1"))
    odds = (F.col("c1") + 0.5) / (n1 + 1) / ((F.col("c0") + 0.5) / (n0 + 1))
    # Beginnings of words count as well: a stem may take endings that were never seen.
    sizes = F.sequence(F.lit(MIN_STEM), F.least(F.length("w") - 1, F.lit(MAX_STEM)))
    stems = counts.where(F.length("w") > MIN_STEM).select(
        F.explode(F.transform(sizes, lambda n: F.substring(F.col("w"), F.lit(1), n))).alias("w"), "c0", "c1"
    ).groupBy("w").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    parts = counts.withColumn("w", F.concat("w", F.lit(" "))).unionByName(stems)
    # Both lists are bounded: a dictionary holds no more words than bytes over two.
    telling = parts.where((odds >= MIN_ODDS) & (F.col("c1") >= MIN_DOCS)).orderBy(F.desc("c1"), "w").limit(TOXIC_BYTES // 2)
    common = counts.where(F.col("c0") >= MIN_DOCS).orderBy(F.desc("c0"), "w").limit(COMMON_BYTES // 2)
    toxic_words = longest([(r["w"], r["c1"]) for r in telling.select("w", "c1").collect()])
    common_words = [r["w"].encode() for r in common.select("w").collect()]
    if not toxic_words or not common_words:
        return Model(LEAD, LEAD, None)
    # The most frequent words stand last, where matches cost least.
    ending = b"".join(b" " + w.rstrip() for w in reversed(toxic_words))[-TOXIC_BYTES:] + b" "
    shared = (b" " + b" ".join(reversed(common_words)))[-COMMON_BYTES:]
    filler = b" ".join(reversed(common_words[len(common_words) // 2 :]))
    tail, other = two_bytes(ending), two_bytes(filler)
    start = two_bytes(shared)
    model = Model(start + other[-len(tail) :] + LEAD, start + tail + LEAD, None)
    held = sample.where("fold = 1").select("y", F.col("text").cast("binary").alias("t"))
    points = measured(held, model).collect()
    y = np.asarray([r["y"] for r in points], float)
    if not len(y) or y.min() == y.max():
        return model
    x = np.asarray([r["f"] for r in points], float)
    return Model(model.ordinary, model.toxic, logistic(x, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    if model.weights is None:
        value = F.lit(0.0)
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), fold(id_col).alias("fold"))
    else:
        plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), fold(id_col).cast("int").alias("fold"),
                            empty_if_null(text_col).cast("binary").alias("t"))
        rows = measured(plain, model)
        value = _probability(model)
    return rows.select(
        "doc_id", (F.col("fold") == 0).alias("held_out"), value.alias("score"), (value >= 0.5).cast("int").alias("predicted")
    )


def _probability(model: Model) -> Column:
    linear = F.lit(model.weights[0])
    for k, w in enumerate(model.weights[1:]):
        linear = linear + F.col("f")[k] * F.lit(w)
    return 1 / (1 + F.exp(-linear))


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of documents that the model does not reject, all columns kept."""
    if model.weights is None:
        return docs
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)  # any column names, also the ones used here
    text = F.col(names[docs.columns.index(text_col)])
    rows = measured(plain.withColumn("t", F.coalesce(text.cast("string"), F.lit("")).cast("binary")), model)
    return rows.where(_probability(model) < 0.5).select(*names).toDF(*docs.columns)
