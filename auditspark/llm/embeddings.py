"""Near-duplicate embeddings by randomised-rotation binary codes.

Equal vectors are one class.  A class's unit vector is rotated at random; the
signs are its code, and the stored factor is the inner product of the vector
with its code's unit vector.  The inner product of a code with another rotated
vector over that factor is an unbiased estimate of their cosine, and the factor
bounds its error: pairs whose upper bound stays below the threshold are left
out, all others are computed again in double precision.

Which pairs are looked at: signs of further rotated coordinates are grouped into
tables of b bits, b growing with the logarithm of the number of classes, and as
many tables as give a pair just at the threshold a common bucket with the
stated probability.  Pairs are counted in the first table that they share, in
blocks, so a large bucket is spread over tasks; tasks return counts and spanning
forests, never all pairs.

Null, empty, zero and non-finite vectors link with nothing; vectors of unequal
length never link.  Rows that repeat a vector link with each other, whatever
their ids.  A null id takes no part in the smallest id.  An empty table gives no
row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from auditspark.operators.joins import lookup_join

from .common import block_pairs, per_process, row_groups, store
from .components import components

BUCKET = 2048
BLOCK = 1024
#: Chance that a pair just at the threshold shares a bucket.
RECALL = 0.995
#: Half width of the confidence interval in standard errors of the estimate.
SIGMAS = 4.5


def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""

    def make() -> np.ndarray:
        q, r = np.linalg.qr(np.random.default_rng((number, dim)).standard_normal((dim, dim)))
        return q * np.sign(np.diag(r))

    return per_process(("rotation", dim, number), make)


def tables(n: int, threshold: float, bucket: int = BUCKET, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table's key and number of tables."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / bucket)))
    same = 1 - math.acos(threshold) / math.pi
    hit = same**bits
    return bits, 1 if bits == 0 else math.ceil(math.log(1 - recall) / math.log(1 - hit))


def signs(unit: np.ndarray, n: int) -> np.ndarray:
    """The first n signs of the vectors under one rotation after another."""
    dim = unit.shape[1]
    parts = [unit @ rotation(dim, 1 + k).T > 0 for k in range(-(-n // dim))]
    return np.concatenate(parts, axis=1)[:, :n] if parts else np.zeros((len(unit), 0), bool)


def keys_of(unit: np.ndarray, bits: int, count: int) -> np.ndarray:
    """Key of every vector in every table."""
    if not bits:
        return np.zeros((len(unit), 1), np.int64)
    weights = 1 << np.arange(bits, dtype=np.int64)
    return signs(unit, bits * count).reshape(len(unit), count, bits) @ weights


def compare(unit: np.ndarray, keys: np.ndarray, table: int, side: np.ndarray, threshold: float):
    """Index pairs (i < j) of one bucket that reach the threshold and share no
    earlier table; with two blocks only pairs across."""
    dim = unit.shape[1]
    rotated = unit @ rotation(dim, 0).T
    code = np.where(rotated > 0, 1.0, -1.0).astype(np.float32) / np.float32(math.sqrt(dim))
    factor = np.abs(rotated).sum(1) / math.sqrt(dim)
    error = SIGMAS * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(dim - 1, 1))
    low = ((threshold - error) * factor - 1e-5).astype(np.float32)
    found = []
    for a in range(0, len(unit), 512):
        estimate = code[a : a + 512] @ rotated.astype(np.float32).T
        i, j = np.nonzero(estimate >= low[a : a + 512, None])
        i += a
        # Either of two estimates may decide; the code of the smaller index does.
        keep = i < j
        if len(set(side.tolist())) > 1:
            keep &= side[i] != side[j]
        i, j = i[keep], j[keep]
        if table:
            fresh = (keys[i, :table] != keys[j, :table]).all(1)
            i, j = i[fresh], j[fresh]
        cosine = np.einsum("ij,ij->i", unit[i], unit[j])
        found.append((i[cosine >= threshold], j[cosine >= threshold]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    root, edges = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            edges.append((a, b))
    return edges


def classes_of(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, key (null: no direction) and unit vector of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, units = [], []
            for v in batch.column(1).to_pylist():
                x = np.asarray([np.nan if c is None else c for c in v or []], np.float64)
                big = np.abs(x).max() if len(x) else 0.0
                if not len(x) or not np.isfinite(x).all() or big == 0:
                    keys.append(None)
                    units.append(None)
                    continue
                x = x / big  # no overflow or underflow of squares
                x = x / math.sqrt(float(x @ x)) + 0.0
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                units.append(x.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], names=["id", "key", "unit"]
            )

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id long, key binary, unit binary")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = store(classes_of(vectors, id_col, vector_col), "vectors")
    classes = store(
        rows.where("key is not null").groupBy("key")
        .agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("unit").alias("unit")),
        "classes",
    )
    bits, count = tables(classes.count(), threshold)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_dim: dict[int, list[int]] = {}
            raw = batch.column("unit").to_pylist()
            for k, u in enumerate(raw):
                by_dim.setdefault(len(u) // 8, []).append(k)
            for dim, at in by_dim.items():
                found = keys_of(np.stack([np.frombuffer(raw[k]) for k in at]), bits, count)
                rows = batch.take(pa.array(at))
                for t in range(count):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim] * len(at), pa.int32()), pa.array([t] * len(at), pa.int32()), pa.array(found[:, t]),
                         rows.column("key"), rows.column("copies"), rows.column("unit")],
                        names=["dim", "tbl", "bucket", "key", "copies", "unit"],
                    )

    entries = store(
        classes.select("key", "copies", "unit").mapInArrow(
            spread, "dim int, tbl int, bucket long, key binary, copies long, unit binary"
        ),
        "buckets",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, tbl, _, _, _), group in row_groups(batches, 5):
            if len(group) < 2:
                continue
            unit = np.stack([np.frombuffer(r[8]) for r in group])
            keys = keys_of(unit, bits, count)
            i, j = compare(unit, keys, tbl, np.asarray([r[5] for r in group]), threshold)
            copies = np.asarray([r[7] for r in group], np.int64)
            links = np.bincount(i, copies[j], len(group)) + np.bincount(j, copies[i], len(group))
            linked = np.flatnonzero(links)
            edges = forest(len(group), i, j)
            if not len(linked):
                continue
            name = lambda at: [group[k][6] for k in at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(name(linked) + name([e[0] for e in edges]), pa.binary()),
                    pa.array([None] * len(linked) + name([e[1] for e in edges]), pa.binary()),
                    pa.array(links[linked].astype(np.int64).tolist() + [0] * len(edges), pa.int64()),
                ],
                names=["a", "b", "links"],
            )

    placed = block_pairs(entries, ["dim", "tbl", "bucket"], "key", BLOCK).select(
        "dim", "tbl", "bucket", "i", "j", "mine", "key", "copies", "unit"
    )
    together = placed.repartition("dim", "tbl", "bucket", "i", "j").sortWithinPartitions("dim", "tbl", "bucket", "i", "j", "key")
    found = store(together.mapInArrow(run, "a binary, b binary, links long"), "links")
    degrees = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b is not null")).withColumnRenamed("node", "key")
    known = store(classes.select("key", "copies", "least").join(roots, "key", "left").join(degrees, "key", "left").select(
        "key", "copies", "least", F.coalesce("root", "key").alias("root"), F.coalesce("links", F.lit(0)).alias("links")
    ), "rooted")
    smallest = known.groupBy("root").agg(F.min("least").alias("component"))
    # A large component is one root, and copies share one key: neither is joined in one task.
    known = lookup_join(known, smallest, ["root"], "inner", ["key"])
    known = store(known.select("key", (F.col("links") + F.col("copies") - 1).alias("n"), "component"), "named")
    out = lookup_join(rows.select("id", "key"), known, ["key"], "left", ["id"])
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )
