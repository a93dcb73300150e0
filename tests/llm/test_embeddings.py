import math

import numpy as np
import pytest

from auditspark.llm import embeddings


def brute(rows, threshold=0.9):
    units = []
    for _, v in rows:
        x = np.asarray([np.nan if c is None else c for c in v or []], float)
        good = len(x) and np.isfinite(x).all() and np.abs(x).max() > 0
        units.append(x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) if good else None)
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = units[i], units[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, links[i], least.get(find(i)), least.get(find(i)) == d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=300, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((20, dim))
    rows = []
    for k in range(n):
        v = base[rng.integers(20)] + rng.standard_normal(dim) * rng.choice([0.0, 0.1, 0.3, 0.6])
        rows.append((k, v.tolist()))
    return rows


SPECIAL = [
    (900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] + [1.0] * 23), (904, [None] + [1.0] * 23),
    (905, [float("inf")] * 24), (906, [1e-300] * 24), (907, [1e300] * 24), (908, [1.0, 2.0]), (908, [1.0, 2.0]), (None, [1.0, 2.1]),
]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumnRenamed("x", "y").selectExpr("*", "1 as key", "2 as id")


@pytest.mark.parametrize("bucket, block", [(2048, 1024), (40, 1024), (2048, 16)])
def test_equals_brute_force(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings.tables, "__defaults__", (bucket, 0.99999))
    rows = corpus(4) + SPECIAL
    got = [tuple(r) for r in embeddings.near_duplicates(table(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    unit = rng.standard_normal((400, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rotated = unit @ embeddings.rotation(64, 0).T
    code = np.where(rotated > 0, 1, -1) / math.sqrt(64)
    factor = np.abs(rotated).sum(1) / math.sqrt(64)
    off = ~np.eye(400, dtype=bool)
    miss = (code @ rotated.T / factor[:, None] - unit @ unit.T)[off]
    assert abs(miss.mean()) < 0.005
    error = np.sqrt((1 - factor**2) / factor**2 / 63)
    assert (np.abs(miss) <= embeddings.SIGMAS * np.repeat(error, 399)).mean() > 0.9999


def test_tables_grow_with_the_logarithm():
    assert embeddings.tables(1000, 0.9) == (0, 1)
    bits, count = embeddings.tables(2_000_000, 0.9)
    hit = (1 - math.acos(0.9) / math.pi) ** bits
    assert bits == 10 and 1 - (1 - hit) ** count >= embeddings.RECALL


def test_empty_table(spark):
    assert embeddings.near_duplicates(table(spark, [])).collect() == []
