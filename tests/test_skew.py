"""Hot keys, ties and layouts must not change results."""

import random

import pytest
from pyspark.sql import functions as F

from auditspark.columns import AuditColumns
from auditspark.operators import joins, labelling, normality, ranking, sampling, stat_tests

C = AuditColumns(row_id="id", block="block", label="label", model="model", cohort="cohort")


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group, with long runs of one value."""
    random.seed(1)
    rows = []
    for i in range(6000):
        g = "hot" if i % 3 == 0 else f"g{i % 40}"
        v = 5.0 if i % 4 == 0 else round(random.gauss(0, 100), 3)
        rows.append((i, g, i % 7 == 0, v))
    rows.append((6000, "hot", True, 1e12))
    return spark.createDataFrame(rows, "id long, block string, label boolean, v double").repartition(16)


def test_quantiles_equal_builtin(skewed):
    probs = {"p0": 0.0, "p10": 0.1, "median": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["block"]: r for r in ranking.exact_quantiles(skewed, ["block"], {"v": F.col("v")}, probs).collect()}
    want = skewed.groupBy("block").agg(*[F.percentile("v", F.lit(p)).alias(f"{n}_v") for n, p in probs.items()]).collect()
    assert len(got) == len(want)
    for row in want:
        for name in probs:
            assert got[row["block"]][f"{name}_v"] == pytest.approx(row[f"{name}_v"], rel=1e-12)


def test_quantiles_of_constant_and_empty(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, None)], "k int, v double")
    rows = ranking.exact_medians(df, ["k"], {"v": F.col("v")}).collect()
    assert [(r["k"], r["median_v"]) for r in rows] == [(1, 2.0)]
    assert ranking.exact_medians(df.where("k = 9"), [], {"v": F.col("v")}).collect()[0]["median_v"] is None


def test_average_ranks(skewed):
    got = {r["v"]: r["rk"] for r in ranking.average_ranks(skewed, "v", "rk").collect()}
    values = sorted(r["v"] for r in skewed.select("v").collect())
    for v in (5.0, values[0], values[-1]):
        first = values.index(v)
        assert got[v] == first + (values.count(v) + 1) / 2


def test_salted_join_equals_plain(spark, skewed):
    dim = spark.createDataFrame([("hot", 1), ("g1", 2), ("nobody", 3)], "block string, x int")
    skewed = skewed.withColumn("block", F.when(F.col("id") % 11 != 0, F.col("block")))  # and rows without a key
    for how in ("left", "inner"):
        plain = skewed.join(dim, ["block"], how).select("id", "x")
        salted = joins.lookup_join(skewed, dim, ["block"], how, ["id"], limit=0).select("id", "x")
        assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0


def test_hot_keys_are_bounded(skewed):
    found = joins.hot_keys(skewed, ["block"], 8).collect()
    assert [r["block"] for r in found] == ["hot"]
    assert joins.hot_keys(skewed, ["id"], 8).count() == 0


def _sample(rows, seed=4):
    return sampling.balanced_sample(rows.drop("v"), 300, seed, "uniform", 12, c=C)


def test_sample_is_balanced_and_layout_free(skewed):
    base = sorted(r["id"] for r in _sample(skewed).collect())
    assert len(base) == len(set(base)) == 300
    assert sorted(r["id"] for r in _sample(skewed.repartition(3)).collect()) == base
    sample = skewed.where(F.col("id").isin(base))
    assert sampling.unbalanced_blocks(sample, C).count() == 0
    assert sample.groupBy("block").count().agg(F.max("count")).first()[0] <= 24


def test_uncapped_quotas_fill_the_target(skewed):
    blocks = labelling.eligible_blocks(labelling.block_counts(skewed, C))
    total = blocks.agg(F.sum("capacity")).first()[0]
    quotas = sampling.quota_race(blocks, int(total), 1, "sqrt", block="block")
    joined = quotas.join(blocks, "block")
    assert joined.where("quota <> capacity").count() == 0
    assert quotas.agg(F.sum("quota")).first()[0] == total


@pytest.mark.parametrize("mode", ["uniform", "sqrt", "inverse_sqrt"])
@pytest.mark.parametrize("target", [5, 77, 400])
def test_proportional_quotas(skewed, mode, target):
    blocks = labelling.eligible_blocks(labelling.block_counts(skewed, C))
    quotas = sampling.quota_proportional(blocks, target, mode, 30, "block").join(blocks, "block")
    assert quotas.agg(F.sum("quota")).first()[0] == target
    assert quotas.where("quota > least(capacity, 30)").count() == 0


def test_infeasible_target_raises(skewed):
    blocks = labelling.eligible_blocks(labelling.block_counts(skewed, C))
    with pytest.raises(ValueError):
        sampling.feasible_target(blocks, 10**9)
    assert sampling.feasible_target(blocks, 10**9, 2, allow_short=True) > 0


def test_race_follows_sequential_draw(spark):
    """Mean quotas per capacity equal those of drawing one unit at a time."""
    copies, target = 150, 1500
    caps = {f"{k}{i}": v for k, v in {"a": 2, "b": 5, "c": 12, "d": 30}.items() for i in range(copies)}
    blocks = spark.createDataFrame(list(caps.items()), "block string, capacity long")
    quotas = sampling.quota_race(blocks, target, 9, "uniform", block="block")
    got = {r["k"]: r["q"] / copies for r in quotas.groupBy(F.substring("block", 1, 1).alias("k")).agg(F.sum("quota").alias("q")).collect()}
    rng = random.Random(3)
    drawn = dict.fromkeys("abcd", 0)
    trials = 20
    for _ in range(trials):
        left = dict(caps)
        open_blocks = list(left)
        for _ in range(target):
            i = rng.randrange(len(open_blocks))
            pick = open_blocks[i]
            drawn[pick[0]] += 1
            left[pick] -= 1
            if not left[pick]:
                open_blocks[i] = open_blocks[-1]
                open_blocks.pop()
    for k in "abcd":
        assert got[k] == pytest.approx(drawn[k] / trials / copies, abs=0.45)


def test_shapiro_with_ties_equals_direct(skewed):
    import numpy as np
    from statistics import NormalDist

    got = normality.shapiro_wilk(skewed, ["block"], "v").where("block = 'hot'").first()
    x = np.sort(np.array([r["v"] for r in skewed.where("block = 'hot'").collect()]))
    n = len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, root = 1 / np.sqrt(n), np.sqrt((m * m).sum())
    poly = lambda cs: sum(c * u**i for i, c in enumerate(cs))
    a = np.empty(n)
    a[-1], a[-2] = m[-1] / root + poly(normality._LAST), m[-2] / root + poly(normality._NEXT)
    a[0], a[1] = -a[-1], -a[-2]
    inner = slice(2, n - 2)
    a[inner] = m[inner] / np.sqrt(((m * m).sum() - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2))
    w = (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()
    assert got["n"] == n and got["w"] == pytest.approx(w, rel=1e-8)


def test_shapiro_small_published(spark):
    # Eleven weights (lb), a much-used published example: W = 0.79, p < 0.01.
    data = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([("x", float(v)) for v in data], "k string, v double")
    row = normality.shapiro_wilk(df, ["k"], "v").first()
    assert row["w"] == pytest.approx(0.79, abs=0.005)
    assert 0.005 < row["p_value"] < 0.01 and row["is_normal"] is False


def test_spearman_with_hot_values(spark):
    random.seed(2)
    rows = [(1.0 if i % 3 else round(random.random(), 2), float(i % 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "x double, y double")
    got = stat_tests.spearman(df, "x", "y").first()
    import pandas as pd

    pdf = pd.DataFrame(rows, columns=["x", "y"]).rank()
    assert got["n_rows"] == 3000
    assert got["spearman_r"] == pytest.approx(pdf.x.corr(pdf.y), abs=1e-12)


def test_zero_variance_and_tiny_groups(spark):
    df = spark.createDataFrame(
        [("a", True, 1.0), ("a", True, 1.0), ("a", False, 3.0), ("a", False, 3.0), ("b", True, 1.0), ("b", False, 2.0)],
        "k string, label boolean, v double",
    )
    out = {r["k"]: r for r in stat_tests.welch_by(df, ["k"], "v", F.col("label")).collect()}
    assert out["a"]["df"] == 1 and out["a"]["t"] is None and out["a"]["ci_low"] == out["a"]["ci_high"] == -2.0
    assert out["b"]["status"] == "not_estimable" and out["b"]["df"] is None


@pytest.fixture(scope="module")
def lopsided(spark):
    """Sixty per cent zeros, one group in a range of 1e-9 and a few huge values."""
    random.seed(3)
    rows = [(0.0 if i % 10 < 6 else random.gauss(0, 1), "wide") for i in range(30_000)]
    rows += [(1.0 + random.random() * 1e-9, "narrow") for _ in range(10_000)]
    rows += [(1e15 * k, "wide") for k in range(-3, 3)] + [(float(k % 3), "few") for k in range(100)]
    return spark.createDataFrame([(i, k, v) for i, (v, k) in enumerate(rows)], "id long, k string, v double").repartition(8)


def test_selection_narrows_until_no_task_sorts_many(lopsided):
    limit = 20
    places = [0.0, 0.001, 0.35, 0.5, 0.77, 0.999, 1.0]
    chosen = ranking.Selection(lopsided, ["k"], {"v": F.col("v")}, [("v", lambda n, p=p: F.lit(p) * (n - 1)) for p in places], limit)
    assert chosen.most[0] > limit >= chosen.most[-1] and len(chosen.most) <= 4
    inside = chosen.interior_counts().groupBy("k", "t").agg(F.sum("__count").alias("n"))
    assert inside.agg(F.max("n")).first()[0] <= limit
    probs = {f"p{k}": p for k, p in enumerate(places)}
    got = {r["k"]: r for r in ranking.exact_quantiles(lopsided, ["k"], {"v": F.col("v")}, probs, limit).collect()}
    want = lopsided.groupBy("k").agg(*[F.percentile("v", F.lit(p)).alias(f"{n}_v") for n, p in probs.items()]).collect()
    assert len(want) == len(got) == 3
    for row in want:
        for name in probs:
            assert got[row["k"]][f"{name}_v"] == pytest.approx(row[f"{name}_v"], rel=1e-12)


def test_kth_smallest_of_a_narrow_range(lopsided):
    values = sorted(r["v"] for r in lopsided.select("v").collect())
    for k in (1, 17, 20_000, len(values)):
        assert lopsided.sparkSession.range(1).select(ranking.kth_smallest(lopsided, "v", k).alias("v")).first()["v"] == values[k - 1]
    assert lopsided.sparkSession.range(1).select(ranking.kth_smallest(lopsided, "v", len(values) + 1).alias("v")).first()["v"] is None


def test_rank_ranges_are_even(lopsided, monkeypatch):
    stored = []
    keep = ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df, name: stored.append(keep(df, name)) or stored[-1])
    conf = lopsided.sparkSession.conf
    conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it would put so few rows into one task
    counts = ranking.value_counts(lopsided, [], "v")
    got = {r["v"]: (r["__below"], r["__total"]) for r in ranking.running_counts(counts, [], ["v"]).collect()}
    conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in stored[0].groupBy("__part").count().collect()]
    assert max(sizes) <= 2 * counts.count() / 8 + 1
    values = sorted(r["v"] for r in lopsided.select("v").collect())
    first = {v: k for k, v in reversed(list(enumerate(values)))}
    assert got == {v: (k, len(values)) for v, k in first.items()}


def test_running_counts_within_keys(lopsided):
    rows = lopsided.withColumn("__count", F.lit(1))
    got = {r["id"]: (r["__below"], r["__total"]) for r in ranking.running_counts(rows, ["k"], ["v", "id"]).collect()}
    groups = {}
    for r in lopsided.collect():
        groups.setdefault(r["k"], []).append((r["v"], r["id"]))
    want = {i: (place, len(g)) for g in groups.values() for place, (_, i) in enumerate(sorted(g))}
    assert got == want
