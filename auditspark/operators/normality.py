"""Normality of the bias within groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.dist import p_shapiro
from ..functions.numeric import norm_ppf
from .ranking import _C, running_counts, value_counts

RUN = 1 << 14

# Polynomials of Royston's 1995 end weights in 1/sqrt(n) (fixed values).
_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)


def _poly(coefs: tuple, x):
    out = F.lit(coefs[-1])
    for k in reversed(coefs[:-1]):
        out = out * x + F.lit(k)
    return out


def order_scores(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each value at each of its ranks i = 1..n with the normal score of i.

    Equal values are one counted row with a run of ranks; long runs are cut in
    pieces that are spread over the tasks before they are expanded.
    """
    ranked = running_counts(value_counts(df, keys, value), keys, [value]).withColumnRenamed("__total", "n")
    pieces = ranked.withColumn(
        "__piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(_C) - 1) / RUN)))
    ).repartition(*keys, value, "__piece")
    first = F.col("__below") + F.col("__piece") * RUN + 1
    last = F.least(first + RUN - 1, F.col("__below") + F.col(_C))
    return pieces.withColumn("i", F.explode(F.sequence(first, last))).select(
        *keys, value, "n", "i", norm_ppf((F.col("i") - F.lit(0.375)) / (F.col("n") + F.lit(0.25))).alias("m")
    )


def shapiro_wilk(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """W and p per group of at least three values (p is calibrated to n = 5000).

    Interior weights are proportional to the normal scores and the two outer
    pairs have their own polynomials, so W needs only sums: two passes.
    """
    scores = order_scores(df, keys, value)
    v, m, n = F.col(value), F.col("m"), F.col("n")
    sums = scores.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.sum(m * m).alias("ss_m"),
        F.sum(m * v).alias("mv"),
        F.max(m).alias("m1"),
        F.max(F.when(F.col("i") == n - 1, m)).alias("m2"),
        F.max(v).alias("x_hi1"),
        F.min(v).alias("x_lo1"),
        F.max(F.when(F.col("i") == n - 1, v)).alias("x_hi2"),
        F.max(F.when(F.col("i") == 2, v)).alias("x_lo2"),
        (F.var_pop(v) * F.count(v)).alias("ss_x"),
    )
    u = F.lit(1.0) / F.sqrt(F.col("n").cast("double"))
    root = F.sqrt("ss_m")
    a1 = F.when(F.col("n") == 3, F.sqrt(F.lit(0.5))).otherwise(F.try_divide(F.col("m1"), root) + _poly(_LAST, u))
    a2 = F.try_divide(F.col("m2"), root) + _poly(_NEXT, u)
    wide = F.col("n") > 5
    m1, m2 = F.col("m1"), F.col("m2")
    num = F.col("ss_m") - 2 * m1 * m1 - F.when(wide, 2 * m2 * m2).otherwise(F.lit(0.0))
    den = F.lit(1.0) - 2 * F.col("a1") * F.col("a1") - F.when(wide, 2 * F.col("a2") * F.col("a2")).otherwise(F.lit(0.0))
    scale = F.sqrt(F.try_divide(den, F.nullif(num, F.lit(0.0))))
    outer1 = F.col("x_hi1") - F.col("x_lo1")
    outer2 = F.col("x_hi2") - F.col("x_lo2")
    inner = F.col("mv") - m1 * outer1 - F.when(wide, m2 * outer2).otherwise(F.lit(0.0))
    linear = (
        F.col("a1") * outer1
        + F.when(wide, F.col("a2") * outer2).otherwise(F.lit(0.0))
        + F.when(F.col("n") == 3, F.lit(0.0)).otherwise(inner * F.col("scale"))
    )
    w = F.try_divide(F.col("lin") * F.col("lin"), F.nullif(F.col("ss_x"), F.lit(0.0)))
    out = sums.where(F.col("n") >= 3).withColumns({"a1": a1, "a2": a2}).withColumn("scale", scale).withColumn("lin", linear)
    out = out.withColumn("w", F.least(w, F.lit(1.0)))
    out = out.withColumn("w", F.when(F.col("ss_x") > 0, F.col("w")))
    return out.select(*keys, "n", "w").withColumn("p_value", p_shapiro(F.col("w"), F.col("n"))).withColumn(
        "is_normal", F.col("p_value") > 0.05
    )


def moment_normality(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Skewness, excess kurtosis and the Jarque-Bera statistic per group.

    The companion of W for large groups: one aggregate, exact p (chi-square
    with two degrees of freedom).
    """
    v = F.col(value)
    out = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("n"), F.var_pop(v).alias("__var"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt")
    )
    usable = F.col("__var") > 0
    jb = F.col("n") / F.lit(6.0) * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4)
    return (
        out.withColumns({"skew": F.when(usable, F.col("skew")), "kurt": F.when(usable, F.col("kurt"))})
        .withColumn("jarque_bera", jb)
        .withColumn("p_value", F.exp(-F.col("jarque_bera") / 2))
        .drop("__var")
    )
