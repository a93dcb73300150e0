"""Grouped statistical tests. Aggregates run on the full data; only the last
step (tail probabilities) sees one row per group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..columns import DEFAULT, DELTA_PCT, IS_AI, MEAN_PCT, PCT_POINTS, AuditColumns
from ..functions.dist import p_correlation, p_greater, p_sign, p_two_sided, t_critical
from ..functions.numeric import effect_size, significant, unit_hash
from ..functions.text import model_family
from ..session import materialize
from .joins import fits_broadcast, lookup_join
from .ranking import average_ranks, exact_medians


def two_sample(df: DataFrame, keys: list[str], value: str, first: Column) -> DataFrame:
    """Sizes, means and variances of both samples of ``value``; the first sample
    is where ``first`` is true, the second where it is false."""
    v = F.col(value)
    one, two = F.when(first & v.isNotNull(), v), F.when(~first & v.isNotNull(), v)
    aggs = []
    for tag, x in (("1", one), ("2", two)):
        aggs += [F.count(x).alias("n" + tag), F.avg(x).alias("mean" + tag), F.var_samp(x).alias("var" + tag)]
    return df.groupBy(*keys).agg(*aggs)


def with_welch(stats: DataFrame) -> DataFrame:
    """Add difference, t, degrees of freedom, se, Cohen's d and a status.

    Direction is first minus second. Zero variance on both sides gives no t and
    falls back to the smaller sample size minus one.
    """
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    enough = (n1 >= 2) & (n2 >= 2)
    part1, part2 = F.try_divide(F.col("var1"), n1), F.try_divide(F.col("var2"), n2)
    se2 = part1 + part2
    num = se2 * se2
    den = F.try_divide(part1 * part1, n1 - 1) + F.try_divide(part2 * part2, n2 - 1)
    pooled = F.sqrt(F.try_divide((n1 - 1) * F.col("var1") + (n2 - 1) * F.col("var2"), n1 + n2 - 2))
    diff = F.col("mean1") - F.col("mean2")
    small = F.least(n1, n2) - 1
    return stats.withColumns(
        {
            "diff": diff,
            "se": F.when(enough, F.sqrt(se2)),
            "df": F.when(enough, F.coalesce(F.try_divide(num, F.nullif(den, F.lit(0.0))), small)),
            "t": F.when(enough, F.try_divide(diff, F.nullif(F.sqrt(se2), F.lit(0.0)))),
            "cohens_d": F.when(enough, F.try_divide(diff, F.nullif(pooled, F.lit(0.0)))),
            "status": F.when(enough, "ok").otherwise("not_estimable"),
        }
    )


def with_single_row(df: DataFrame, single: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate, as a scalar subquery."""
    row = single.select(F.struct(*single.columns).alias("__one")).scalar()
    return df.withColumn("__one", row).select(*df.columns, *[F.col(f"__one.{c}").alias(c) for c in single.columns])


def with_p(df: DataFrame, t: str = "t", dof: str = "df", name: str = "p_two_sided") -> DataFrame:
    return df.withColumn(name, p_two_sided(F.col(t), F.col(dof)))


def with_ci(
    df: DataFrame, center: str = "diff", se: str = "se", dof: str = "df", level: float = 0.95
) -> DataFrame:
    """Confidence limits; a zero standard error gives the point itself."""
    margin = t_critical(F.lit(0.5 + level / 2), F.col(dof)) * F.col(se)
    return df.withColumn("__m", margin).withColumns(
        {"ci_low": F.col(center) - F.col("__m"), "ci_high": F.col(center) + F.col("__m")}
    ).drop("__m")


def welch_by(df: DataFrame, keys: list[str], value: str, first: Column) -> DataFrame:
    """The full Welch report for each key: t, df, p-values, interval, effect."""
    out = with_ci(with_p(with_welch(two_sample(df, keys, value, first))))
    out = out.withColumn("p_greater", p_greater(F.col("t"), F.col("df")))
    return out.withColumn("effect", effect_size(F.col("cohens_d")))


def model_welch_table(df: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    stats = with_p(with_welch(two_sample(df, [c.model], PCT_POINTS, F.col(IS_AI) == 1)))
    return stats.select(
        F.lit("per_model_welch_ai_vs_other").alias("analysis"),
        c.model,
        model_family(F.col(c.model).cast("string")).alias("model_family"),
        F.lit(PCT_POINTS).alias("outcome"),
        F.col("mean1").alias("mean_ai_pct_points"),
        F.col("mean2").alias("mean_other_pct_points"),
        F.col("diff").alias("difference_ai_minus_other_pct_points"),
        F.col("n1").alias("n_ai_rows"),
        F.col("n2").alias("n_other_rows"),
        F.col("t").alias("t_value"),
        F.col("p_two_sided").alias("p_value"),
        "status",
    )


def row_welch_table(rows: DataFrame) -> DataFrame:
    """Label groups compared over row averages, in one row."""
    is_ai = F.col(IS_AI) == 1
    stats = with_p(with_welch(two_sample(rows, [], MEAN_PCT, is_ai)))
    medians = exact_medians(
        rows,
        [],
        {"ai_pct_points": F.when(is_ai, F.col(MEAN_PCT)), "other_pct_points": F.when(~is_ai, F.col(MEAN_PCT))},
    )
    return with_single_row(stats, medians).select(
        F.lit("secondary_row_average_welch_ai_vs_other").alias("analysis"),
        F.lit(MEAN_PCT).alias("outcome"),
        F.lit("H1B row averaged across models").alias("unit"),
        F.col("mean1").alias("mean_ai_pct_points"),
        F.col("mean2").alias("mean_other_pct_points"),
        F.col("diff").alias("difference_ai_minus_other_pct_points"),
        "median_ai_pct_points",
        "median_other_pct_points",
        F.col("n1").alias("n_ai_rows"),
        F.col("n2").alias("n_other_rows"),
        F.col("t").alias("t_value"),
        F.col("p_two_sided").alias("p_value"),
        "status",
    )


def one_sample(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One-sample t against zero with signs counted; df is n - 1."""
    v = F.col(value)
    out = df.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.count_if(v > 0).alias("positive"),
        F.count_if(v < 0).alias("negative"),
        F.count_if(v == 0).alias("zero"),
    )
    n = F.col("n").cast("double")
    return out.withColumns(
        {
            "se": F.try_divide(F.col("sd"), F.sqrt(n)),
            "df": F.when(n >= 2, n - 1),
            "t": F.when(n >= 2, F.try_divide(F.col("mean"), F.nullif(F.col("sd") / F.sqrt(n), F.lit(0.0)))),
            "d": F.try_divide(F.col("mean"), F.nullif(F.col("sd"), F.lit(0.0))),
        }
    )


def block_contrast_summary(contrasts: DataFrame) -> DataFrame:
    """The primary test: t and sign test over block differences."""
    stats = with_p(one_sample(contrasts, [], DELTA_PCT))
    medians = exact_medians(contrasts, [], {DELTA_PCT: F.col(DELTA_PCT)})
    status = (
        F.when(F.col("n") == 0, "not_estimable_no_common_support_blocks")
        .when(F.col("n") < 2, "not_estimable_too_few_blocks")
        .otherwise("ok")
    )
    return with_single_row(stats, medians).select(
        F.lit("primary_block_level_contrast_ttest").alias("analysis"),
        F.lit(DELTA_PCT).alias("outcome"),
        F.lit("BLOCK_ID").alias("unit"),
        F.col("mean").alias("mean_" + DELTA_PCT),
        "median_" + DELTA_PCT,
        F.col("sd").alias("std_" + DELTA_PCT),
        F.col("n").alias("n_common_support_blocks"),
        F.col("positive").alias("positive_blocks"),
        F.col("negative").alias("negative_blocks"),
        F.col("zero").alias("zero_blocks"),
        F.col("t").alias("t_value"),
        F.col("p_two_sided").alias("p_value"),
        p_sign(F.col("positive"), F.col("negative")).alias("sign_test_p_value"),
        status.alias("status"),
    )


def model_block_summary(contrasts: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    stats = with_p(one_sample(contrasts, [c.model], DELTA_PCT))
    medians = exact_medians(contrasts, [c.model], {DELTA_PCT: F.col(DELTA_PCT)})
    return stats.join(medians, c.model, "left").select(
        F.lit("per_model_block_contrast_ttest").alias("analysis"),
        c.model,
        model_family(F.col(c.model).cast("string")).alias("model_family"),
        F.lit(DELTA_PCT).alias("outcome"),
        F.col("mean").alias("mean_" + DELTA_PCT),
        "median_" + DELTA_PCT,
        F.col("n").alias("n_common_support_blocks"),
        F.col("positive").alias("positive_blocks"),
        F.col("negative").alias("negative_blocks"),
        F.col("t").alias("t_value"),
        F.col("p_two_sided").alias("p_value"),
        F.when(F.col("n") >= 2, "ok").otherwise("not_estimable").alias("status"),
    )


def cohort_welch(uplifts: DataFrame, first: str = "closed", second: str = "open", c: AuditColumns = DEFAULT) -> DataFrame:
    """Closed minus open over model-level uplifts."""
    two = uplifts.where(F.col(c.cohort).isin(first, second))
    return welch_by(two, [], "uplift", F.col(c.cohort) == first)


def cohort_one_sample(uplifts: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    """Each cohort's mean uplift against zero, with interval and effect."""
    stats = with_p(one_sample(uplifts, [c.cohort], "uplift"))
    return with_ci(stats, center="mean").drop("positive", "negative", "zero")


def cohort_label_welch(
    df: DataFrame, first: str = "closed", second: str = "open", c: AuditColumns = DEFAULT
) -> DataFrame:
    """Closed minus open, separately for labelled and other rows (``spb``)."""
    two = df.where(F.col(c.cohort).isin(first, second))
    return welch_by(two, [c.label], "spb", F.col(c.cohort) == first)


def paired_welch(df: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    """Label groups compared on row means over all models of each cohort; rows that
    lack a model or have two answers of one are left out."""
    per_cohort = df.select(c.cohort, c.model).distinct().groupBy(c.cohort).agg(F.count(F.lit(1)).alias("__models"))
    est = F.col(c.estimate).cast("double")
    per_row = df.groupBy(c.cohort, c.row_id).agg(
        F.count(F.lit(1)).alias("__n"),
        F.count_distinct(c.model).alias("__m"),
        F.avg(est).alias("mean_estimate"),
        F.max(c.actual).alias(c.actual),
        F.max(c.label).alias(c.label),
    )
    whole = lookup_join(per_row, per_cohort, [c.cohort], "inner", [c.row_id]).where(
        (F.col("__m") == F.col("__models")) & (F.col("__n") == F.col("__m"))
    )
    spb = F.try_divide(F.col("mean_estimate") - F.col(c.actual), F.col(c.actual)) * F.lit(100.0)
    return welch_by(whole.withColumn("spb", spb), [c.cohort], "spb", F.col(c.label))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r and p; null for fewer than three rows or a constant side."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    stats = both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.covar_samp(x, y).alias("cov"),
        F.stddev_samp(x).alias("sx"),
        F.stddev_samp(y).alias("sy"),
    )
    r = F.when(F.col("n_rows") >= 3, F.try_divide(F.col("cov"), F.nullif(F.col("sx") * F.col("sy"), F.lit(0.0))))
    return stats.withColumn("pearson_r", r).select(
        "n_rows", "pearson_r", p_correlation(F.col("pearson_r"), F.col("n_rows")).alias("pearson_p_value")
    )


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman r and p with tie-averaged ranks.

    Ranks come from value counts, so no global sort of rows; the rank tables
    join back onto (x, y) cells, and the mean rank is known to be (n + 1) / 2.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    cells = both.groupBy(x, y).agg(F.count(F.lit(1)).alias("w"))
    # Stored rank tables have a known size: few distinct values are broadcast.
    x_ranks, y_ranks = (materialize(average_ranks(both, v, n), n) for v, n in ((x, "rx"), (y, "ry")))
    ranked = lookup_join(cells, x_ranks, [x], "inner", [y])
    if not fits_broadcast(y_ranks):  # then the second join reads its left side twice
        ranked = materialize(ranked, "ranked")
    ranked = lookup_join(ranked, y_ranks, [y], "inner", [x])
    n = both.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    mid = (n + 1) / F.lit(2.0)
    dx, dy, w = F.col("rx") - mid, F.col("ry") - mid, F.col("w")
    sums = ranked.agg(
        F.sum("w").alias("n_rows"),
        F.sum(w * dx * dy).alias("sxy"),
        F.sum(w * dx * dx).alias("sxx"),
        F.sum(w * dy * dy).alias("syy"),
    )
    r = F.try_divide(F.col("sxy"), F.nullif(F.sqrt(F.col("sxx") * F.col("syy")), F.lit(0.0)))
    return sums.withColumn("spearman_r", F.when(F.col("n_rows") >= 3, r)).select(
        "n_rows", "spearman_r", p_correlation(F.col("spearman_r"), F.col("n_rows")).alias("spearman_p_value")
    )


def confidence_correlation(rows: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    """Correlation of row-average bias with the label confidence."""
    p = pearson(rows, c.confidence, MEAN_PCT)
    s = spearman(rows, c.confidence, MEAN_PCT)
    ok = F.col("pearson_r").isNotNull()
    return with_single_row(p, s.drop("n_rows")).select(
        F.lit("row_average_continuous_ai_confidence_correlation").alias("analysis"),
        F.lit(MEAN_PCT).alias("outcome"),
        "n_rows",
        "pearson_r",
        "pearson_p_value",
        F.when(ok, F.col("spearman_r")).alias("spearman_r"),
        F.when(ok, F.col("spearman_p_value")).alias("spearman_p_value"),
        F.when(ok, "ok").otherwise("not_estimable").alias("status"),
    )


def _split_means(units: DataFrame, keys: list[str], in_second: Column) -> DataFrame:
    v = F.col("uplift")
    return units.groupBy(*keys).agg((F.avg(F.when(in_second, v)) - F.avg(F.when(~in_second, v))).alias("diff"))


def permutation_null(
    uplifts: DataFrame, n_permutations: int = 10_000, seed: int = 42, second: str = "closed", c: AuditColumns = DEFAULT
) -> DataFrame:
    """Difference (second minus first cohort) under shuffled cohort labels.

    Each unit yields one row per permutation; a permutation ranks its units by
    hash, and the first n1 ranks form the first cohort. A group is one
    permutation: as many rows as there are models.
    """
    whole = Window.partitionBy("perm")
    shuffled = uplifts.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))))
    placed = shuffled.withColumns(
        {
            "place": F.row_number().over(
                whole.orderBy(unit_hash(str(seed), F.col("perm"), F.col(c.model)), F.col(c.model))
            ),
            "n_first": F.count_if(F.col(c.cohort) != second).over(whole),
        }
    )
    return _split_means(placed, ["perm"], F.col("place") > F.col("n_first"))


def exact_null(uplifts: DataFrame, second: str = "closed", c: AuditColumns = DEFAULT, max_units: int = 24) -> DataFrame:
    """All splits of the units into cohorts of the given sizes.

    A split is a bit mask over the numbered units (one row per model). More than
    ``max_units`` units leave no usable number of splits: use the permutation
    test, or ``exact_split_test``, which counts splits by halves.
    """
    whole = Window.partitionBy(F.lit(0))
    numbered = uplifts.withColumns(
        {
            "bit": F.row_number().over(whole.orderBy(c.model)) - 1,
            "n_units": F.count(F.lit(1)).over(whole),
            "n_second": F.count_if(F.col(c.cohort) == second).over(whole),
        }
    )
    checked = F.when(F.col("n_units") > max_units, F.raise_error(F.lit("too many units for exact splits"))).otherwise(
        F.col("n_units")
    )
    masks = numbered.withColumn(
        "mask", F.explode(F.sequence(F.lit(0), (F.pow(F.lit(2), checked) - 1).cast("int")))
    ).where(F.bit_count("mask") == F.col("n_second"))
    taken = F.getbit(F.col("mask"), F.col("bit")) == 1
    return _split_means(masks, ["mask"], taken)


def _half_sums(units: DataFrame, half: int, n_half: int) -> DataFrame:
    """Every subset of one half of the units: its size and sum."""
    values = units.where(F.col("half") == half).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("bit", "uplift"))), lambda e: e["uplift"]).alias("vs")
    )
    masks = units.sparkSession.range(1 << n_half).withColumnRenamed("id", "mask")
    taken = F.aggregate(
        F.sequence(F.lit(0), F.lit(n_half - 1)) if n_half else F.array().cast("array<int>"),
        F.lit(0.0),
        lambda total, b: total + F.when(F.getbit(F.col("mask"), b) == 1, F.get("vs", b)).otherwise(0.0),
    )
    with_values = masks.withColumn("vs", values.select("vs").scalar())
    return with_values.select(F.bit_count("mask").cast("int").alias("k"), taken.alias("s"))


def _count_up_to(cuts: list[float]):
    """Pairs of one subset per half whose sum is at most each cut."""

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = left.s.to_numpy(), np.sort(right.s.to_numpy())
        counts = [int(np.searchsorted(b, cut - a, side="right").sum()) for cut in cuts]
        return pd.DataFrame({"at": range(len(cuts)), "n": counts})

    return count


def exact_split_test(
    uplifts: DataFrame, second: str = "closed", c: AuditColumns = DEFAULT, max_units: int = 48, pivots: int = 64
) -> DataFrame:
    """Exact permutation test for more units than can be split one by one.

    The difference of the cohort means grows with the sum of the second cohort,
    and such a sum is a subset sum of each half of the units. So 2^(n/2) sums
    per half, grouped by subset size, hold all splits: the pairs with a sum up
    to a value are counted by searching one sorted half for each sum of the other.
    p is two such counts; the quantiles are order statistics found by rounds of
    ``pivots`` counts, to 1e-12 of the range. Rows and columns as
    ``permutation_summary``. Values within 1e-12 count as equal.
    """
    spark = uplifts.sparkSession
    order = Window.partitionBy(F.lit(0)).orderBy(c.model)  # a row per unit
    numbered = uplifts.select(c.model, F.col("uplift").cast("double").alias("uplift"), (F.col(c.cohort) == second).alias("__second"))
    numbered = numbered.withColumn("place", F.row_number().over(order) - 1)
    size = numbered.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("__second").alias("n2"), F.sum("uplift").alias("total"),
        F.sum(F.when(F.col("__second"), F.col("uplift"))).alias("s2"), F.sum(F.abs("uplift")).alias("spread"),
    ).first()
    n, n2 = size["n"], size["n2"]
    if n > max_units:
        raise ValueError(f"{n} units; exact splits hold for at most {max_units}, use permutation_null")
    if not 0 < n2 < n:
        raise ValueError("both cohorts need units")
    n_left = n // 2
    halved = materialize(
        numbered.select("uplift", "place", (F.col("place") >= n_left).cast("int").alias("half"))
        .withColumn("bit", F.when(F.col("half") == 0, F.col("place")).otherwise(F.col("place") - n_left))
        .select("half", "bit", "uplift"),
        "units",
    )
    left = materialize(_half_sums(halved, 0, n_left), "left_sums")
    right = materialize(_half_sums(halved, 1, n - n_left).withColumn("k", F.lit(n2) - F.col("k")), "right_sums")

    def counts(cuts: list[float]) -> list[int]:
        pairs = left.groupBy("k").cogroup(right.groupBy("k")).applyInPandas(_count_up_to(cuts), "at int, n long")
        found = {row["at"]: row["n"] for row in pairs.groupBy("at").agg(F.sum("n").alias("n")).collect()}  # a row per cut
        return [found[i] for i in range(len(cuts))]

    n1, total = n - n2, size["total"]
    diff = lambda s: s / n2 - (total - s) / n1
    sum_of = lambda d: (d + total / n1) / (1.0 / n2 + 1.0 / n1)
    observed = diff(size["s2"])
    far, width = abs(observed) - 1e-12, max(size["spread"], 1e-300)
    low, high, everything = -2 * width, 2 * width, math.comb(n, n2)
    if far <= 0:
        extreme = everything
    else:
        below, under = counts([sum_of(-far), float(np.nextafter(sum_of(far), -np.inf))])
        extreme = below + everything - under

    def order_statistics(ranks: list[int]) -> list[float]:
        brackets = [(low, high)] * len(ranks)
        while max(hi - lo for lo, hi in brackets) > 1e-12 * width:
            cuts = [lo + (hi - lo) * j / (pivots + 1) for lo, hi in brackets for j in range(1, pivots + 1)]
            seen = counts(cuts)
            for r, rank in enumerate(ranks):
                lo, hi = brackets[r]
                for cut, many in zip(cuts[r * pivots : (r + 1) * pivots], seen[r * pivots : (r + 1) * pivots]):
                    if many > rank:
                        hi = cut
                        break
                    lo = cut
                brackets[r] = (lo, hi)
        return [hi for _, hi in brackets]

    places = [q * (everything - 1) for q in (0.025, 0.975)]
    ranks = [min(math.floor(p) + step, everything - 1) for p in places for step in (0, 1)]
    found = [diff(s) for s in order_statistics(ranks)]
    quantile = [found[2 * i] + (found[2 * i + 1] - found[2 * i]) * (p - math.floor(p)) for i, p in enumerate(places)]
    row = (everything, observed, extreme / everything, quantile[0], quantile[1])
    return spark.createDataFrame([row], "n_permutations long, observed_diff double, p_value double, null_low double, null_high double")


def permutation_summary(null: DataFrame, uplifts: DataFrame, second: str = "closed", c: AuditColumns = DEFAULT) -> DataFrame:
    """Observed difference, two-sided p and central 95 % of the null.

    The null has one row per permutation, a number set by the caller.
    """
    observed = _split_means(uplifts, [], F.col(c.cohort) == second).select("diff").scalar()
    return null.withColumn("obs", observed).agg(
        F.count(F.lit(1)).alias("n_permutations"),
        F.max("obs").alias("observed_diff"),
        F.avg(F.when(F.abs("diff") >= F.abs("obs") - F.lit(1e-12), 1.0).otherwise(0.0)).alias("p_value"),
        F.percentile("diff", F.lit(0.025)).alias("null_low"),
        F.percentile("diff", F.lit(0.975)).alias("null_high"),
    )


def significance_summary(welch: DataFrame, regression: DataFrame, key: str, alpha: float = 0.05) -> DataFrame:
    """Flags per model: Welch one- and two-sided, and the regression label."""
    return welch.join(regression, key, "left").select(
        key,
        significant(F.col("p_greater"), alpha).alias("welch_one_sided"),
        significant(F.col("p_two_sided"), alpha).alias("welch_two_sided"),
        significant(F.col("label_p"), alpha).alias("regression"),
    )
