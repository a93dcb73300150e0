"""Descriptive tables: per model, per label group, per block, per cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import (
    DEFAULT, DELTA_PCT, DELTA_USD, DIFF_USD, IS_AI, MEAN_PCT, MEAN_USD, PCT_POINTS, AuditColumns,
)
from ..functions.text import model_family
from .ranking import exact_medians


def ai() -> Column:
    return F.col(IS_AI) == 1


def other() -> Column:
    return F.col(IS_AI) == 0


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r as an aggregate; null for a constant side."""
    return F.try_divide(F.covar_samp(x, y), F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0)))


def _family(c: AuditColumns) -> Column:
    return model_family(F.col(c.model).cast("string")).alias("model_family")


def model_summary(df: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    """Means, medians, group means, deltas and confidence correlation per model."""
    est, pct, usd = F.col(c.estimate).cast("double"), F.col(PCT_POINTS), F.col(DIFF_USD)
    both = F.col(c.confidence).isNotNull() & pct.isNotNull()
    main = df.groupBy(c.model).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(ai()).alias("n_ai_rows"),
        F.count_if(other()).alias("n_other_rows"),
        F.avg(c.actual).alias("mean_actual_usd"),
        F.avg(est).alias("mean_predicted_usd"),
        F.avg(usd).alias("mean_overestimation_usd"),
        F.avg(pct).alias("mean_overestimation_pct_points"),
        F.avg(F.when(ai(), pct)).alias("mean_ai_overestimation_pct_points"),
        F.avg(F.when(other(), pct)).alias("mean_other_overestimation_pct_points"),
        F.avg(F.when(ai(), usd)).alias("mean_ai_overestimation_usd"),
        F.avg(F.when(other(), usd)).alias("mean_other_overestimation_usd"),
        safe_corr(F.when(both, F.col(c.confidence)), F.when(both, pct)).alias(
            "corr_ai_confidence_overestimation_pct_points"
        ),
    )
    medians = exact_medians(df, [c.model], {"overestimation_usd": usd, "overestimation_pct_points": pct})
    return (
        main.join(medians, c.model, "left")
        .withColumns(
            {
                "delta_ai_minus_other_pct_points": F.col("mean_ai_overestimation_pct_points")
                - F.col("mean_other_overestimation_pct_points"),
                "delta_ai_minus_other_usd": F.col("mean_ai_overestimation_usd")
                - F.col("mean_other_overestimation_usd"),
            }
        )
        .select(
            c.model, _family(c), "n_rows", "n_ai_rows", "n_other_rows", "mean_actual_usd", "mean_predicted_usd",
            "mean_overestimation_usd", "median_overestimation_usd", "mean_overestimation_pct_points",
            "median_overestimation_pct_points", "mean_ai_overestimation_pct_points",
            "mean_other_overestimation_pct_points", "delta_ai_minus_other_pct_points", "mean_ai_overestimation_usd",
            "mean_other_overestimation_usd", "delta_ai_minus_other_usd",
            "corr_ai_confidence_overestimation_pct_points",
        )
    )


def label_group_summary(rows: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    """The two label groups over row averages."""
    named = rows.withColumn("group", F.when(ai(), "AI").otherwise("Other"))
    main = named.groupBy("group").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(c.confidence).alias("mean_ai_confidence"),
        F.avg(c.actual).alias("mean_actual_usd"),
        F.avg("mean_predicted_salary_usd").alias("mean_predicted_salary_usd"),
        F.avg(MEAN_USD).alias("mean_overestimation_usd"),
        F.avg(MEAN_PCT).alias("mean_overestimation_pct_points"),
    )
    medians = exact_medians(
        named, ["group"], {"overestimation_usd": F.col(MEAN_USD), "overestimation_pct_points": F.col(MEAN_PCT)}
    )
    return main.join(medians, "group").select(
        "group", "n_rows", "mean_ai_confidence", "mean_actual_usd", "mean_predicted_salary_usd",
        "mean_overestimation_usd", "median_overestimation_usd", "mean_overestimation_pct_points",
        "median_overestimation_pct_points",
    )


def block_contrasts(rows: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    """AI minus other within each block that holds both groups."""
    pct, usd = F.col(MEAN_PCT), F.col(MEAN_USD)
    main = rows.groupBy(c.block).agg(
        F.count_if(ai()).alias("n_ai_rows"),
        F.count_if(other()).alias("n_other_rows"),
        F.avg(F.when(ai(), pct)).alias("mean_ai_overestimation_pct_points"),
        F.avg(F.when(other(), pct)).alias("mean_other_overestimation_pct_points"),
        F.avg(F.when(ai(), usd)).alias("mean_ai_overestimation_usd"),
        F.avg(F.when(other(), usd)).alias("mean_other_overestimation_usd"),
        F.avg(F.when(ai(), F.col(c.confidence))).alias("mean_ai_confidence"),
        F.avg(F.when(other(), F.col(c.confidence))).alias("mean_other_confidence"),
    )
    main = main.where((F.col("n_ai_rows") > 0) & (F.col("n_other_rows") > 0))
    medians = exact_medians(
        rows.where(F.col(c.block).isNotNull()),
        [c.block],
        {
            "ai_overestimation_pct_points": F.when(ai(), pct),
            "other_overestimation_pct_points": F.when(other(), pct),
        },
    )
    n_ai, n_other = F.col("n_ai_rows"), F.col("n_other_rows")
    return (
        main.join(medians, c.block, "left")
        .withColumns(
            {
                DELTA_PCT: F.col("mean_ai_overestimation_pct_points") - F.col("mean_other_overestimation_pct_points"),
                DELTA_USD: F.col("mean_ai_overestimation_usd") - F.col("mean_other_overestimation_usd"),
                "harmonic_weight": n_ai.cast("double") * n_other / (n_ai + n_other),
            }
        )
        .select(
            c.block, "n_ai_rows", "n_other_rows", "mean_ai_overestimation_pct_points",
            "mean_other_overestimation_pct_points", DELTA_PCT, "median_ai_overestimation_pct_points",
            "median_other_overestimation_pct_points", "mean_ai_overestimation_usd", "mean_other_overestimation_usd",
            DELTA_USD, "mean_ai_confidence", "mean_other_confidence", "harmonic_weight",
        )
    )


def model_block_contrasts(df: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    """Block contrasts of every model, in one aggregate."""
    pct, usd = F.col(PCT_POINTS), F.col(DIFF_USD)
    out = df.groupBy(c.model, c.block).agg(
        F.count_if(ai()).alias("n_ai_rows"),
        F.count_if(other()).alias("n_other_rows"),
        F.avg(F.when(ai(), pct)).alias("mean_ai_overestimation_pct_points"),
        F.avg(F.when(other(), pct)).alias("mean_other_overestimation_pct_points"),
        F.avg(F.when(ai(), usd)).alias("mean_ai_overestimation_usd"),
        F.avg(F.when(other(), usd)).alias("mean_other_overestimation_usd"),
    )
    out = out.where((F.col("n_ai_rows") > 0) & (F.col("n_other_rows") > 0))
    return out.select(
        c.model, _family(c), c.block, "n_ai_rows", "n_other_rows", "mean_ai_overestimation_pct_points",
        "mean_other_overestimation_pct_points",
        (F.col("mean_ai_overestimation_pct_points") - F.col("mean_other_overestimation_pct_points")).alias(DELTA_PCT),
        "mean_ai_overestimation_usd", "mean_other_overestimation_usd",
        (F.col("mean_ai_overestimation_usd") - F.col("mean_other_overestimation_usd")).alias(DELTA_USD),
    )


def cohort_pool_summary(df: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    """Predictions, group sizes, mean and median bias of each pooled cohort.

    ``df`` carries ``spb``. Counted per (cohort, model) first for the number of
    models.
    """
    label = F.col(c.label)
    per_model = df.groupBy(c.cohort, c.model).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(label).alias("a"),
        F.sum(F.when(label, F.col("spb"))).alias("sa"),
        F.sum(F.when(~label, F.col("spb"))).alias("so"),
    )
    main = per_model.groupBy(c.cohort).agg(
        F.count(F.lit(1)).alias("n_models"),
        F.sum("n").alias("n_predictions"),
        F.sum("a").alias("n_ai"),
        (F.sum("n") - F.sum("a")).alias("n_other"),
        F.try_divide(F.sum("sa"), F.sum("a")).alias("mean_ai"),
        F.try_divide(F.sum("so"), F.sum("n") - F.sum("a")).alias("mean_other"),
    )
    medians = exact_medians(
        df, [c.cohort], {"ai": F.when(label, F.col("spb")), "other": F.when(~label, F.col("spb"))}
    )
    return main.join(medians, c.cohort).withColumn("uplift", F.col("mean_ai") - F.col("mean_other"))


def cohort_uplift_summary(uplifts: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    """Mean, spread and number of the model-level uplifts of each cohort."""
    return uplifts.groupBy(c.cohort).agg(
        F.count(F.lit(1)).alias("n_models"),
        F.avg("uplift").alias("mean_uplift"),
        F.stddev_samp("uplift").alias("sd_uplift"),
    )
