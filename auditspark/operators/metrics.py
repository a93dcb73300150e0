"""Per-row bias metrics and per-row averages over models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import DEFAULT, DIFF_USD, IS_AI, LOG_RATIO, MEAN_PCT, MEAN_USD, PCT_POINTS, RATIO, AuditColumns
from ..functions.numeric import signed_pct_bias


def with_metrics(df: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    """Difference, percent points, ratio and log ratio (positive sides only)."""
    est, act = F.col(c.estimate).cast("double"), F.col(c.actual)
    both = (est > 0) & (act > 0)
    return df.withColumns(
        {
            DIFF_USD: est - act,
            RATIO: F.try_divide(est, act),
            PCT_POINTS: F.try_divide(F.lit(100.0) * (est - act), act),
            LOG_RATIO: F.when(both, F.ln(est) - F.ln(act)),
        }
    )


def with_spb(df: DataFrame, c: AuditColumns = DEFAULT, min_actual: float = 1.0, cap: float = 0.0) -> DataFrame:
    """Signed percent bias as ``spb``; rows without one are dropped."""
    est = F.col(c.estimate).cast("double")
    return df.withColumn("spb", signed_pct_bias(est, F.col(c.actual), min_actual, cap)).where(F.col("spb").isNotNull())


def mape(df: DataFrame, keys: list[str], c: AuditColumns = DEFAULT) -> DataFrame:
    label = F.col(c.label)
    return df.groupBy(*keys).agg(
        F.avg(F.when(label, F.abs("spb"))).alias("mape_ai"), F.avg(F.when(~label, F.abs("spb"))).alias("mape_other")
    )


def model_uplift(df: DataFrame, keys: list[str], c: AuditColumns = DEFAULT) -> DataFrame:
    """Mean bias of both groups and their difference; both groups must occur."""
    label = F.col(c.label)
    means = df.groupBy(*keys).agg(
        F.avg(F.when(label, F.col("spb"))).alias("mean_ai"), F.avg(F.when(~label, F.col("spb"))).alias("mean_other")
    )
    return means.withColumn("uplift", F.col("mean_ai") - F.col("mean_other")).where(F.col("uplift").isNotNull())


def row_averages(df: DataFrame, c: AuditColumns = DEFAULT, base: list[str] | None = None) -> DataFrame:
    """One row per observation with its averages over models.

    The observation's own columns ride along in the same aggregate instead of a
    join back. A group holds one row per model; its answers are gathered in one
    short array, whose sorted fields give the medians.
    """
    wanted = base or [
        c.title, c.soc_code, c.soc_title, c.city, c.state, c.naics, c.full_time, c.positions, c.wage_level,
        c.actual, c.label, IS_AI, c.confidence, c.job_key, c.block,
    ]
    kept = [b for b in dict.fromkeys(wanted) if b in df.columns]
    est = F.col(c.estimate).cast("double")
    picked = F.min_by(F.struct(*kept), F.col(c.model)).alias("__base")
    answers = {"e": est, "u": F.col(DIFF_USD), "p": F.col(PCT_POINTS)}

    def median(name: str) -> Column:
        values, n = F.sort_array(F.col("__all")[name]), F.col("__n_" + name)  # missing values first
        first = F.size(values) - n.cast("int")
        at = lambda i: F.get(values, first + i)
        return F.when(n > 0, (at(F.expr(f"int((__n_{name} - 1) div 2)")) + at(F.expr(f"int(__n_{name} div 2)"))) / 2)

    out = df.groupBy(c.row_id).agg(
        picked,
        F.collect_list(F.struct(F.col(c.model).alias("m"), *[v.alias(k) for k, v in answers.items()])).alias("__all"),
        *[F.count(v).alias("__n_" + k) for k, v in answers.items()],
        F.avg(est).alias("mean_predicted_salary_usd"),
        F.avg(DIFF_USD).alias(MEAN_USD),
        F.avg(PCT_POINTS).alias(MEAN_PCT),
        F.avg(RATIO).alias("mean_prediction_to_actual_ratio"),
        F.avg(LOG_RATIO).alias("mean_log_prediction_minus_log_actual"),
    )
    return out.select(
        c.row_id,
        "__base.*",
        F.size(F.array_compact(F.array_distinct(F.col("__all")["m"]))).cast("bigint").alias("n_models"),
        "mean_predicted_salary_usd",
        median("e").alias("median_predicted_salary_usd"),
        MEAN_USD,
        median("u").alias("median_overestimation_usd"),
        MEAN_PCT,
        median("p").alias("median_overestimation_pct_points"),
        "mean_prediction_to_actual_ratio",
        "mean_log_prediction_minus_log_actual",
    )
