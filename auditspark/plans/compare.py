"""Comparisons of cohorts of models, and of label groups within models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..columns import DEFAULT, AuditColumns
from ..functions.text import naics2
from ..operators.filters import valid_pairs
from ..operators.metrics import mape, model_uplift, with_spb
from ..operators.normality import shapiro_wilk
from ..operators.ranking import exact_medians
from ..operators.regression import ols_hc3
from ..operators.stat_tests import (
    cohort_label_welch, cohort_one_sample, cohort_welch, paired_welch, permutation_null, permutation_summary,
    significance_summary, welch_by,
)
from ..operators.summaries import cohort_pool_summary, cohort_uplift_summary
from ..session import materialize


def compare_models(df: DataFrame, c: AuditColumns = DEFAULT, min_actual: float = 1.0, cap: float = 0.0) -> dict[str, DataFrame]:
    """Per model: Welch with medians and MAPE, normality, HC3 regression, flags."""
    rows = with_spb(df, c, min_actual, cap)
    label = F.col(c.label)
    medians = exact_medians(rows, [c.model], {"ai": F.when(label, F.col("spb")), "other": F.when(~label, F.col("spb"))})
    welch = welch_by(rows, [c.model], "spb", label).join(medians, c.model, "left").join(mape(rows, [c.model], c), c.model)
    design = rows.withColumns({"naics2": naics2(F.col(c.naics), ""), "log_positions": F.log1p(F.col(c.positions).try_cast("double"))})
    regression = ols_hc3(design, c.model, "spb", c.label, c.soc_code, [c.state, "naics2", c.full_time], ["log_positions"])
    return {
        "welch": welch,
        "normality": shapiro_wilk(rows, [c.model, c.label], "spb"),
        "regression": regression,
        "significance": significance_summary(welch, regression, c.model),
    }


def compare_cohorts(
    df: DataFrame, c: AuditColumns = DEFAULT, min_actual: float = 1.0, cap: float = 0.0,
    n_permutations: int = 10_000, seed: int = 42, first: str = "closed", second: str = "open",
) -> dict[str, DataFrame]:
    """Closed against open on model-level uplifts (one row per model)."""
    uplifts = materialize(model_uplift(with_spb(df, c, min_actual, cap), [c.cohort, c.model], c), "uplifts")
    uplifts = uplifts.where(F.col(c.cohort).isin(first, second))  # every test sees the same two cohorts
    null = permutation_null(uplifts, n_permutations, seed, first, c)
    return {
        "uplifts": uplifts,
        "cohorts": cohort_uplift_summary(uplifts, c),
        "welch": cohort_welch(uplifts, first, second, c),
        "permutation": permutation_summary(null, uplifts, first, c),
        "one_sample": cohort_one_sample(uplifts, c),
    }


def compare_pooled(df: DataFrame, c: AuditColumns = DEFAULT, min_actual: float = 1.0, cap: float = 0.0) -> dict[str, DataFrame]:
    """All predictions of a cohort pooled."""
    rows = with_spb(df, c, min_actual, cap)
    return {
        "summary": cohort_pool_summary(rows, c),
        "within": welch_by(rows, [c.cohort], "spb", F.col(c.label)),
        "between": cohort_label_welch(rows, c=c),
    }


def compare_paired(df: DataFrame, c: AuditColumns = DEFAULT, min_actual: float = 1.0) -> DataFrame:
    """Row means over all models of a cohort, label groups compared."""
    return paired_welch(valid_pairs(df, c, min_actual), c)
