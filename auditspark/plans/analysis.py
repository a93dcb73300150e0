"""The main analysis: predictions and metadata to fifteen tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..columns import DEFAULT, DIFF_USD, IS_AI, LOG_RATIO, PCT_POINTS, RATIO, AuditColumns
from ..functions.numeric import clip, parse_money, to_number
from ..functions.text import TRUTHY_ANALYSIS, truthy
from ..operators.filters import is_out_of_range, is_parsed, parsed_rows, require_none
from ..operators.metrics import row_averages, with_metrics
from ..operators.quality import identical_vectors, prediction_vector_qc, raw_output_qc, run_counts, status_counts
from ..operators.stat_tests import (
    block_contrast_summary, confidence_correlation, model_block_summary, model_welch_table, row_welch_table,
)
from ..operators.summaries import block_contrasts, label_group_summary, model_block_contrasts, model_summary
from ..session import materialize, together
from ..sources.writers import ordered, write_table, write_tables


def coerce(merged: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    """Typed columns: money to numbers, flags to 0/1, confidence within [0, 1].

    Only text columns are parsed; numbers and flags are taken as they are.
    """

    def number(name: str, parse) -> Column:
        if isinstance(merged.schema[name].dataType, NumericType):
            return F.nanvl(F.col(name).cast("double"), F.lit(None))
        return parse(F.col(name))

    flag = F.col(c.label)
    if not isinstance(merged.schema[c.label].dataType, BooleanType):
        flag = truthy(flag, TRUTHY_ANALYSIS)
    return merged.withColumns(
        {
            c.actual: number(c.actual, parse_money),
            c.estimate: number(c.estimate, parse_money),
            c.confidence: clip(number(c.confidence, to_number), 0.0, 1.0),
            IS_AI: F.coalesce(flag, F.lit(False)).cast("int"),
            c.status: F.coalesce(F.col(c.status), F.lit("missing_parse_status")),
        }
    )


def analysis_rows(
    coerced: DataFrame, low: float = 20_000, high: float = 1_000_000, c: AuditColumns = DEFAULT, check: bool = True
) -> DataFrame:
    """Parsed rows with metrics; impossible actuals or predictions are errors."""
    if check:
        rules = {
            f"{c.actual} missing or outside [{low}, {high}]": is_out_of_range(c.actual, low, high, True),
            f"predictions outside [{low}, {high}]": is_parsed(c) & is_out_of_range(c.estimate, low, high, False),
        }
        require_none(coerced, rules, [c.model, c.row_id, c.actual, c.estimate, c.raw, c.status])
    return with_metrics(parsed_rows(coerced, c), c)


def preferred_order(c: AuditColumns = DEFAULT) -> list[str]:
    return [
        c.model, c.family, c.row_id, c.job_key, c.title, c.soc_code, c.soc_title, c.city, c.state, c.naics,
        c.full_time, c.positions, c.wage_level, c.block, c.label, IS_AI, c.confidence, c.actual, c.estimate,
        DIFF_USD, PCT_POINTS, RATIO, LOG_RATIO, c.status, c.raw, c.source,
    ]


def analysis_tables(
    merged: DataFrame, low: float = 20_000, high: float = 1_000_000, c: AuditColumns = DEFAULT, check: bool = True
) -> dict[str, DataFrame]:
    """All result tables by name.

    Three tables feed several outputs and are stored once: the typed rows, the
    row averages and the per-model block contrasts.
    """
    coerced = materialize(coerce(merged, c), "coerced")
    long = ordered(analysis_rows(coerced, low, high, c, check), preferred_order(c))

    spark = merged.sparkSession

    def averaged() -> tuple[DataFrame, DataFrame, DataFrame]:
        rows = materialize(row_averages(long, c), "row_average")
        return rows, *together(
            spark, lambda: materialize(block_contrasts(rows, c), "blocks"), lambda: label_group_summary(rows, c)
        )

    # Several of these run jobs when they are called; none reads another's result.
    (rows, blocks, label_groups), model_blocks, vectors, models = together(
        spark,
        averaged,
        lambda: materialize(model_block_contrasts(long, c), "model_blocks"),
        lambda: materialize(prediction_vector_qc(long, c), "vectors"),
        lambda: model_summary(long, c),
    )
    return {
        "model_row_salary_overestimation_long": long,
        "row_average_salary_overestimation": rows,
        "primary_block_level_contrasts": blocks,
        "primary_block_level_contrast_summary": block_contrast_summary(blocks),
        "secondary_row_average_welch": row_welch_table(rows),
        "per_model_welch_tests": model_welch_table(long, c),
        "per_model_block_level_contrasts": model_blocks,
        "per_model_block_contrast_summary": model_block_summary(model_blocks, c),
        "model_salary_overestimation_summary": models,
        "ai_group_salary_overestimation_summary": label_groups,
        "continuous_ai_confidence_summary": confidence_correlation(rows, c),
        "parse_status_summary": status_counts(coerced, c),
        "raw_model_output_qc": raw_output_qc(coerced, c),
        "prediction_vector_qc": vectors,
        "identical_prediction_vectors": identical_vectors(vectors, c),
    }


def run_metadata(tables: dict[str, DataFrame], c: AuditColumns = DEFAULT, **config) -> DataFrame:
    """Counts of a run and its settings as one row."""
    long = tables["model_row_salary_overestimation_long"]
    single = lambda name, label: tables[name].agg(F.count(F.lit(1)).alias(label)).select(label).scalar()
    models = long.select(F.col(c.model).cast("string").alias("m")).distinct().agg(F.array_sort(F.collect_set("m")).alias("models"))
    return run_counts(long, c).withColumns(
        {
            "models": models.select("models").scalar(),
            "n_row_average_records": single("row_average_salary_overestimation", "r"),
            "n_common_support_blocks": single("primary_block_level_contrasts", "b"),
            "n_identical_prediction_vector_pairs": single("identical_prediction_vectors", "p"),
            **{f"config_{k}": F.lit(v) for k, v in config.items()},
        }
    )


def write_analysis(tables: dict[str, DataFrame], folder: str, formats: tuple[str, ...] = ("parquet",), c: AuditColumns = DEFAULT, **config) -> list[str]:
    written = write_tables(tables, folder, formats)
    return written + write_table(run_metadata(tables, c, **config), f"{folder}/run_metadata", ("json",))
