"""Compliance and integrity checks over stored answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import DEFAULT, AuditColumns
from ..functions.parse import COMPLETED, PARSE_OK
from ..functions.text import model_family


def status_counts(df: DataFrame, c: AuditColumns = DEFAULT, missing: str | None = None) -> DataFrame:
    """Rows per model and status. A null status is kept, or named ``missing``."""
    status = F.col(c.status) if missing is None else F.coalesce(c.status, F.lit(missing))
    return df.groupBy(c.model, status.alias(c.status)).agg(F.count(F.lit(1)).alias("n_rows"))


def status_totals(df: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    """Rows per status over all models; null counts as pending."""
    return df.groupBy(F.coalesce(c.status, F.lit("pending")).alias(c.status)).agg(F.count(F.lit(1)).alias("n_rows"))


def raw_output_qc(df: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    """Rows, unique rows, parsed rows and missing numbers per model.

    Aggregated to (model, row) first, so the distinct count needs no second
    copy of the rows and a model with most of the data spreads over all tasks.
    """
    ok = F.coalesce(F.col(c.status).isin(*PARSE_OK), F.lit(False))
    per_row = df.groupBy(c.model, c.row_id).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ok"), F.count_if(F.col(c.estimate).isNull()).alias("miss")
    )
    return per_row.groupBy(c.model).agg(
        model_family(F.first(F.col(c.model).cast("string"))).alias("model_family"),
        F.sum("n").alias("n_rows"),
        F.count(c.row_id).alias("n_unique_rows"),
        F.sum("ok").alias("parse_ok_rows"),
        (F.sum("ok") / F.sum("n")).alias("parse_ok_rate"),
        F.sum("miss").alias("missing_prediction_rows"),
    )


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def fingerprint_parts(row_id: Column, prediction: Column) -> tuple[Column, Column]:
    """Two 52-bit integers of one (row, rounded prediction) pair."""
    digest = F.md5(F.concat_ws(":", row_id.cast("string"), prediction.cast("string")).cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, 13), 16, 10).cast("bigint")
    return part(1), part(14)


def prediction_vector_qc(df: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    """An order-free fingerprint of each model's predictions, with their spread.

    The fingerprint is the count and the sums of two digests per row: it combines
    in partial aggregates, never gathers a model's vector, and repeated rows count
    as often as they occur. Each digest is summed in two halves of 26 bits, which
    stay within a long up to 10^11 rows. Predictions are
    counted per (model, prediction) first for the distinct count.
    """
    est = F.col(c.estimate).cast("double")
    high, low = fingerprint_parts(F.col(c.row_id), F.bround(est, 0).cast("bigint"))
    halves = {"h": high, "l": low}
    upper = lambda part: F.sum(F.shiftright(part, 26))
    lower = lambda part: F.sum(part.bitwiseAND(F.lit((1 << 26) - 1)))
    whole = lambda name: (
        F.sum(name + "1").cast("decimal(28,0)") * F.lit(1 << 26).cast("decimal(9,0)") + F.sum(name + "0")
    ).cast("decimal(38,0)")
    digests = df.select(c.model, c.row_id, c.estimate, *[part.alias(name) for name, part in halves.items()])
    per_value = digests.groupBy(c.model, c.estimate).agg(
        F.count(F.lit(1)).alias("n"),
        *[upper(F.col(name)).alias(name + "1") for name in halves],
        *[lower(F.col(name)).alias(name + "0") for name in halves],
    )
    values = per_value.groupBy(c.model).agg(
        model_family(F.first(F.col(c.model).cast("string"))).alias("model_family"),
        F.sum("n").alias("n_rows"),
        whole("h").alias("__h"),
        whole("l").alias("__l"),
        F.count(c.estimate).alias("n_unique_predicted_salaries"),
        F.min(F.col(c.estimate).cast("double")).alias("min_predicted_salary_usd"),
        F.max(F.col(c.estimate).cast("double")).alias("max_predicted_salary_usd"),
    )
    unique = df.groupBy(c.model, c.row_id).agg(F.lit(1).alias("one")).groupBy(c.model).agg(
        F.count(F.lit(1)).alias("n_unique_rows")
    )
    fingerprint = F.concat_ws("-", F.col("n_rows"), F.col("__h"), F.col("__l"))
    return (
        values.join(unique, c.model)
        .withColumn("prediction_vector_hash", fingerprint)
        .select(
            c.model, "model_family", "n_rows", "n_unique_rows", "prediction_vector_hash",
            "n_unique_predicted_salaries", "min_predicted_salary_usd", "max_predicted_salary_usd",
        )
    )


def identical_vectors(vector_qc: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    """Model pairs with equal fingerprints, from the one-row-per-model table."""
    a = vector_qc.select(F.col(c.model).alias("model_a"), "prediction_vector_hash")
    b = vector_qc.select(F.col(c.model).alias("model_b"), "prediction_vector_hash")
    pairs = a.join(b, "prediction_vector_hash").where(F.col("model_a") < F.col("model_b"))
    return pairs.select(
        "model_a",
        "model_b",
        model_family(F.col("model_a").cast("string")).alias("model_a_family"),
        model_family(F.col("model_b").cast("string")).alias("model_b_family"),
        F.lit(True).alias("same_row_order"),
        F.lit(True).alias("same_prediction_vector"),
    )


def output_gate(df: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    """Pass or fail per model: has rows, none pending, some parsed."""
    done = F.coalesce(F.col(c.status).isin(*COMPLETED), F.lit(False))
    return (
        df.groupBy(c.model)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(done).alias("n_completed"),
            F.count_if(F.col(c.status) == "ok").alias("n_ok"),
            F.count_if(F.coalesce(c.status, F.lit("pending")) == "pending").alias("n_pending"),
        )
        .withColumn("passed", (F.col("n_rows") > 0) & (F.col("n_pending") == 0) & (F.col("n_ok") > 0))
    )


def run_counts(analysis: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    """Records, rows, models and blocks of a run in one row.

    Each distinct count is a plain two-step aggregate over one key column.
    """
    def distinct(column: str, name: str) -> Column:
        return analysis.select(column).distinct().agg(F.count(column).alias(name)).select(name).scalar()

    return analysis.agg(F.count(F.lit(1)).alias("n_model_row_records_used")).withColumns(
        {
            "n_unique_rows_used": distinct(c.row_id, "r"),
            "n_models_used": distinct(c.model, "m"),
            "n_blocks": distinct(c.block, "b"),
        }
    )
