"""The driver tables seen as an audit: observations, predictions, raw answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..columns import AuditColumns

N_MODELS = 6

COLS = AuditColumns(
    row_id="row_id", title="title", soc_code="status_code", soc_title="segment", city="city",
    state="state", naics="naics", full_time="full_time", positions="positions", wage_level="wage_level",
    actual="actual", estimate="est", status="status", raw="raw_output", label="is_ai",
    confidence="ai_confidence", job_key="job_key", block="block_id", model="model_id",
    family="model_family", cohort="cohort", source="source",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    key, nation = F.col("o_orderkey"), F.col("c_nationkey").cast("string")
    is_ai = F.col("o_orderpriority") == "1-URGENT"
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        key.alias("row_id"),
        F.concat("o_orderpriority", F.lit(" "), "c_mktsegment").alias("title"),
        F.col("o_orderstatus").alias("status_code"),
        nation.alias("state"),
        F.col("c_mktsegment").alias("segment"),
        F.concat_ws("||", "o_orderstatus", nation, "c_mktsegment").alias("block_id"),
        is_ai.alias("is_ai"),
        (key % 20 + 1).alias("positions"),
        (F.when(is_ai, (80 + key % 20).cast("double")).otherwise((key % 30).cast("double")) / 100).alias("ai_confidence"),
        F.col("o_totalprice").alias("actual"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six models; each observation yields its six rows without a shuffle."""
    m = F.col("model_id")
    wobble = ((F.col("row_id") * (2 * m + 3) + m * 7919) % 101).cast("double") / 250
    uplift = F.when(F.col("is_ai"), (2 * m).cast("double") / 100).otherwise(F.lit(0.0))
    return (
        audit_rows(spark, sf_dir)
        .withColumn("model_id", F.explode(F.array(*[F.lit(i) for i in range(N_MODELS)])))
        .withColumn("cohort", F.when(m < 4, "open").otherwise("closed"))
        .withColumn("est", F.round(F.col("actual") * (F.lit(80.0) / 100 + wobble + uplift)).cast("bigint"))
    )


def raw_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text answers, good and bad, for every prediction."""
    est, kind = F.col("est").cast("string"), (F.col("row_id") * 7 + F.col("model_id")) % 20
    text = (
        F.when(kind == 0, F.lit(""))
        .when(kind == 1, F.concat(est, F.lit("-"), (F.col("est") + 1000).cast("string")))
        .when(kind == 2, F.concat(F.lit("about "), est))
        .when(kind == 3, F.concat(F.lit("$"), est))
        .when(kind == 4, F.lit("n/a"))
        .when(kind == 5, F.concat(est, F.lit(" USD")))
        .when(kind == 6, F.concat(est, F.lit(".00")))
        .otherwise(est)
    )
    return predictions(spark, sf_dir).withColumn("raw_output", text)
