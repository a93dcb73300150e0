"""Cases in which an earlier version gave another answer."""

import pytest
from pyspark.sql import functions as F

from auditspark.columns import DEFAULT as C
from auditspark.operators import filters, labelling, quality, stat_tests
from auditspark.plans import compare
from auditspark.sources import readers


def answers(spark, rows):
    return spark.createDataFrame(rows, f"{C.model} string, {C.row_id} long, {C.status} string, {C.estimate} double")


def test_only_parsed_answers_count_as_ok(spark):
    """560 of 2,000 answers parsed, and a model with none (recorded run)."""
    n = spark.range(2000).withColumn(C.estimate, F.when(F.col("id") < 560, 90_000.0))
    llama = n.select(F.lit("llama").alias(C.model), F.col("id").alias(C.row_id),
                     F.when(F.col("id") < 560, "ok").otherwise("multiple_numbers_or_range").alias(C.status), C.estimate)
    mistral = n.select(F.lit("mistral").alias(C.model), F.col("id").alias(C.row_id), F.lit("malformed").alias(C.status),
                       F.lit(None).cast("double").alias(C.estimate))
    got = {r[C.model]: r for r in quality.raw_output_qc(llama.unionByName(mistral)).collect()}
    assert (got["llama"]["parse_ok_rows"], got["llama"]["parse_ok_rate"]) == (560, 0.28)
    assert (got["mistral"]["parse_ok_rows"], got["mistral"]["parse_ok_rate"]) == (0, 0.0)


def test_a_number_with_a_bad_status_is_left_out(spark):
    df = answers(spark, [("m", 1, "ok", 1.0), ("m", 2, "malformed", 5.0), ("m", 3, None, 5.0), ("m", 4, "ok_legacy_missing_parse_status", 2.0)])
    assert sorted(r[C.row_id] for r in filters.parsed_rows(df).collect()) == [1, 4]


def test_repeated_rows_do_not_cancel_in_fingerprints(spark):
    df = answers(spark, [("a", 1, "ok", 5.0), ("a", 1, "ok", 5.0), ("a", 2, "ok", 7.0),
                         ("b", 3, "ok", 9.0), ("b", 3, "ok", 9.0), ("b", 2, "ok", 7.0),
                         ("c", 2, "ok", 7.0), ("c", 1, "ok", 5.0), ("c", 1, "ok", 5.0)])
    pairs = quality.identical_vectors(quality.prediction_vector_qc(df)).select("model_a", "model_b").collect()
    assert [tuple(p) for p in pairs] == [("a", "c")]


def test_paired_rows_need_every_model_once(spark):
    rows = []
    for k in range(8):
        rows += [("open", m, k, 100.0 + k * (k % 3), 100.0, k % 2 == 0) for m in ("x", "y")]
    schema = f"{C.cohort} string, {C.model} string, {C.row_id} long, {C.estimate} double, {C.actual} double, {C.label} boolean"
    good = spark.createDataFrame(rows, schema)
    bad = spark.createDataFrame([("open", "x", 50, 9e5, 100.0, True), ("open", "x", 50, 9e5, 100.0, True)], schema)
    both = [stat_tests.paired_welch(df).select("n1", "n2", "diff").first() for df in (good, good.unionByName(bad))]
    assert both[0] == both[1]


def test_answers_are_stripped_of_all_white_space(spark):
    def factory():
        return lambda chats: [" Yes\n" for _ in chats]

    titles = spark.createDataFrame([("AI engineer",)], "job_title string")
    assert [r["AI_job"] for r in labelling.classify_titles(titles, factory).collect()] == [True]


@pytest.mark.parametrize("folder", ["my model", "a+b", "plain", "ü%20"])
def test_model_folder_with_escaped_characters(spark, folder):
    row = spark.createDataFrame([("x",)], "x string").select(
        readers.plain_path(F.lit("file:/runs/" + folder.replace("%", "%25").replace(" ", "%20").replace("ü", "%C3%BC") + "/f.csv")).alias("p")
    ).first()
    assert row["p"] == f"file:/runs/{folder}/f.csv"


def test_a_third_cohort_does_not_enter_the_permutation(spark):
    rows = []
    for cohort, models in (("open", "abc"), ("closed", "def"), ("other", "gh")):
        for i, m in enumerate(models):
            for k in range(8):
                rows.append((cohort, m, k, 100.0 + (k % 2) * (5 + i) + (900 if cohort == "other" else 0), 100.0, k % 2 == 0, "b%d" % (k // 4)))
    schema = f"{C.cohort} string, {C.model} string, {C.row_id} long, {C.estimate} double, {C.actual} double, {C.label} boolean, {C.block} string"
    df = spark.createDataFrame(rows, schema)
    three, two = (compare.compare_cohorts(d, n_permutations=40) for d in (df, df.where(F.col(C.cohort) != "other")))
    assert three["permutation"].first() == two["permutation"].first()
