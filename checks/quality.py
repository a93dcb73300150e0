"""Joins (J), set operations (U), metrics (B), quality and summaries (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditspark.columns import DIFF_USD, IS_AI, LOG_RATIO, PCT_POINTS, RATIO
from auditspark.operators import filters, joins, labelling, metrics, quality, ranking, scoring, summaries
from auditspark.plans import fixtures as fx
from auditspark.plans.fixtures import COLS, table
from auditspark.session import materialize
from auditspark.sources import readers

from .registry import audit, query, r
from .scalars import answers


def long_rows(spark, d):
    """Parsed answers with metrics and a 0/1 label. The answers are parsed once
    and stored: a filter on the result would otherwise parse every text again."""
    stored = materialize(answers(spark, d).drop("raw_output", "title", "positions"), "answers")
    rows = filters.parsed_rows(stored, COLS).withColumn(IS_AI, F.col("is_ai").cast("int"))
    return metrics.with_metrics(rows, COLS)


def stored_rows(spark, d):
    """The row averages, stored for operators that read them more than once."""
    return materialize(row_table(spark, d), "rows")


def row_table(spark, d):
    return metrics.row_averages(long_rows(spark, d), COLS, ["block_id", "actual", "is_ai", IS_AI, "ai_confidence", "state", "segment"])


SCORES = """scores as (select job_key, max(ai_confidence) as score from
 (select concat_ws(' || ', title, status_code, segment) as job_key, ai_confidence from audit_rows where is_ai or state = '7') group by job_key)"""


def score_rows(spark, d):
    """A score file with one row per observation: many rows per key."""
    rows = fx.audit_rows(spark, d).where(F.col("is_ai") | (F.col("state") == "7"))
    return readers.score_table(rows.withColumnsRenamed({"status_code": "soc_code", "segment": "SOC_TITLE"}), COLS_SCORE)


COLS_SCORE = COLS.__class__(**{**COLS.__dict__, "soc_title": "SOC_TITLE", "soc_code": "soc_code"})


def keyed_rows(spark, d):
    key = F.concat_ws(" || ", "title", "status_code", "segment")
    return fx.audit_rows(spark, d).withColumn("job_key", key)


@query(
    "j1_scores_by_job_key",
    audit(f"select row_id, {r('score', 'score')} from audit_rows left join scores on concat_ws(' || ', title, status_code, segment) = job_key").replace(
        "select row_id, round", ", " + SCORES + " select row_id, round", 1
    ),
)
def j1(spark, d):
    scores = score_rows(spark, d).withColumnRenamed("ai_confidence", "score")
    return joins.lookup_join(keyed_rows(spark, d), scores, ["job_key"], "left", ["row_id"]).select("row_id", "score")


@query(
    "j1_scores_salted",
    audit(f"select row_id, {r('score', 'score')} from audit_rows left join scores on concat_ws(' || ', title, status_code, segment) = job_key").replace(
        "select row_id, round", ", " + SCORES + " select row_id, round", 1
    ),
)
def j1_salted(spark, d):
    scores = score_rows(spark, d).withColumnRenamed("ai_confidence", "score")
    return joins.lookup_join(keyed_rows(spark, d), scores, ["job_key"], "left", ["row_id"], limit=0).select("row_id", "score")


@query(
    "j2_merge_metadata",
    audit(f"select p.model_id, p.row_id, p.block_id, a.block_id as block_id_meta, {r('a.ai_confidence * 2', 'doubled')} from predictions p left join audit_rows a on a.row_id = p.row_id"),
)
def j2(spark, d):
    meta = fx.audit_rows(spark, d).select("row_id", "block_id", (F.col("ai_confidence") * 2).alias("doubled"))
    return joins.left_join_renamed(fx.predictions(spark, d), meta, "row_id").select(
        "model_id", "row_id", "block_id", "block_id_meta", "doubled"
    )


@query(
    "j3_base_with_row_averages",
    audit(f"select row_id, block_id, {r('conf', 'ai_confidence')}, {r('mean_pct', 'mean_pct')} from row_avg", parsed=True),
)
def j3(spark, d):
    return row_table(spark, d).select(
        "row_id", "block_id", "ai_confidence", F.col("mean_overestimation_pct_points").alias("mean_pct")
    )


@query(
    "j4_scored_by_all_models",
    audit("select row_id from answers where value is not null group by row_id having count(distinct model_id) = 6", parsed=True),
)
def j4(spark, d):
    parsed = filters.parsed_rows(answers(spark, d), COLS)
    return joins.scored_by_all(parsed, "row_id", "model_id", fx.N_MODELS)


def ai_titles(spark, d):
    """A title list read off the tables, with other case and spacing."""
    rows = fx.audit_rows(spark, d).where(F.col("title").rlike("^[12]-") & (F.col("segment") != "BUILDING"))
    return rows.select(F.concat(F.lit(" "), F.lower("title"), F.lit("  ")).alias("t")).distinct()


@query(
    "j5_label_by_title",
    audit("select row_id, (title like '1-%' or title like '2-%') and segment <> 'BUILDING' as labelled from audit_rows"),
)
def j5(spark, d):
    out = labelling.label_by_titles(fx.audit_rows(spark, d), ai_titles(spark, d), COLS, "labelled")
    return out.select("row_id", "labelled")


@query(
    "j6_common_blocks",
    audit("select block_id from audit_rows where is_ai intersect select block_id from audit_rows where not is_ai"),
)
def j6(spark, d):
    return labelling.eligible_blocks(labelling.block_counts(fx.audit_rows(spark, d), COLS)).select("block_id")


@query(
    "j7_resume_pending",
    audit("select model_id, row_id from predictions where not (cohort = 'open' and est > actual)"),
)
def j7(spark, d):
    requested = fx.predictions(spark, d)
    stored = requested.where("cohort = 'open'").select(
        "model_id", "row_id", F.when(F.col("est") > F.col("actual"), "no_number").alias("status")
    )
    return scoring.pending_rows(requested, stored, ["model_id", "row_id"], COLS).select("model_id", "row_id")


@query(
    "j8_upsert",
    audit("select model_id, row_id, case when is_ai then case when est > actual then null else est + 1 end else est end as est from predictions"),
)
def j8(spark, d):
    base = fx.predictions(spark, d)
    fixes = base.where("is_ai").select(
        "model_id", "row_id", F.when(F.col("est") <= F.col("actual"), F.col("est") + 1).alias("est")
    )
    return joins.upsert(base, fixes, ["model_id", "row_id"], ["est"]).select("model_id", "row_id", "est")


TWINS = """twins as (select model_id, row_id, case when model_id in (1, 4) then (select 0) + cast(round(actual) as bigint) else est end as est from predictions)"""


def twin_models(spark, d):
    same = F.round("actual").cast("bigint")
    return fx.predictions(spark, d).withColumn("est", F.when(F.col("model_id").isin(1, 4), same).otherwise(F.col("est")))


@query(
    "j9_identical_vectors",
    audit(
        """select a.model_id as model_a, b.model_id as model_b from twins a join twins b on a.row_id = b.row_id and a.est = b.est and a.model_id < b.model_id
     group by all having count(*) = (select count(*) from audit_rows)"""
    ).replace("select a.model_id as model_a", ", " + TWINS + " select a.model_id as model_a", 1),
)
def j9(spark, d):
    pairs = quality.identical_vectors(quality.prediction_vector_qc(twin_models(spark, d), COLS), COLS)
    return pairs.select("model_a", "model_b")


@query(
    "u1_union_models",
    audit("select model_id, count(*) as n_rows, sum(coalesce(extra, 0))::bigint as extras from (select model_id, 0 as extra from predictions where model_id < 3 union all select model_id, 1 from predictions where model_id >= 3) group by model_id"),
)
def u1(spark, d):
    p = fx.predictions(spark, d)
    both = p.where("model_id < 3").unionByName(p.where("model_id >= 3").withColumn("extra", F.lit(1)), allowMissingColumns=True)
    return both.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.coalesce("extra", F.lit(0))).alias("extras"))


@query("u2_shared_states", "select distinct n_name from nation join customer on c_nationkey = n_nationkey where n_nationkey in (select s_nationkey from supplier)")
def u2(spark, d):
    nations = table(spark, d, "nation")
    used = nations.join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return used.join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("n_name")


@query("u3_distinct", "select distinct p_name as job_title from part where p_name is not null")
def u3(spark, d):
    return readers.distinct_titles(table(spark, d, "part"), "p_name")


# Metrics -------------------------------------------------------------------

@query(
    "b1_signed_pct_bias",
    audit(f"select model_id, row_id, {r('case when actual >= 50000 and (is_ai or model_id < 4) then greatest(least((est - actual) / actual * 100, 15), -15) end', 'spb')} from predictions"),
)
def b1(spark, d):
    from auditspark.functions.numeric import signed_pct_bias

    est = F.when(F.col("is_ai") | (F.col("cohort") == "open"), F.col("est"))
    return fx.predictions(spark, d).select("model_id", "row_id", signed_pct_bias(est, F.col("actual"), 50000, 15).alias("spb"))


@query(
    "b2_row_metrics",
    audit(
        f"""select model_id, row_id, {r('est - actual', DIFF_USD)}, {r('est / actual', RATIO)},
     {r('100 * (est - actual) / actual', PCT_POINTS)}, {r('ln(est) - ln(actual)', LOG_RATIO)} from predictions"""
    ),
)
def b2(spark, d):
    return metrics.with_metrics(fx.predictions(spark, d), COLS).select("model_id", "row_id", DIFF_USD, RATIO, PCT_POINTS, LOG_RATIO)


@query(
    "b3_mape",
    audit(f"select model_id, {r('avg(abs(spb)) filter (is_ai)', 'mape_ai')}, {r('avg(abs(spb)) filter (not is_ai)', 'mape_other')} from spb group by model_id"),
)
def b3(spark, d):
    return metrics.mape(metrics.with_spb(fx.predictions(spark, d), COLS), ["model_id"], COLS)


@query(
    "b4_model_uplift",
    audit(
        f"""select cohort, model_id, {r('avg(spb) filter (is_ai)', 'mean_ai')}, {r('avg(spb) filter (not is_ai)', 'mean_other')},
     {r('avg(spb) filter (is_ai) - avg(spb) filter (not is_ai)', 'uplift')} from spb group by cohort, model_id"""
    ),
)
def b4(spark, d):
    return metrics.model_uplift(metrics.with_spb(fx.predictions(spark, d), COLS), ["cohort", "model_id"], COLS)


@query(
    "b5_row_averages",
    audit(
        f"""select row_id, block_id, {r('actual', 'actual')}, n_models, {r('mean_est', 'mean_predicted_salary_usd')}, {r('med_est', 'median_predicted_salary_usd')},
     {r('mean_usd', 'mean_overestimation_usd')}, {r('med_usd', 'median_overestimation_usd')}, {r('mean_pct', 'mean_overestimation_pct_points')},
     {r('med_pct', 'median_overestimation_pct_points')}, {r('mean_ratio', 'mean_prediction_to_actual_ratio')},
     {r('mean_log', 'mean_log_prediction_minus_log_actual')} from row_avg""",
        parsed=True,
    ),
)
def b5(spark, d):
    return row_table(spark, d).drop("is_ai", IS_AI, "ai_confidence", "state", "segment")


# Quality and summaries ------------------------------------------------------

STATUSES = "case when actual > 400000 then null else status end"


def gappy(spark, d):
    gap = F.col("actual") > 400000
    return answers(spark, d).withColumn("status", F.when(~gap, F.col("status")))


@query(
    "a1_status_counts",
    audit(f"select model_id, {STATUSES} as status, count(*) as n_rows from answers group by all", parsed=True),
)
def a1(spark, d):
    return quality.status_counts(gappy(spark, d), COLS)


@query(
    "a2_raw_output_qc",
    audit(
        f"""select model_id, 'Other' as model_family, count(*) as n_rows, count(distinct row_id) as n_unique_rows,
     count(*) filter (status in ('ok', 'ok_legacy_missing_parse_status')) as parse_ok_rows,
     {r("avg(case when status in ('ok', 'ok_legacy_missing_parse_status') then 1.0 else 0.0 end)", 'parse_ok_rate')}, count(*) filter (value is null) as missing_prediction_rows
     from (select * exclude (status), {STATUSES} as status from answers) group by model_id""",
        parsed=True,
    ),
)
def a2(spark, d):
    return quality.raw_output_qc(gappy(spark, d), COLS)


@query(
    "a3_duplicate_rows",
    "select l_orderkey, l_suppkey, count(*) as n_rows from lineitem group by all having count(*) > 1",
)
def a3(spark, d):
    return quality.duplicate_rows(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"])


def _part(at: int) -> str:
    return f"sum(('0x' || substr(md5(concat_ws(':', row_id, est)), {at}, 13))::bigint)"


@query(
    "a4_prediction_vectors",
    audit(
        f"""select model_id, 'Other' as model_family, count(*) as n_rows, count(distinct row_id) as n_unique_rows,
     concat_ws('-', count(*), {_part(1)}, {_part(14)}) as prediction_vector_hash,
     count(distinct est) as n_unique_predicted_salaries, {r('min(est)', 'min_predicted_salary_usd')}, {r('max(est)', 'max_predicted_salary_usd')}
     from predictions group by model_id"""
    ),
)
def a4(spark, d):
    return quality.prediction_vector_qc(fx.predictions(spark, d), COLS)


@query(
    "a5_identical_pairs",
    audit(
        """select a.model_id as model_a, b.model_id as model_b, 'Other' as model_a_family, 'Other' as model_b_family,
     true as same_row_order, true as same_prediction_vector from twins a join twins b on a.row_id = b.row_id and a.est = b.est and a.model_id < b.model_id
     group by a.model_id, b.model_id having count(*) = (select count(*) from audit_rows)"""
    ).replace("select a.model_id as model_a", ", " + TWINS + " select a.model_id as model_a", 1),
)
def a5(spark, d):
    return quality.identical_vectors(quality.prediction_vector_qc(twin_models(spark, d), COLS), COLS)


@query(
    "a6_model_summary",
    audit(
        f"""select model_id, 'Other' as model_family, count(*) as n_rows, count(*) filter (is_ai) as n_ai_rows, count(*) filter (not is_ai) as n_other_rows,
     {r('avg(actual)', 'mean_actual_usd', 4)}, {r('avg(value)', 'mean_predicted_usd', 4)}, {r('avg(usd)', 'mean_overestimation_usd', 4)},
     {r('median(usd)', 'median_overestimation_usd', 4)}, {r('avg(pct)', 'mean_overestimation_pct_points', 4)}, {r('median(pct)', 'median_overestimation_pct_points', 4)},
     {r('avg(pct) filter (is_ai)', 'mean_ai_overestimation_pct_points', 4)}, {r('avg(pct) filter (not is_ai)', 'mean_other_overestimation_pct_points', 4)},
     {r('avg(pct) filter (is_ai) - avg(pct) filter (not is_ai)', 'delta_ai_minus_other_pct_points', 4)},
     {r('avg(usd) filter (is_ai)', 'mean_ai_overestimation_usd', 4)}, {r('avg(usd) filter (not is_ai)', 'mean_other_overestimation_usd', 4)},
     {r('avg(usd) filter (is_ai) - avg(usd) filter (not is_ai)', 'delta_ai_minus_other_usd', 4)},
     {r('corr(ai_confidence, pct)', 'corr_ai_confidence_overestimation_pct_points', 4)} from long group by model_id""",
        parsed=True,
    ),
    digits=4,
)
def a6(spark, d):
    return summaries.model_summary(long_rows(spark, d), COLS)


@query(
    "a7_label_group_summary",
    audit(
        f"""select case when is_ai then 'AI' else 'Other' end as "group", count(*) as n_rows, {r('avg(conf)', 'mean_ai_confidence', 4)}, {r('avg(actual)', 'mean_actual_usd', 4)},
     {r('avg(mean_est)', 'mean_predicted_salary_usd', 4)}, {r('avg(mean_usd)', 'mean_overestimation_usd', 4)}, {r('median(mean_usd)', 'median_overestimation_usd', 4)},
     {r('avg(mean_pct)', 'mean_overestimation_pct_points', 4)}, {r('median(mean_pct)', 'median_overestimation_pct_points', 4)} from row_avg group by is_ai""",
        parsed=True,
    ),
    digits=4,
)
def a7(spark, d):
    return summaries.label_group_summary(stored_rows(spark, d), COLS)


@query(
    "a8_block_contrasts",
    audit(
        f"""select block_id, n_ai as n_ai_rows, n_other as n_other_rows, {r('ai_pct', 'mean_ai_overestimation_pct_points', 7)}, {r('other_pct', 'mean_other_overestimation_pct_points', 7)},
     {r('ai_pct - other_pct', 'delta_pct_points_ai_minus_other', 7)}, {r('ai_med', 'median_ai_overestimation_pct_points', 7)}, {r('other_med', 'median_other_overestimation_pct_points', 7)},
     {r('ai_usd', 'mean_ai_overestimation_usd', 7)}, {r('other_usd', 'mean_other_overestimation_usd', 7)}, {r('ai_usd - other_usd', 'delta_usd_ai_minus_other', 7)},
     {r('ai_conf', 'mean_ai_confidence', 7)}, {r('other_conf', 'mean_other_confidence', 7)}, {r('n_ai::double * n_other / (n_ai + n_other)', 'harmonic_weight', 7)} from blocks""",
        parsed=True,
    ),
    digits=7,
)
def a8(spark, d):
    return summaries.block_contrasts(stored_rows(spark, d), COLS)


@query(
    "a9_model_block_contrasts",
    audit(
        f"""select model_id, 'Other' as model_family, block_id, n_ai as n_ai_rows, n_other as n_other_rows, {r('ai_pct', 'mean_ai_overestimation_pct_points', 7)},
     {r('other_pct', 'mean_other_overestimation_pct_points', 7)}, {r('ai_pct - other_pct', 'delta_pct_points_ai_minus_other', 7)},
     {r('ai_usd', 'mean_ai_overestimation_usd', 7)}, {r('other_usd', 'mean_other_overestimation_usd', 7)}, {r('ai_usd - other_usd', 'delta_usd_ai_minus_other', 7)} from model_blocks""",
        parsed=True,
    ),
    digits=7,
)
def a9(spark, d):
    return summaries.model_block_contrasts(long_rows(spark, d), COLS)


@query(
    "a10_pooled_cohorts",
    audit(
        f"""select cohort, count(distinct model_id) as n_models, count(*) as n_predictions, count(*) filter (is_ai) as n_ai, count(*) filter (not is_ai) as n_other,
     {r('avg(spb) filter (is_ai)', 'mean_ai')}, {r('avg(spb) filter (not is_ai)', 'mean_other')}, {r('median(spb) filter (is_ai)', 'median_ai')},
     {r('median(spb) filter (not is_ai)', 'median_other')}, {r('avg(spb) filter (is_ai) - avg(spb) filter (not is_ai)', 'uplift')} from spb group by cohort"""
    ),
)
def a10(spark, d):
    return summaries.cohort_pool_summary(metrics.with_spb(fx.predictions(spark, d), COLS), COLS)


@query(
    "a11_run_counts",
    audit(
        """select count(*) as n_model_row_records_used, count(distinct row_id) as n_unique_rows_used, count(distinct model_id) as n_models_used,
     count(distinct block_id) as n_blocks from predictions"""
    ),
)
def a11(spark, d):
    return quality.run_counts(fx.predictions(spark, d), COLS)


UPLIFTS = "(select cohort, model_id, avg(spb) filter (is_ai) - avg(spb) filter (not is_ai) as uplift from spb group by cohort, model_id)"


def uplifts(spark, d):
    return metrics.model_uplift(metrics.with_spb(fx.predictions(spark, d), COLS), ["cohort", "model_id"], COLS)


@query(
    "a12_cohort_uplifts",
    audit(f"select cohort, count(*) as n_models, {r('avg(uplift)', 'mean_uplift')}, {r('stddev_samp(uplift)', 'sd_uplift')} from {UPLIFTS} group by cohort"),
)
def a12(spark, d):
    return summaries.cohort_uplift_summary(uplifts(spark, d), COLS)


@query(
    "a13_exact_percentiles",
    audit(
        "select model_id, "
        + ", ".join(r(f"quantile_cont({m}, {p})", f"{name}_{m}", 4) for m in ("spb", "est") for name, p in (("p025", 0.025), ("p50", 0.5), ("p95", 0.95)))
        + " from spb group by model_id"
    ),
    digits=4,
)
def a13(spark, d):
    rows = metrics.with_spb(fx.predictions(spark, d), COLS)
    return ranking.exact_quantiles(
        rows, ["model_id"], {"spb": F.col("spb"), "est": F.col("est")}, {"p025": 0.025, "p50": 0.5, "p95": 0.95}
    )
