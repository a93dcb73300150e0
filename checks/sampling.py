"""Labelling (L), sampling (M) and window (W) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditspark.operators import labelling, ranking, sampling
from auditspark.plans import fixtures as fx, sample as sample_plan
from auditspark.plans.fixtures import COLS, table
from auditspark.session import materialize

from .registry import audit, query, r, u52
from .scalars import LEVEL, STATUS, UNIT

TITLE = "concat(case p_partkey % 14 when 0 then 'Senior AI Engineer ' when 1 then 'First aid ' when 2 then 'BI Intelligence ' when 3 then 'Lead, A.I. ' when 4 then 'MLOps-' when 5 then 'Data Scientist ' when 6 then 'machine  learning ' when 7 then 'Prompt Engineering/' when 8 then 'Email ML2 ' when 9 then 'HTML ' when 10 then 'LLMs for ' when 11 then 'Deep Learning_' when 12 then '(GenAI) ' else 'Neural Networks: ' end, p_name)"


def _pattern() -> str:
    return r"(?i)(?:^|[^a-z0-9_])(?:" + "|".join(labelling.AI_TERMS) + r")(?:$|[^a-z0-9_])"


def in_order(df):
    """Each row of a sorted table with its place (from 1), as the rows come out."""
    numbered = df.rdd.zipWithIndex().map(lambda pair: (*pair[0], pair[1] + 1))
    return df.sparkSession.createDataFrame(numbered, df.schema.add("place", "long"))


def yes_scorer():
    """Stand-in model: Yes for titles with an even number of characters."""

    def answer(chats):
        out = []
        for chat in chats:
            title = chat[1]["content"].split("'")[1]
            out.append(" Yes\n" if len(title) % 2 == 0 else "Yes, probably")
        return out

    return answer


@query("l1_classify_titles", "select job_title, length(job_title) % 2 = 0 as \"AI_job\", cast(null as varchar) as error from (select distinct p_name as job_title from part)")
def l1(spark, d):
    titles = table(spark, d, "part").select(F.col("p_name").alias("job_title"))
    return labelling.classify_titles(titles, yes_scorer)


@query("l2_keyword_titles", f"select p_partkey, regexp_matches({TITLE}, '{_pattern()}') as is_ai from part")
def l2(spark, d):
    return table(spark, d, "part").select("p_partkey", labelling.keyword_label(F.expr(TITLE)).alias("is_ai"))


@query("l2_keyword_documents", f"select doc_id, coalesce(regexp_matches(text, '{_pattern()}'), false) as is_ai from documents")
def l2_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", labelling.keyword_label(F.col("text")).alias("is_ai"))


@query(
    "l3_label_rows_salted",
    audit("select row_id, (title like '1-%' or title like '2-%') and segment <> 'BUILDING' as labelled from audit_rows"),
)
def l3(spark, d):
    from .quality import ai_titles

    out = labelling.label_by_titles(fx.audit_rows(spark, d), ai_titles(spark, d), COLS, "labelled", limit=0)
    return out.select("row_id", "labelled")


BLOCKS = """eligible as (select block_id, count(*) filter (is_ai) as n_ai, count(*) filter (not is_ai) as n_other,
 least(count(*) filter (is_ai), count(*) filter (not is_ai)) as capacity from audit_rows group by block_id
 having count(*) filter (is_ai) >= 1 and count(*) filter (not is_ai) >= 1)"""


def with_blocks(body: str, more: str = "") -> str:
    from .registry import AUDIT

    return "with " + AUDIT.strip() + ", " + BLOCKS + (", " + more if more else "") + " " + body


def eligible(spark, d):
    return materialize(labelling.eligible_blocks(labelling.block_counts(fx.audit_rows(spark, d), COLS)), "blocks")


@query("l4_block_counts", audit("select block_id, count(*) filter (is_ai) as n_ai, count(*) filter (not is_ai) as n_other from audit_rows group by block_id"))
def l4(spark, d):
    return labelling.block_counts(fx.audit_rows(spark, d), COLS)


@query("l5_eligible_blocks", with_blocks("select * from eligible where n_ai >= 4 and n_other >= 10"))
def l5(spark, d):
    return labelling.eligible_blocks(labelling.block_counts(fx.audit_rows(spark, d), COLS), 4, 10)


@query("l6_feasible_target", with_blocks("select least(cast(1000000 as bigint), sum(least(capacity, 5)))::bigint as target from eligible"))
def l6(spark, d):
    blocks = eligible(spark, d)
    target = sampling.feasible_target(blocks, 1_000_000, 5, allow_short=True)
    return blocks.agg(F.lit(target).cast("bigint").alias("target"))


@query(
    "m1_block_weights",
    with_blocks(
        f"select block_id, {r('1.0', 'uniform')}, {r('sqrt(least(capacity, 6))', 'sqrt')}, {r('1 / sqrt(least(capacity, 6))', 'inverse_sqrt')} from eligible"
    ),
)
def m1(spark, d):
    cap = sampling.effective_capacity(6)
    return eligible(spark, d).select("block_id", *[sampling.block_weight(cap, m).alias(m) for m in ("uniform", "sqrt", "inverse_sqrt")])


def race_sql(weight: str, cap: int, target: int, seed: int, body: str) -> str:
    u = u52(f"concat_ws('|', '{seed}', block_id, k)")
    more = f"""gaps as (select block_id, k, -ln({u}) / ({weight}) as gap from (select block_id, least(capacity, {cap}) as c,
     unnest(range(1, least(capacity, {cap}, {target}) + 1)) as k from eligible)),
     arrivals as (select block_id, sum(gap) over (partition by block_id order by k) as t from gaps),
     first_ones as (select * from arrivals order by t limit {target}),
     quotas as (select block_id, count(*) as quota from first_ones group by block_id)"""
    return with_blocks(body, more)


TARGET, CAP, SEED = 700, 10, 7


def race(blocks, target, seed, mode, cap=0):
    """Quotas for the target, or for all the blocks hold on the smallest tables."""
    target = sampling.feasible_target(blocks, target, cap, allow_short=True)
    return sampling.quota_race(blocks, target, seed, mode, cap)


@query("m2_quota_race", race_sql("1 / sqrt(c)", CAP, TARGET, SEED, "select * from quotas"))
def m2(spark, d):
    return race(eligible(spark, d), TARGET, SEED, "inverse_sqrt", CAP)


@query("m2_quota_race_sqrt", race_sql("sqrt(c)", 1000000, 900, 11, "select * from quotas"))
def m2_sqrt(spark, d):
    return race(eligible(spark, d), 900, 11, "sqrt")


def proportional_sql(weight: str, cap: int, target: int) -> str:
    edge = u52("concat_ws('|', 'edge', block_id)")
    more = f"""b as (select block_id, least(capacity, {cap}) as cap, {weight.format(c=f'least(capacity, {cap})')} as w from eligible),
     swept as (select *, sum(cap) over (order by cap) + cap / w * (sum(w) over () - sum(w) over (order by cap)) <= {target} + 1e-9 as sat from b),
     level as (select ({target} - sum(case when sat then cap else 0 end)) / sum(case when sat then 0 else w end) as v from swept),
     shares as (select block_id, cap, case when sat then cap::double else v * w end as share from swept, level),
     floors as (select block_id, cap, floor(share + 1e-9)::bigint as base, round(share - floor(share + 1e-9), 9) as rem from shares),
     placed as (select *, row_number() over (partition by base < cap order by rem desc, cap, {edge}, block_id) as place,
      {target} - sum(base) over () as spare from floors),
     dealt as (select block_id, (base + case when base < cap and place <= spare then 1 else 0 end)::bigint as quota from placed)"""
    return with_blocks("select * from dealt where quota > 0", more)


@query("m3_quota_proportional", proportional_sql("1 / sqrt({c})", CAP, TARGET))
def m3(spark, d):
    return sampling.quota_proportional(eligible(spark, d), TARGET, "inverse_sqrt", CAP)


def m_quotas(spark, d):
    blocks = eligible(spark, d)
    quotas = race(blocks, TARGET, SEED, "inverse_sqrt", CAP)
    return materialize(quotas.join(blocks.select("block_id", "n_ai", "n_other"), "block_id"), "quotas")


DRAWN = f"""select row_id, block_id, is_ai from (select a.row_id, a.block_id, a.is_ai, quota,
 row_number() over (partition by a.block_id, a.is_ai order by {u52("concat_ws('|', '3', a.row_id)")}, a.row_id) as rn
 from audit_rows a join quotas q on a.block_id = q.block_id) where rn <= quota"""


@query("m4_sample_within_blocks", race_sql("1 / sqrt(c)", CAP, TARGET, SEED, DRAWN))
def m4(spark, d):
    return sampling.sample_within_blocks(fx.audit_rows(spark, d), m_quotas(spark, d), 3, COLS).select("row_id", "block_id", "is_ai")


@query("m4_sample_salted", race_sql("1 / sqrt(c)", CAP, TARGET, SEED, DRAWN))
def m4_salted(spark, d):
    return sampling.sample_within_blocks(fx.audit_rows(spark, d), m_quotas(spark, d), 3, COLS, limit=0).select("row_id", "block_id", "is_ai")


@query("m5_seeded_order", f"select o_orderkey, o_totalprice, row_number() over (order by {u52(chr(39).join(['concat_ws(', '|', ', ', '5', ', ', 'order', ', o_orderkey)']))}, o_orderkey) as place from orders")
def m5(spark, d):
    return in_order(sampling.shuffled(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 5, "o_orderkey"))


@query("m6_balance_audit", audit("select block_id, count(*) filter (is_ai) as n_ai, count(*) filter (not is_ai) as n_other from audit_rows group by block_id having count(*) filter (is_ai) <> count(*) filter (not is_ai)"))
def m6(spark, d):
    return sampling.unbalanced_blocks(fx.audit_rows(spark, d), COLS)


def raw_filings(spark, d):
    """Orders as a disclosure file with every column the sampler reads."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("ROW_ID"),
        F.concat(F.lit(" "), "o_orderpriority", F.lit("  "), "c_mktsegment").alias("JOB_TITLE"),
        F.col("o_orderstatus").alias("SOC_CODE"),
        F.col("c_nationkey").cast("string").alias("WORKSITE_STATE"),
        F.lit(None).cast("string").alias("NAICS_CODE"),
        F.lit("Y").alias("FULL_TIME_POSITION"),
        F.expr(LEVEL).alias("PW_WAGE_LEVEL"),
        F.expr(STATUS).alias("CASE_STATUS"),
        F.expr(UNIT).alias("PW_UNIT_OF_PAY"),
        F.lit("Year").alias("WAGE_UNIT_OF_PAY"),
    )


M7 = f"""with audit_rows as (select o_orderkey as row_id, concat_ws('||', o_orderstatus, c_nationkey, 'UNK', 'Y', 'II') as block_id,
  o_orderpriority in ('1-URGENT', '5-LOW') as is_ai from orders join customer on o_custkey = c_custkey
  where {STATUS} = 'Certified' and {LEVEL} is not null and lower(trim({UNIT})) = 'year'), {BLOCKS},
 gaps as (select block_id, k, -ln({u52("concat_ws('|', '2', block_id, k)")}) / (1 / sqrt(c)) as gap from (select block_id, least(capacity, 8) as c,
  unnest(range(1, least(capacity, 8, 100) + 1)) as k from eligible)),
 arrivals as (select block_id, sum(gap) over (partition by block_id order by k) as t from gaps),
 first_ones as (select * from arrivals order by t limit 100),
 quotas as (select block_id, count(*) as quota from first_ones group by block_id)
 select row_id as "ROW_ID", block_id as "BLOCK_ID", is_ai as "IS_AI" from (select a.*, quota,
  row_number() over (partition by a.block_id, a.is_ai order by {u52("concat_ws('|', '2', a.row_id)")}, a.row_id) as rn
  from audit_rows a join quotas q on a.block_id = q.block_id) where rn <= quota"""


@query("m7_balanced_sample", M7)
def m7(spark, d):
    raw = raw_filings(spark, d)
    titles = raw.where(F.trim("JOB_TITLE").rlike("^[15]-")).select(F.upper("JOB_TITLE").alias("title")).distinct()
    out = sample_plan.sample_observations(raw, titles, 200, seed=2, max_per_block=8, allow_short=True)
    return out["sample"].select("ROW_ID", "BLOCK_ID", "IS_AI")


@query(
    "w1_rank_in_segments",
    audit("select row_id, row_number() over (partition by block_id, is_ai order by actual, row_id) as place from audit_rows"),
)
def w1(spark, d):
    rows = fx.audit_rows(spark, d).withColumn("__count", F.lit(1))
    ranked = ranking.running_counts(rows, ["block_id", "is_ai"], ["actual", "row_id"])
    return ranked.select("row_id", (F.col("__below") + 1).alias("place"))


@query(
    "w2_average_ranks",
    f"select distinct l_extendedprice, {r('rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0', 'avg_rank')} from lineitem",
)
def w2(spark, d):
    return ranking.average_ranks(table(spark, d, "lineitem"), "l_extendedprice", "avg_rank")


@query("w3_sorted_status", audit("select model_id, status, n_rows, row_number() over (order by model_id, status) as place from (select model_id, status, count(*) as n_rows from answers group by all)", parsed=True))
def w3(spark, d):
    from auditspark.operators.quality import status_counts

    from .scalars import answers

    return in_order(status_counts(answers(spark, d), COLS).orderBy("model_id", "status"))


@query("w4_top_examples", audit("select model_id, row_id, est from predictions order by est desc, model_id, row_id limit 10"))
def w4(spark, d):
    p = fx.predictions(spark, d).select("model_id", "row_id", "est")
    return p.orderBy(F.desc("est"), "model_id", "row_id").limit(10)
