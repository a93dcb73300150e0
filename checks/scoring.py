"""Prompting, scoring, parsing and retry (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditspark.functions import prompts
from auditspark.operators import quality, scoring
from auditspark.plans import estimate as estimate_plan, fixtures as fx
from auditspark.plans.fixtures import COLS, table
from auditspark.session import scratch_path

from .quality import gappy, STATUSES
from .registry import audit, query, r
from .scalars import _prompt_sql, answers, chats, prompt_rows


def length_scorer():
    """Stand-in model: an amount that depends on the length of the question."""
    return lambda batch: [str(20_000 + 100 * len(chat[-1]["content"])) for chat in batch]


def picky_scorer():
    """Stand-in model that fails on some questions."""

    def answer(batch):
        if any(chat[-1]["content"].count("BUILDING") for chat in batch):
            raise RuntimeError("no answer")
        return [str(20_000 + 100 * len(chat[-1]["content"])) for chat in batch]

    return answer


LEN = f"length({_prompt_sql()})"


@query(
    "p1_prompt_table",
    audit(
        f"""select row_id, persona, md5(concat(case persona when 'salary_estimator' then '{prompts.PERSONAS["salary_estimator"]}' else '' end, '{prompts.SALARY_SYSTEM}', '#', {_prompt_sql()})) as digest
     from audit_rows, (select unnest(['salary_estimator', '']) as persona)"""
    ),
)
def p1(spark, d):
    t = scoring.prompt_table(prompt_rows(spark, d), ["salary_estimator", ""], COLS)
    both = F.concat(F.get("messages", F.lit(0))["content"], F.lit("#"), F.get("messages", F.lit(1))["content"])
    return t.select("row_id", "persona", F.md5(both.cast("binary")).alias("digest"))


def single_prompts(spark, d):
    return scoring.prompt_table(prompt_rows(spark, d), ["salary_estimator"], COLS)


@query("p2_batch_scoring", audit(f"select row_id, cast(20000 + 100 * {LEN} as varchar) as output, cast(null as varchar) as error from audit_rows"))
def p2(spark, d):
    return scoring.score(single_prompts(spark, d), length_scorer, ["row_id"])


@query(
    "p2_scoring_errors",
    audit(f"select row_id, case when segment <> 'BUILDING' then cast(20000 + 100 * {LEN} as varchar) end as output, case when segment = 'BUILDING' then 'RuntimeError: no answer' end as error from audit_rows"),
)
def p2_errors(spark, d):
    return scoring.score(single_prompts(spark, d), picky_scorer, ["row_id"])


@query("p3_chunked_scoring", audit(f"select row_id, cast(20000 + 100 * {LEN} as varchar) as output, cast(null as varchar) as error from audit_rows"))
def p3(spark, d):
    return scoring.score(single_prompts(spark, d).repartition(5), length_scorer, ["row_id"], batch_rows=64)


@query(
    "p4_resumable_scoring",
    audit(f"select row_id, {r(f'20000 + 100 * {LEN}', 'est')}, 'ok' as status, case when state < '2' then 1 else 2 end::bigint as run_no from audit_rows"),
)
def p4(spark, d):
    rows, path = prompt_rows(spark, d).withColumn("positions", F.col("positions").cast("bigint")), scratch_path(spark, "estimates")
    args = ("stand-in", ["salary_estimator"], length_scorer, path, COLS)
    # Four chunks a run, the last smaller, whatever the size of the table.
    chunk = lambda some: dict(chunk_rows=max(1, -(-some.count() // 4)), batch_rows=500)
    estimate_plan.estimate(rows.where("state < '2'"), *args, **chunk(rows.where("state < '2'")))
    estimate_plan.estimate(rows, *args, **chunk(rows.where("state >= '2'")))
    out = estimate_plan.estimate(rows, *args)
    # The third run found everything finished, so only two run ids hold rows.
    order = F.array_sort(F.collect_set("run_id"))
    runs = estimate_plan.read_results(spark, path).agg(order.alias("runs")).select("runs").scalar()
    return out.select("row_id", "est", "status", F.array_position(runs, F.col("run_id")).alias("run_no"))


@query("p5_legacy_resume", audit("select model_id, row_id from predictions where est > actual"))
def p5(spark, d):
    requested = fx.predictions(spark, d)
    stored = requested.select("model_id", "row_id", F.when(F.col("est") <= F.col("actual"), F.col("est")).alias("est"))
    return scoring.pending_rows(requested, stored, ["model_id", "row_id"], COLS).select("model_id", "row_id")


@query("p6_parse_table", audit(f"select model_id, status, count(*) as n_rows, {r('sum(value)', 'total')} from answers group by all", parsed=True))
def p6(spark, d):
    df = scoring.with_parsed_answer(fx.raw_outputs(spark, d).drop("est").withColumn("output", F.col("raw_output")), COLS)
    return df.groupBy("model_id", "status").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("est").alias("total"))


@query("p7_status_totals", audit(f"select coalesce({STATUSES}, 'pending') as status, count(*) as n_rows from answers group by 1", parsed=True))
def p7(spark, d):
    return quality.status_totals(gappy(spark, d), COLS)


@query(
    "p8_output_gate",
    audit(
        f"""select model_id, count(*) as n_rows, count(s) as n_completed, count(*) filter (s = 'ok') as n_ok, count(*) - count(s) as n_pending,
     count(*) = count(s) and count(*) filter (s = 'ok') > 0 as passed from (select model_id, case when model_id = 2 and actual > 400000 then null when model_id = 4 then 'no_number' else status end as s from answers) group by model_id""",
        parsed=True,
    ),
)
def p8(spark, d):
    m = F.col("model_id")
    df = answers(spark, d).withColumn(
        "status",
        F.when((m == 2) & (F.col("actual") > 400000), F.lit(None)).when(m == 4, "no_number").otherwise(F.col("status")),
    )
    return quality.output_gate(df, COLS)


BAD = "(est < 30000 or est > 450000 or abs((est - actual) / actual) * 100 > 12)"


@query(
    "p9_retry_unreasonable",
    audit(f"select model_id, row_id, case when {BAD} then 20000 + 100 * {LEN} else est end as est from predictions"),
)
def p9(spark, d):
    rows = fx.predictions(spark, d).withColumns(
        {"full_time": F.lit("Y"), "city": F.lit(None).cast("string"), "naics": F.lit("54"), "wage_level": F.lit("II")}
    )
    fixed, _ = scoring.retry_unreasonable(rows, length_scorer, ["model_id", "row_id"], COLS, "salary_estimator", 30000, 450000, 12)
    return fixed.select("model_id", "row_id", "est")


@query(
    "p9_still_unreasonable",
    audit(
        f"""select model_id, count(*) as n_asked, count(*) filter (new < 30000 or new > 450000 or abs((new - actual) / actual) * 100 > 12) as n_still_bad
     from (select *, 20000 + 100 * {LEN} as new from predictions where {BAD}) group by model_id"""
    ),
)
def p9_still(spark, d):
    rows = fx.predictions(spark, d).withColumns(
        {"full_time": F.lit("Y"), "city": F.lit(None).cast("string"), "naics": F.lit("54"), "wage_level": F.lit("II")}
    )
    _, asked = scoring.retry_unreasonable(
        rows, length_scorer, ["model_id", "row_id"], COLS, "salary_estimator", 30000, 450000, 12, legacy_parse=True
    )
    return asked.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_asked"), F.count_if("still_unreasonable").alias("n_still_bad"))


WORD = r"\p{L}\p{M}\p{N}_"


@query("p10_token_lengths", rf"select doc_id, cast(len(regexp_extract_all(text, '[{WORD}]+|[^\s{WORD}]')) as bigint) as token_len from documents")
def p10(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(scoring.simple_tokens(F.col("text"))).alias("token_len"))


@query(
    "p10_token_summary",
    f"""select count(*) as n_texts, {r('avg(k)', 'mean_tokens')}, {r('median(k)', 'median_tokens')}, cast(max(k) as bigint) as max_tokens, {r('quantile_cont(k, 0.95)', 'p95_tokens')}
     from (select len(regexp_extract_all(text, '[{WORD}]+|[^\\s{WORD}]')) as k from documents)""",
)
def p10_summary(spark, d):
    lengths = table(spark, d, "documents").select(F.size(scoring.simple_tokens(F.col("text"))).alias("token_len"))
    return scoring.token_summary(lengths)


def _title_chat_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    head, tail = prompts.TITLE_USER.split("{job_title}")
    start = quoted("<|system|>\n" + prompts.TITLE_SYSTEM + "\n<|user|>\n" + head)
    return f"concat({start}, job_title, {quoted(tail + chr(10) + '<|assistant|>' + chr(10))})"


@query(
    "p10_title_tokens",
    rf"select job_title, cast(len(regexp_extract_all({_title_chat_sql()}, '[{WORD}]+|[^\s{WORD}]')) as bigint) as token_len from (select distinct p_name as job_title from part)",
)
def p10_titles(spark, d):
    lengths, _ = estimate_plan.title_token_lengths(table(spark, d, "part"), "p_name")
    return lengths


@query("p10_conversation_tokens", f"select count(*) as n_texts, {r('avg(k)', 'mean_tokens')}, {r('median(k)', 'median_tokens')}, cast(max(k) as bigint) as max_tokens, {r('quantile_cont(k, 0.95)', 'p95_tokens')} from (select octet_length(encode(string_agg(concat('<|', role, '|>', chr(10), text, chr(10)), '' order by turn))) + 14 as k from conversations group by conv_id)")
def p10_conversations(spark, d):
    from .storage import byte_encoder

    texts = chats(spark, d).select(prompts.messages_to_text(F.col("messages")).alias("text"))
    lengths = scoring.token_ids(texts, "text", byte_encoder).select(F.size("token_ids").alias("token_len"))
    return scoring.token_summary(lengths)


@query(
    "p11_score_distinct",
    "select p_partkey, cast(20000 + 100 * length(concat('Is the job title ''', p_name, ''' directly related to AI/ML as per the above definition? Answer only ''Yes'' or ''No''.')) as varchar) as output, cast(null as varchar) as error from part",
)
def p11(spark, d):
    asked = table(spark, d, "part").select("p_partkey", prompts.title_messages(F.col("p_name")).alias("messages"))
    return scoring.score_distinct(asked, length_scorer, ["p_partkey"])
