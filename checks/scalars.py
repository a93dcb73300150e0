"""Column functions (C), prompts and filters (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditspark.functions import numeric, parse, prompts, text
from auditspark.operators import filters
from auditspark.plans import fixtures as fx
from auditspark.plans.fixtures import COLS, table

from .registry import audit, n, query, r

def messy():
    return F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t "), F.col("p_brand"), F.lit(" \n"))


MESSY_SQL = "concat('  ', upper(p_name), chr(9), ' ', p_brand, ' ', chr(10))"


@query(
    "c1_norm_title",
    f"select p_partkey, lower(regexp_replace(regexp_replace({MESSY_SQL}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) as title from part",
)
def c1(spark, d):
    return table(spark, d, "part").select("p_partkey", text.norm_title(messy()).alias("title"))


@query(
    "c2_norm_text",
    "select doc_id, md5(coalesce(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '')) as digest from documents",
)
def c2(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.norm_text(F.col("text")).cast("binary")).alias("digest"))


FLAG = "case o_orderkey % 9 when 0 then ' True ' when 1 then '1' when 2 then 'YES' when 3 then 'y' when 4 then 't' when 5 then 'AI' when 6 then 'no' when 7 then '' else null end"


@query(
    "c3_truthy",
    f"""select o_orderkey,
     coalesce(lower(trim({FLAG})) in ('true','1','yes','y','t'), false) as in_label_file,
     coalesce(lower(trim({FLAG})) in ('true','1','yes','y','ai'), false) as in_analysis,
     coalesce(lower(trim({FLAG})) in ('true','1','yes','y'), false) as in_compare from orders""",
)
def c3(spark, d):
    flag = F.expr(FLAG)
    return table(spark, d, "orders").select(
        "o_orderkey",
        text.truthy(flag, text.TRUTHY_LABEL_FILE).alias("in_label_file"),
        text.truthy(flag, text.TRUTHY_ANALYSIS).alias("in_analysis"),
        text.truthy(flag, text.TRUTHY_COMPARE).alias("in_compare"),
    )


CODE = "case o_orderkey % 6 when 0 then cast(o_orderkey as {S}) when 1 then concat('5-', cast(41000 + o_orderkey % 1000 as {S})) when 2 then '5' when 3 then concat(' ', cast(541511 + o_orderkey % 7 as {S}), '.0') when 4 then null else 'none' end"
CODE_SQL = CODE.replace("{S}", "varchar")


@query(
    "c4_naics2",
    f"""select o_orderkey, coalesce(nullif(regexp_extract({CODE_SQL}, '(\\d{{2}})', 1), ''), 'UNK') as unk_filled,
     coalesce(nullif(regexp_extract({CODE_SQL}, '(\\d{{2}})', 1), ''), '') as blank_filled from orders""",
)
def c4(spark, d):
    code = F.expr(CODE.replace("{S}", "string"))
    return table(spark, d, "orders").select(
        "o_orderkey", text.naics2(code).alias("unk_filled"), text.naics2(code, "").alias("blank_filled")
    )


@query(
    "c5_clean_naics2",
    f"select o_orderkey, substr(regexp_replace(coalesce({CODE_SQL}, ''), '\\D', '', 'g'), 1, 2) as naics2 from orders",
)
def c5(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", text.clean_naics2(F.expr(CODE.replace("{S}", "string"))).alias("naics2")
    )


@query("c6_fill_unknown", f"select o_orderkey, coalesce(nullif(trim({FLAG}), ''), 'UNK') as filled from orders")
def c6(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.fill_unknown(F.expr(FLAG)).alias("filled"))


UNIT = "case o_orderkey % 5 when 0 then 'Year' when 1 then ' year ' when 2 then 'YEAR' when 3 then 'Hour' else null end"


@query("c7_same_unit", f"select o_orderkey, coalesce(lower(trim({UNIT})) = 'year', false) as is_year from orders")
def c7(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.same_unit(F.expr(UNIT)).alias("is_year"))


MONEY = "case l_orderkey % 4 when 0 then concat('$', cast(cast(floor(l_extendedprice) as bigint) as {S})) when 1 then concat(' $ ', cast(cast(floor(l_extendedprice) as bigint) div 1000 as {S}), ',', lpad(cast(cast(floor(l_extendedprice) as bigint) % 1000 as {S}), 3, '0'), '.50 ') when 2 then 'nan' else null end"
MONEY_SQL = MONEY.replace("{S}", "varchar").replace("div", "//")


@query(
    "c8_parse_money",
    f"""select l_orderkey, cast(l_linenumber as bigint) as l_linenumber,
     {r("case when regexp_full_match(regexp_replace(" + MONEY_SQL + ", '[$,\\s]', '', 'g'), '[+-]?[0-9]+([.][0-9]*)?') then cast(regexp_replace(" + MONEY_SQL + ", '[$,\\s]', '', 'g') as double) end", "amount")} from lineitem""",
)
def c8(spark, d):
    money = F.expr(MONEY.replace("{S}", "string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numeric.parse_money(money).alias("amount"))


@query(
    "c9_job_key",
    audit("select row_id, concat_ws(' || ', title, status_code, segment) as job_key from audit_rows"),
)
def c9(spark, d):
    return fx.audit_rows(spark, d).select(
        "row_id", text.job_key(F.concat(F.lit(" "), "title"), F.col("status_code"), F.col("segment")).alias("job_key")
    )


@query(
    "c10_block_ids",
    f"""select o_orderkey,
     concat_ws('||', trim(coalesce({FLAG}, '')), o_orderstatus, substr(regexp_replace(coalesce({CODE_SQL}, ''), '\\D', '', 'g'), 1, 2), '', o_orderpriority) as analysis_block,
     concat_ws('||', coalesce(nullif(trim({FLAG}), ''), 'UNK'), o_orderstatus, coalesce(nullif(regexp_extract({CODE_SQL}, '(\\d{{2}})', 1), ''), 'UNK'), 'UNK', o_orderpriority) as sampling_block
     from orders""",
)
def c10(spark, d):
    parts = [F.expr(FLAG), F.col("o_orderstatus"), F.expr(CODE.replace("{S}", "string")), F.lit(None).cast("string"), F.col("o_orderpriority")]
    return table(spark, d, "orders").select(
        "o_orderkey", text.analysis_block(*parts).alias("analysis_block"), text.sampling_block(*parts).alias("sampling_block")
    )


PATH = "case p_partkey % 4 when 0 then concat('/runs/', replace(p_name, ' ', '-'), '/llm_estimated_salaries-salary_estimator.csv') when 1 then concat('out/', p_brand, '/llm_estimated_salaries_debug-', p_type, '.csv') when 2 then concat(p_type, '.tar.csv') else concat('/data/', p_brand, '/other.csv') end"


@query(
    "c11_slug_from_path",
    f"""select p_partkey, case when len(string_split({PATH}, '/')) > 1 then string_split({PATH}, '/')[-2]
     else regexp_replace({PATH}, '[.][^.]*$', '') end as slug from part""",
)
def c11(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug_from_path(F.expr(PATH)).alias("slug"))


SLUG = "concat(case p_partkey % 12 when 0 then 'Qwen3' when 1 then 'Meta-Llama-3' when 2 then 'Mistral-7B' when 3 then 'Mixtral-8x7B' when 4 then 'ibm-granite' when 5 then 'falcon-40b' when 6 then 'OLMo-2' when 7 then 'allenai' when 8 then 'gemma-2' when 9 then 'gpt-oss-120b' when 10 then 'deepseek-r1' else 'Phi-3.5B' end, '-', replace(p_name, ' ', '_'))"


@query(
    "c12_model_family",
    f"""select p_partkey, case when s like '%qwen%' then 'Qwen' when s like '%llama%' or s like '%meta%' then 'Llama'
     when s like '%mistral%' then 'Mistral' when s like '%granite%' or s like '%ibm%' then 'Granite' when s like '%falcon%' then 'Falcon'
     when s like '%olmo%' or s like '%allenai%' then 'Olmo' when s like '%gemma%' then 'Gemma' else 'Other' end as family
     from (select p_partkey, lower({SLUG}) as s from part)""",
)
def c12(spark, d):
    return table(spark, d, "part").select("p_partkey", text.model_family(F.expr(SLUG)).alias("family"))


@query(
    "c13_persona_from_path",
    f"""select p_partkey, coalesce(nullif(regexp_extract(regexp_replace(string_split({PATH}, '/')[-1], '[.][^.]*$', ''),
     '^llm_estimated_salaries(?:_debug)?[-_](.+)$', 1), ''), 'unknown') as persona from part""",
)
def c13(spark, d):
    return table(spark, d, "part").select("p_partkey", text.persona_from_path(F.expr(PATH)).alias("persona"))


NAME = "concat(' org/', case p_partkey % 3 when 0 then '_' else '' end, p_name, '@', p_brand, ' v1.5__ ')"


@query(
    "c14_model_slug",
    f"""select p_partkey, coalesce(nullif(regexp_replace(regexp_replace(string_split(trim({NAME}), '/')[-1],
     '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'model') as slug from part""",
)
def c14(spark, d):
    return table(spark, d, "part").select("p_partkey", text.model_slug(F.expr(NAME)).alias("slug"))


SIZE = "case p_partkey % 5 when 0 then concat('M-', cast(p_size as {S}), 'x7B') when 1 then concat('M-', cast(p_size as {S}), '.5b-it') when 2 then concat('M-', cast(p_size as {S}), 'B-A22B') when 3 then p_name else concat('v2-', cast(p_size as {S}), 'B') end"
SIZE_SQL = SIZE.replace("{S}", "varchar")


@query(
    "c15_model_size",
    f"""select p_partkey, {r("case when m[1] <> '' then cast(m[1] as double) * cast(m[2] as double) when m[3] <> '' then cast(m[3] as double) end", "size_b")}
     from (select p_partkey, [regexp_extract(s, p, 1), regexp_extract(s, p, 2), regexp_extract(s, p, 3)] as m
      from (select p_partkey, {SIZE_SQL} as s, '(\\d+)x(\\d+)[Bb]|(\\d+(?:\\.\\d+)?)[Bb]' as p from part))""".replace(
        "regexp_extract(s, p,", "regexp_extract(s, '(\\d+)x(\\d+)[Bb]|(\\d+(?:\\.\\d+)?)[Bb]',"
    ).replace(", '(\\d+)x(\\d+)[Bb]|(\\d+(?:\\.\\d+)?)[Bb]' as p", ""),
)
def c15(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", text.model_size_b(F.expr(SIZE.replace("{S}", "string"))).alias("size_b")
    )


@query(
    "c16_strip_think",
    """select conv_id, turn, md5(case when turn % 2 = 1 then regexp_replace(text, '^\\s+|\\s+$', '', 'g')
      when turn % 4 = 0 then concat('<think>', text) else concat(text, '</think>', chr(10), chr(10), 'x') end) as digest
     from conversations""",
)
def c16(spark, d):
    mark = F.lit("</think>\n\n")
    said = (
        F.when(F.col("turn") % 2 == 1, F.concat(F.lit("<think>why"), mark, F.col("text")))
        .when(F.col("turn") % 4 == 0, F.concat(F.lit("<think>"), F.col("text")))
        .otherwise(F.concat(F.col("text"), mark, F.lit("x")))
    )
    out = text.strip_think(said, F.col("turn") % 4 != 2)
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(out.cast("binary")).alias("digest"))


@query(
    "c17_clip",
    f"""select l_orderkey, cast(l_linenumber as bigint) as l_linenumber,
     {r("case when l_orderkey % 7 > 0 then greatest(least(l_tax * 20, 1), 0) end", "unit")},
     {r("greatest(least(l_extendedprice - 30000, 10000), -10000)", "capped")} from lineitem""",
)
def c17(spark, d):
    part = F.when(F.col("l_orderkey") % 7 > 0, F.col("l_tax") * 20)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", numeric.clip(part, 0, 1).alias("unit"),
        numeric.clip(F.col("l_extendedprice") - 30000, -10000, 10000).alias("capped"),
    )


@query(
    "c18_logs",
    audit(f"select model_id, row_id, {r('ln(1 + positions)', 'log_positions')}, {r('ln(est) - ln(actual)', 'log_ratio')}, {r('abs(est - actual)', 'abs_diff')} from predictions"),
)
def c18(spark, d):
    return fx.predictions(spark, d).select(
        "model_id", "row_id", F.log1p("positions").alias("log_positions"),
        (F.ln("est") - F.ln("actual")).alias("log_ratio"), F.abs(F.col("est") - F.col("actual")).alias("abs_diff"),
    )


@query(
    "c19_effect_size",
    """select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, case when d is null then 'unknown' when abs(d) < 0.2 then 'negligible'
     when abs(d) < 0.5 then 'small' when abs(d) < 0.8 then 'medium' else 'large' end as effect
     from (select *, case when l_quantity > 3 then (25 - l_quantity) / 25 end as d from lineitem)""",
)
def c19(spark, d):
    value = F.when(F.col("l_quantity") > 3, (25 - F.col("l_quantity")) / 25)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numeric.effect_size(value).alias("effect"))


@query(
    "c20_significant",
    "select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, coalesce(l_discount < 0.05, false) as flag from lineitem",
)
def c20(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numeric.significant(F.col("l_discount")).alias("flag"))


def _prompt_sql() -> str:
    body = prompts.SALARY_USER.replace("'", "''")
    fields = {
        "job_title": "title", "soc_code": "status_code", "soc_title": "segment", "full_time_position": "'Y'",
        "total_worker_positions": "cast(positions as varchar)", "worksite_city": "''", "worksite_state": "state",
        "naics_code": "'54'", "pw_wage_level": "'II'",
    }
    for k, v in fields.items():
        body = body.replace("{" + k + "}", f"' || {v} || '")
    return "'" + body + "'"


def prompt_rows(spark, d):
    return fx.audit_rows(spark, d).withColumns(
        {"full_time": F.lit("Y"), "city": F.lit(None).cast("string"), "naics": F.lit("54"), "wage_level": F.lit("II")}
    )


@query("c21_render_prompt", audit(f"select row_id, {_prompt_sql()} as user_text from audit_rows"))
def c21(spark, d):
    return prompt_rows(spark, d).select("row_id", prompts.salary_user(COLS).alias("user_text"))


PERSONA_CASE = "case row_id % 3 when 0 then 'salary_estimator' when 1 then 'human_minimalistic_behavior_mod' else 'nobody' end"


@query(
    "c22_persona_system",
    audit(
        f"""select row_id, md5(concat(case {PERSONA_CASE} when 'salary_estimator' then '{prompts.PERSONAS["salary_estimator"]}'
     when 'human_minimalistic_behavior_mod' then '{prompts.PERSONAS["human_minimalistic_behavior_mod"]}' else '' end,
     '{prompts.SALARY_SYSTEM}')) as digest from audit_rows"""
    ),
)
def c22(spark, d):
    return fx.audit_rows(spark, d).select(
        "row_id", F.md5(prompts.persona_system(F.expr(PERSONA_CASE)).cast("binary")).alias("digest")
    )


def chats(spark, d):
    turns = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))),
        lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")),
    )
    return table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("messages"))


@query(
    "c23_messages_to_text",
    """select conv_id, md5(concat(string_agg(concat('<|', role, '|>', chr(10), text, chr(10)), '' order by turn), '<|assistant|>', chr(10))) as digest
     from conversations group by conv_id""",
)
def c23(spark, d):
    return chats(spark, d).select("conv_id", F.md5(prompts.messages_to_text(F.col("messages")).cast("binary")).alias("digest"))


@query("c24_parse_answers", audit(f"select model_id, row_id, {r('value', 'value')}, status from answers", parsed=True))
def c24(spark, d):
    return fx.raw_outputs(spark, d).select("model_id", "row_id", parse.parse_answer(F.col("raw_output")).alias("p")).select(
        "model_id", "row_id", "p.value", "p.status"
    )


DIGITS_SQL = r"coalesce(try_cast(regexp_replace(raw_output, '\D', '', 'g') as double), 0)"


@query("c25_parse_digits", audit(f"select model_id, row_id, {n(DIGITS_SQL, 'value')} from raw_outputs", raw=True))
def c25(spark, d):
    return fx.raw_outputs(spark, d).select("model_id", "row_id", parse.parse_digits(F.col("raw_output")).cast("bigint").alias("value"))


# Filters -----------------------------------------------------------------

STATUS = "case o_orderkey % 11 when 0 then 'Withdrawn' when 1 then 'Certified ' when 2 then null else 'Certified' end"
LEVEL = "case when o_orderkey % 13 = 0 then null else 'II' end"


def filings(spark, d):
    return table(spark, d, "orders").select(
        "*", F.expr(STATUS).alias("CASE_STATUS"), F.expr(LEVEL).alias("PW_WAGE_LEVEL"),
        F.expr(UNIT).alias("PW_UNIT_OF_PAY"),
        F.when(F.col("o_orderkey") % 17 == 0, "Month").otherwise("Year").alias("WAGE_UNIT_OF_PAY"),
    )


FILINGS = f"""with filings as (select *, {STATUS} as cs, {LEVEL} as lv, coalesce(lower(trim({UNIT})) = 'year', false) as u1,
 o_orderkey % 17 <> 0 as u2 from orders) """


@query("f1_status_filter", FILINGS + "select o_orderkey from filings where cs = 'Certified'")
def f1(spark, d):
    df = filings(spark, d)
    return filters.apply_steps(df, filters.eligibility_steps(df)[:1]).select("o_orderkey")


@query("f2_level_filter", FILINGS + "select o_orderkey from filings where lv is not null")
def f2(spark, d):
    df = filings(spark, d)
    return filters.apply_steps(df, filters.eligibility_steps(df)[1:2]).select("o_orderkey")


@query("f3_unit_filters", FILINGS + "select o_orderkey, u2 from filings where u1")
def f3(spark, d):
    # The second unit column is absent here and skipped on request.
    df = filings(spark, d).withColumn("u2", F.col("WAGE_UNIT_OF_PAY") == "Year").drop("WAGE_UNIT_OF_PAY")
    steps = filters.eligibility_steps(df, allow_missing_units=True)[2:]
    return filters.apply_steps(df, steps).select("o_orderkey", "u2")


@query(
    "f4_filter_funnel",
    FILINGS
    + """, c as (select count(*) as n0, count(*) filter (cs = 'Certified') as n1, count(*) filter (cs = 'Certified' and lv is not null) as n2,
     count(*) filter (cs = 'Certified' and lv is not null and u1) as n3, count(*) filter (cs = 'Certified' and lv is not null and u1 and u2) as n4 from filings)
    select cast(0 as bigint) as step_no, 'input' as step, n0 as rows_left, cast(0 as bigint) as dropped from c
    union all select 1, 'status', n1, n0 - n1 from c union all select 2, 'wage_level', n2, n1 - n2 from c
    union all select 3, 'PW_UNIT_OF_PAY', n3, n2 - n3 from c union all select 4, 'WAGE_UNIT_OF_PAY', n4, n3 - n4 from c""",
)
def f4(spark, d):
    df = filings(spark, d)
    return filters.filter_funnel(df, filters.eligibility_steps(df))


@query(
    "f5_eligible_block_rows",
    audit("select row_id from audit_rows where block_id in (select block_id from audit_rows group by block_id having count(*) filter (is_ai) > 0 and count(*) filter (not is_ai) > 0)"),
)
def f5(spark, d):
    from auditspark.operators.labelling import block_counts, eligible_blocks

    rows = fx.audit_rows(spark, d)
    return rows.join(eligible_blocks(block_counts(rows, COLS)), "block_id", "left_semi").select("row_id")


@query(
    "f6_valid_pairs",
    audit("select model_id, row_id from predictions where actual >= 50000 and (is_ai or cohort = 'open')"),
)
def f6(spark, d):
    gaps = fx.predictions(spark, d).withColumn("est", F.when(F.col("is_ai") | (F.col("cohort") == "open"), F.col("est")))
    return filters.valid_pairs(gaps, COLS, 50000).select("model_id", "row_id")


@query("f7_parsed_rows", audit("select model_id, row_id from answers where value is not null", parsed=True))
def f7(spark, d):
    return filters.parsed_rows(answers(spark, d), COLS).select("model_id", "row_id")


@query("f8_bad_actuals", audit("select row_id from audit_rows where actual not between 60000 and 400000"))
def f8(spark, d):
    return filters.out_of_range(fx.audit_rows(spark, d), "actual", 60000, 400000, True).select("row_id")


@query(
    "f9_bad_predictions",
    audit("select model_id, row_id, est from predictions where est not between 20000 and 1000000 order by model_id, row_id limit 20"),
)
def f9(spark, d):
    bad = filters.out_of_range(fx.predictions(spark, d), "est", 20000, 1000000, False)
    return filters.head(bad.select("model_id", "row_id", "est"), 20, ["model_id", "row_id"])


@query(
    "f10_unreasonable",
    audit("select model_id, row_id, est < 30000 or est > 450000 or abs((est - actual) / actual) * 100 > 15 as bad from predictions"),
)
def f10(spark, d):
    return fx.predictions(spark, d).select(
        "model_id", "row_id", filters.unreasonable(F.col("est"), F.col("actual"), 30000, 450000, 15).alias("bad")
    )


@query("f11_head", "select o_orderkey, o_totalprice from orders order by o_orderkey limit 50")
def f11(spark, d):
    return filters.head(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 50, ["o_orderkey"])


def answers(spark, d):
    """Raw outputs with parsed number and status, named as the engine expects."""
    p = fx.raw_outputs(spark, d).withColumn("__p", parse.parse_answer(F.col("raw_output")))
    return p.withColumns({"est": F.col("__p.value"), "status": F.col("__p.status")}).drop("__p")
