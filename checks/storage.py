"""Sources (S) and sinks (K): written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditspark.operators import filters, scoring
from auditspark.plans import analysis, fixtures as fx
from auditspark.plans.fixtures import COLS, table
from auditspark.session import scratch_path
from auditspark.sources import ledger, readers, split_csv, writers

from .quality import keyed_rows
from .registry import audit, query, r
from .scalars import FLAG, answers

TITLED = "concat(p_name, ', \"', p_brand, '\"')"


@query("s1_scan_csv", f"select p_partkey, {TITLED} as title, {r('p_retailprice', 'price')} from part")
def s1(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.expr(TITLED).alias("title"), F.col("p_retailprice").alias("price"))
    path = writers.write_table(df, scratch_path(spark, "part"), ("csv",))[0]
    return readers.read_csv(spark, path, df.schema)


QUOTED_TEXT = "replace(concat('\"', text, '\"'), ' the ', concat(chr(10), '\"the\", '))"


@query("s1_scan_split_csv", f"select doc_id, {QUOTED_TEXT} as text from documents")
def s1_split(spark, d):
    """Whole texts with line breaks, quotes and commas, read by as many tasks as the file has splits."""
    df = table(spark, d, "documents").select("doc_id", F.expr(QUOTED_TEXT).alias("text"))
    path = scratch_path(spark, "texts")
    df.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return split_csv.read_split_csv(spark, path, df.schema)


@query("s1_scan_parquet", f"select s_suppkey, s_name, {r('s_acctbal', 's_acctbal')} from supplier")
def s1_parquet(spark, d):
    return readers.read_table(spark, f"{d}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal")


LINE = "case p_size when 1 then concat('# ', p_name) when 2 then '   ' else concat('  ', upper(p_name), '  ', p_brand, ' ') end"


def text_file(spark, d):
    path = scratch_path(spark, "titles.txt")
    table(spark, d, "part").select(F.expr(LINE).alias("value")).write.text(path)
    return path


@query("s2_title_list", "select distinct lower(concat(p_name, ' ', p_brand)) as title from part where p_size > 2")
def s2(spark, d):
    return readers.read_ai_titles(spark, text_file(spark, d))


@query(
    "s3_label_csv",
    f"select distinct lower(o_orderpriority) as title from orders where coalesce(lower(trim({FLAG})) in ('true','1','yes','y','t'), false)",
)
def s3(spark, d):
    df = table(spark, d, "orders").select(
        F.concat(F.lit(" "), F.upper("o_orderpriority")).alias("job_title"), F.expr(FLAG).alias("AI_job")
    )
    return readers.read_ai_titles(spark, writers.write_table(df, scratch_path(spark, "labels"), ("csv",))[0])


@query("s4_title_lines", f"select trim({LINE}) as job_title, count(*) as n_lines from part group by 1")
def s4(spark, d):
    return readers.read_lines(spark, text_file(spark, d)).groupBy("job_title").agg(F.count(F.lit(1)).alias("n_lines"))


def prediction_files(spark, d, with_bad: bool = False):
    """One folder per model; models 0-2 carry a parse status, 3-5 are old files."""
    base = scratch_path(spark, "runs")
    p = answers(spark, d).select(
        F.concat(F.lit("qwen-"), "model_id").alias("slug"), "model_id",
        F.col("row_id").alias("ROW_ID"), F.col("actual").alias("PREVAILING_WAGE"),
        F.col("est").alias("estimated_salary_in_usd"), F.col("is_ai").alias("IS_AI"),
        F.col("status").alias("salary_parse_status"), F.col("raw_output").alias("salary_raw_output"),
    )
    new = p.where("model_id < 3").drop("model_id")
    old = p.where("model_id >= 3").drop("model_id", "salary_parse_status", "salary_raw_output")
    for df in (new, old):
        df.write.mode("append").partitionBy("slug").options(header=True, escape='"').csv(base)
    if with_bad:
        bad = p.where("model_id = 0").select(F.lit("broken").alias("slug"), "ROW_ID")
        bad.write.mode("append").partitionBy("slug").options(header=True).csv(base)
    return f"{base}/*/part-*.csv"


@query(
    "s5_scan_prediction_files",
    audit(
        """select concat('slug=qwen-', model_id) as model_slug, 'Qwen' as model_family, case when model_id < 3 then status when value is not null then 'ok_legacy_missing_parse_status' end as salary_parse_status,
     count(*) as n_rows, count(value) as n_parsed, count(distinct row_id) as n_ids from answers group by all""",
        parsed=True,
    ),
)
def s5(spark, d):
    df, _ = readers.scan_predictions(spark, prediction_files(spark, d))
    return df.groupBy("model_slug", "model_family", "salary_parse_status").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("estimated_salary_in_usd").alias("n_parsed"), F.countDistinct("ROW_ID").alias("n_ids")
    )


@query(
    "s6_tag_predictions",
    audit("select model_id, row_id, concat('m-', model_id % 2) as model_slug, case when est % 2 = 0 then 'ok_legacy_missing_parse_status' end as status from predictions"),
)
def s6(spark, d):
    old = fx.predictions(spark, d).withColumn("est", F.when(F.col("est") % 2 == 0, F.col("est")))
    names = COLS.__class__(**{**COLS.__dict__, "model": "model_slug"})
    path = F.concat(F.lit("/runs/m-"), F.col("model_id") % 2, F.lit("/llm_estimated_salaries-x.csv"))
    return readers.tag_predictions(old, path, names).select("model_id", "row_id", "model_slug", "status")


@query(
    "s7_score_table",
    audit(f"select concat_ws(' || ', title, status_code, segment) as job_key, {r('max(ai_confidence)', 'ai_confidence')} from audit_rows group by 1"),
)
def s7(spark, d):
    rows = fx.audit_rows(spark, d).withColumnsRenamed({"status_code": "soc_code", "segment": "SOC_TITLE"})
    names = COLS.__class__(**{**COLS.__dict__, "soc_title": "SOC_TITLE", "soc_code": "soc_code"})
    return readers.score_table(rows.withColumn("ai_confidence", F.col("ai_confidence").cast("string")), names)


@query(
    "s8_sampled_metadata",
    audit(
        f"""select row_id, concat_ws(' || ', a.title, status_code, segment) as job_key, concat_ws('||', status_code, state, '', 'Y', 'II') as block_id, {r('best', 'ai_confidence')}
     from audit_rows a join (select title as t, status_code as s, segment as g, max(ai_confidence) as best from audit_rows group by all) on title = t and status_code = s and segment = g"""
    ),
)
def s8(spark, d):
    rows = fx.audit_rows(spark, d)
    scores = readers.score_table(keyed_rows(spark, d), COLS)
    bare = rows.drop("block_id", "ai_confidence").withColumns(
        {"naics": F.lit(None).cast("string"), "full_time": F.lit("Y"), "wage_level": F.lit("II")}
    )
    return readers.sampled_metadata(bare, scores, COLS).select("row_id", "job_key", "block_id", "ai_confidence")


@query("s9_distinct_titles", audit("select distinct title as job_title from audit_rows"))
def s9(spark, d):
    return readers.distinct_titles(fx.audit_rows(spark, d), "title")


@query("s10_required_columns", "select o_orderstatus, count(*) as n_rows from orders group by 1")
def s10(spark, d):
    df = filters.require_columns(table(spark, d, "orders"), ["o_orderkey", "o_orderstatus"], "orders")
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"))


@query("s11_min_models", audit("select model_id, count(*) as n_rows from predictions group by 1"))
def s11(spark, d):
    df = filters.require_min_models(fx.predictions(spark, d), "model_id", fx.N_MODELS)
    return df.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("s12_skip_unusable", audit("select concat('slug=qwen-', model_id) as model_slug, count(*) as n_rows from predictions group by 1"))
def s12(spark, d):
    df, skipped = readers.scan_predictions(spark, prediction_files(spark, d, with_bad=True), skip_unusable=True)
    if not skipped:
        raise AssertionError("the broken file was not noticed")
    return df.groupBy("model_slug").agg(F.count(F.lit(1)).alias("n_rows"))


@query("s13_row_ids", "select p_partkey, p_partkey - 1 + (select 1 - min(p_partkey) from part) as \"ROW_ID\" from part")
def s13(spark, d):
    ordered = table(spark, d, "part").select("p_partkey").repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey")
    fixed = spark.createDataFrame(ordered.rdd, ordered.schema)  # one layout, however often it is read
    return readers.with_row_id(fixed).select("p_partkey", "ROW_ID")


# Sinks -------------------------------------------------------------------------

@query("k1_write_table", f"select fmt, count(*) as n_rows, {r('sum(p_retailprice)', 'total', 3)} from part, (select unnest(['csv', 'parquet']) as fmt) group by fmt", digits=3)
def k1(spark, d):
    part = table(spark, d, "part")
    csv, parquet = writers.write_table(part, scratch_path(spark, "part"), ("csv", "parquet"))
    total = [F.count(F.lit(1)).alias("n_rows"), F.sum("p_retailprice").alias("total")]
    back = readers.read_csv(spark, csv, part.schema).agg(*total).withColumn("fmt", F.lit("csv"))
    return back.unionByName(spark.read.parquet(parquet).agg(*total).withColumn("fmt", F.lit("parquet")))


def merged_answers(spark, d):
    return answers(spark, d).withColumns({"job_key": F.concat_ws(" || ", "title", "status_code", "segment"), "model_family": F.lit("Other")})


TABLE_COUNTS = {
    "model_row_salary_overestimation_long": "(select count(*) from long)",
    "row_average_salary_overestimation": "(select count(*) from row_avg)",
    "primary_block_level_contrasts": "(select count(*) from blocks)",
    "primary_block_level_contrast_summary": "1",
    "secondary_row_average_welch": "1",
    "per_model_welch_tests": "6",
    "per_model_block_level_contrasts": "(select count(*) from model_blocks)",
    "per_model_block_contrast_summary": "6",
    "model_salary_overestimation_summary": "6",
    "ai_group_salary_overestimation_summary": "2",
    "continuous_ai_confidence_summary": "1",
    "parse_status_summary": "(select count(*) from (select distinct model_id, status from answers))",
    "raw_model_output_qc": "6",
    "prediction_vector_qc": "6",
    "identical_prediction_vectors": "0",
}


@query(
    "k2_write_fifteen_tables",
    audit(" union all ".join(f"select '{k}' as name, cast({v} as bigint) as n_rows" for k, v in TABLE_COUNTS.items()), parsed=True),
)
def k2(spark, d):
    tables = analysis.analysis_tables(merged_answers(spark, d), 0, 1e12, COLS)
    folder = scratch_path(spark, "analysis")
    writers.write_tables(tables, folder)
    counts = [
        spark.read.parquet(f"{folder}/{name}.parquet").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("name", F.lit(name))
        for name in tables
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(
    "k3_run_metadata",
    audit(
        """select count(*) as n_model_row_records_used, count(distinct row_id) as n_unique_rows_used, count(distinct model_id) as n_models_used, count(distinct block_id) as n_blocks,
     '0,1,2,3,4,5' as models, (select count(*) from row_avg) as n_row_average_records, (select count(*) from blocks) as n_common_support_blocks,
     0::bigint as n_identical_prediction_vector_pairs, 'all' as config_run from long""",
        parsed=True,
    ),
)
def k3(spark, d):
    tables = analysis.analysis_tables(merged_answers(spark, d), 0, 1e12, COLS)
    path = writers.write_table(analysis.run_metadata(tables, COLS, run="all"), scratch_path(spark, "meta"), ("json",))[0]
    return spark.read.json(path).withColumn("models", F.array_join("models", ","))


@query("k4_column_order", audit(f"select row_id, {r('actual', 'actual')}, title, block_id from audit_rows"))
def k4(spark, d):
    rows = writers.ordered(fx.audit_rows(spark, d).select("title", "block_id", "actual", "row_id"), ["row_id", "absent", "actual"])
    if rows.columns != ["row_id", "actual", "title", "block_id"]:
        raise AssertionError(rows.columns)
    return rows


@query("k5_write_sample", audit("select row_id, block_id, is_ai from audit_rows"))
def k5(spark, d):
    sample = fx.audit_rows(spark, d).select("row_id", "block_id", "is_ai")
    csv = writers.write_table(sample, scratch_path(spark, "sample"), ("csv",))[0]
    return readers.read_csv(spark, csv, sample.schema)


def byte_encoder():
    """Stand-in tokenizer: one id per UTF-8 byte."""
    return lambda texts: [list(t.encode()) for t in texts]


@query("k6_token_arrays", "select doc_id, cast(octet_length(encode(text)) as bigint) as n_tokens, cast(ascii(text) as bigint) as first_id from documents where ascii(text) < 128 union all select doc_id, octet_length(encode(text)), null from documents where ascii(text) >= 128")
def k6(spark, d):
    ids = scoring.token_ids(table(spark, d, "documents").select("doc_id", "text"), "text", byte_encoder).drop("text")
    path = writers.write_table(ids, scratch_path(spark, "tokens"))[0]
    back = spark.read.parquet(path)
    first = F.get("token_ids", F.lit(0))
    return back.select("doc_id", F.size("token_ids").alias("n_tokens"), F.when(first < 128, first).alias("first_id"))


@query("k7_append_runs", audit("select model_id, count(*) as n_rows, count(distinct state < '2') as n_runs from predictions group by model_id"))
def k7(spark, d):
    path = scratch_path(spark, "results")
    p = fx.predictions(spark, d).select("model_id", "row_id", "est", "state")
    writers.append_run(p.where("state < '2'"), path, ["model_id"])
    writers.append_run(p.where("state >= '2'"), path, ["model_id"])
    return spark.read.parquet(path).groupBy("model_id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("run_id").alias("n_runs"))


@query(
    "k7_committed_chunks",
    audit("select model_id as chunk, count(*) as n_rows, sum(est) as total from predictions where model_id <> 4 group by model_id").replace("select model_id as chunk, count(*) as n_rows, sum(est)", "select cast(model_id as bigint) as chunk, count(*) as n_rows, cast(sum(est) as bigint)"),
)
def k7_chunks(spark, d):
    """A chunk for each model: one is written twice, one dies before its commit."""
    path, run = scratch_path(spark, "ledger"), ledger.new_run()
    p = fx.predictions(spark, d).select("model_id", "row_id", "est")
    for chunk in range(6):
        part = p.where(F.col("model_id") == chunk)
        if chunk == 4:
            ledger.write_attempt(part, path, run, chunk)
        else:
            ledger.append_chunk(part, path, run, chunk)
    ledger.append_chunk(p.where("model_id = 2"), path, run, 2)
    found = ledger.read_committed(spark, path)
    return found.groupBy(F.col("chunk").cast("bigint").alias("chunk")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("est").alias("total"))


@query("k8_write_versions", audit("select v, sum(est + v - 1)::bigint as total from predictions, (select unnest([1, 2]) as v) group by v").replace("sum(est + v - 1)::bigint as total", "cast(sum(est + v - 1) as bigint) as total").replace("select v,", "select cast(v as bigint) as v,"))
def k8(spark, d):
    folder = scratch_path(spark, "versions")
    p = fx.predictions(spark, d).select("model_id", "row_id", "est")
    first = writers.write_version(p, folder)
    writers.write_version(spark.read.parquet(first).withColumn("est", F.col("est") + 1), folder)
    return spark.read.parquet(folder).groupBy(F.col("v").cast("bigint").alias("v")).agg(F.sum("est").alias("total"))
