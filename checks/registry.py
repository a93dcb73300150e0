"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a query; its doubles are rounded and integers widened, so both
    engines print the same values."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return uniform(fn(spark, sf_dir), digits)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def uniform(df: DataFrame, digits: int = 6) -> DataFrame:
    def shape(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return (F.round(c, digits) + F.lit(0.0)).alias(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint").alias(field.name)
        return c

    return df.select(*[shape(f) for f in df.schema.fields])


def r(expr: str, name: str, digits: int = 6) -> str:
    """A rounded double column of an oracle."""
    return f"round(cast({expr} as double), {digits}) + 0.0 as {name}"


def n(expr: str, name: str) -> str:
    """A widened integer column of an oracle."""
    return f"cast({expr} as bigint) as {name}"


# The audit tables as SQL, for oracles (see FIXTURES.md).
AUDIT = """
audit_rows as (
 select o_orderkey as row_id, concat(o_orderpriority,' ',c_mktsegment) as title,
  o_orderstatus as status_code, cast(c_nationkey as varchar) as state, c_mktsegment as segment,
  concat(o_orderstatus,'||',cast(c_nationkey as varchar),'||',c_mktsegment) as block_id,
  o_orderpriority = '1-URGENT' as is_ai, o_orderkey % 20 + 1 as positions,
  case when o_orderpriority = '1-URGENT' then cast(80 + o_orderkey % 20 as double)
       else cast(o_orderkey % 30 as double) end / 100 as ai_confidence,
  o_totalprice as actual
 from orders join customer on o_custkey = c_custkey),
predictions as (
 select v.m as model_id, case when v.m < 4 then 'open' else 'closed' end as cohort, a.*,
  cast(round(actual * (cast(80 as double)/100
    + cast((row_id*(2*v.m+3) + v.m*7919) % 101 as double)/250
    + case when is_ai then cast(2*v.m as double)/100 else cast(0 as double) end)) as bigint) as est
 from audit_rows a cross join (values (0),(1),(2),(3),(4),(5)) as v(m)),
spb as (select *, (est - actual) / actual * 100 as spb from predictions)"""

RAW = """,
raw_outputs as (
 select *, case (row_id*7 + model_id) % 20
  when 0 then '' when 1 then concat(cast(est as varchar),'-',cast(est+1000 as varchar))
  when 2 then concat('about ',cast(est as varchar)) when 3 then concat('$',cast(est as varchar))
  when 4 then 'n/a' when 5 then concat(cast(est as varchar),' USD')
  when 6 then concat(cast(est as varchar),'.00') else cast(est as varchar) end as raw_output
 from predictions)"""

PARSED = RAW + r""",
parsed as (
 select *, case
  when raw_output = '' then 'empty'
  when regexp_matches(raw_output, '\d[\d,]*(?:\.\d+)?\s*[-–—]\s*\$?\s*\d', 'i')
    or regexp_matches(raw_output, '\d[\d,]*(?:\.\d+)?\s+(?:to|or|and)\s+\$?\s*\d', 'i')
    or regexp_matches(raw_output, 'between\s+\$?\s*\d', 'i') or regexp_matches(raw_output, 'range', 'i')
    then 'multiple_numbers_or_range'
  when len(regexp_extract_all(raw_output, '\$?\s*\d[\d,]*(?:\.\d+)?')) = 0 then 'no_number'
  when len(regexp_extract_all(raw_output, '\$?\s*\d[\d,]*(?:\.\d+)?')) > 1 then 'multiple_numbers_or_range'
  when not regexp_full_match(raw_output, '\s*\$?\s*\d[\d,]*(?:\.0+)?\s*(?:USD|usd|dollars|Dollars)?\s*') then 'malformed'
  when try_cast(regexp_replace(regexp_extract(raw_output, '\$?\s*\d[\d,]*(?:\.\d+)?'), '[$,\s]', '', 'g') as double)
    not between 20000 and 1000000 then 'out_of_plausible_range'
  else 'ok' end as status,
  try_cast(regexp_replace(regexp_extract(raw_output, '\$?\s*\d[\d,]*(?:\.\d+)?'), '[$,\s]', '', 'g') as double) as number
 from raw_outputs),
answers as (select *, case when status = 'ok' then number end as value from parsed),
long as (
 select *, value - actual as usd, 100 * (value - actual) / actual as pct, value / actual as ratio,
  ln(value) - ln(actual) as logr, is_ai::int as ai
 from answers where value is not null),
row_avg as (
 select row_id, min(block_id) as block_id, min(actual) as actual, bool_or(is_ai) as is_ai, min(ai_confidence) as conf,
  count(*) as n_models, avg(value) as mean_est, median(value) as med_est, avg(usd) as mean_usd, median(usd) as med_usd,
  avg(pct) as mean_pct, median(pct) as med_pct, avg(ratio) as mean_ratio, avg(logr) as mean_log
 from long group by row_id),
blocks as (
 select block_id, count(*) filter (is_ai) as n_ai, count(*) filter (not is_ai) as n_other,
  avg(mean_pct) filter (is_ai) as ai_pct, avg(mean_pct) filter (not is_ai) as other_pct,
  median(mean_pct) filter (is_ai) as ai_med, median(mean_pct) filter (not is_ai) as other_med,
  avg(mean_usd) filter (is_ai) as ai_usd, avg(mean_usd) filter (not is_ai) as other_usd,
  avg(conf) filter (is_ai) as ai_conf, avg(conf) filter (not is_ai) as other_conf
 from row_avg group by block_id having count(*) filter (is_ai) > 0 and count(*) filter (not is_ai) > 0),
model_blocks as (
 select model_id, block_id, count(*) filter (is_ai) as n_ai, count(*) filter (not is_ai) as n_other,
  avg(pct) filter (is_ai) as ai_pct, avg(pct) filter (not is_ai) as other_pct,
  avg(usd) filter (is_ai) as ai_usd, avg(usd) filter (not is_ai) as other_usd
 from long group by model_id, block_id having count(*) filter (is_ai) > 0 and count(*) filter (not is_ai) > 0)"""


def audit(body: str, parsed: bool = False, raw: bool = False) -> str:
    head = "with " + AUDIT.strip() + (PARSED if parsed else RAW if raw else "")
    return head + "\n" + body.strip()


def t_p(t: str, df: str, points: int = 20000) -> str:
    """Two-sided t probability by Simpson's rule on the angle form of the density:
    another method than the engine's continued fraction."""
    lo = f"atan(abs({t}) / sqrt({df}))"
    h = f"((pi() / 2 - {lo}) / {points})"
    f = f"power(cos(least({lo} + i * {h}, pi() / 2)), {df} - 1)"
    total = (
        f"list_sum(list_transform(range(0, {points + 1}), lambda i: "
        f"(case when i = 0 or i = {points} then 1 when i % 2 = 1 then 4 else 2 end) * {f}))"
    )
    const = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi())"
    return f"(2 * {const} * {total} * {h} / 3)"


def z_p(z: str, points: int = 2000) -> str:
    """Two-sided normal probability by Simpson's rule on Craig's form of the tail."""
    h = f"(pi() / 2 / {points})"
    total = (
        f"list_sum(list_transform(range(1, {points + 1}), lambda i: "
        f"(case when i = {points} then 1 when i % 2 = 1 then 4 else 2 end) * exp(-({z}) * ({z}) / (2 * power(sin(i * {h}), 2)))))"
    )
    return f"(case when {z} = 0 then 1 else 2 / pi() * {total} * {h} / 3 end)"


# Welch's statistics from n1, mean1, var1, n2, mean2, var2.
WELCH = {
    "diff": "mean1 - mean2",
    "se": "sqrt(var1/n1 + var2/n2)",
    "df": "power(var1/n1 + var2/n2, 2) / (power(var1/n1, 2)/(n1-1) + power(var2/n2, 2)/(n2-1))",
    "t": "(mean1 - mean2) / sqrt(var1/n1 + var2/n2)",
    "cohens_d": "(mean1 - mean2) / sqrt(((n1-1)*var1 + (n2-1)*var2) / (n1+n2-2))",
}


def two_groups(source: str, keys: str, value: str, first: str) -> str:
    """A subquery with the sizes, means and variances of both groups."""
    key = f"{keys}, " if keys else ""
    by = f" group by {keys}" if keys else ""
    return (
        f"(select {key}count({value}) filter ({first}) as n1, avg({value}) filter ({first}) as mean1, "
        f"var_samp({value}) filter ({first}) as var1, count({value}) filter (not ({first})) as n2, "
        f"avg({value}) filter (not ({first})) as mean2, var_samp({value}) filter (not ({first})) as var2 "
        f"from {source}{by})"
    )


def u52(text: str) -> str:
    """The engine's unit hash of a text expression."""
    return f"((('0x' || substr(md5({text}), 1, 13))::bigint + 0.5) / 4503599627370496.0)"
