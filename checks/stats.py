"""Statistical tests (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditspark.functions import numeric
from auditspark.operators import metrics, normality, regression, stat_tests, summaries
from auditspark.plans import compare, fixtures as fx
from auditspark.plans.fixtures import COLS
from auditspark.session import materialize

from .quality import UPLIFTS, long_rows, row_table, stored_rows, uplifts
from .registry import WELCH, audit, n, query, r, t_p, two_groups, u52, z_p


def biased(spark, d):
    return metrics.with_spb(fx.predictions(spark, d), COLS)


def welch_sql(source: str, keys: str, value: str, first: str, columns: list[str], extra: str = "") -> str:
    """Welch columns by engine name, from a grouped subquery."""
    key = f"{keys}, " if keys else ""
    picks = []
    for c in columns:
        if c in ("n1", "n2"):
            picks.append(c)
        elif c in WELCH:
            picks.append(r(WELCH[c], c))
        elif c == "p_two_sided":
            picks.append(r(t_p("t0", "df0"), c))
        else:
            picks.append(r(c, c))
    inner = f"(select *, {WELCH['t']} as t0, {WELCH['df']} as df0 from {two_groups(source, keys, value, first)})"
    return f"select {key}{', '.join(picks)}{extra} from {inner}"


BASIC = ["n1", "n2", "mean1", "mean2", "diff", "se", "df", "t", "cohens_d", "p_two_sided"]


@query("t1_welch_per_model", audit(welch_sql("spb", "model_id", "spb", "is_ai", BASIC)))
def t1(spark, d):
    stats = stat_tests.with_p(stat_tests.with_welch(stat_tests.two_sample(biased(spark, d), ["model_id"], "spb", F.col("is_ai"))))
    return stats.select("model_id", *BASIC)


@query(
    "t1_model_welch_table",
    audit(
        f"""select 'per_model_welch_ai_vs_other' as analysis, model_id, 'Other' as model_family, 'overestimation_pct_points' as outcome,
     {r('mean1', 'mean_ai_pct_points')}, {r('mean2', 'mean_other_pct_points')}, {r('mean1 - mean2', 'difference_ai_minus_other_pct_points')},
     n1 as n_ai_rows, n2 as n_other_rows, {r('t0', 't_value')}, {r(t_p('t0', 'df0'), 'p_value')}, 'ok' as status
     from (select *, {WELCH['t']} as t0, {WELCH['df']} as df0 from {two_groups('long', 'model_id', 'pct', 'is_ai')})""",
        parsed=True,
    ),
)
def t1_table(spark, d):
    return stat_tests.model_welch_table(long_rows(spark, d), COLS)


@query(
    "t1_row_average_welch",
    audit(
        f"""select 'secondary_row_average_welch_ai_vs_other' as analysis, 'mean_overestimation_pct_points' as outcome, 'H1B row averaged across models' as unit,
     {r('mean1', 'mean_ai_pct_points')}, {r('mean2', 'mean_other_pct_points')}, {r('mean1 - mean2', 'difference_ai_minus_other_pct_points')},
     {r('(select median(mean_pct) from row_avg where is_ai)', 'median_ai_pct_points')}, {r('(select median(mean_pct) from row_avg where not is_ai)', 'median_other_pct_points')},
     n1 as n_ai_rows, n2 as n_other_rows, {r('t0', 't_value')}, {r(t_p('t0', 'df0'), 'p_value')}, 'ok' as status
     from (select *, {WELCH['t']} as t0, {WELCH['df']} as df0 from {two_groups('row_avg', '', 'mean_pct', 'is_ai')})""",
        parsed=True,
    ),
)
def t1_rows(spark, d):
    return stat_tests.row_welch_table(stored_rows(spark, d))


@query(
    "t2_one_sided",
    audit(
        f"""select model_id, {r('t0', 't')}, {r(f"case when t0 > 0 then {t_p('t0', 'df0')} / 2 else 1 - {t_p('t0', 'df0')} / 2 end", 'p_greater')}
     from (select *, {WELCH['t']} as t0, {WELCH['df']} as df0 from {two_groups('spb', 'model_id', 'spb', 'is_ai')})"""
    ),
)
def t2(spark, d):
    return stat_tests.welch_by(biased(spark, d), ["model_id"], "spb", F.col("is_ai")).select("model_id", "t", "p_greater")


@query(
    "t3_welch_df_per_block",
    audit(
        f"""select block_id, {r(f"case when n1 >= 2 and n2 >= 2 then coalesce({WELCH['df'].replace(' / (', ' / nullif(', 1).replace('(n2-1))', '(n2-1), 0)')}, least(n1, n2) - 1) end", 'df', 5)},
     case when n1 >= 2 and n2 >= 2 then 'ok' else 'not_estimable' end as status from {two_groups('spb', 'block_id', 'spb', 'is_ai')}"""
    ),
    digits=5,
)
def t3(spark, d):
    stats = stat_tests.with_welch(stat_tests.two_sample(biased(spark, d), ["block_id"], "spb", F.col("is_ai")))
    return stats.select("block_id", "df", "status")


# Quantile of t for large df by its expansion around the normal quantile.
Z = "1.959963984540054"
T_CRIT = (
    f"({Z} + (power({Z},3) + {Z}) / (4*df0) + (5*power({Z},5) + 16*power({Z},3) + 3*{Z}) / (96*power(df0,2))"
    f" + (3*power({Z},7) + 19*power({Z},5) + 17*power({Z},3) - 15*{Z}) / (384*power(df0,3)))"
)


@query(
    "t4_welch_interval",
    audit(
        f"""select model_id, {r('mean1 - mean2', 'diff')}, {r(f"mean1 - mean2 - {T_CRIT} * {WELCH['se']}", 'ci_low')}, {r(f"mean1 - mean2 + {T_CRIT} * {WELCH['se']}", 'ci_high')}
     from (select *, {WELCH['df']} as df0 from {two_groups('spb', 'model_id', 'spb', 'is_ai')})"""
    ),
)
def t4(spark, d):
    return stat_tests.welch_by(biased(spark, d), ["model_id"], "spb", F.col("is_ai")).select("model_id", "diff", "ci_low", "ci_high")


@query(
    "t5_cohens_d",
    audit(
        f"""select model_id, {r('d0', 'cohens_d')}, case when abs(d0) < 0.2 then 'negligible' when abs(d0) < 0.5 then 'small' when abs(d0) < 0.8 then 'medium' else 'large' end as effect
     from (select model_id, {WELCH['cohens_d']} as d0 from {two_groups('spb', 'model_id', 'spb', 'is_ai')})"""
    ),
)
def t5(spark, d):
    return stat_tests.welch_by(biased(spark, d), ["model_id"], "spb", F.col("is_ai")).select("model_id", "cohens_d", "effect")


SIGN_P = "least(1.0, 2 * list_sum(list_transform(range(0, least(pos, neg) + 1), lambda i: exp(lgamma(pos + neg + 1.0) - lgamma(i + 1.0) - lgamma(pos + neg - i + 1.0) - (pos + neg) * ln(2.0)))))"
ONE = """(select {key} count(*) as n, avg(ai_pct - other_pct) as mean, median(ai_pct - other_pct) as med, stddev_samp(ai_pct - other_pct) as sd,
 count(*) filter (ai_pct > other_pct) as pos, count(*) filter (ai_pct < other_pct) as neg, count(*) filter (ai_pct = other_pct) as zero from {src} {by})"""


@query(
    "t6_t7_block_contrast_summary",
    audit(
        f"""select 'primary_block_level_contrast_ttest' as analysis, 'delta_pct_points_ai_minus_other' as outcome, 'BLOCK_ID' as unit,
     {r('mean', 'mean_delta_pct_points_ai_minus_other')}, {r('med', 'median_delta_pct_points_ai_minus_other')}, {r('sd', 'std_delta_pct_points_ai_minus_other')},
     n as n_common_support_blocks, pos as positive_blocks, neg as negative_blocks, zero as zero_blocks, {r('mean / (sd / sqrt(n))', 't_value')},
     {r(t_p('(mean / (sd / sqrt(n)))', '(n - 1)'), 'p_value')}, {r(SIGN_P, 'sign_test_p_value')}, 'ok' as status from {ONE.format(key='', src='blocks', by='')}""",
        parsed=True,
    ),
)
def t6(spark, d):
    return stat_tests.block_contrast_summary(
        materialize(summaries.block_contrasts(stored_rows(spark, d), COLS), "blocks")
    )


@query(
    "t6_model_block_summary",
    audit(
        f"""select 'per_model_block_contrast_ttest' as analysis, model_id, 'Other' as model_family, 'delta_pct_points_ai_minus_other' as outcome,
     {r('mean', 'mean_delta_pct_points_ai_minus_other')}, {r('med', 'median_delta_pct_points_ai_minus_other')}, n as n_common_support_blocks,
     pos as positive_blocks, neg as negative_blocks, {r('mean / (sd / sqrt(n))', 't_value')}, {r(t_p('(mean / (sd / sqrt(n)))', '(n - 1)'), 'p_value')}, 'ok' as status
     from {ONE.format(key='model_id,', src='model_blocks', by='group by model_id')}""",
        parsed=True,
    ),
)
def t6_models(spark, d):
    return stat_tests.model_block_summary(
        materialize(summaries.model_block_contrasts(long_rows(spark, d), COLS), "model_blocks"), COLS
    )


@query(
    "t7_sign_test",
    audit(f"select model_id, pos as positive, neg as negative, {r(SIGN_P, 'p_sign')} from {ONE.format(key='model_id,', src='model_blocks', by='group by model_id')}", parsed=True),
)
def t7(spark, d):
    from auditspark.columns import DELTA_PCT
    from auditspark.functions.dist import p_sign

    stats = stat_tests.one_sample(summaries.model_block_contrasts(long_rows(spark, d), COLS), ["model_id"], DELTA_PCT)
    return stats.select("model_id", "positive", "negative", p_sign(F.col("positive"), F.col("negative")).alias("p_sign"))


# 97.5 % points of t for one to three degrees of freedom (fixed values).
T_CRIT_SMALL = "(case n when 2 then 12.706204736432095 when 3 then 4.302652729911275 when 4 then 3.182446305284263 end)"


@query(
    "t8_cohort_one_sample",
    audit(
        f"""select cohort, n, {r('mean', 'mean')}, {r('sd', 'sd')}, {r('sd / sqrt(n)', 'se')}, {r('n - 1', 'df')}, {r('mean / (sd / sqrt(n))', 't')}, {r('mean / sd', 'd')},
     {r(t_p('(mean / (sd / sqrt(n)))', '(n - 1)'), 'p_two_sided')},
     {r(f'mean - {T_CRIT_SMALL} * sd / sqrt(n)', 'ci_low')}, {r(f'mean + {T_CRIT_SMALL} * sd / sqrt(n)', 'ci_high')}
     from (select cohort, count(*) as n, avg(uplift) as mean, stddev_samp(uplift) as sd from {UPLIFTS} group by cohort)"""
    ),
)
def t8(spark, d):
    return stat_tests.cohort_one_sample(uplifts(spark, d), COLS)


@query(
    "t8_cohort_welch",
    audit(welch_sql(UPLIFTS, "", "uplift", "cohort = 'closed'", ["n1", "n2", "mean1", "mean2", "diff", "se", "df", "t", "cohens_d", "p_two_sided"])),
)
def t8_welch(spark, d):
    return stat_tests.cohort_welch(uplifts(spark, d), c=COLS).select(*BASIC)


CORR_P = lambda x: t_p(f"({x} * sqrt((n - 2) / ((1 - {x}) * (1 + {x}))))", "(n - 2)")


@query(
    "t9_pearson",
    audit(f"select n as n_rows, {r('c', 'pearson_r')}, {r(CORR_P('c'), 'pearson_p_value')} from (select count(*) as n, corr(actual, mean_pct) as c from row_avg)", parsed=True),
)
def t9(spark, d):
    return stat_tests.pearson(row_table(spark, d), "actual", "mean_overestimation_pct_points")


RANKED = """(select count(*) as n, corr(rx, ry) as c from (select
 rank() over (order by {x}) + (count(*) over (partition by {x}) - 1) / 2.0 as rx,
 rank() over (order by {y}) + (count(*) over (partition by {y}) - 1) / 2.0 as ry from {src}))"""


@query(
    "t10_spearman",
    f"select n as n_rows, {r('c', 'spearman_r')}, {r(CORR_P('c'), 'spearman_p_value')} from {RANKED.format(x='l_quantity', y='l_extendedprice', src='lineitem')}",
)
def t10(spark, d):
    from auditspark.plans.fixtures import table

    return stat_tests.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query(
    "t9_t10_confidence_correlation",
    audit(
        f"""select 'row_average_continuous_ai_confidence_correlation' as analysis, 'mean_overestimation_pct_points' as outcome, p.n as n_rows,
     {r('p.c', 'pearson_r')}, {r(CORR_P('c').replace('c *', 'p.c *').replace('1 - c', '1 - p.c').replace('1 + c', '1 + p.c').replace('(n - 2)', '(p.n - 2)'), 'pearson_p_value')},
     {r('s.c', 'spearman_r')}, {r(CORR_P('c').replace('c *', 's.c *').replace('1 - c', '1 - s.c').replace('1 + c', '1 + s.c').replace('(n - 2)', '(s.n - 2)'), 'spearman_p_value')}, 'ok' as status
     from (select count(*) as n, corr(conf, mean_pct) as c from row_avg) p, {RANKED.format(x='conf', y='mean_pct', src='row_avg')} s""",
        parsed=True,
    ),
)
def t9_t10(spark, d):
    return stat_tests.confidence_correlation(stored_rows(spark, d), COLS)


N_PERM = 10_000


@query(
    "t11_permutation",
    audit(
        f"""select count(*) as n_permutations, {r('max(obs)', 'observed_diff')}, {r('avg(case when abs(diff) >= abs(obs) - 1e-12 then 1.0 else 0.0 end)', 'p_value')},
     {r('quantile_cont(diff, 0.025)', 'null_low')}, {r('quantile_cont(diff, 0.975)', 'null_high')} from (
      select perm, avg(uplift) filter (place > n_first) - avg(uplift) filter (place <= n_first) as diff, max(obs) as obs from (
       select *, row_number() over (partition by perm order by {u52("concat_ws('|', '42', perm, model_id)")}, model_id) as place from (
        select u.*, (select count(*) from up where cohort = 'open') as n_first,
         (select avg(uplift) filter (cohort = 'closed') - avg(uplift) filter (cohort = 'open') from up) as obs, unnest(range(0, {N_PERM})) as perm from up u)) group by perm)"""
    ).replace("\nselect count(*) as n_permutations", f", up as {UPLIFTS} select count(*) as n_permutations", 1),
)
def t11(spark, d):
    u = uplifts(spark, d)
    return stat_tests.permutation_summary(stat_tests.permutation_null(u, N_PERM, 42, "closed", COLS), u, "closed", COLS)


@query(
    "t12_exact_permutation",
    audit(
        f"""select count(*) as n_permutations, {r('max(obs)', 'observed_diff')}, {r('avg(case when abs(diff) >= abs(obs) - 1e-12 then 1.0 else 0.0 end)', 'p_value')},
     {r('quantile_cont(diff, 0.025)', 'null_low')}, {r('quantile_cont(diff, 0.975)', 'null_high')} from (
      select mask, avg(uplift) filter ((mask >> bit) & 1 = 1) - avg(uplift) filter ((mask >> bit) & 1 = 0) as diff, max(obs) as obs from (
        select u.*, row_number() over (order by model_id) - 1 as bit,
         (select avg(uplift) filter (cohort = 'closed') - avg(uplift) filter (cohort = 'open') from up) as obs from up u) b
       join (select unnest(range(0, 64)) as mask) m on bit_count(mask) = (select count(*) from up where cohort = 'closed') group by mask)"""
    ).replace("\nselect count(*) as n_permutations", f", up as {UPLIFTS} select count(*) as n_permutations", 1),
)
def t12(spark, d):
    u = uplifts(spark, d)
    return stat_tests.permutation_summary(stat_tests.exact_null(u, "closed", COLS), u, "closed", COLS)


@query(
    "t12_exact_split_test",
    audit(
        f""", up as (select cohort, model_id || ' ' || status_code as unit, avg(spb) filter (is_ai) - avg(spb) filter (not is_ai) as uplift from spb group by all),
 u as (select * from (select *, row_number() over (order by unit) - 1 as bit, count(*) over () as n, count(*) filter (cohort = 'closed') over () as n2,
   sum(uplift) over () as total, (select avg(uplift) filter (cohort = 'closed') - avg(uplift) filter (cohort = 'open') from up) as obs from up where uplift is not null)),
 w as (select list(uplift order by bit) as us, max(n) as n, max(n2) as n2, max(total) as total, max(obs) as obs from u),
 m as (select unnest(range(0, 1::bigint << n)) as mask, us, n, n2, total, obs from w),
 d as (select obs, list_sum(list_transform(us, lambda x, i: case when (mask >> (i - 1)) & 1 = 1 then x / n2 else -x / (n - n2) end)) as diff from m where bit_count(mask) = n2)
 select count(*) as n_permutations, {r('max(obs)', 'observed_diff')}, {r('avg(case when abs(diff) >= abs(obs) - 1e-12 then 1.0 else 0.0 end)', 'p_value')},
  {r('quantile_cont(diff, 0.025)', 'null_low')}, {r('quantile_cont(diff, 0.975)', 'null_high')} from d"""
    ),
)
def t12_halves(spark, d):
    rows = biased(spark, d).withColumn("model_id", F.concat_ws(" ", "model_id", "status_code"))
    return stat_tests.exact_split_test(metrics.model_uplift(rows, ["cohort", "model_id"], COLS), "closed", COLS)


@query("t13_between_cohorts", audit(welch_sql("spb", "is_ai", "spb", "cohort = 'closed'", BASIC)))
def t13(spark, d):
    return stat_tests.cohort_label_welch(biased(spark, d), c=COLS).select("is_ai", *BASIC)


@query(
    "t14_paired_models",
    audit(
        welch_sql(
            """(select cohort, row_id, bool_or(is_ai) as is_ai, (avg(est) - max(actual)) / max(actual) * 100 as spb from predictions
      where not (actual > 300000 and model_id in (1, 5)) group by cohort, row_id having count(*) = case cohort when 'open' then 4 else 2 end)""",
            "cohort", "spb", "is_ai", BASIC,
        )
    ),
)
def t14(spark, d):
    gaps = fx.predictions(spark, d).withColumn("est", F.when(~((F.col("actual") > 300000) & F.col("model_id").isin(1, 5)), F.col("est")))
    return compare.compare_paired(gaps, COLS).select("cohort", *BASIC)


def _ppf_sql(p: str) -> str:
    """The published rational approximation of the normal quantile."""

    def ratio(tables, x):
        def poly(cs):
            out = repr(float(cs[-1]))
            for c in reversed(cs[:-1]):
                out = f"({out} * {x} + {float(c)!r})"
            return out

        return f"({poly(tables[0])} / {poly(tables[1])})"

    q = f"({p} - 0.5::double)"
    tail = f"sqrt(-ln(least({p}, 1 - {p})))"
    return (
        f"case when abs({q}) <= 0.425 then {q} * {ratio(numeric._CENTRAL, f'(0.180625::double - {q} * {q})')} "
        f"when {tail} <= 5 then sign({q}) * {ratio(numeric._NEAR_TAIL, f'({tail} - 1.6::double)')} "
        f"else sign({q}) * {ratio(numeric._FAR_TAIL, f'({tail} - 5::double)')} end"
    )


def _poly_sql(cs, x: str) -> str:
    return "(" + " + ".join(f"({c!r}::double) * power({x}, {i})" for i, c in enumerate(cs)) + ")"


U = "(1 / sqrt(n))"
T15 = f""", o as (select model_id, is_ai, spb as x, row_number() over (partition by model_id, is_ai order by spb) as i, count(*) over (partition by model_id, is_ai) as n from spb),
 s as (select *, {_ppf_sql('((i - 0.375::double) / (n + 0.25::double))')} as m from o),
 g as (select model_id, is_ai, max(n) as n, sum(m*m) as ssm, max(m) as m1, max(case when i = n - 1 then m end) as m2 from s group by all),
 c as (select *, m1 / sqrt(ssm) + {_poly_sql(normality._LAST, U)} as a1, m2 / sqrt(ssm) + {_poly_sql(normality._NEXT, U)} as a2 from g),
 w as (select s.*, case when s.i = s.n then a1 when s.i = 1 then -a1 when s.i = s.n - 1 then a2 when s.i = 2 then -a2
   else s.m / sqrt((ssm - 2*m1*m1 - 2*m2*m2) / (1 - 2*a1*a1 - 2*a2*a2)) end as a from s join c on s.model_id = c.model_id and s.is_ai = c.is_ai)
 select model_id, is_ai, count(*) as n, {r('power(sum(a * x), 2) / (var_pop(x) * count(*))', 'w')} from w group by model_id, is_ai"""


@query("t15_shapiro_wilk", audit("").rstrip() + T15)
def t15(spark, d):
    return normality.shapiro_wilk(biased(spark, d), ["model_id", "is_ai"], "spb").select("model_id", "is_ai", "n", "w")


@query(
    "t16_moment_normality",
    audit(
        f""", g as (select model_id, count(*) as n, avg(spb) as mu from spb group by model_id),
 c as (select s.model_id, max(g.n) as n, avg(power(spb - mu, 2)) as m2, avg(power(spb - mu, 3)) as m3, avg(power(spb - mu, 4)) as m4 from spb s join g on s.model_id = g.model_id group by s.model_id),
 k as (select model_id, n, m3 / power(m2, 1.5) as skew, m4 / (m2 * m2) - 3 as kurt from c)
 select model_id, n, {r('skew', 'skew')}, {r('kurt', 'kurt')}, {r('n / 6.0 * (skew*skew + kurt*kurt/4)', 'jarque_bera')}, {r('exp(-n / 12.0 * (skew*skew + kurt*kurt/4))', 'p_value')} from k"""
    ),
)
def t16(spark, d):
    return normality.moment_normality(biased(spark, d), ["model_id"], "spb")


HC3 = f""", g as (select model_id, block_id, count(*) as nb, avg(is_ai::int) as lb, avg(spb) as yb from spb group by all),
 x as (select s.model_id, g.nb, s.is_ai::int - g.lb as d, s.spb - g.yb as y from spb s join g on s.model_id = g.model_id and s.block_id = g.block_id),
 b as (select model_id, count(*) as n, sum(d*d) as sdd, sum(d*y) / sum(d*d) as beta from x group by model_id),
 v as (select x.model_id, sum(case when abs(1 - 1.0/nb - d*d/sdd) < 1e-9 then 0 else d*d * power(y - beta*d, 2) / power(1 - 1.0/nb - d*d/sdd, 2) end) as s,
   sum(power(y - beta*d, 2)) as sse from x join b on x.model_id = b.model_id group by x.model_id),
 f as (select b.model_id, n, beta, sqrt(s) / sdd as se, 1 - sse / (select var_pop(spb) * count(*) from spb where spb.model_id = b.model_id) as r2 from b join v on b.model_id = v.model_id)"""


INTERVAL = f"{r(z_p('beta / se'), 'label_p')}, {r(f'beta - {Z} * se', 'ci_low')}, {r(f'beta + {Z} * se', 'ci_high')}"


@query("t18_absorbed_hc3", audit(f"{HC3} select model_id, n, {r('beta', 'label_coef')}, {r('se', 'label_se')}, {r('beta / se', 'label_z')}, {INTERVAL} from f"))
def t18(spark, d):
    out = regression.absorbed_hc3(biased(spark, d), "model_id", "spb", "is_ai", "block_id")
    return out.select("model_id", "n", "label_coef", "label_se", "label_z", "label_p", "ci_low", "ci_high")


@query(
    "t17_ols_hc3_one_factor",
    audit(f"{HC3} select model_id, n, {r('beta', 'label_coef')}, {r('se', 'label_se')}, {r('beta / se', 'label_z')}, {INTERVAL}, {r('r2', 'r2')} from f"),
)
def t17_one(spark, d):
    out = regression.ols_hc3(biased(spark, d), "model_id", "spb", "is_ai", "block_id", [], [])
    return out.select("model_id", "n", "label_coef", "label_se", "label_z", "label_p", "ci_low", "ci_high", "r2")


# Dense dummies with an intercept, inverted by a Gauss-Jordan sweep that skips dependent
# columns; the label stands last, the right-hand side beside the matrix.
CONTROLS = f""", o as (select model_id, spb as y, is_ai::int::double as lab, ln(1 + positions::double) as lp, state, status_code, segment from spb),
 c as (select *, row_number() over (order by model_id, state, status_code, segment, lp, lab) as cell from (
   select model_id, state, status_code, segment, lp, lab, count(*) as n, avg(y) as ym, var_pop(y) * count(*) as m2 from o group by all)),
 x as (select cell, model_id, n, ym, m2, unnest([{{'g': 0, 'f': '', 'x': 1::double}}, {{'g': 1, 'f': state, 'x': 1::double}}, {{'g': 2, 'f': status_code, 'x': 1::double}},
   {{'g': 3, 'f': segment, 'x': 1::double}}, {{'g': 4, 'f': '', 'x': lp}}, {{'g': 5, 'f': '', 'x': lab}}]) as e from c),
 lv as (select *, row_number() over (partition by model_id order by g, f) as i from (select distinct model_id, e.g as g, e.f as f from x)),
 z as (select x.cell, x.model_id, x.n, x.ym, x.m2, lv.i, x.e.x as x from x join lv on x.model_id = lv.model_id and x.e.g = lv.g and x.e.f = lv.f),
 size as (select model_id, max(i) as p from lv group by model_id),
 gram as (select a.model_id, a.i, b.i as j, sum(a.n * a.x * b.x) as v from z a join z b on a.cell = b.cell group by all
   union all select z.model_id, z.i, p + 1, sum(n * x * ym) from z join size on z.model_id = size.model_id group by all),
 grid as (select a.model_id, a.i, t.j, p from lv a join size on a.model_id = size.model_id, lateral (select unnest(range(1, p + 2)) as j) t),
 matrix_rows as (select grid.model_id, grid.i, max(p) as p, list(coalesce(v, 0) order by grid.j) as line
   from grid left join gram on grid.model_id = gram.model_id and grid.i = gram.i and grid.j = gram.j group by all),
 sweep as (
  select model_id, 0 as k, max(p) as p, list(line order by i) as m, list(line[i] order by i) as d from matrix_rows group by model_id
  union all
  select model_id, k + 1, p, list_transform(range(1, p + 1), lambda i: list_transform(range(1, p + 2), lambda j: case
    when m[k+1][k+1] < 1e-9 * d[k+1] then case when i = k + 1 or j = k + 1 then 0 else m[i][j] end
    when i = k + 1 and j = k + 1 then 1 / m[k+1][k+1]
    when i = k + 1 then m[i][j] / m[k+1][k+1]
    when j = k + 1 then -m[i][j] / m[k+1][k+1]
    else m[i][j] - m[i][k+1] * m[k+1][j] / m[k+1][k+1] end)), d
  from sweep where k < p),
 solved as (select model_id, p, unnest(range(1, p + 1)) as i, unnest(m) as line from sweep where k = p),
 inv as (select model_id, p, i, unnest(range(1, p + 2)) as j, unnest(line) as v from solved),
 quad as (select a.cell, sum(a.x * b.x * v) as lev from z a join z b on a.cell = b.cell join inv on inv.model_id = a.model_id and inv.i = a.i and inv.j = b.i group by a.cell),
 dots as (select z.cell, max(z.model_id) as model_id, max(n) as n, max(ym) as ym, max(m2) as m2, sum(x * beta.v) as fit, sum(x * own.v) as a from z
   join inv beta on beta.model_id = z.model_id and beta.i = z.i and beta.j = beta.p + 1
   join inv own on own.model_id = z.model_id and own.i = z.i and own.j = own.p group by z.cell),
 h as (select dots.*, 1 - lev as rest, m2 + n * power(ym - fit, 2) as sse from dots join quad on dots.cell = quad.cell),
 s as (select model_id, sum(n) as n, sqrt(sum(case when abs(rest) < 1e-9 then 0 else a * a * sse / (rest * rest) end)) as se,
   sum(case when abs(rest) < 1e-9 then n else 0 end) as ones, bool_or(abs(rest) < 1e-9 and abs(a) > 1e-9) as hangs,
   1 - sum(sse) / (sum(m2 + n * ym * ym) - power(sum(n * ym), 2) / sum(n)) as r2 from h group by model_id),
 f as (select s.*, b.v as beta, b.v / se as zed, case when n < 10 then 'too_few_rows' when l.v <= 0 then 'not_estimable' when hangs then 'leverage_one' else 'ok' end as status from s
   join inv b on b.model_id = s.model_id and b.i = b.p and b.j = b.p + 1 join inv l on l.model_id = s.model_id and l.i = l.p and l.j = l.p)"""


@query(
    "t17_ols_hc3_controls",
    audit(
        CONTROLS
        + f""" select model_id, {n('n', 'n')}, {r('beta', 'label_coef')}, {r('se', 'label_se')}, {n('ones', 'n_leverage_one')}, {r('r2', 'r2')}, status, {r('zed', 'label_z')},
 {r(z_p('zed'), 'label_p')}, {r(f'beta - {Z} * se', 'ci_low')}, {r(f'beta + {Z} * se', 'ci_high')} from f"""
    ).replace("with ", "with recursive ", 1),
)
def t17(spark, d):
    rows = biased(spark, d).withColumn("log_positions", F.log1p("positions"))
    return regression.ols_hc3(rows, "model_id", "spb", "is_ai", "state", ["status_code", "segment"], ["log_positions"])


@query(
    "t19_significance",
    audit(
        f"""{HC3} select w.model_id, coalesce(t0 > 0 and {t_p('t0', 'df0')} / 2 < 0.05, false) as welch_one_sided, {t_p('t0', 'df0')} < 0.05 as welch_two_sided, abs(beta / se) > {Z} as regression
     from (select *, {WELCH['t']} as t0, {WELCH['df']} as df0 from {two_groups('spb', 'model_id', 'spb', 'is_ai')}) w join f on w.model_id = f.model_id"""
    ),
)
def t19(spark, d):
    rows = biased(spark, d)
    welch = stat_tests.welch_by(rows, ["model_id"], "spb", F.col("is_ai"))
    return stat_tests.significance_summary(welch, regression.absorbed_hc3(rows, "model_id", "spb", "is_ai", "block_id"), "model_id")
