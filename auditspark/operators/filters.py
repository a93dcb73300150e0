"""Row filters, the filter funnel and fail-fast guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import DEFAULT, AuditColumns
from ..functions.parse import PARSE_OK
from ..functions.text import same_unit


def require_columns(df: DataFrame, columns: list[str], what: str = "input") -> DataFrame:
    """Fail before any job runs when a column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def require_min_models(df: DataFrame, model: str, minimum: int) -> DataFrame:
    found = df.select(model).distinct().count()
    if found < minimum:
        raise ValueError(f"found only {found} model(s), at least {minimum} needed")
    return df


def require_empty(violations: DataFrame, message: str, examples: int = 20) -> None:
    """Raise with a few examples when ``violations`` has any row."""
    rows = violations.limit(examples).collect()
    if rows:
        raise ValueError(f"{message}; examples: {[r.asDict() for r in rows]}")


def require_none(df: DataFrame, rules: dict[str, Column], show: list[str], examples: int = 20) -> None:
    """Raise when any row breaks a rule. One pass counts all rules together;
    example rows are fetched only for a broken one."""
    names = list(rules)
    counts = df.agg(*[F.count_if(rules[name]).alias(f"r{i}") for i, name in enumerate(names)]).first()
    for i, name in enumerate(names):
        if counts[i]:
            rows = df.where(rules[name]).select(*show).limit(examples).collect()
            raise ValueError(f"{counts[i]} rows: {name}; examples: {[r.asDict() for r in rows]}")


def is_parsed(c: AuditColumns = DEFAULT) -> Column:
    """The answer was parsed as one plausible number."""
    return F.coalesce(F.col(c.status).isin(*PARSE_OK), F.lit(False)) & F.col(c.estimate).isNotNull()


def eligibility_steps(
    df: DataFrame,
    status_col: str = "CASE_STATUS",
    status_value: str = "Certified",
    level_col: str = DEFAULT.wage_level,
    unit_cols: tuple[str, ...] = ("PW_UNIT_OF_PAY", "WAGE_UNIT_OF_PAY"),
    unit_value: str = "Year",
    allow_missing_units: bool = False,
) -> list[tuple[str, Column]]:
    """The named filter conditions in order; an absent unit column is an error
    unless allowed."""
    steps = [
        ("status", F.coalesce(F.col(status_col) == status_value, F.lit(False))),
        ("wage_level", F.col(level_col).isNotNull()),
    ]
    for unit in unit_cols:
        if unit in df.columns:
            steps.append((unit, same_unit(F.col(unit), unit_value)))
        elif not allow_missing_units:
            raise ValueError(f"missing unit column: {unit}")
    return steps


def apply_steps(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    for _, condition in steps:
        df = df.where(condition)
    return df


def filter_funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows left after each step, from one pass over the data."""
    aggs, so_far = [F.count(F.lit(1)).alias("n0")], F.lit(True)
    for i, (_, condition) in enumerate(steps, 1):
        so_far = so_far & condition
        aggs.append(F.count_if(so_far).alias(f"n{i}"))
    names = ["input"] + [n for n, _ in steps]
    entries = [
        F.struct(
            F.lit(i).cast("bigint").alias("step_no"),
            F.lit(n).alias("step"),
            F.col(f"n{i}").alias("rows_left"),
            (F.col(f"n{max(i - 1, 0)}") - F.col(f"n{i}")).alias("dropped"),
        )
        for i, n in enumerate(names)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def valid_pairs(df: DataFrame, c: AuditColumns = DEFAULT, min_actual: float = 1.0) -> DataFrame:
    return df.where((F.col(c.actual) >= min_actual) & F.col(c.estimate).isNotNull())


def parsed_rows(df: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    return df.where(is_parsed(c))


def is_out_of_range(column: str, low: float, high: float, missing_is_bad: bool) -> Column:
    return F.coalesce(~F.col(column).between(low, high), F.lit(missing_is_bad))


def out_of_range(df: DataFrame, column: str, low: float, high: float, missing_is_bad: bool) -> DataFrame:
    """Rows whose ``column`` lies outside [low, high]."""
    return df.where(is_out_of_range(column, low, high, missing_is_bad))


def unreasonable(
    estimate: Column, actual: Column, low: float = 1000.0, high: float = 10_000_000.0, pct: float = 500.0
) -> Column:
    """Too low, too high, or too far from a positive actual, in percent."""
    far = (F.abs(F.try_divide(estimate - actual, actual)) * 100 > pct) & (actual > 0)
    return F.coalesce(estimate < low, F.lit(False)) | F.coalesce(estimate > high, F.lit(False)) | F.coalesce(far, F.lit(False))


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows by key (a debugging feature)."""
    return df.orderBy(*order).limit(n)
