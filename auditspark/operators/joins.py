"""Equi-joins that survive a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import shuffle_width

_SALT = "__salt"
_HOT = "__hot"


def _byte_limit(df: DataFrame) -> int:
    raw = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").lower()
    units = {"kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "b": 1}
    for suffix, factor in units.items():
        if raw.endswith(suffix):
            return int(raw[: -len(suffix)]) * factor
    return int(raw)


def estimated_bytes(df: DataFrame) -> float:
    """The optimizer's size estimate; infinite where it cannot be asked."""
    if not hasattr(df, "_jdf"):  # no JVM handle (remote session)
        return float("inf")
    return float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df: DataFrame, limit: int | None = None) -> bool:
    """Whether the estimated size is below the broadcast limit."""
    limit = _byte_limit(df) if limit is None else limit
    return limit > 0 and estimated_bytes(df) <= limit


def hot_keys(df: DataFrame, on: list[str], parts: int) -> DataFrame:
    """Keys holding at least ``1/parts`` of the rows: never more than ``parts``."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("t")).select("t").scalar()
    return counts.where(F.col("__n") * F.lit(parts) >= total).select(*on)


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "left",
    spread_by: list[str] | None = None,
    limit: int | None = None,
    hot: bool = True,
) -> DataFrame:
    """Join a large table to a lookup table with unique ``on`` keys.

    Below the broadcast limit the lookup is broadcast. Beyond it, the keys that
    hold at least 1/P of the fact rows (P = shuffle partitions, so at most P
    keys) are salted over P tasks and only their lookup rows are replicated;
    all other keys join once. The salt is a hash of ``spread_by`` (row identity)
    and hence the same when a task is run again. ``hot=False`` states that the
    fact side cannot have a hot key (row ids) and saves the counting pass.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unsupported join type: {how}")
    if fits_broadcast(dim, limit):
        return fact.join(F.broadcast(dim), on, how)
    if not hot:
        return fact.join(dim, on, how)
    parts = shuffle_width(fact.sparkSession)
    heavy = F.broadcast(hot_keys(fact, on, parts).withColumn(_HOT, F.lit(True)))
    spread = spread_by or [c for c in fact.columns if c not in on] or on
    scatter = F.coalesce(F.col(_HOT), F.lit(False))
    for name in on:  # rows without a key match nothing: spread them as well
        scatter = scatter | F.col(name).isNull()
    salted_fact = fact.join(heavy, on, "left").withColumn(
        _SALT, F.when(scatter, F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int")).otherwise(F.lit(0))
    ).drop(_HOT)
    salted_dim = dim.join(heavy, on, "left").withColumn(
        _SALT,
        F.explode(F.when(F.col(_HOT), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))),
    ).drop(_HOT)
    return salted_fact.join(salted_dim, on + [_SALT], how).drop(_SALT)


def left_join_renamed(
    left: DataFrame, right: DataFrame, key: str, suffix: str = "_meta", **kwargs
) -> DataFrame:
    """Left join by row id in which clashing right columns get ``suffix``."""
    clashes = [c for c in right.columns if c != key and c in left.columns]
    renamed = right.withColumnsRenamed({c: c + suffix for c in clashes})
    return lookup_join(left, renamed, [key], "left", hot=False, **kwargs)


def upsert(
    base: DataFrame, corrections: DataFrame, on: list[str], columns: list[str]
) -> DataFrame:
    """Replace ``columns`` where a correction row exists, null values included.

    Both sides carry unique keys, so the join has no hot key.
    """
    fresh = corrections.select(*on, *[F.col(c).alias(f"__new_{c}") for c in columns], F.lit(True).alias("__hit"))
    joined = base.join(fresh, on, "left")
    replaced = {c: F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(replaced).select(*base.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the least by ``order`` and then by all other columns: an
    aggregate with map-side combine, so a key with many copies never gathers in
    one window, and the choice does not depend on the layout."""
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in dict.fromkeys([*order, *rest])])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordering).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def scored_by_all(df: DataFrame, row_id: str, model: str, n_models: int) -> DataFrame:
    """Keys of the rows that every one of ``n_models`` models scored."""
    return (
        df.groupBy(row_id)
        .agg(F.countDistinct(model).alias("__m"))
        .where(F.col("__m") == n_models)
        .select(row_id)
    )
