"""Block-balanced sampling: seeded, order-free and without a driver loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..columns import DEFAULT, AuditColumns
from ..functions.numeric import unit_hash
from ..session import materialize
from .joins import lookup_join
from .labelling import block_counts, eligible_blocks
from .ranking import _C, kth_smallest, running_counts

_B = "__bucket"

SEGMENT = 1024


def effective_capacity(max_per_block: int = 0) -> Column:
    return F.least(F.col("capacity"), F.lit(max_per_block)) if max_per_block > 0 else F.col("capacity")


def block_weight(capacity: Column, mode: str = "inverse_sqrt") -> Column:
    weights = {
        "uniform": F.lit(1.0),
        "sqrt": F.sqrt(capacity.cast("double")),
        "inverse_sqrt": F.lit(1.0) / F.sqrt(F.nullif(capacity, F.lit(0)).cast("double")),
    }
    if mode not in weights:
        raise ValueError(f"unknown weight mode: {mode}")
    return F.when(capacity > 0, weights[mode]).otherwise(F.lit(0.0))


def feasible_target(blocks: DataFrame, target: int, max_per_block: int = 0, allow_short: bool = False) -> int:
    """The per-group target, shrunk to the total capacity where allowed."""
    total = blocks.agg(F.sum(effective_capacity(max_per_block))).first()[0] or 0
    if total >= target:
        return target
    if not allow_short:
        raise ValueError(f"balanced capacity {total} is below the requested {target} per group")
    return int(total)


def quota_race(
    blocks: DataFrame, target: int, seed: int, mode: str = "inverse_sqrt", max_per_block: int = 0, block: str = "block_id"
) -> DataFrame:
    """Random quotas with the law of drawing one unit at a time.

    Each block gets arrivals with exponential gaps of rate = its weight and
    stops at its capacity; the first ``target`` arrivals overall are the units.
    Arrival times are prefix sums in segments of 1024 gaps, and the overall cut
    selects one order statistic by histogram, so neither a large block nor a large target gathers in
    one task.
    """
    cap = effective_capacity(max_per_block)
    limit = F.least(cap, F.lit(target)).cast("bigint")
    segments = blocks.select(
        F.col(block),
        limit.alias("__cap"),
        block_weight(cap, mode).alias("__w"),
    ).where((F.col("__cap") > 0) & (F.col("__w") > 0))
    segments = segments.withColumn(
        "__seg", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__cap") - 1) / SEGMENT)))
    ).repartition(block, "__seg")
    first = F.col("__seg") * SEGMENT
    gaps = segments.withColumn(
        "__k", F.explode(F.sequence(first + 1, F.least(first + SEGMENT, F.col("__cap"))))
    ).withColumn("__gap", -F.ln(unit_hash(str(seed), F.col(block), F.col("__k"))) / F.col("__w"))
    seg_sums = gaps.groupBy(block, "__seg").agg(F.sum("__gap").alias("__s"))
    earlier = Window.partitionBy(block).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = seg_sums.select(block, "__seg", F.coalesce(F.sum("__s").over(earlier), F.lit(0.0)).alias("__start"))
    inside = Window.partitionBy(block, "__seg").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    arrivals = gaps.join(starts, [block, "__seg"]).select(
        block, (F.col("__start") + F.sum("__gap").over(inside)).alias("__t")
    )
    # Two arrivals at one instant (of 2**52) have no practical chance.
    short = F.raise_error(F.lit(f"the blocks cannot supply {target} units")).cast("double")
    last = F.coalesce(kth_smallest(arrivals, "__t", target), short)
    return arrivals.where(F.col("__t") <= last).groupBy(block).agg(F.count(F.lit(1)).alias("quota"))


def quota_proportional(
    blocks: DataFrame, target: int, mode: str = "inverse_sqrt", max_per_block: int = 0, block: str = "block_id"
) -> DataFrame:
    """Repeatable quotas: capped weight shares rounded by largest remainder.

    Weight and cap depend on the capacity only, so everything is solved on one
    row per distinct capacity (k distinct capacities need k*k/2 rows of data, so
    the windows below stay small), and only the class on the rounding edge ranks
    its blocks.
    """
    cap = effective_capacity(max_per_block).cast("bigint")
    base = blocks.select(F.col(block), cap.alias("cap")).where(F.col("cap") > 0)
    whole = Window.partitionBy(F.lit(0))
    upto = whole.orderBy("cap").rowsBetween(Window.unboundedPreceding, 0)
    classes = (
        base.groupBy("cap")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("w", block_weight(F.col("cap"), mode))
        .withColumns({"nc": F.col("n") * F.col("cap"), "nw": F.col("n") * F.col("w")})
    )
    # Raising the level fills classes in order of cap / w, which rises with cap.
    full_here = F.sum("nc").over(upto) + F.col("cap") / F.col("w") * (F.sum("nw").over(whole) - F.sum("nw").over(upto))
    classes = classes.withColumn("full", full_here <= F.lit(target) + F.lit(1e-9))
    left = F.lit(target) - F.sum(F.when(F.col("full"), F.col("nc")).otherwise(0)).over(whole)
    level = F.try_divide(left, F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("nw"))).over(whole))
    share = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level * F.col("w"))
    classes = classes.withColumn("share", share).withColumn("base", F.floor(F.col("share") + F.lit(1e-9)))
    classes = classes.withColumn("rem", F.round(F.col("share") - F.col("base"), 9))
    spare = F.lit(target) - F.sum(F.col("n") * F.col("base")).over(whole)
    open_n = F.when(F.col("base") < F.col("cap"), F.col("n")).otherwise(0)
    by_rem = whole.orderBy(F.desc("rem"), "cap").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn(
        "extra", F.greatest(F.lit(0), F.least(open_n, spare - F.coalesce(F.sum(open_n).over(by_rem), F.lit(0))))
    )
    dealt = lookup_join(base, classes.select("cap", "n", "base", "extra"), ["cap"], "inner", [block])
    settled = dealt.where((F.col("extra") == 0) | (F.col("extra") == F.col("n"))).select(
        block, (F.col("base") + F.when(F.col("extra") > 0, 1).otherwise(0)).alias("quota")
    )
    edge = (
        dealt.where((F.col("extra") > 0) & (F.col("extra") < F.col("n")))
        .withColumn("u", unit_hash("edge", F.col(block)))
        .withColumn(_C, F.lit(1))
    )
    ranked = running_counts(edge, ["cap"], ["u", block]).select(
        block, (F.col("base") + F.when(F.col("__below") < F.col("extra"), 1).otherwise(0)).alias("quota")
    )
    return settled.unionByName(ranked).where(F.col("quota") > 0).withColumn("quota", F.col("quota").cast("bigint"))


def sample_within_blocks(
    rows: DataFrame, quotas: DataFrame, seed: int, c: AuditColumns = DEFAULT, limit: int | None = None
) -> DataFrame:
    """Draw ``quota`` rows without replacement in each (block, label) group.

    The order is a hash of (seed, row id). A histogram of that hash gives the
    bucket in which each group's quota ends; rows beyond it are dropped before
    anything is shuffled, so a block with a third of the data ranks only about
    its quota. ``quotas`` needs block, quota, n_ai and n_other.
    """
    size = F.when(F.col(c.label), F.col("n_ai")).otherwise(F.col("n_other"))
    bins = F.least(F.lit(65_536), F.ceil(size / F.lit(1000.0)))
    drawn = quotas.where(F.col("quota") > 0).select(c.block, "quota", "n_ai", "n_other")
    tagged = (
        lookup_join(rows, drawn, [c.block], "inner", [c.row_id], limit)
        .withColumn("__u", unit_hash(str(seed), F.col(c.row_id)))
        .withColumn(_B, F.floor(F.col("__u") * bins).cast("int"))
    )
    group = [c.block, c.label]
    hist = tagged.groupBy(*group, _B).agg(F.count(F.lit(1)).alias("__in"), F.max("quota").alias("__q"))
    before = Window.partitionBy(*group).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        hist.withColumn("__before", F.coalesce(F.sum("__in").over(before), F.lit(0)))
        .where((F.col("__before") < F.col("__q")) & (F.col("__q") <= F.col("__before") + F.col("__in")))
        .select(*group, F.col(_B).alias("__cut"), (F.col("__q") - F.col("__before")).alias("__need"))
    )
    # One row per group, stored: its size is then known to the join.
    kept = lookup_join(tagged, materialize(cuts, "cuts"), group, "inner", [c.row_id], limit).where(F.col(_B) <= F.col("__cut"))
    place = F.row_number().over(Window.partitionBy(*group, _B).orderBy("__u", c.row_id))
    return (
        kept.withColumn("__rn", place)
        .where((F.col(_B) < F.col("__cut")) | (F.col("__rn") <= F.col("__need")))
        .select(*rows.columns)
    )


def shuffled(df: DataFrame, seed: int, row_id: str) -> DataFrame:
    """Seeded random output order."""
    return df.orderBy(unit_hash(str(seed), "order", F.col(row_id)), row_id)


def unbalanced_blocks(sample: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    """Blocks whose two groups differ in size: empty for a sound sample."""
    return block_counts(sample, c).where(F.col("n_ai") != F.col("n_other"))


def balanced_sample(
    rows: DataFrame,
    target_total: int,
    seed: int = 0,
    mode: str = "inverse_sqrt",
    max_per_block: int = 0,
    min_ai: int = 1,
    min_other: int = 1,
    allow_short: bool = False,
    c: AuditColumns = DEFAULT,
) -> DataFrame:
    """Half labelled, half other, equal within each block. ``rows`` carries the
    label and block columns."""
    # One row per block, read by every step below.
    blocks = materialize(eligible_blocks(block_counts(rows, c), min_ai, min_other), "blocks")
    target = feasible_target(blocks, target_total // 2, max_per_block, allow_short)
    quotas = quota_race(blocks, target, seed, mode, max_per_block, c.block).join(
        blocks.select(c.block, "n_ai", "n_other"), c.block
    )
    return sample_within_blocks(rows, materialize(quotas, "quotas"), seed, c)
