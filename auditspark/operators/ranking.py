"""Exact ranks and quantiles without one task per group.

A group may hold a third of all rows and most rows may share one value, so
neither a buffering ``median`` nor a window over a group or a value range is
used.  Quantiles are selected in rounds: mergeable sketches give each (key,
measure, rank) two pivots, one pass counts the rows below, at and between them,
and the bracket that holds the rank is narrowed until few rows lie inside; rows
equal to an end of a bracket are only counted.  Ranks come from value counts that
are range-partitioned, summed inside each partition and shifted by the totals of
the partitions before, so tasks are as even as the ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import materialize
from .joins import lookup_join

_C = "__count"
#: Rows strictly inside a bracket that one task may sort.
INTERIOR = 1 << 16
GRID = 256
ACCURACY = 8 * GRID


def _present(columns: list[str]) -> Column:
    return reduce(lambda a, c: a & F.col(f"`{c}`").isNotNull(), columns, F.lit(True))


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values with their frequency; a hot value is one row."""
    return df.where(_present([*keys, value])).groupBy(*keys, value).agg(F.count(F.lit(1)).alias(_C))


def running_counts(counts: DataFrame, keys: list[str], order: list[str], count: str = _C) -> DataFrame:
    """Add ``__below`` (rows of the key ordered before this one) and ``__total``.

    The rows are range-partitioned by (keys, order), which must be unique, and each
    task sums its own range; what lies before a range is a prefix sum over one row
    for each partition, and a key begins where its least place is.
    """
    ranged = counts.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    number = counts.columns.index(count)
    schema = T.StructType([*counts.schema, T.StructField("__part", T.LongType()), T.StructField("__run", T.LongType())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(number).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = before + np.cumsum(n)
            added = [pa.array(np.full(len(n), part)), pa.array(upto - n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)
            before = int(upto[-1]) if len(n) else before

    placed = materialize(ranged.mapInArrow(sums, schema), "ranges")
    parts = placed.groupBy("__part").agg(F.sum(count).alias("__in"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    parts = parts.select("__part", F.coalesce(F.sum("__in").over(ahead), F.lit(0)).alias("__ahead"))
    placed = placed.join(F.broadcast(parts), "__part")
    placed = placed.withColumn("__below", F.col("__ahead") + F.col("__run")).drop("__part", "__run", "__ahead")
    if not keys:
        return placed.withColumn("__total", counts.agg(F.sum(count).alias("t")).select("t").scalar())
    totals = placed.groupBy(*keys).agg(F.min("__below").alias("__first"), F.sum(count).alias("__total"))
    named = lookup_join(placed, totals, keys, "inner", order)
    return named.withColumn("__below", F.col("__below") - F.col("__first")).drop("__first")


def row_places(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``__below``, the rows ordered before this one; ``order`` must be unique.

    As ``running_counts`` where every row counts once: the number of a row in its
    range is known without a pass through Python.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumn("__place", F.monotonically_increasing_id()), "places")
    part = F.shiftright("__place", 33)  # the id is the partition and, in 33 bits, the row in it
    parts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__in"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    parts = parts.select("__part", F.coalesce(F.sum("__in").over(ahead), F.lit(0)).alias("__ahead"))
    placed = placed.withColumn("__part", part).join(F.broadcast(parts), "__part")
    below = F.col("__ahead") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__below", below).drop("__part", "__ahead", "__place")


def average_ranks(df: DataFrame, value: str, rank_name: str) -> DataFrame:
    """Distinct values with their tie-averaged rank (1-based)."""
    ranked = running_counts(value_counts(df, [], value), [], [value])
    mean_rank = F.col("__below") + (F.col(_C) + 1) / F.lit(2.0)
    return ranked.select(value, mean_rank.alias(rank_name))


class Selection:
    """Brackets around wanted ranks, one row for each key.

    ``targets`` are (measure, place): place gives, from the number of values n, a
    place from 0 that may lie between two ranks.  Of target i the table holds its
    two ranks ``a{i}`` and ``b{i}``, the ends ``lo{i}`` and ``hi{i}`` (null: open),
    ``until{i}`` values up to and with the lower end, of these ``at{i}`` equal to
    it, and ``inner{i}`` values strictly inside.
    """

    def __init__(self, df: DataFrame, keys: list[str], measures: dict[str, Column],
                 targets: list[tuple[str, Callable[[Column], Column]]], interior: int = INTERIOR):
        self.keys = keys or ["__all"]
        self.interior, self.targets, self.names = interior, targets, [m for m, _ in targets]
        self.most: list[int] = []  # rows inside the widest bracket after each round
        rows = df.where(_present(keys)) if keys else df.withColumn("__all", F.lit(0))
        narrow = rows.select(*self.keys, *[c.cast("double").alias(f"v_{m}") for m, c in measures.items()])
        self.rows = materialize(narrow, "measures")
        grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
        self.sketch = lambda v: F.percentile_approx(v, grid, F.lit(ACCURACY))
        self.state = self._begun(measures)
        while True:
            self.state = materialize(self.state, "brackets")
            widest = self.state.agg(F.max(F.greatest(F.lit(0), *map(self._open, range(len(targets)))))).first()[0]
            self.most.append(widest or 0)
            if self.most[-1] <= interior:
                return
            again = [F.when(self._open(i) > interior, self._inside(i, F.col(f"v_{m}"))) for i, m in enumerate(self.names)]
            met = self._with_state(self.state).groupBy(*self.keys).agg(
                *[self.sketch(v).alias(f"g{i}") for i, v in enumerate(again)]
            )
            self.state = self._narrowed(self.state.join(met, self.keys, "left"))

    def _begun(self, measures) -> DataFrame:
        sums = [F.count(f"v_{m}").alias(f"n_{m}") for m in measures] + [self.sketch(F.col(f"v_{m}")).alias(f"g_{m}") for m in measures]
        met = self.rows.groupBy(*self.keys).agg(*sums)
        columns = list(self.keys)
        for i, (m, place) in enumerate(self.targets):
            n = F.col(f"n_{m}")
            at = F.when(n > 0, place(n).cast("double"))
            columns += [
                F.floor(at).alias(f"a{i}"), F.ceil(at).alias(f"b{i}"), (at - F.floor(at)).alias(f"frac{i}"),
                F.lit(None).cast("double").alias(f"lo{i}"), F.lit(None).cast("double").alias(f"hi{i}"),
                F.lit(0).cast("long").alias(f"until{i}"), F.lit(0).cast("long").alias(f"at{i}"), n.alias(f"inner{i}"),
                F.col(f"g_{m}").alias(f"g{i}"),
            ]
        return self._narrowed(met.select(*columns))

    def _open(self, i: int) -> Column:
        """Values inside if a wanted rank is among them, else 0."""
        a, b, until, inner = (F.col(f"{c}{i}") for c in ("a", "b", "until", "inner"))
        return F.when((b >= until) & (a < until + inner), inner).otherwise(F.lit(0))

    def _inside(self, i: int, v: Column) -> Column:
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        return F.when((lo.isNull() | (v > lo)) & (hi.isNull() | (v < hi)), v)

    def _with_state(self, state: DataFrame) -> DataFrame:
        return lookup_join(self.rows, state, self.keys, "inner")

    def _narrowed(self, sketched: DataFrame) -> DataFrame:
        """Count the values around the pivots that the grids g{i} give, and keep of each
        bracket the part with the wanted ranks."""
        targets = range(len(self.targets))
        pivots = {}
        for i in targets:
            a, b, until, inner, g = (F.col(f"{c}{i}") for c in ("a", "b", "until", "inner", "g"))
            left, right = F.floor((a - until) / inner * GRID) - 2, F.ceil((b + 1 - until) / inner * GRID) + 2
            index = lambda k: F.greatest(F.least(k, F.lit(GRID)), F.lit(0)).cast("int")
            pivots |= {f"p{i}": F.when(inner > 0, F.get(g, index(left))), f"q{i}": F.when(inner > 0, F.get(g, index(right)))}
        state = materialize(sketched.withColumns(pivots).drop(*[f"g{i}" for i in targets]), "pivots")
        counts = []
        for i, m in enumerate(self.names):
            v, p, q = self._inside(i, F.col(f"v_{m}")), F.col(f"p{i}"), F.col(f"q{i}")
            counts += [F.count_if(v < p).alias(f"c1_{i}"), F.count_if(v <= p).alias(f"c2_{i}"),
                       F.count_if(v < q).alias(f"c3_{i}"), F.count_if(v <= q).alias(f"c4_{i}")]
        counted = state.join(self._with_state(state).groupBy(*self.keys).agg(*counts), self.keys)
        columns = list(self.keys)
        for i in targets:
            a, b, lo, hi, until, at, inner, p, q = (
                F.col(f"{c}{i}") for c in ("a", "b", "lo", "hi", "until", "at", "inner", "p", "q")
            )
            c1, c2, c3, c4 = (until + F.col(f"c{k}_{i}") for k in (1, 2, 3, 4))
            c3 = F.greatest(c2, c3)  # where both pivots are one value
            some = p.isNotNull()
            from_p, from_q = some & (a >= c1), some & (a >= c3)
            to_q, to_p = some & (b < c4), some & (b < c2)
            pick = lambda c, x, d, y, z: F.when(c, x).when(d, y).otherwise(z)
            new_until = pick(from_q, c4, from_p, c2, until)
            below_hi = pick(to_p, c1, to_q, c3, until + inner)
            columns += [
                f"a{i}", f"b{i}", f"frac{i}", pick(from_q, q, from_p, p, lo).alias(f"lo{i}"),
                pick(to_p, p, to_q, q, hi).alias(f"hi{i}"), new_until.alias(f"until{i}"),
                pick(from_q, c4 - c3, from_p, c2 - c1, at).alias(f"at{i}"),
                F.greatest(F.lit(0), below_hi - new_until).alias(f"inner{i}"),
            ]
        return counted.select(*columns)

    def interior_counts(self) -> DataFrame:
        """keys, target, until, a, b, v and how often v stands inside an open bracket."""
        entries = []
        for i, m in enumerate(self.names):
            v = self._inside(i, F.col(f"v_{m}"))
            entry = F.struct(F.lit(i).alias("t"), v.alias("v"), F.col(f"until{i}").alias("until"), F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"))
            entries.append(F.when((self._open(i) > 0) & v.isNotNull(), entry))
        met = self._with_state(self.state).select(*self.keys, F.explode(F.array_compact(F.array(*entries))).alias("e"))
        return met.groupBy(*self.keys, "e.t", "e.until", "e.a", "e.b", "e.v").agg(F.count(F.lit(1)).alias(_C))

    def values(self) -> DataFrame:
        """keys, and of each target the values ``lo{i}`` and ``hi{i}`` at its two ranks."""
        inside = Window.partitionBy(*self.keys, "t").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        run = self.interior_counts().withColumn("upto", F.col("until") + F.sum(_C).over(inside))
        here = lambda rank: (F.col(rank) < F.col("upto")) & (F.col(rank) >= F.col("upto") - F.col(_C))
        found = run.where(here("a") | here("b")).groupBy(*self.keys).agg(*[
            F.max(F.when((F.col("t") == i) & here(rank), F.col("v"))).alias(f"{rank}v{i}")
            for i in range(len(self.targets)) for rank in "ab"
        ])
        out = list(self.keys)
        for i in range(len(self.targets)):
            lo, hi, until, inner = (F.col(f"{c}{i}") for c in ("lo", "hi", "until", "inner"))
            for rank, name in (("a", "x"), ("b", "y")):
                k = F.col(f"{rank}{i}")
                out.append(F.when(k < until, lo).when(k >= until + inner, hi).otherwise(F.col(f"{rank}v{i}")).alias(f"{name}{i}"))
            out.append(f"frac{i}")
        return self.state.join(found, self.keys, "left").select(*out)


def exact_quantiles(
    df: DataFrame, keys: list[str], measures: dict[str, Column], probs: dict[str, float], interior: int = INTERIOR
) -> DataFrame:
    """Linear-interpolation quantiles of each measure per key.

    Output columns are ``{prob name}_{measure name}``; rows without a key are left
    out.  The input is computed once; its keys and measures are stored and read three
    times, and twice more for each further round (a round narrows a bracket to about
    a fiftieth).  The rounds run when this is called.
    """
    names = [(f"{name}_{m}", m, float(p)) for name, p in probs.items() for m in measures]
    targets = [(m, lambda n, p=p: F.lit(p) * (n - 1)) for _, m, p in names]
    found = Selection(df, keys, measures, targets, interior).values()
    x, y = (lambda i: F.col(f"x{i}")), (lambda i: F.col(f"y{i}"))
    out = [(x(i) + (y(i) - x(i)) * F.col(f"frac{i}")).alias(name) for i, (name, _, _) in enumerate(names)]
    if not keys:
        return found.agg(*[F.max(c).alias(name) for c, (name, _, _) in zip(out, names)])
    return found.select(*keys, *out).where(F.coalesce(*[F.col(f"`{name}`") for name, _, _ in names]).isNotNull())


def kth_smallest(df: DataFrame, value: str, k: int) -> Column:
    """The k-th smallest value (from 1) as a scalar; null when there is none."""
    place = lambda n: F.when(n >= k, F.lit(float(k - 1)))
    found = Selection(df, [], {"v": F.col(value)}, [("v", place)]).values()
    return found.agg(F.max("x0").alias("v")).select("v").scalar()


def exact_medians(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Exact medians; output columns are ``median_{measure name}``."""
    return exact_quantiles(df, keys, measures, {"median": 0.5})
