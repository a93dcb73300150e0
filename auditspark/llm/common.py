"""Tables, stored intermediates and per-process caches of the operators."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from auditspark.session import materialize, scratch_path  # noqa: F401

#: Text bytes that one task handles at a time.
CHUNK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so a lost executor
    costs no recomputation and several readers share one run."""
    return materialize(df, name)


def per_process(key: Hashable, make: Callable[[], object], large: bool = False) -> object:
    """A value made once in each Python worker: tokenizers and word caches.

    Functions travel to tasks by value, so their own globals start anew with
    every task; this holder is kept by the interpreter.  Of the large values a
    worker keeps only the last, whichever operator ran before.
    """
    holder = sys.modules.setdefault("_auditspark_llm_cache", types.ModuleType("_auditspark_llm_cache"))
    values = holder.__dict__.setdefault("values", {})
    key = ("large" if large else "small", key)
    if key not in values:
        if large:
            release()
        values[key] = make()
    return values[key]


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items of at most ``most`` bytes, or one larger item."""
    at = 0
    while at < len(sizes):
        upto, size = at, 0
        while upto < len(sizes) and (upto == at or size + sizes[upto] <= most):
            size += sizes[upto]
            upto += 1
        yield at, upto
        at = upto


def release() -> None:
    """Drop the large value that an earlier stage may have left in this worker."""
    holder = sys.modules.get("_auditspark_llm_cache")
    values = holder.__dict__.get("values", {}) if holder else {}
    for key in [k for k in values if k[0] == "large"]:
        del values[key]
    give_back()


def give_back() -> None:
    """Return this process's freed memory to the system.  Workers live on from task to
    task, and Arrow's pool and the C library keep what the largest batch needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def empty_if_null(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def chunks_for(df: DataFrame, text: str, size: int = CHUNK_BYTES) -> int:
    """How many chunks of about ``size`` text bytes a table fills, from all its rows."""
    total = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(8, -(-int(total) // size))


def block_pairs(df: DataFrame, keys: list[str], spread_by: str, block: int, load: Column | None = None) -> DataFrame:
    """Give the rows of a group places in pairs of blocks (i <= j) of about
    ``block`` rows, or of a summed ``load`` of one: every two rows of a group meet in
    one pair or more, and no task holds more than two blocks.  ``mine`` is the
    row's own block."""
    filled = F.count("*") / block if load is None else F.sum(load)
    # A little less than a whole block more is no new block: sums of doubles.
    sizes = df.groupBy(*keys).agg(F.ceil(filled - F.lit(1e-9)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64(spread_by), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # A group of several blocks meets itself in the pairs of unequal blocks as well.
    placed = df.join(sizes, keys).withColumn("mine", mine).withColumn("other", other)
    return placed.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("other", "blocks")


def row_groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first ``width`` columns, of sorted batches."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:width] != key:
                if rows:
                    yield key, rows
                key, rows = row[:width], []
            rows.append(row)
    if rows:
        yield key, rows
