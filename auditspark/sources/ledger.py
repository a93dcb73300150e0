"""Appends that count whole or not at all.

Each attempt at a chunk writes a folder of its own and then one empty ledger file
whose name says (run, chunk, attempt).  Making that file is the commit: data of
an attempt that ended before it are never read, and of two attempts at one chunk
(a driver that was thought dead) the least name counts.  The ledger has one name
for each chunk, which bounds what the driver lists.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

LEDGER = "_ledger"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def new_run() -> str:
    """A run id that sorts by time."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def write_attempt(df: DataFrame, path: str, run: str, chunk: int) -> str:
    """Write a chunk's rows; returns the attempt's name for ``commit``."""
    name = f"{run}~{chunk}~{uuid.uuid4().hex[:12]}"
    df.write.mode("errorifexists").parquet(_folder(path, name))
    return name


def commit(spark: SparkSession, path: str, name: str) -> None:
    entry, fs = _file_system(spark, f"{path}/{LEDGER}/{name}")
    fs.create(entry, False).close()


def append_chunk(df: DataFrame, path: str, run: str, chunk: int) -> bool:
    """Append one chunk once: nothing is done for a chunk that is committed."""
    spark = df.sparkSession
    if chunk in committed_chunks(spark, path, run):
        return False
    commit(spark, path, write_attempt(df, path, run, chunk))
    return True


def _folder(path: str, name: str) -> str:
    run, chunk, attempt = name.split("~")
    return f"{path}/run_id={run}/chunk={chunk}/attempt={attempt}"


def _entries(spark: SparkSession, path: str) -> dict[tuple[str, int], str]:
    where, fs = _file_system(spark, f"{path}/{LEDGER}")
    names = sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []
    first: dict[tuple[str, int], str] = {}
    for name in names:
        if name.count("~") == 2:
            run, chunk, _ = name.split("~")
            first.setdefault((run, int(chunk)), name)
    return first


def committed_chunks(spark: SparkSession, path: str, run: str | None = None) -> list[int]:
    return sorted(chunk for r, chunk in _entries(spark, path) if run is None or r == run)


def read_committed(spark: SparkSession, path: str) -> DataFrame | None:
    """All committed rows with ``run_id`` and ``chunk``; None before the first commit."""
    names = _entries(spark, path).values()
    if not names:
        return None
    rows = spark.read.option("basePath", path).parquet(*[_folder(path, n) for n in names])
    return rows.drop("attempt")
