"""Sinks. Every write is a new folder or an append; nothing read is rewritten."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import together
from .readers import CSV_OPTIONS


def ordered(df: DataFrame, preferred: list[str]) -> DataFrame:
    """Preferred columns first (those present), then the rest."""
    front = [c for c in preferred if c in df.columns]
    return df.select(*front, *[c for c in df.columns if c not in front])


def write_table(df: DataFrame, path: str, formats: tuple[str, ...] = ("parquet",), partition_by: list[str] | None = None) -> list[str]:
    """Write to ``path.<format>`` for each format; typed columns need no casts."""
    written = []
    for fmt in formats:
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        target = f"{path}.{fmt}"
        if fmt == "csv":
            writer.options(**{k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}).csv(target)
        elif fmt == "parquet":
            writer.parquet(target)
        elif fmt == "json":
            writer.json(target)
        else:
            raise ValueError(f"unsupported format: {fmt}")
        written.append(target)
    return written


def write_tables(tables: dict[str, DataFrame], folder: str, formats: tuple[str, ...] = ("parquet",)) -> list[str]:
    """Write each table below ``folder``, several at a time."""
    if not tables:
        return []
    steps = [lambda name=name, df=df: write_table(df, f"{folder}/{name}", formats) for name, df in tables.items()]
    return [p for written in together(next(iter(tables.values())).sparkSession, *steps) for p in written]


def append_run(df: DataFrame, path: str, partition_by: list[str], run_id: str | None = None) -> str:
    """Append one run's results, tagged with a run id that sorts by time."""
    from pyspark.sql import functions as F
    import time

    run = run_id or f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.withColumn("run_id", F.lit(run)).write.mode("append").partitionBy(*partition_by).parquet(path)
    return run


def write_version(df: DataFrame, folder: str, version: int | None = None) -> str:
    """Write a corrected table beside the earlier ones, which stay as backups."""
    spark = df.sparkSession
    path_class = spark._jvm.org.apache.hadoop.fs.Path
    if version is None:
        pattern = path_class(f"{folder}/v=*")
        found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        known = [int(s.getPath().getName().split("=")[1]) for s in found]
        version = max(known, default=0) + 1
    target = f"{folder}/v={version}"
    df.write.mode("errorifexists").parquet(target)
    return target
