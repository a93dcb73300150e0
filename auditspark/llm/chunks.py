"""Chunks of neighbouring rows of a stored table, and packed columns for exchanges.

A chunk is a run of row numbers of one Parquet file, so a row keeps its chunk
however a scan is split and whichever executor runs it.  Facts about a chunk's
texts travel packed: sorted 64-bit keys as differences, every column as byte
planes, whose empty planes the shuffle's compression removes.
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from .common import CHUNK_BYTES, store

NO_ID = (1 << 63) - 1


def based(docs: DataFrame) -> DataFrame:
    """The table itself if its rows have places in files, else a stored copy."""
    try:
        docs.select("_metadata.row_index").schema
    except AnalysisException:
        return store(docs, "rows")
    return docs


def row_place() -> list[Column]:
    """Columns f and r: file and row number, which name a row of a based table."""
    return [F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")]


def chunked(docs: DataFrame, id_col: str, text_col: str, *more: Column, size: int = CHUNK_BYTES) -> DataFrame:
    """doc (null: largest of all), text as bytes (null: none), chunk and further
    columns of a based table."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    total, n = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string"))), F.count("*")).first()
    rows = max(1, min(1 << 14, int(size * n // max(total or 0, 1)) if n else 1))
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc"),
        text.alias("text"),
        F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / rows)).alias("chunk"),
        *more,
    )


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as eight byte planes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def lookup(keys: np.ndarray, checks: np.ndarray, in_keys: np.ndarray, in_checks: np.ndarray) -> np.ndarray:
    """Position of each (key, check) in a list sorted by key, or -1."""
    found = np.full(len(keys), -1, np.int64)
    if not len(in_keys):
        return found
    at = np.searchsorted(in_keys, keys)
    live = np.flatnonzero(at < len(in_keys))
    while len(live):  # once, but for equal keys with unequal checks
        live = live[in_keys[at[live]] == keys[live]]
        hit = in_checks[at[live]] == checks[live]
        found[live[hit]] = at[live[hit]]
        live = live[~hit]
        at[live] += 1
        live = live[at[live] < len(in_keys)]
    return found
