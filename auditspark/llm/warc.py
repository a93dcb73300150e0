"""WARC archives: written with revisit records, read back by boundary chains.

Writing: of the pages with equal payloads the one with the smallest id is a
response, the others are revisits of it.  Every scan task writes its own
archive through Spark's text writer, whose line separator closes a record.

Reading: archives are read in splits at any byte.  Each occurrence of the
record magic is a candidate; its task parses the header and emits the offset of
the successor that the record's length names.  Whether a candidate is a record
or magic inside a payload shows only along the chain from the file's start, so
the narrow table of (offset, successor) is pointer-jumped per archive, and only
candidates on the chain remain.  A record whose payload holds the magic lies in
several segments; such records are cut from their archive once more by offset.

Null html is the empty payload; a null url is an empty one; rows without an id
are written and returned with a null id, and are responses unless a page with an
id has the same payload.  Rows that repeat the smallest id of a payload are all
responses.  An empty table gives no row.  A chain ends at the first successor
that is neither a candidate nor the end of the file (a damaged archive).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import empty_if_null, scratch_path, store

MAGIC = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Representatives of repeated payloads that may be broadcast (about 100 bytes each).
BROADCAST_ROWS = 100_000
#: Records of one archive at most.
ARCHIVE_RECORDS = 50_000


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four digits for each 20 bits."""
    hexed = F.sha1(payload)
    fours = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*fours), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, id_col: str, url_col: str, html_col: str, min_bytes: int = 0) -> None:
    """One record per page; payloads below ``min_bytes`` are never revisits."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_replace(empty_if_null(url_col), r"[\r\n]+", "%0A").alias("url"),
        empty_if_null(html_col).alias("html"),
    ).withColumns({"bytes": F.octet_length("html").cast("long"), "digest": base32_sha1(F.col("html").cast("binary"))})
    groups = (
        rows.where(F.col("bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
    )
    repeated = store(groups.select("digest", "first"), "repeated_payloads")
    # A join would move every payload; few representatives are sent to the pages instead.
    side = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    rows = rows.join(side, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("bytes") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"), F.lit(BREAK),
    )
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), number("id"),
        F.lit(">\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), number("first"),
                                 F.lit(f">\r\nWARC-Profile: {PROFILE}"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        length.cast("string"), F.lit(BREAK), http, F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )
    rows.select(record).write.option("lineSep", BREAK).option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def _page(uri: Column) -> Column:
    return F.regexp_extract(uri, r"<urn:page:(-?\d+)>", 1).try_cast("long")


def _parsed(value: Column) -> dict[str, Column]:
    """Fields of a segment that follows the magic; null where it has no header."""
    head = F.substring_index(value, BREAK, 1)
    start = F.octet_length(head) + 4
    both = F.octet_length(F.substring_index(value, BREAK, 2)) + 4
    http = F.substring_index(F.substring_index(value, BREAK, 2), BREAK, -1)
    content = _field(head, "Content-Length").try_cast("long")
    payload = F.substring(value.cast("binary"), both + 1, (start + content - both).cast("int"))
    revisit = F.lower(_field(head, "WARC-Type")) == "revisit"
    return {
        "size": F.octet_length(value).cast("long"),
        "ends": F.when(F.instr(value, BREAK) > 0, start + content + 4),
        "record_type": F.lower(_field(head, "WARC-Type")),
        "page_id": _page(_field(head, "WARC-Record-ID")),
        "refers_to": F.when(revisit, _page(_field(head, "WARC-Refers-To"))),
        "payload_bytes": F.when(revisit, _field(http, "Content-Length").try_cast("long")).otherwise(
            F.octet_length(payload).cast("long")
        ),
        "payload_digest": F.when(revisit, F.regexp_replace(_field(head, "WARC-Payload-Digest"), "^sha1:", "")).otherwise(
            base32_sha1(payload)
        ),
    }


FIELDS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def chain(group: pd.DataFrame) -> pd.DataFrame:
    """Candidates of one archive that the chain from its start reaches."""
    group = group.sort_values("at", ignore_index=True)
    at, after = group["at"].to_numpy(), group["after"].fillna(-1).to_numpy(np.int64)
    n = len(at)
    jump = np.searchsorted(at, after)
    jump[(jump < n) & (at[np.minimum(jump, n - 1)] != after)] = n
    jump = np.append(jump, n)
    reached = np.zeros(n + 1, bool)
    reached[0] = n > 0 and at[0] == 0
    while True:  # after k rounds the first 2**k records are marked
        more = reached.copy()
        more[jump[reached]] = True
        if (more == reached)[:n].all():
            break
        reached, jump = more, jump[jump]
    # A record is whole if a candidate or the end of the file follows it.
    whole = np.isin(after, at) | (after == group["end"].iloc[0])
    return group.loc[whole & reached[:n], ["file", "at", "after"]]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below a path."""
    lines = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"), "value",
    )
    segments = store(lines.select("file", "block", "nth", *[c.alias(k) for k, c in _parsed(F.col("value")).items()]),
                     "segments")
    # Byte offsets: sizes summed within a split, plus the splits before it.
    step = F.col("size") + len(MAGIC)
    splits = segments.groupBy("file", "block").agg(F.sum(step).alias("bytes"))
    order = Window.partitionBy("file").orderBy("block")
    splits = splits.select("file", "block", (F.sum("bytes").over(order) - F.col("bytes")).alias("base"),
                           (F.sum("bytes").over(Window.partitionBy("file")) - len(MAGIC)).alias("end"))
    inside = Window.partitionBy("file", "block").orderBy("nth")
    placed = store(
        segments.withColumn("run", F.sum(step).over(inside) - step)
        .join(splits, ["file", "block"])
        .withColumn("body", F.col("base") + F.col("run"))
        .where("body > 0")  # what stands before the first magic is no candidate
        .withColumns({"at": F.col("body") - len(MAGIC), "after": F.col("body") + F.col("ends")}),
        "candidates",
    )
    kept = placed.select("file", "at", "after", "end").groupBy("file").applyInPandas(chain, "file string, at long, after long")
    records = store(placed.join(kept.select("file", "at"), ["file", "at"]), "records")
    split_up = records.where("ends > size").select("file", "at", "after")
    whole = records.where("ends <= size").select(*FIELDS)
    if split_up.isEmpty():
        return whole
    return whole.unionByName(_cut_out(spark, split_up))


def _cut_out(spark: SparkSession, spans: DataFrame) -> DataFrame:
    """Records over several segments, sliced from the bytes of their archives."""
    places = spans.groupBy("file").agg(F.collect_list(F.struct("at", "after")).alias("spans"))
    files = [r["file"] for r in places.select("file").collect()]
    content = spark.read.format("binaryFile").load(files).select(F.col("path").alias("file"), "content")
    sliced = content.join(places, "file").select(F.explode("spans").alias("s"), "content").select(
        F.expr(f"substring(content, int(s.at) + 1 + {len(MAGIC)}, int(s.after - s.at) - {len(MAGIC)})")
        .cast("string").alias("value")
    )
    return sliced.select(*[c.alias(k) for k, c in _parsed(F.col("value")).items() if k in FIELDS]).select(*FIELDS)


def round_trip(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0
) -> DataFrame:
    """Write all pages to archives in the shared folder and read the records back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, id_col, url_col, html_col, min_bytes)
    return read_archives(pages.sparkSession, path)
