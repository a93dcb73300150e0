import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from auditspark.llm import warc

EVIL = "before WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\nafter"


def brute(rows, least=0):
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        to = first.get(h or "")
        again = to is not None and to != p and len(data) >= least
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((p, len(data), digest, "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def pages(spark, rows, n=3):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(1)).repartition(n)


ROWS = [
    (5, "http://a", "<p>same</p>"), (3, "http://b", "<p>same</p>"), (9, "http://c\r\nX: y", "<p>same</p>"), (1, None, None), (2, "u", ""),
    (4, "u", EVIL), (6, "u", EVIL), (7, "u", "WARC/1.1\r\n"), (8, "u", "é\r\n\r\nü" * 50), (10, "u", "ends in\r\n\r\n"), (11, "u", "\r\n\r\n"),
    (None, "u", "no id"), (None, "u", "<p>same</p>"), (12, "u", "twice"), (12, "u", "twice"), (13, "u", "WARC/1.1\r\n\r\n\r\n" * 3),
]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    got = [tuple(r) for r in warc.round_trip(pages(spark, ROWS), min_bytes=least).collect()]
    assert sorted(got, key=str) == brute(ROWS, least)


def test_small_splits(spark):
    rnd = random.Random(1)
    rows = [(k, f"http://x/{k}", rnd.choice([EVIL, "pay", "p" * rnd.randint(0, 400)]) + str(k % 40)) for k in range(300)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    source = pages(spark, rows, 2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = [tuple(r) for r in warc.round_trip(source).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got, key=str) == brute(rows)


def test_records_are_warc(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(pages(spark, ROWS[:3], 1), path, "page_id", "url", "html")
    data = b"".join(r["content"] for r in spark.read.format("binaryFile").load(path).collect())
    at, types = 0, []
    while at < len(data):
        assert data[at : at + 10] == b"WARC/1.1\r\n"
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(b": ", 1) for line in data[at:end].split(b"\r\n")[1:])
        at = end + 4 + int(head[b"Content-Length"])
        assert data[at : at + 4] == b"\r\n\r\n"
        at += 4
        types.append(head[b"WARC-Type"])
    assert sorted(types) == [b"response", b"revisit", b"revisit"]


def test_many_representatives_are_joined(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    got = [tuple(r) for r in warc.round_trip(pages(spark, ROWS)).collect()]
    assert sorted(got, key=str) == brute(ROWS)


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []
