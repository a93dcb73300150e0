"""The answer parser on accepted and rejected forms."""

import pytest
from pyspark.sql import functions as F

from auditspark.functions.parse import parse_answer, parse_digits

CASES = {
    "ok": [
        "120000", "120,000", "$120000", "$120,000", "120000.00", "120000 USD", "120000 dollars", "120000USD",
        "$ 120000", "120000,", "12,00,00", "120000\n", "20000", "1000000",
    ],
    "empty": [None, "", "   ", "\t"],
    "no_number": ["n/a", "[ERROR] timeout"],
    "multiple_numbers_or_range": [
        "120000-140000", "120000 – 140000", "120000 or 130000", "120000 TO 130000", "120000 130000",
        "between 90000 and 1", "orange", "Orange 120000", "1e5", "2024-05",
    ],
    "malformed": [
        "salary: 120000", "about 120000", "I estimate 120000", "120000.50", "120000.", "-120000", ",120000",
        "120000 Usd", "120000 USD per year", "[ERROR] HTTP 429",
    ],
    "out_of_plausible_range": ["19999", "1000001", "99999999999999999999"],
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, text) for i, text in enumerate(t for texts in CASES.values() for t in texts)]
    df = spark.createDataFrame(rows, "i int, raw string").select("i", "raw", parse_answer(F.col("raw")).alias("p"))
    return {r["i"]: r for r in df.select("i", "raw", "p.*").collect()}


def test_statuses(parsed):
    expected = [s for s, texts in CASES.items() for _ in texts]
    assert [parsed[i]["status"] for i in range(len(expected))] == expected


def test_values(parsed):
    for row in parsed.values():
        assert (row["value"] is not None) == (row["status"] == "ok")
    values = {r["raw"]: r["value"] for r in parsed.values()}
    assert values["$120,000"] == values["12,00,00"] == values["120000.00"] == 120000.0


def test_digits(spark):
    df = spark.createDataFrame([("about 12-5",), ("none",), (None,)], "raw string")
    assert [r[0] for r in df.select(parse_digits(F.col("raw"))).collect()] == [125.0, 0.0, 0.0]
