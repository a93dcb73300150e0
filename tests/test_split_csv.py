"""CSV with quoted line breaks read in many splits equals the whole read."""

import random

import pytest

from auditspark.columns import DEFAULT as C
from auditspark.sources.readers import CSV_OPTIONS, scan_predictions
from auditspark.sources.split_csv import read_split_csv


@pytest.fixture
def small_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    cost, old = spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get(name)
    spark.conf.set(name, "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set(name, old)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def _rows(df):
    return sorted(tuple("\0" if v is None else v for v in row) for row in df.collect())


def _field(rng):
    kind = rng.randrange(8)
    text = "".join(rng.choice(["a", "b ", ",", '""', "\n", "x\n\n,", "\r\n"]) for _ in range(rng.randrange(12)))
    if kind < 4:
        return '"' + text + '"'
    return ["plain", "", 'six"inch', "two words"][kind - 4]


@pytest.mark.parametrize("seed", range(4))
def test_equals_whole_read(spark, small_splits, tmp_path, seed):
    rng = random.Random(seed)
    for part in range(3):
        body = "".join(f"{part}-{i},{_field(rng)},{_field(rng)}\n" for i in range(300))
        (tmp_path / f"p{part}.csv").write_text("id,left side,right\n" + body, newline="")
    got = read_split_csv(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    whole = spark.read.options(**CSV_OPTIONS).csv(str(tmp_path))
    assert got.columns == whole.columns and _rows(got) == _rows(whole) and whole.count() == 900


def test_record_over_many_splits(spark, small_splits, tmp_path):
    long = "line, with \"\"quotes\"\"\n" * 400
    (tmp_path / "a.csv").write_text(f'id,t\n1,"{long}"\n2,"x"\n3,\n', newline="")
    got = read_split_csv(spark, str(tmp_path / "a.csv"), "id int, t string").collect()
    assert sorted((r["id"], r["t"]) for r in got if r["t"]) == [(1, long.replace('""', '"')), (2, "x")]
    assert [r["id"] for r in got if r["t"] is None] == [3]


def test_header_alone_crlf_and_no_last_break(spark, tmp_path):
    (tmp_path / "h.csv").write_text("id,t\n", newline="")
    assert read_split_csv(spark, str(tmp_path / "h.csv")).collect() == []
    (tmp_path / "c.csv").write_text('id,t\r\n1,a\r\n2,"b\r\nc"\r\n\r\n3,d', newline="")
    got = sorted(tuple(r) for r in read_split_csv(spark, str(tmp_path / "c.csv")).collect())
    assert got == [("1", "a"), ("2", "b\r\nc"), ("3", "d")]


def test_prediction_scan_by_splits(spark, small_splits, tmp_path):
    head = ",".join([C.row_id, C.actual, C.estimate, C.label, C.raw])
    for model in ("qwen-a+b 1", "llama-2"):
        body = "".join(f'{i},100,{i * 3},{i % 2 == 0},"about\n{i}, or ""so"""\n' for i in range(80))
        (tmp_path / model).mkdir()
        (tmp_path / model / "out.csv").write_text(head + "\n" + body, newline="")
    tables = [scan_predictions(spark, f"{tmp_path}/*/out.csv", split_files=split)[0] for split in (True, False)]
    assert tables[0].columns == tables[1].columns
    assert _rows(tables[0]) == _rows(tables[1]) and len(_rows(tables[0])) == 160
