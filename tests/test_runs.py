"""Guards, resume, retry, sources, whole runs and the streamed run."""

import glob
import math
import os
import sys
import threading
import tracemalloc
import uuid

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from auditspark.columns import DEFAULT as C
from auditspark.functions.prompts import chat, messages_to_text
from auditspark.operators import filters, quality, ranking, scoring
from auditspark.plans import analysis, compare, estimate, sample
from auditspark.sources import ledger, readers, writers
from auditspark.streaming.incremental import stream_estimates

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def scorer():
    return lambda batch: [str(60_000 + 37 * (sum(map(ord, chat[-1]["content"])) % 1000)) for chat in batch]


def flaky():
    def answer(batch):
        if len(batch) > 1 or "t3" in batch[0][-1]["content"]:
            raise TimeoutError("busy")
        return ["75000"]

    return answer


@pytest.fixture(scope="module")
def observations(spark):
    rows = [
        (i, f"{'AI Engineer' if i % 4 == 0 else 'Clerk'} t{i % 6}", f"15-{i % 3}", f"Soc {i % 3}", "Here", f"S{i % 2}", "541511", "Y",
         1 + i % 5, "II", 70_000.0 + 500 * (i % 40), i % 4 == 0, (80.0 + i % 20) / 100 if i % 4 == 0 else (i % 30) / 100,
         "Certified" if i % 9 else "Denied", "Year", "year ")
        for i in range(240)
    ]
    names = [C.row_id, C.title, C.soc_code, C.soc_title, C.city, C.state, C.naics, C.full_time, C.positions, C.wage_level,
             C.actual, C.label, C.confidence, "CASE_STATUS", "PW_UNIT_OF_PAY", "WAGE_UNIT_OF_PAY"]
    return spark.createDataFrame(rows, names)


def test_guards(spark, observations):
    with pytest.raises(ValueError, match="absent"):
        filters.require_columns(observations, ["absent"])
    with pytest.raises(ValueError, match="at least 3"):
        filters.require_min_models(spark.createDataFrame([("a",), ("b",)], ["m"]), "m", 3)
    with pytest.raises(ValueError, match="240 rows: bad"):
        filters.require_none(observations, {"bad": F.col(C.actual) > 0}, [C.row_id])
    filters.require_none(observations, {"fine": F.col(C.actual) < 0}, [C.row_id])
    with pytest.raises(ValueError, match="unit column"):
        filters.eligibility_steps(observations.drop("PW_UNIT_OF_PAY"))


def test_failed_batch_is_asked_row_by_row(observations):
    prompts = scoring.prompt_table(observations, [""], C)
    out = scoring.with_parsed_answer(scoring.score(prompts, flaky, [C.row_id]), C)
    counts = {r[0]: r[1] for r in out.groupBy(C.status).count().collect()}
    assert counts == {"ok": 200, "inference_error": 40}
    # An error is not a finished row, so it is asked again.
    assert scoring.pending_rows(prompts, out, [C.row_id], C).count() == 40


def test_resume_scores_nothing_twice(spark, observations, tmp_path):
    path = str(tmp_path / "results")
    args = ("qwen-x", ["salary_estimator", ""], scorer, path)
    first = estimate.estimate(observations, *args)
    assert first.count() == 480
    before = spark.read.parquet(path).count()
    again = estimate.estimate(observations.orderBy(F.rand(3)), *args)
    assert spark.read.parquet(path).count() == before == again.count()


def counting(folder, dies_on=None):
    """A scorer that notes each prompt it answers, and may take its run down."""

    def factory():
        def answer(batch):
            for chat in batch:
                if dies_on and dies_on in chat[-1]["content"]:
                    os._exit(3)  # the worker, not the prompt: no answer can be kept
                with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
                    out.write(chat[-1]["content"])
            return ["75000"] * len(batch)

        return answer

    return factory


def test_a_killed_run_keeps_its_chunks(spark, observations, tmp_path):
    asked, path = tmp_path / "asked", str(tmp_path / "results")
    asked.mkdir()
    # In the order of the keys (row ids) the last eighth dies.
    rows = observations.withColumn(C.title, F.when(F.col(C.row_id) >= 210, "Deadly").otherwise(F.concat(C.title, F.lit(" "), C.row_id)))
    with pytest.raises(Exception):
        estimate.estimate(rows, "m", [""], counting(str(asked), "Deadly"), path, chunk_rows=50, tasks=2)
    kept = estimate.read_results(spark, path)
    assert sorted({r["chunk"] for r in kept.select("chunk").collect()}) == [0, 1, 2, 3]
    assert {r[0] for r in kept.select(C.row_id).collect()} == set(range(200))
    once = set(asked.iterdir())
    out = estimate.estimate(observations, "m", [""], counting(str(asked)), path, chunk_rows=7, batch_rows=3, tasks=2)
    assert out.count() == 240 == out.select(C.row_id).distinct().count()
    again = [p.read_text() for p in set(asked.iterdir()) - once]
    assert len(again) == 40  # what no committed chunk held


def test_uncommitted_and_doubled_chunks_do_not_count(spark, tmp_path):
    path, run = str(tmp_path / "ledger"), ledger.new_run()
    assert ledger.read_committed(spark, path) is None
    rows = spark.range(10)
    lost, kept = ledger.write_attempt(rows, path, run, 0), ledger.write_attempt(rows, path, run, 0)
    assert lost != kept and ledger.read_committed(spark, path) is None
    ledger.commit(spark, path, kept)
    assert ledger.read_committed(spark, path).count() == 10
    ledger.commit(spark, path, lost)  # a late driver
    assert ledger.read_committed(spark, path).count() == 10
    assert ledger.append_chunk(rows, path, run, 0) is False and ledger.append_chunk(rows, path, run, 1) is True
    assert ledger.committed_chunks(spark, path, run) == [0, 1]
    assert ledger.read_committed(spark, path).groupBy("chunk").count().count() == 2


@pytest.mark.parametrize("n,bad", [(10_000, [6_543]), (1024, [0]), (1000, [3, 999]), (1, [0]), (5, [])])
def test_failing_batches_are_halved(n, bad):
    calls = []

    def scorer(batch):
        calls.append(len(batch))
        if any(b in batch for b in bad):
            raise ValueError("bad prompt")
        return [str(b) for b in batch]

    out = scoring.ask(scorer, list(range(n)))
    assert [k for k, (_, problem) in enumerate(out) if problem] == bad
    assert all(a == str(k) for k, (a, problem) in enumerate(out) if not problem)
    assert len(calls) <= 1 + len(bad) * 2 * math.ceil(math.log2(max(n, 2)))


def test_batch_size_is_a_parameter(spark, observations):
    sizes = lambda: lambda batch: [str(len(batch))] * len(batch)
    prompts = scoring.prompt_table(observations.coalesce(1), [""], C)
    for size, want in ((100, {"100": 200, "40": 40}), (7, {"7": 238, "2": 2}), (1000, {"240": 240})):
        out = scoring.score(prompts, sizes, [C.row_id], batch_rows=size)
        assert {r["output"]: r["count"] for r in out.groupBy("output").count().collect()} == want


def test_estimate_of_nothing(spark, observations, tmp_path):
    out = estimate.estimate(observations.limit(0), "m", [""], scorer, str(tmp_path / "none"))
    assert out.count() == 0 and {C.row_id, C.estimate, "run_id"} <= set(out.columns)


def test_latest_result_prefers_finished(spark):
    rows = [(1, "ok", 5.0, "r1"), (1, "inference_error", None, "r2"), (2, "inference_error", None, "r1"), (2, "malformed", None, "r2")]
    df = spark.createDataFrame(rows, f"{C.row_id} int, {C.status} string, {C.estimate} double, run_id string")
    got = {r[C.row_id]: r[C.status] for r in scoring.latest_results(df, [C.row_id]).collect()}
    assert got == {1: "ok", 2: "malformed"}


def test_retry_and_versions(spark, observations, tmp_path):
    stored = observations.withColumn(C.estimate, F.when(F.col(C.row_id) % 10 == 0, 5.0).otherwise(F.col(C.actual)))
    target, asked = estimate.correct_estimates(stored, scorer, [C.row_id], str(tmp_path / "v"))
    fixed = spark.read.parquet(target)
    assert fixed.count() == 240 and fixed.where(F.col(C.estimate) < 1000).count() == 0 and asked.count() == 24
    assert writers.write_version(fixed, str(tmp_path / "v")).endswith("v=2")


def test_streamed_run_continues(spark, observations, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    observations.where("ROW_ID < 100").repartition(2).write.parquet(source)
    run = lambda: stream_estimates(
        spark, source, observations.schema, "m", ["salary_estimator"], scorer, out, mark
    ).awaitTermination(120)
    run()
    assert spark.read.parquet(out).count() == 100
    observations.where("ROW_ID >= 100").write.mode("append").parquet(source)
    run()
    result = spark.read.parquet(out)
    assert result.count() == 240 == result.select(C.row_id).distinct().count()


def test_files_to_fifteen_tables(spark, observations, tmp_path):
    for slug, shift in (("Qwen3-8B", 1.05), ("gemma-2", 0.9), ("gemma-3", 0.9)):
        df = observations.drop(C.confidence).withColumn(C.estimate, F.round(F.col(C.actual) * shift + F.col(C.row_id) % 7 * 900))
        if slug != "gemma-3":
            df = df.withColumns({C.status: F.lit("ok"), C.raw: F.lit("one,\nof \"two\"")})
        writers.write_table(df.coalesce(1), str(tmp_path / slug / "llm_estimated_salaries-x"), ("csv",))
    # Spark writes folders; the reader takes the files below them as one layout.
    for folder in glob.glob(str(tmp_path / "*" / "*.csv")):
        part = glob.glob(folder + "/part-*.csv")[0]
        with open(part) as src, open(os.path.join(os.path.dirname(folder), "answers.csv"), "w") as dst:
            dst.write(src.read())
    pred = readers.load_all_predictions(spark, str(tmp_path / "*" / "answers.csv"), 3)
    assert {r[0] for r in pred.select(C.family).distinct().collect()} == {"Qwen", "Gemma"}
    meta = readers.sampled_metadata(observations)
    tables = analysis.analysis_tables(readers.merge_metadata(pred, meta))
    assert len(tables) == 15
    paths = writers.write_tables(tables, str(tmp_path / "out"), ("parquet", "csv"))
    assert len(paths) == 30
    pairs = spark.read.parquet(str(tmp_path / "out" / "identical_prediction_vectors.parquet")).collect()
    assert [(p["model_a"], p["model_b"]) for p in pairs] == [("gemma-2", "gemma-3")]
    info = analysis.run_metadata(tables, seed=1).first()
    assert info["n_models_used"] == 3 and info["n_model_row_records_used"] == 720 and info["n_identical_prediction_vector_pairs"] == 1
    gate = {r[C.model]: r["passed"] for r in quality.output_gate(pred).collect()}
    assert gate["Qwen3-8B"] and gate["gemma-2"]
    bad = pred.withColumn(C.actual, F.lit("12"))
    with pytest.raises(ValueError, match="missing or outside"):
        analysis.analysis_tables(readers.merge_metadata(bad, meta))


def test_sampling_run(spark, observations):
    titles = spark.createDataFrame([(f" ai engineer  t{i}",) for i in range(6)], ["t"])
    out = sample.sample_observations(observations.drop(C.label), titles, 20, seed=1)
    rows = out["sample"].collect()
    assert len(rows) == 20 and sum(r[C.label] for r in rows) == 10
    assert out["unbalanced_blocks"].count() == 0
    funnel = [r["rows_left"] for r in out["funnel"].orderBy("step_no").collect()]
    assert funnel[0] == 240 and funnel[1] == funnel[-1] == 213


def test_comparisons(spark, observations):
    models = [("a", "open"), ("b", "open"), ("c", "closed"), ("d", "closed")]
    dim = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), F.lit(i).alias("i")) for i, (m, k) in enumerate(models)]))
    df = observations.withColumn("x", dim).withColumns(
        {C.model: F.col("x.m"), C.cohort: F.col("x.k"),
         C.estimate: F.col(C.actual) * (1 + F.when(F.col(C.label), 0.03 * F.col("x.i")).otherwise(0.0)) + F.col(C.row_id) % 11 * (100 + F.col("x.i"))}
    ).drop("x")
    cohorts = compare.compare_cohorts(df, n_permutations=50)
    assert cohorts["uplifts"].count() == 4
    assert cohorts["welch"].first()["diff"] == pytest.approx(6.0, abs=0.6)
    assert cohorts["permutation"].first()["n_permutations"] == 50
    models_out = compare.compare_models(df)
    flags = {r[C.model]: r for r in models_out["significance"].collect()}
    assert flags["d"]["welch_one_sided"] and flags["d"]["regression"]
    pooled = compare.compare_pooled(df)
    assert pooled["summary"].count() == 2 and pooled["between"].count() == 2
    assert compare.compare_paired(df).count() == 2


def test_skipped_files_are_reported(spark, observations, tmp_path):
    good = observations.select(C.row_id, C.actual, C.label, F.lit(1.0).alias(C.estimate))
    good.coalesce(1).write.option("header", True).csv(str(tmp_path / "a"))
    observations.select(C.row_id).coalesce(1).write.option("header", True).csv(str(tmp_path / "b"))
    df, skipped = readers.scan_predictions(spark, str(tmp_path / "*" / "part-*.csv"), skip_unusable=True)
    assert df.count() == 240 and len(skipped) == 1
    with pytest.raises(ValueError):
        readers.scan_predictions(spark, str(tmp_path / "*" / "part-*.csv"))


def slice_lengths():
    return lambda texts: [[sum(map(len, texts)), len(t)] for t in texts]


def test_encoders_get_slices(spark):
    rows = [(k, None if k % 50 == 0 else "x" * (k * 97 % 20_000)) for k in range(400)] + [(400, "y" * (scoring.SLICE_CHARS + 5))]
    df = spark.createDataFrame(rows, "k long, text string").coalesce(1)
    got = {r["k"]: r["token_ids"] for r in scoring.token_ids(df, "text", slice_lengths).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: len(t or "") for k, t in rows}
    assert max(v[0] for k, v in got.items() if k != 400) <= scoring.SLICE_CHARS < got[400][0]


def test_encoders_get_slices_of_long_conversations(spark):
    turns = F.expr("transform(sequence(1, 40), t -> struct('user' as role, repeat('word ', 100) as content))")
    df = spark.range(60).coalesce(1).select(messages_to_text(turns).alias("text"))
    got = scoring.token_ids(df, "text", slice_lengths).select("token_ids").collect()
    assert len(got) == 60 and max(r["token_ids"][0] for r in got) <= scoring.SLICE_CHARS


def test_strings_of_one_slice_exist_at_a_time():
    """20 million characters in one batch, of which a slice at a time is made into strings."""
    texts = pa.array([None if k % 7 == 0 else "é" * 5_000 for k in range(4_000)], pa.string())
    tracemalloc.start()
    try:
        sizes = [(len(some), sum(map(len, some))) for some in scoring.text_slices(texts)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(n for n, _ in sizes) == 4_000 and sum(c for _, c in sizes) == len(texts.drop_null()) * 5_000
    assert max(c for _, c in sizes) <= scoring.SLICE_CHARS and peak < 4 << 20


def test_no_texts_give_no_slices():
    assert list(scoring.text_slices(pa.array([], pa.string()))) == []
    assert list(scoring.text_slices(pa.array([None, ""], pa.string()))) == [["", ""]]


def test_texts_of_one_task_are_dealt_before_they_are_sorted(spark):
    title = F.concat(F.lit("t"), F.col("id") % 7)
    prompts = spark.range(0, 700, 1, 1).select("id", chat(F.lit("s"), title).alias("messages"))
    asked = scoring.distinct_chats(prompts.withColumn("__key", F.sha2(F.to_json("messages"), 256)))
    assert asked.count() == 7
    plan = asked._jdf.queryExecution().executedPlan().toString()
    first_sort = plan.rindex("Sort ")  # the deepest line is the last
    assert "REPARTITION_BY_NUM" in plan[first_sort:]
    out = scoring.score_distinct(prompts, scorer, ["id"]).collect()
    assert len(out) == 700 and len({r["output"] for r in out}) == 7


def test_chats_are_read_as_whole_columns(spark):
    rows = [[], [("user", "a", None)], [("system", "b", 1), ("user", None, 2)]]
    kind = pa.list_(pa.struct([("role", pa.string()), ("content", pa.string()), ("n", pa.int64())]))
    column = pa.array([[dict(zip(("role", "content", "n"), m)) for m in ms] for ms in rows], kind)
    want = [[dict(zip(("role", "content", "n"), m)) for m in ms] for ms in rows]
    assert scoring.chats_of(column) == want and scoring.chats_of(column.slice(1, 2)) == want[1:]


def test_chunks_are_planned_without_python(spark, observations, monkeypatch):
    monkeypatch.setattr(ranking, "running_counts", None)
    plans = []
    keep = ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or keep(df, name))
    rows = observations.withColumn("persona", F.lit("")).repartition(5)
    plan, chunks = estimate.planned(rows, ["persona", C.row_id], 100)
    got = [(r["__chunk"], r[C.row_id]) for r in plan.collect()]
    ids = sorted(i for _, i in got)
    assert chunks == 3 and sorted(got) == [(k // 100, i) for k, i in enumerate(ids)]
    assert plans and not any("InArrow" in p or "InPandas" in p for p in plans)


def test_tables_are_written_side_by_side(spark, tmp_path, monkeypatch):
    meet, keep = threading.Barrier(3, timeout=60), writers.write_table

    def write(df, path, formats):
        meet.wait()  # broken where one table waits for another
        return keep(df, path, formats)

    monkeypatch.setattr(writers, "write_table", write)
    tables = {name: spark.range(n) for n, name in enumerate("abc")}
    assert writers.write_tables(tables, str(tmp_path)) == [f"{tmp_path}/{n}.parquet" for n in "abc"]
    assert [spark.read.parquet(f"{tmp_path}/{n}.parquet").count() for n in "abc"] == [0, 1, 2]
    assert writers.write_tables({}, str(tmp_path)) == []
