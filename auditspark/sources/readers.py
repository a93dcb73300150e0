"""Readers for label lists, predictions, scores and sampled observations."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from ..columns import DEFAULT, AuditColumns
from ..functions.numeric import clip, to_number
from ..functions.parse import OK_LEGACY
from ..functions.text import (
    TRUTHY_LABEL_FILE, analysis_block, job_key, model_family, norm_title, slug_from_path, strip, truthy,
)
from ..operators.filters import require_columns, require_empty, require_min_models
from ..operators.joins import first_per_key, left_join_renamed, lookup_join
from ..operators.quality import duplicate_rows
from .split_csv import read_split_csv

CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet or CSV by suffix. CSV columns are strings unless a schema is given.

    Spark does not split a CSV file that may hold quoted line breaks; read large
    ones through ``split_csv.read_split_csv``, which does.
    """
    if path.rstrip("/*").lower().endswith(".parquet"):
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    return read_csv(spark, path, schema)


def read_csv(spark: SparkSession, path: str, schema=None, multi_line: bool = True) -> DataFrame:
    reader = spark.read.options(**{**CSV_OPTIONS, "multiLine": multi_line})
    return (reader.schema(schema) if schema else reader).csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One stripped title per line; every line counts."""
    return spark.read.text(path).select(strip(F.col("value")).alias("job_title"))


def read_title_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct normalised titles of a text file without blank and ``#`` lines."""
    lines = read_lines(spark, path).where(~F.col("job_title").rlike(r"\A(#|\z)"))
    return _titles(lines, F.col("job_title"))


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    """Distinct normalised titles whose ``AI_job`` is true."""
    df = require_columns(read_csv(spark, path), ["AI_job", "job_title"], path)
    return _titles(df.where(truthy(F.col("AI_job"), TRUTHY_LABEL_FILE)), F.col("job_title"))


def _titles(df: DataFrame, title: Column) -> DataFrame:
    return df.select(norm_title(title).alias("title")).where(F.col("title") != "").distinct()


def read_ai_titles(spark: SparkSession, path: str) -> DataFrame:
    low = path.lower()
    if low.endswith(".txt"):
        return read_title_list(spark, path)
    if low.endswith(".csv"):
        return read_label_csv(spark, path)
    raise ValueError(f"unsupported title list: {path} (use .txt or .csv)")


def distinct_titles(df: DataFrame, title: str = DEFAULT.title) -> DataFrame:
    return df.select(F.col(title).alias("job_title")).dropna().distinct()


def with_row_id(df: DataFrame, row_id: str = DEFAULT.row_id) -> DataFrame:
    """Number the rows of a file scan in file order where it has no row id.

    Spark's own increasing id holds (partition, position); the rows before each
    partition turn it into a dense number. The table of partitions is as long as
    the scan has tasks, which bounds the broadcast. Store the result before
    using the ids as keys.
    """
    if row_id in df.columns:
        return df
    placed = df.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.join(F.broadcast(starts), "__part").withColumn(row_id, F.col("__start") + within)
    return numbered.select(row_id, *df.columns)


def required_prediction_columns(c: AuditColumns = DEFAULT) -> list[str]:
    return [c.row_id, c.actual, c.estimate, c.label]


def plain_path(uri: Column) -> Column:
    """A file's path as it was written, from its escaped URI."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def tag_predictions(df: DataFrame, path: Column, c: AuditColumns = DEFAULT) -> DataFrame:
    """Add model, family and source, and fill the columns old files lack."""
    df = df.withColumn(c.source, path).withColumn(c.model, slug_from_path(F.col(c.source)))
    df = df.withColumn(c.family, model_family(F.col(c.model)))
    if c.status not in df.columns:
        df = df.withColumn(c.status, F.when(F.col(c.estimate).isNotNull(), OK_LEGACY))
    if c.raw not in df.columns:
        df = df.withColumn(c.raw, F.lit(None).cast("string"))
    return df


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    """Files matched by a glob, through the cluster's file system."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found) if found else []


def scan_predictions(
    spark: SparkSession, pattern: str, c: AuditColumns = DEFAULT, skip_unusable: bool = False, split_files: bool = False
) -> tuple[DataFrame, list[str]]:
    """All matching per-model files as one long table, and the files skipped.

    Only headers are looked at to group files by layout: one scan per layout,
    not per file, and the model comes from the file's own path. ``split_files``
    reads large CSV files by many tasks each, for one shuffle of their lines.
    """
    paths = _matches(spark, pattern)
    if not paths:
        raise FileNotFoundError(f"no prediction files match {pattern}")
    layouts: dict[tuple[str, ...], list[str]] = {}
    skipped: list[str] = []
    for path in paths:
        try:
            names = tuple(read_table(spark, path).columns)
            missing = set(required_prediction_columns(c)) - set(names)
            if missing:
                raise ValueError(f"{path} is missing required columns: {sorted(missing)}")
            layouts.setdefault(names, []).append(path)
        except (ValueError, AnalysisException, ParseException):  # no access or network errors
            if not skip_unusable:
                raise
            skipped.append(path)
    if not layouts:
        raise ValueError(f"no usable prediction file among {paths}")
    parts = []
    for names, files in layouts.items():
        if files[0].lower().endswith(".parquet"):
            df = spark.read.parquet(*files).withColumn("__path", F.col("_metadata.file_path"))
        elif split_files:
            strings = T.StructType([T.StructField(name, T.StringType()) for name in names])
            df = read_split_csv(spark, files, strings, file_column="__path")
        else:
            df = spark.read.options(**CSV_OPTIONS).csv(files).withColumn("__path", F.col("_metadata.file_path"))
        parts.append(tag_predictions(df.withColumn("__path", plain_path(F.col("__path"))), F.col("__path"), c).drop("__path"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out, skipped


def load_all_predictions(spark: SparkSession, pattern: str, min_models: int = 1, c: AuditColumns = DEFAULT) -> DataFrame:
    """The long table, guarded against too few models and duplicate rows."""
    df, _ = scan_predictions(spark, pattern, c)
    require_min_models(df, c.model, min_models)
    require_empty(duplicate_rows(df, [c.model, c.row_id]), "duplicate model/row records")
    return df


def find_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate present, ignoring case."""
    present = {name.lower(): name for name in df.columns}
    return next((present[x.lower()] for x in candidates if x.lower() in present), None)


def score_table(df: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    """One confidence per job key, from a key column or from title and codes.

    Of several scores for one key the largest is kept (any fixed rule would do;
    file order does not exist here).
    """
    require_columns(df, [c.confidence], "score table")
    key_name = find_column(df, ["job_key", c.job_key, "JOB_CONTEXT_KEY"])
    if key_name:
        key = F.col(key_name)
    else:
        title = find_column(df, [c.title, "job_title", "title"])
        code = find_column(df, [c.soc_code, "soc_code"])
        name = find_column(df, [c.soc_title, "soc_title"])
        if not (title and code and name):
            raise ValueError("the score table needs a job key, or title and code columns")
        key = job_key(F.col(title), F.col(code), F.col(name))
    return df.select(key.alias(c.job_key), to_number(F.col(c.confidence)).alias(c.confidence)).groupBy(c.job_key).agg(
        F.max(c.confidence).alias(c.confidence)
    )


def sampled_metadata(
    df: DataFrame, scores: DataFrame | None = None, c: AuditColumns = DEFAULT, check: bool = True
) -> DataFrame:
    """Key, block and confidence of each sampled row, derived where absent."""
    require_columns(df, [c.row_id, c.title, c.soc_code, c.soc_title], "sampled input")
    if c.job_key not in df.columns:
        df = df.withColumn(c.job_key, job_key(F.col(c.title), F.col(c.soc_code), F.col(c.soc_title)))
    if c.block not in df.columns:
        parts = [c.soc_code, c.state, c.naics, c.full_time, c.wage_level]
        df = df.withColumn(c.block, analysis_block(*[F.col(p) for p in parts]))
    if c.confidence not in df.columns:
        if scores is None:
            raise ValueError(f"no {c.confidence} column and no score table")
        df = lookup_join(df, scores, [c.job_key], "left", [c.row_id])
    df = df.withColumn(c.confidence, to_number(F.col(c.confidence)))
    wanted = [c.row_id, c.job_key, c.block, c.confidence, c.wage_level, c.city, "QWEN_AI_GROUP", "EMPLOYER_NAME"]
    out = first_per_key(
        df.select(*[w for w in wanted if w in df.columns]), [c.row_id], [c.job_key, c.block, c.confidence]
    )
    if check:
        require_empty(out.where(F.col(c.confidence).isNull()), f"missing {c.confidence} for sampled rows")
    return out


def merge_metadata(pred: DataFrame, meta: DataFrame, c: AuditColumns = DEFAULT, check: bool = True) -> DataFrame:
    """Attach metadata to predictions by typed row id; nothing may be missing."""
    keyed = pred.withColumn(c.row_id, F.col(c.row_id).cast("bigint"))
    meta = meta.withColumn(c.row_id, F.col(c.row_id).cast("bigint"))
    out = left_join_renamed(keyed, meta, c.row_id)
    if check:
        gaps = out.where(F.col(c.job_key).isNull() | F.col(c.block).isNull() | F.col(c.confidence).isNull())
        require_empty(gaps.select(c.model, c.row_id), "model rows without metadata")
    return out.withColumn(c.confidence, clip(F.col(c.confidence), 0.0, 1.0))
