"""Batch scoring through a plug-in, with resume, retry and token statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..columns import DEFAULT, AuditColumns
from ..functions.parse import COMPLETED, INFERENCE_ERROR, parse_answer, parse_digits
from ..functions.prompts import chat, persona_system, salary_user
from ..session import materialize, shuffle_width
from .filters import unreasonable
from .joins import lookup_join, upsert

# A scorer maps a batch of chats to one answer text each. A factory builds it
# once per task, so that clients and models load on the executor.
Scorer = Callable[[list[list[dict]]], list[str]]
ScorerFactory = Callable[[], Scorer]

#: Characters of the texts that a token encoder gets at a time.
SLICE_CHARS = 1 << 18


def prompt_table(df: DataFrame, personas: list[str], c: AuditColumns = DEFAULT) -> DataFrame:
    """Rows times personas, each with its chat; a literal array, so no join."""
    return with_messages(with_personas(df, personas), c)


def with_personas(df: DataFrame, personas: list[str]) -> DataFrame:
    return df.withColumn("persona", F.explode(F.array(*[F.lit(p) for p in personas])))


def with_messages(df: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    return df.withColumn("messages", chat(persona_system(F.col("persona")), salary_user(c)))


def ask(scorer: Scorer, chats: list[list[dict]]) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each chat.  A failing batch is halved until the bad chats
    stand alone, so one among n costs at most 2 log2(n) + 1 further calls."""
    try:
        answers = list(scorer(chats))
        if len(answers) != len(chats):
            raise ValueError(f"{len(answers)} answers for {len(chats)} prompts")
        return [(a, None) for a in answers]
    except Exception as problem:
        if len(chats) == 1:
            return [(None, f"{type(problem).__name__}: {problem}")]
    middle = len(chats) // 2
    return ask(scorer, chats[:middle]) + ask(scorer, chats[middle:])


def rebatched(batches: Iterator[pa.RecordBatch], size: int | None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``size`` (the last may be smaller), whatever the
    session's own batches are."""
    held, n = [], 0
    for batch in batches:
        if not size:
            yield batch
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            whole = pa.concat_batches(held)
            cut = n - n % size
            for a in range(0, cut, size):
                yield whole.slice(a, size)
            held, n = [whole.slice(cut)], n - cut
    if n:
        yield pa.concat_batches(held)


def chats_of(column: pa.Array) -> list[list[dict]]:
    """The chats of a column of message lists, its fields read as whole columns."""
    flat = column.flatten()
    if column.null_count or flat.null_count or not pa.types.is_struct(flat.type):
        return [[dict(m) for m in ms] for ms in column.to_pylist()]
    names = [f.name for f in flat.type]
    fields = [flat.field(i).to_pylist() for i in range(len(names))]
    messages = [dict(zip(names, values)) for values in zip(*fields)]
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    return [messages[a:b] for a, b in zip([0, *ends], ends)]


def score(
    prompts: DataFrame,
    scorer_factory: ScorerFactory,
    keep: list[str],
    messages: str = "messages",
    output: str = "output",
    batch_rows: int | None = None,
) -> DataFrame:
    """Add ``output`` and ``error`` to the ``keep`` columns of each prompt.

    A scorer gets ``batch_rows`` prompts at a time (absent: as many as the session's
    ``spark.sql.execution.arrow.maxRecordsPerBatch``).  A failing batch is halved, so
    a bad prompt costs only its own row; its reason goes to ``error`` and
    ``output`` stays null.
    """
    wanted = [prompts.schema[k] for k in keep]
    schema = T.StructType(
        [*wanted, T.StructField(output, T.StringType()), T.StructField("error", T.StringType())]
    )

    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_factory()
        for batch in rebatched(batches, batch_rows):
            pairs = ask(scorer, chats_of(batch.column(messages)))
            answers = [pa.array([None if v is None else str(v) for v in column], pa.string()) for column in zip(*pairs)]
            if pairs:
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], *answers], names=names)

    return prompts.select(*dict.fromkeys([*keep, messages])).mapInArrow(run, schema)


def score_distinct(
    prompts: DataFrame, scorer_factory: ScorerFactory, keep: list[str], messages: str = "messages"
) -> DataFrame:
    """Score each distinct chat once and hand the answer to all its rows.

    Rows and answers meet on a SHA-256 of the chat. The answer side is as large as
    the distinct prompts and a popular prompt may cover many rows: the lookup join
    salts it.
    """
    keyed = prompts.withColumn("__key", F.sha2(F.to_json(messages), 256))
    # Stored, so that a model is asked once whatever reads the answers.
    answered = materialize(score(distinct_chats(keyed, messages), scorer_factory, ["__key"], messages), "answers")
    return lookup_join(keyed.select(*keep, "__key"), answered, ["__key"], "left", keep).drop("__key")


def distinct_chats(keyed: DataFrame, messages: str = "messages") -> DataFrame:
    """One row for each ``__key``. The long texts are sorted to be combined, so they
    are dealt evenly first: a small file that few tasks read may render to many
    gigabytes of chats. Copies are combined again before they meet by key."""
    width = shuffle_width(keyed.sparkSession)
    dealt = keyed.select("__key", messages).repartition(width, F.monotonically_increasing_id())
    return dealt.groupBy("__key").agg(F.first(messages).alias(messages))


def with_parsed_answer(df: DataFrame, c: AuditColumns = DEFAULT, output: str = "output") -> DataFrame:
    """Raw text, parsed number and status; a scoring error has its own status."""
    failed = F.col("error").isNotNull() if "error" in df.columns else F.lit(False)
    parsed = df.withColumn("__p", parse_answer(F.col(output)))
    return parsed.withColumns(
        {
            c.raw: F.col(output),
            c.estimate: F.when(~failed, F.col("__p.value")),
            c.status: F.when(failed, INFERENCE_ERROR).otherwise(F.col("__p.status")),
        }
    ).drop("__p")


def completed(df: DataFrame, c: AuditColumns = DEFAULT) -> Column:
    """Whether a stored row is finished. Tables without a status column count a
    stored number as finished."""
    if c.status in df.columns:
        return F.coalesce(F.col(c.status).isin(*COMPLETED), F.lit(False))
    return F.col(c.estimate).isNotNull()


def pending_rows(requested: DataFrame, stored: DataFrame, keys: list[str], c: AuditColumns = DEFAULT) -> DataFrame:
    """Requested rows without a finished result, matched by key."""
    done = stored.where(completed(stored, c)).select(*keys)
    return requested.join(done, keys, "left_anti")


def latest_results(stored: DataFrame, keys: list[str], run: str = "run_id", c: AuditColumns = DEFAULT) -> DataFrame:
    """One stored result per key: a finished one wins, then the latest run."""
    rest = [x for x in stored.columns if x not in keys]
    order = F.struct(completed(stored, c).alias("done"), F.col(run).alias("run"))
    picked = stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return picked.select(*keys, "__row.*").select(*stored.columns)


def retry_unreasonable(
    df: DataFrame,
    scorer_factory: ScorerFactory,
    keys: list[str],
    c: AuditColumns = DEFAULT,
    persona: str = "",
    low: float = 1000.0,
    high: float = 10_000_000.0,
    pct: float = 500.0,
    legacy_parse: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Ask again for unreasonable estimates; returns (whole table, re-scored rows)."""
    bad = df.where(unreasonable(F.col(c.estimate), F.col(c.actual), low, high, pct))
    prompts = bad.withColumn("messages", chat(persona_system(F.lit(persona)), salary_user(c)))
    # Stored: the model must be asked once although two results read this.
    answered = with_parsed_answer(materialize(score(prompts, scorer_factory, [*keys, c.actual]), "answers"), c)
    if legacy_parse:
        answered = answered.withColumn(c.estimate, parse_digits(F.col(c.raw)))
    dtype = df.schema[c.estimate].dataType
    answered = answered.withColumn(c.estimate, F.col(c.estimate).cast(dtype)).withColumn(
        "still_unreasonable",
        F.col(c.estimate).isNull() | unreasonable(F.col(c.estimate), F.col(c.actual), low, high, pct),
    )
    changed = [x for x in (c.estimate, c.status, c.raw) if x in df.columns]
    return upsert(df, answered, keys, changed), answered


def simple_tokens(text: Column) -> Column:
    """Default tokens: runs of letters and digits, and single other characters."""
    word = r"\p{L}\p{M}\p{N}_"
    return F.regexp_extract_all(text, F.lit(rf"([{word}]+|[^\s{word}])"), 1)


def text_slices(texts: pa.Array, most: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Neighbouring texts (null: empty) of at most ``most`` characters together, or one
    longer text.  Only the texts of one slice are made into Python strings."""
    start, size = 0, 0
    for at, chars in enumerate(pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False).tolist()):
        if at > start and size + chars > most:
            yield [t or "" for t in texts.slice(start, at - start).to_pylist()]
            start, size = at, 0
        size += chars
    if len(texts) > start:
        yield [t or "" for t in texts.slice(start).to_pylist()]


def token_ids(df: DataFrame, text: str, encoder_factory: Callable[[], Callable[[list[str]], list[list[int]]]]) -> DataFrame:
    """Add ``token_ids`` from a plug-in encoder built once per task.  It gets slices of a
    batch, so the strings and ids of few texts exist at a time whatever the session's batches are."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_factory()
        for texts in batches:
            for some in text_slices(texts):
                yield pa.array(encoder(some), pa.list_(pa.int64()))

    return df.withColumn("token_ids", encode(F.col(text)))


def token_summary(lengths: DataFrame, token_len: str = "token_len") -> DataFrame:
    """Count, mean, median, maximum and 95th percentile of token lengths.

    Lengths are counted first, so the exact percentiles see one row per
    distinct length, which is bounded by the longest text.
    """
    counts = lengths.groupBy(token_len).agg(F.count(F.lit(1)).alias("n"))
    value, weight = F.col(token_len), F.col("n")
    return counts.agg(
        F.sum("n").alias("n_texts"),
        F.try_divide(F.sum(value * weight), F.sum(weight)).alias("mean_tokens"),
        F.percentile(value, F.lit(0.5), weight).alias("median_tokens"),
        F.max(value).cast("bigint").alias("max_tokens"),
        F.percentile(value, F.lit(0.95), weight).alias("p95_tokens"),
    )
