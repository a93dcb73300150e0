"""Resumable scoring runs, retries, title labels and token statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..columns import DEFAULT, AuditColumns
from ..functions.prompts import messages_to_text, title_messages
from ..operators.filters import require_columns
from ..operators.scoring import (
    ScorerFactory, latest_results, pending_rows, retry_unreasonable, score, simple_tokens, token_ids, token_summary,
    with_messages, with_parsed_answer, with_personas,
)
from ..sources.readers import distinct_titles
from ..operators.ranking import row_places
from ..session import scratch_path, shuffle_width
from ..sources.ledger import append_chunk, new_run, read_committed
from ..sources.writers import write_version

# Columns of a stored estimate besides keys and answers.
def carried_columns(c: AuditColumns = DEFAULT) -> list[str]:
    return [
        c.title, c.soc_code, c.soc_title, c.state, c.naics, c.full_time, c.positions, c.actual, c.label,
    ]


def prompt_columns(c: AuditColumns = DEFAULT) -> list[str]:
    return [
        c.title, c.soc_code, c.soc_title, c.full_time, c.positions, c.city, c.state, c.naics, c.wage_level,
    ]


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """What the committed chunks of all runs hold; None where nothing is stored."""
    return read_committed(spark, path)


def planned(todo: DataFrame, keys: list[str], chunk_rows: int) -> tuple[DataFrame, int]:
    """The rows to score with their chunk, stored, and the number of chunks.  Chunks are
    ``chunk_rows`` rows in the order of the keys, the last one what is left."""
    placed = row_places(todo, keys)
    chunk = F.floor(F.col("__below") / chunk_rows).cast("long")
    stored = scratch_path(todo.sparkSession, "chunks")
    placed.withColumn("__chunk", chunk).drop("__below").write.partitionBy("__chunk").parquet(stored)
    plan = todo.sparkSession.read.schema(todo.schema.add("__chunk", "long")).parquet(stored)
    return plan, (plan.agg(F.max("__chunk")).first()[0] if not plan.isEmpty() else -1) + 1


def estimate(
    rows: DataFrame,
    model: str,
    personas: list[str],
    scorer_factory: ScorerFactory,
    path: str,
    c: AuditColumns = DEFAULT,
    chunk_rows: int = 100_000,
    batch_rows: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Score what is not finished yet, chunk by chunk, and return all results.

    A chunk is ``chunk_rows`` prompts, scored by ``tasks`` tasks in batches of
    ``batch_rows`` and committed when it is whole: a run that dies keeps the chunks
    before, and the next run asks only for what no committed chunk has finished.
    Running again scores nothing.  ``rows`` must not hold a key twice.
    """
    require_columns(rows, [c.row_id, *prompt_columns(c)], "rows to score")
    spark = rows.sparkSession
    keys = [c.model, "persona", c.row_id]
    wanted = with_personas(rows, personas).withColumn(c.model, F.lit(model))
    stored = read_results(spark, path)
    todo = wanted if stored is None else pending_rows(wanted, stored, keys, c)
    carried = [x for x in carried_columns(c) if x in rows.columns]
    plan, chunks = planned(todo, keys, chunk_rows)
    run, width = new_run(), tasks or shuffle_width(spark)
    for chunk in range(chunks):
        # Finished rows are gone and prompts are not yet written out: little is shuffled.
        part = plan.where(F.col("__chunk") == chunk).drop("__chunk").repartition(width, *keys)
        answered = score(with_messages(part, c), scorer_factory, [*keys, *carried], batch_rows=batch_rows)
        append_chunk(with_parsed_answer(answered, c).drop("output"), path, run, chunk)
    found = read_results(spark, path)
    if found is None:  # nothing was asked for
        empty = score(with_messages(wanted.limit(0), c), scorer_factory, [*keys, *carried])
        return with_parsed_answer(empty, c).drop("output").withColumns({"run_id": F.lit(""), "chunk": F.lit(0)})
    return latest_results(found, keys, c=c)


def correct_estimates(
    results: DataFrame, scorer_factory: ScorerFactory, keys: list[str], folder: str, c: AuditColumns = DEFAULT, **limits
) -> tuple[str, DataFrame]:
    """Ask again for unreasonable estimates and store the corrected version."""
    corrected, asked = retry_unreasonable(results, scorer_factory, keys, c, **limits)
    return write_version(corrected, folder), asked


def title_token_lengths(df: DataFrame, title: str = DEFAULT.title, encoder_factory=None) -> tuple[DataFrame, DataFrame]:
    """Token lengths of the classification prompt of each distinct title, and
    their summary. Without an encoder the default word tokens are counted."""
    texts = distinct_titles(df, title).withColumn("text", messages_to_text(title_messages(F.col("job_title"))))
    if encoder_factory is None:
        lengths = texts.withColumn("token_len", F.size(simple_tokens(F.col("text"))).cast("bigint"))
    else:
        lengths = token_ids(texts, "text", encoder_factory).withColumn("token_len", F.size("token_ids").cast("bigint"))
    lengths = lengths.drop("text")
    return lengths, token_summary(lengths)
