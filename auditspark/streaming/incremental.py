"""Scoring as a stream: one micro-batch is one chunk, one commit each.

The batch path resumes by an anti-join on finished keys. A stream adds the
query's own checkpoint: input files already committed are not read again.
"""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from ..columns import DEFAULT, AuditColumns
from ..operators.scoring import ScorerFactory, prompt_table, score, with_parsed_answer


def stream_estimates(
    spark: SparkSession,
    source: str,
    schema,
    model: str,
    personas: list[str],
    scorer_factory: ScorerFactory,
    path: str,
    checkpoint: str,
    c: AuditColumns = DEFAULT,
    files_per_chunk: int = 1,
):
    """Score new Parquet files of ``source`` and append to ``path``.

    Runs over everything available and stops; call it again for new files. The
    file sink commits each micro-batch once, so a restart neither loses nor
    doubles rows.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_chunk).parquet(source)
    wanted = prompt_table(rows, personas, c).withColumn(c.model, F.lit(model))
    keys = [c.model, "persona", c.row_id]
    answered = with_parsed_answer(score(wanted, scorer_factory, keys), c).drop("output")
    return (
        answered.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy(c.model)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )

