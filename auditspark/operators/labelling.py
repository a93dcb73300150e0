"""Labelling titles and grouping rows into blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import DEFAULT, AuditColumns
from ..functions.prompts import title_messages
from ..functions.text import norm_title, sampling_block, strip
from .joins import lookup_join
from .scoring import score

# Whole words and phrases that make a title an AI title (fixed values).
AI_TERMS = (
    r"ai",
    r"a\.i\.?",
    r"artificial\s+intelligence",
    r"ml",
    r"machine\s+learning",
    r"deep\s+learning",
    r"dl",
    r"neural\s+networks?",
    r"llms?",
    r"large\s+language\s+models?",
    r"generative\s+ai",
    r"genai",
    r"foundation\s+models?",
    r"mlops",
    r"aiops",
    r"prompt\s+engineer(?:ing)?",
    r"chatbot\s+(?:developer|engineer)",
    r"conversational\s+ai\s+engineer",
)


def keyword_label(title: Column, terms: tuple[str, ...] = AI_TERMS) -> Column:
    """True when a term occurs as a whole word; null titles are false."""
    pattern = r"(?i)(?:^|[^a-z0-9_])(?:" + "|".join(terms) + r")(?:$|[^a-z0-9_])"
    return F.coalesce(title.rlike(pattern), F.lit(False))


def label_by_titles(
    df: DataFrame, ai_titles: DataFrame, c: AuditColumns = DEFAULT, label: str = "IS_AI", limit: int | None = None
) -> DataFrame:
    """Flag rows whose normalised title is in ``ai_titles`` (one column, distinct).

    A common title is salted by the lookup join, so it never fills one task.
    """
    listed = ai_titles.select(norm_title(F.col(ai_titles.columns[0])).alias("__title")).where(
        F.col("__title") != ""
    )
    listed = listed.distinct().withColumn("__listed", F.lit(True))
    keyed = df.withColumn("__title", norm_title(F.col(c.title)))
    joined = lookup_join(keyed, listed, ["__title"], "left", [c.row_id], limit)
    return joined.withColumn(label, F.coalesce("__listed", F.lit(False))).drop("__title", "__listed")


def classify_titles(titles: DataFrame, scorer_factory, title: str = "job_title") -> DataFrame:
    """One model question for each distinct title; only an exact Yes counts."""
    asked = titles.select(title).dropna().distinct().withColumn("messages", title_messages(F.col(title)))
    answered = score(asked, scorer_factory, [title])
    return answered.select(title, F.coalesce(strip(F.col("output")) == "Yes", F.lit(False)).alias("AI_job"), "error")


def with_block(df: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    parts = [F.col(n) for n in (c.soc_code, c.state, c.naics, c.full_time, c.wage_level)]
    return df.withColumn(c.block, sampling_block(*parts))


def block_counts(df: DataFrame, c: AuditColumns = DEFAULT) -> DataFrame:
    return df.groupBy(c.block).agg(
        F.count_if(F.col(c.label)).alias("n_ai"), F.count_if(~F.col(c.label)).alias("n_other")
    )


def eligible_blocks(counts: DataFrame, min_ai: int = 1, min_other: int = 1) -> DataFrame:
    """Blocks holding both groups, with the balanced capacity."""
    low_ai, low_other = max(min_ai, 1), max(min_other, 1)
    return counts.where((F.col("n_ai") >= low_ai) & (F.col("n_other") >= low_other)).withColumn(
        "capacity", F.least("n_ai", "n_other")
    )
