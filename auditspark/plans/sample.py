"""From raw observations to a block-balanced sample."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..columns import DEFAULT, AuditColumns
from ..operators.filters import apply_steps, eligibility_steps, filter_funnel, require_columns
from ..operators.labelling import label_by_titles, with_block
from ..operators.sampling import balanced_sample, shuffled, unbalanced_blocks
from ..session import materialize


def eligible_rows(raw: DataFrame, ai_titles: DataFrame, c: AuditColumns = DEFAULT, **filters) -> DataFrame:
    """Filtered, labelled rows with their block."""
    require_columns(raw, [c.row_id, c.title, c.soc_code, c.state, c.naics, c.full_time, c.wage_level], "observations")
    steps = eligibility_steps(raw, level_col=c.wage_level, **filters)
    return with_block(label_by_titles(apply_steps(raw, steps), ai_titles, c, c.label), c)


def sample_observations(
    raw: DataFrame,
    ai_titles: DataFrame,
    target_total: int = 1000,
    seed: int = 0,
    mode: str = "inverse_sqrt",
    max_per_block: int = 0,
    min_ai: int = 1,
    min_other: int = 1,
    allow_short: bool = False,
    c: AuditColumns = DEFAULT,
    **filters,
) -> dict[str, DataFrame]:
    """The sample in random order, the filter funnel and the balance audit."""
    steps = eligibility_steps(raw, level_col=c.wage_level, **filters)
    rows = materialize(eligible_rows(raw, ai_titles, c, **filters), "eligible")
    sample = balanced_sample(rows, target_total, seed, mode, max_per_block, min_ai, min_other, allow_short, c)
    sample = materialize(sample, "sample")
    return {
        "sample": shuffled(sample, seed, c.row_id),
        "funnel": filter_funnel(raw, steps),
        "unbalanced_blocks": unbalanced_blocks(sample, c),
    }
