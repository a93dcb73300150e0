"""Column names of an audit table, so that every operator takes one mapping."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AuditColumns:
    """Names used by the operators. The defaults are the disclosure file's."""

    row_id: str = "ROW_ID"
    title: str = "JOB_TITLE"
    soc_code: str = "SOC_CODE"
    soc_title: str = "SOC_TITLE"
    city: str = "WORKSITE_CITY"
    state: str = "WORKSITE_STATE"
    naics: str = "NAICS_CODE"
    full_time: str = "FULL_TIME_POSITION"
    positions: str = "TOTAL_WORKER_POSITIONS"
    wage_level: str = "PW_WAGE_LEVEL"
    actual: str = "PREVAILING_WAGE"
    estimate: str = "estimated_salary_in_usd"
    status: str = "salary_parse_status"
    raw: str = "salary_raw_output"
    label: str = "IS_AI"
    confidence: str = "ai_confidence"
    job_key: str = "JOB_CONTEXT_KEY"
    block: str = "BLOCK_ID"
    model: str = "model_slug"
    family: str = "model_family"
    cohort: str = "cohort"
    source: str = "source_prediction_file"


DEFAULT = AuditColumns()

# Names of the derived metric columns (fixed values: they are the output schema).
DIFF_USD = "predicted_minus_actual_usd"
PCT_POINTS = "overestimation_pct_points"
RATIO = "prediction_to_actual_ratio"
LOG_RATIO = "log_prediction_minus_log_actual"
IS_AI = "is_ai_binary"
MEAN_PCT = "mean_overestimation_pct_points"
MEAN_USD = "mean_overestimation_usd"
DELTA_PCT = "delta_pct_points_ai_minus_other"
DELTA_USD = "delta_usd_ai_minus_other"
