"""Strict parsing of free-text answers into one number and a status code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

# Status codes that count as a finished answer (fixed values).
COMPLETED = (
    "ok",
    "empty",
    "no_number",
    "multiple_numbers_or_range",
    "non_integer_number",
    "out_of_plausible_range",
    "malformed",
)
OK_LEGACY = "ok_legacy_missing_parse_status"
# Status codes whose number enters the analysis (fixed values).
PARSE_OK = ("ok", OK_LEGACY)
INFERENCE_ERROR = "inference_error"
LOW, HIGH = 20_000, 1_000_000

# Patterns that define what an answer may look like (fixed values).
WHOLE_ANSWER = r"\A\s*\$?\s*\d[\d,]*(?:\.0+)?\s*(?:USD|usd|dollars|Dollars)?\s*\z"
ONE_NUMBER = r"\$?\s*\d[\d,]*(?:\.\d+)?"
RANGES = (
    r"\d[\d,]*(?:\.\d+)?\s*[-–—]\s*\$?\s*\d",
    r"\d[\d,]*(?:\.\d+)?\s+(?:to|or|and)\s+\$?\s*\d",
    r"between\s+\$?\s*\d",
    r"range",
)


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Column arithmetic is substituted, not stored: without the binding, every
    regular expression below would carry its own copy of the answer expression.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _reject_status(raw: Column) -> Column:
    """Why a text that is not a whole answer is refused; first rule wins."""
    return _bind(
        strip(raw),
        lambda text: F.when(text == "", "empty")
        .when(text.rlike("(?iuU)" + "|".join(RANGES)), "multiple_numbers_or_range")
        .otherwise(
            _bind(
                F.regexp_count(text, F.lit("(?U)" + ONE_NUMBER)),
                lambda n: F.when(n == 0, "no_number").when(n > 1, "multiple_numbers_or_range").otherwise("malformed"),
            )
        ),
    )


def parse_answer(raw: Column, low: int = LOW, high: int = HIGH) -> Column:
    """Struct (value double, status string) of one raw answer.

    A whole answer is tested first: it excludes every reject rule and is the
    usual case, so most rows cost one match and one replacement.
    """

    def accept(number: Column) -> Column:
        inside = F.coalesce(number.between(float(low), float(high)), F.lit(False))
        return F.struct(
            F.when(inside, number).alias("value"),
            F.when(inside, "ok").otherwise("out_of_plausible_range").alias("status"),
        )

    def refuse(text: Column) -> Column:
        return F.struct(F.lit(None).cast("double").alias("value"), _reject_status(text).alias("status"))

    return _bind(
        F.coalesce(raw.cast("string"), F.lit("")),
        lambda text: F.when(
            text.rlike("(?U)" + WHOLE_ANSWER),
            _bind(F.regexp_replace(text, "[^0-9.]", "").try_cast("double"), accept),
        ).otherwise(refuse(text)),
    )


def parse_digits(raw: Column) -> Column:
    """Older rule: join all digits, 0 when there are none."""
    digits = F.regexp_replace(F.coalesce(raw.cast("string"), F.lit("")), r"(?U)\D", "")
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))
