"""String and flag normalisers. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted spellings of "true" (fixed values). The sets differ by use.
TRUTHY_LABEL_FILE = ("true", "1", "yes", "y", "t")
TRUTHY_ANALYSIS = ("true", "1", "yes", "y", "ai")
TRUTHY_COMPARE = ("true", "1", "yes", "y")

# Model families in match order (fixed values).
FAMILY_RULES = (
    ("Qwen", ("qwen",)),
    ("Llama", ("llama", "meta")),
    ("Mistral", ("mistral",)),
    ("Granite", ("granite", "ibm")),
    ("Falcon", ("falcon",)),
    ("Olmo", ("olmo", "allenai")),
    ("Gemma", ("gemma",)),
)

UNKNOWN = "UNK"


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(c.cast("string"), r"(?U)\A\s+|\s+\z", "")


def norm_text(c: Column) -> Column:
    """Strip and collapse white space; null becomes the empty string."""
    return F.coalesce(F.regexp_replace(strip(c), r"(?U)\s+", " "), F.lit(""))


def norm_title(c: Column) -> Column:
    return F.lower(norm_text(c))


def truthy(c: Column, accepted: tuple[str, ...] = TRUTHY_COMPARE) -> Column:
    """True for an accepted spelling, false for anything else, null included."""
    return F.coalesce(F.lower(strip(c)).isin(*accepted), F.lit(False))


def naics2(c: Column, missing: str = UNKNOWN) -> Column:
    """The first two consecutive digits."""
    found = F.regexp_extract(c.cast("string"), r"(?U)(\d{2})", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(missing))


def clean_naics2(c: Column) -> Column:
    """The first two digits once everything else is dropped."""
    return F.substring(F.regexp_replace(norm_text(c), r"(?U)\D", ""), 1, 2)


def fill_unknown(c: Column, unknown: str = UNKNOWN) -> Column:
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(unknown))


def same_unit(c: Column, value: str = "Year") -> Column:
    """Case-insensitive equality after stripping; false for null."""
    return F.coalesce(F.lower(strip(c)) == F.lit(value.strip().lower()), F.lit(False))


def job_key(title: Column, soc_code: Column, soc_title: Column) -> Column:
    return F.concat_ws(" || ", norm_text(title), norm_text(soc_code), norm_text(soc_title))


def analysis_block(soc: Column, state: Column, naics: Column, full_time: Column, level: Column) -> Column:
    """Block id of the analysis side: missing parts stay empty."""
    return F.concat_ws(
        "||", norm_text(soc), norm_text(state), clean_naics2(naics), norm_text(full_time), norm_text(level)
    )


def sampling_block(soc: Column, state: Column, naics: Column, full_time: Column, level: Column) -> Column:
    """Block id of the sampler: missing parts become ``UNK``."""
    return F.concat_ws(
        "||", fill_unknown(soc), fill_unknown(state), naics2(naics), fill_unknown(full_time), fill_unknown(level)
    )


def slug_from_path(path: Column) -> Column:
    """Parent folder of a file, or the file's stem where there is no folder."""
    parts = F.split(path, "/")
    parent = F.try_element_at(parts, F.lit(-2))
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*\z", "")
    return F.coalesce(F.nullif(parent, F.lit("")), stem)


def model_family(slug: Column) -> Column:
    low = F.lower(slug.cast("string"))
    out = F.lit("Other")
    for family, marks in reversed(FAMILY_RULES):
        hit = low.contains(marks[0])
        for mark in marks[1:]:
            hit = hit | low.contains(mark)
        out = F.when(hit, F.lit(family)).otherwise(out)
    return out


def persona_from_path(path: Column) -> Column:
    """Persona named by an estimates file, ``unknown`` if it names none."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*\z", "")
    tag = F.regexp_extract(stem, r"\Allm_estimated_salaries(?:_debug)?[-_](.+)\z", 1)
    return F.coalesce(F.nullif(tag, F.lit("")), F.lit("unknown"))


def model_slug(name: Column) -> Column:
    """File-system safe name from the last part of a model path."""
    last = F.element_at(F.split(strip(name), "/"), -1)
    safe = F.regexp_replace(last, r"[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(safe, r"\A_+|_+\z", ""), F.lit("")), F.lit("model"))


def model_size_b(name: Column) -> Column:
    """Billions of parameters: ``8x7B`` gives 56, ``70B`` gives 70, else null."""
    pattern = r"(\d+)x(\d+)[Bb]|(\d+(?:\.\d+)?)[Bb]"
    part = lambda i: F.regexp_extract(name, pattern, i).try_cast("double")
    return F.coalesce(part(1) * part(2), part(3))


def strip_think(text: Column, is_reasoning: Column) -> Column:
    """Keep what follows the closing think tag, for the models that write one."""
    mark = "</think>\n\n"
    at = F.locate(mark, text)
    rest = strip(F.substring(text, at + len(mark), F.length(text)))
    return F.when(is_reasoning & (at > 0), rest).otherwise(text)
