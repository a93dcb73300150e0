"""Number parsing and per-row metrics. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_NUMBER = r"\A[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\z"


def to_number(c: Column) -> Column:
    """Double, or null for anything that is not a plain number (NaN included)."""
    text = F.regexp_replace(c.cast("string"), r"(?U)\A\s+|\s+\z", "")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_money(c: Column) -> Column:
    """``$1,234.50`` to 1234.5; null when no number is left."""
    return to_number(F.regexp_replace(c.cast("string"), r"(?U)[$,\s]", ""))


def clip(c: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(float(high))), F.lit(float(low))))


def signed_pct_bias(estimate: Column, actual: Column, min_actual: float = 1.0, cap: float = 0.0) -> Column:
    """Signed percent bias; null below ``min_actual`` or when a side is missing."""
    raw = F.when(actual >= F.lit(float(min_actual)), F.try_divide(estimate - actual, actual) * F.lit(100.0))
    return clip(raw, -cap, cap) if cap > 0 else raw


def effect_size(d: Column) -> Column:
    """Verbal size of a standardised difference (fixed cut-offs 0.2, 0.5, 0.8)."""
    size = F.abs(d)
    return (
        F.when(d.isNull() | F.isnan(d), "unknown")
        .when(size < 0.2, "negligible")
        .when(size < 0.5, "small")
        .when(size < 0.8, "medium")
        .otherwise("large")
    )


def significant(p: Column, alpha: float = 0.05) -> Column:
    return F.coalesce(p < F.lit(alpha), F.lit(False))


def unit_hash(*parts: Column | str) -> Column:
    """A number in (0, 1) that depends only on ``parts``: 52 bits of an md5."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


# Coefficients of the published rational approximation AS 241 (fixed values).
_CENTRAL = (
    (3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
_NEAR_TAIL = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
     1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_FAR_TAIL = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(table: tuple, x: Column) -> Column:
    def poly(coefs: tuple) -> Column:
        out = F.lit(coefs[-1])
        for c in reversed(coefs[:-1]):
            out = out * x + F.lit(c)
        return out

    return poly(table[0]) / poly(table[1])


def norm_ppf(p: Column) -> Column:
    """Standard normal quantile in the JVM (no Python worker)."""
    q = p - F.lit(0.5)
    tail = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(F.lit(1.0) - p)))
    sign = F.when(q < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return (
        F.when(F.abs(q) <= 0.425, q * _ratio(_CENTRAL, F.lit(0.180625) - q * q))
        .when(tail <= 5, sign * _ratio(_NEAR_TAIL, tail - F.lit(1.6)))
        .otherwise(sign * _ratio(_FAR_TAIL, tail - F.lit(5.0)))
    )
