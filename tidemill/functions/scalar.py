"""Scalar functions on columns: IEEE arithmetic without errors, NaN results as missing, literal string operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def no_nan(x: Column) -> Column:
    """NaN becomes missing; infinities stay."""
    return F.when(~F.isnan(x), x)


# -- arithmetic ----------------------------------------------------------------


def divide(x, y) -> Column:
    """Double division; a zero divisor gives an infinity, and zero by zero is missing."""
    x, y = _col(x).cast("double"), _col(y).cast("double")
    by_zero = F.when(x > 0, F.lit(_INF)).when(x < 0, F.lit(-_INF))
    return no_nan(F.when(y == 0, by_zero).otherwise(x / F.nullif(y, F.lit(0.0))))


def remainder(x, y) -> Column:
    """Remainder with the dividend's sign; missing for a zero divisor."""
    return F.try_mod(_col(x), _col(y))


def log(x, base: float | None = None) -> Column:
    """Logarithm to e, 2 or 10: minus infinity at zero, missing below."""
    x = _col(x).cast("double")
    f = {None: F.ln, 2: F.log2, 10: F.log10}[base]
    return F.when(x == 0, F.lit(-_INF)).when(x > 0, f(x))


def exp(x) -> Column:
    return F.exp(_col(x).cast("double"))


def sqrt(x) -> Column:
    return no_nan(F.sqrt(_col(x).cast("double")))


def absolute(x) -> Column:
    return F.abs(_col(x).cast("double"))


def floor(x) -> Column:
    return F.floor(_col(x)).cast("double")


def ceil(x) -> Column:
    return F.ceil(_col(x)).cast("double")


def sin(x) -> Column:
    return no_nan(F.sin(_col(x)))


def cos(x) -> Column:
    return no_nan(F.cos(_col(x)))


def power(x, y) -> Column:
    return no_nan(F.pow(_col(x), _col(y) if isinstance(y, (str, Column)) else F.lit(y)))


def round_half_away(x, digits: int = 0) -> Column:
    """Binary rounding of x * 10**digits, halves away from zero."""
    x, f = _col(x).cast("double"), F.lit(10.0**digits)
    return F.signum(x) * F.floor(F.abs(x) * f + 0.5) / f


def clamp(x, low, high) -> Column:
    x = _col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def sigmoid(x) -> Column:
    x = _col(x).cast("double")
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def fused_multiply_add(a, b, c) -> Column:
    return _col(a) * _col(b) + _col(c)


# -- choices -------------------------------------------------------------------


def if_else(condition: Column, yes, no) -> Column:
    """Missing where the condition is."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(condition, lit(yes)).when(~condition, lit(no))


def between(x, low, high) -> Column:
    """Both ends belong to the range."""
    return _col(x).between(F.lit(low), F.lit(high))


def coalesce(*xs) -> Column:
    return F.coalesce(*[_col(x) if isinstance(x, (str, Column)) else F.lit(x) for x in xs])


def is_na(x) -> Column:
    return _col(x).isNull()


# -- strings -------------------------------------------------------------------


def str_upper(x) -> Column:
    return F.upper(_col(x))


def str_lower(x) -> Column:
    return F.lower(_col(x))


def str_trim(x) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(_col(x), r"(?U)^\s+|\s+$", "")


def str_len(x) -> Column:
    """Code points."""
    return F.length(_col(x)).cast("long")


def str_contains(x, part: str) -> Column:
    return _col(x).contains(part)


def str_starts(x, part: str) -> Column:
    return _col(x).startswith(part)


def str_ends(x, part: str) -> Column:
    return _col(x).endswith(part)


def str_replace(x, old: str, new: str) -> Column:
    """All occurrences, taken literally."""
    return F.replace(_col(x), F.lit(old), F.lit(new))


def str_split(x, separator: str) -> Column:
    """Parts at a literal separator, empty ones included."""
    quoted = "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.split(_col(x), quoted, -1)


def str_pad(x, width: int, fill: str = " ") -> Column:
    """Filled on the left; longer strings stay whole."""
    x = _col(x)
    return F.when(F.length(x) >= width, x).otherwise(F.lpad(x, width, fill))


def sha256(x) -> Column:
    return F.sha2(_col(x).cast("string"), 256)


# -- conversions ---------------------------------------------------------------


def to_int(x, strict: bool = True) -> Column:
    """Whole number of a trimmed string, or a number cut towards zero; unparsable strings raise if ``strict``, else are missing."""
    x = F.trim(_col(x).cast("string"))
    parsed = F.coalesce(x.try_cast("long"), x.try_cast("double").try_cast("long"))
    return F.when(parsed.isNotNull() | x.isNull() | F.lit(not strict), parsed).otherwise(F.raise_error(F.concat(F.lit("C0201: not a number: "), x)).cast("long"))


def to_float(x, strict: bool = True) -> Column:
    x = F.trim(_col(x).cast("string"))
    return x.cast("double") if strict else x.try_cast("double")


def to_bool(x) -> Column:
    """True for true and 1."""
    x = _col(x).cast("string")
    return F.when(x.isNotNull(), F.lower(x).isin("true", "1"))


def to_string(x) -> Column:
    return _col(x).cast("string")


def format_string(template: str, *xs) -> Column:
    """``{}`` and ``{:.2}`` places in a template."""
    import re

    pattern = re.sub(r"\{:\.(\d+)\}", r"%.\1f", template.replace("%", "%%")).replace("{}", "%s")
    return F.format_string(pattern, *[_col(x) for x in xs])
