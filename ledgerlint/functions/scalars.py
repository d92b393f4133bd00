"""Scalar building blocks (all JVM-side built-in expressions).

Each helper returns a ``Column``; none of them runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full_match(c, pattern: str) -> Column:
    """Whole-string regex match (F1). Null in, null out.

    ``\\A`` and ``\\z`` anchor the whole text, so a trailing newline fails as
    it does with a full match, which ``^...$`` would let through.
    """
    return col_of(c).cast("string").rlike(r"\A(?:" + pattern + r")\z")


def full_match_or_false(c, pattern: str) -> Column:
    """Regex rule on the text form: a missing value is text too, and fails."""
    return F.coalesce(full_match(c, pattern), F.lit(False))


def is_blank(c) -> Column:
    """Missing or only whitespace, Unicode blanks included (F2)."""
    s = col_of(c).cast("string")
    return s.isNull() | s.rlike(r"(?U)\A\s*\z")


def is_numeric_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def as_number(df: DataFrame, name: str) -> Column:
    """Numeric value of a cell, null when it is not a number."""
    c = F.col(name)
    dt = dtype_of(df, name)
    if is_numeric_type(dt):
        return c.cast("double")
    if isinstance(dt, T.BooleanType):
        return F.lit(None).cast("double")
    return c.cast("string").try_cast("double")


def is_missing_value(df: DataFrame, name: str) -> Column:
    """Missing in the pandas sense: null, or NaN in a floating column."""
    c = F.col(name)
    if isinstance(dtype_of(df, name), (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def is_number(df: DataFrame, name: str) -> Column:
    return as_number(df, name).isNotNull()


def strict_date(c, fmt: str = "yyyy-MM-dd") -> Column:
    """Strict date parse (F7): null on a bad shape or an impossible day."""
    return F.call_function("try_to_date", col_of(c).cast("string"), F.lit(fmt))


def valid_iso_date_text(c, pattern: str = "[0-9]{4}-[0-9]{2}-[0-9]{2}",
                        min_year: int = 1) -> Column:
    """``YYYY-MM-DD`` shape and a real calendar day, year >= ``min_year``.

    The shape test is needed: the parser alone accepts ``2024-1-5``.
    """
    d = strict_date(c)
    return (F.coalesce(full_match(c, pattern), F.lit(False))
            & d.isNotNull() & (F.year(d) >= F.lit(min_year)))


def to_date_any(df: DataFrame, name: str) -> Column:
    """Date value of a date, timestamp or ISO text column (null when bad)."""
    dt = dtype_of(df, name)
    c = F.col(name)
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    return strict_date(c)


def week_start(d) -> Column:
    """Monday of the week of ``d`` as ``yyyy-MM-dd`` text."""
    return F.date_format(F.date_trunc("week", col_of(d)), "yyyy-MM-dd")


def day_name(d) -> Column:
    """English day name."""
    return F.date_format(col_of(d), "EEEE")


def is_whole(x) -> Column:
    """Whole-number test (F9) on a double."""
    x = col_of(x)
    return x == F.floor(x)


def safe_divide(a, b) -> Column:
    """``a / b`` with null for a zero divisor (F10, decision C1)."""
    return F.try_divide(col_of(a), col_of(b))


def percent(n, total) -> Column:
    """``100 * n / total`` (F16), 0 when the total is 0."""
    return F.coalesce(F.try_divide(F.lit(100.0) * col_of(n), col_of(total)),
                      F.lit(0.0))


def map_lookup(mapping: dict, key) -> Column:
    """Literal map lookup, null for an unknown key."""
    if not mapping:
        return F.lit(None).cast("string")
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), col_of(key))


def bool_text(c) -> Column:
    """Python-style text of a boolean: ``True`` / ``False``."""
    c = col_of(c)
    return F.when(c, F.lit("True")).when(~c, F.lit("False"))


def text_to_flag(c) -> Column:
    """Text or boolean to 0/1, missing to 0 (P10)."""
    c = col_of(c)
    b = F.when(c.cast("string").isin("True", "true", "1"), F.lit(True)) \
         .when(c.cast("string").isin("False", "false", "0"), F.lit(False))
    return F.coalesce(b, F.lit(False)).cast("int")


def finite_or_null(x) -> Column:
    """Infinity and NaN to null."""
    x = col_of(x)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
                  F.lit(None).cast("double")).otherwise(x)


def text_length(c) -> Column:
    """Length of the text form (F3); ``5.0`` has length 3."""
    return F.length(col_of(c).cast("string"))


def round_double(c, digits: int = 6) -> Column:
    return F.round(col_of(c).cast("double"), digits)
