"""Completeness (Q1-Q3, P5): missing counts, flags and blank-aware missing.

All counts for all columns come from a single ``agg`` (one pass, partial
aggregation map-side), reshaped to one row per column with ``stack``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlint.functions import scalars as S


def _stack(df: DataFrame, names: list[str], value_cols: list[str], key: str = "column") -> DataFrame:
    """Turn one wide row ``{name}__{value}`` into one row per name (unpivot)."""
    parts = []
    for n in names:
        parts.append(F.struct(F.lit(n).alias(key),
                              *[F.col(f"`{n}__{v}`").alias(v) for v in value_cols]))
    return df.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def missing_report(df: DataFrame, columns: list[str] | None = None,
                   blank_aware: bool = False) -> DataFrame:
    """Q1 / Q3: ``column, missing_count, missing_pct`` in column order.

    ``blank_aware`` also counts whitespace-only text as missing.
    """
    columns = columns or df.columns
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c in columns:
        cond = S.is_blank(F.col(c)) if blank_aware else S.is_missing_value(df, c)
        aggs.append(F.count_if(cond).alias(f"{c}__missing_count"))
    wide = df.agg(*aggs)
    for c in columns:
        wide = wide.withColumn(f"{c}__missing_pct",
                               (S.percent(F.col(f"`{c}__missing_count`"), F.col("__rows"))))
    long = _stack(wide, columns, ["missing_count", "missing_pct"])
    pos = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    return long.withColumn("position", F.element_at(pos, F.col("column")).cast("int"))


def add_completeness_flags(df: DataFrame, columns: list[str] | None = None,
                           exclude: tuple = ("uniqueness_flag",),
                           suffix: str = "_completeness") -> DataFrame:
    """Q2: ``{col}_completeness = col is not null``, flags sorted by column name."""
    columns = columns if columns is not None else df.columns
    names = sorted(c for c in columns if c not in exclude)
    return df.select("*", *[(~S.is_missing_value(df, c)).alias(f"{c}{suffix}") for c in names])


def blank_missing_flag(c) -> F.Column:
    """Q3 flag: missing or blank after trim."""
    return S.is_blank(c)


def co_missing(df: DataFrame, given: str, columns: list[str] | None = None) -> DataFrame:
    """P5: among rows where ``given`` is missing, missing count per column."""
    columns = columns or df.columns
    sub = df.where(S.is_missing_value(df, given))
    wide = sub.agg(*[F.count_if(S.is_missing_value(df, c)).alias(f"{c}__missing_count")
                     for c in columns])
    return _stack(wide, columns, ["missing_count"])
