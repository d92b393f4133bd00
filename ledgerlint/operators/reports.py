"""Column-level quality reports (Q21-Q25).

Every report takes several columns at once and computes all of them in one
``agg`` over one scan, then reshapes to one row per column. Row-level
outputs (tagged rows, missing rows, outliers) are plain filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlint.functions import scalars as S
from ledgerlint.session import cut_lineage

REPORT_FIELDS = ("rows", "missing_count", "missing_pct", "non_missing",
                 "valid_count", "valid_pct")


def _report(df: DataFrame, checks: dict, valid_name: str = "valid") -> DataFrame:
    """``checks``: column -> Column that is True for a valid non-missing value."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c, ok in checks.items():
        miss = S.is_blank(F.col(c))
        aggs.append(F.count_if(miss).alias(f"{c}__missing_count"))
        aggs.append(F.count_if(~miss & F.coalesce(ok, F.lit(False))).alias(f"{c}__valid_count"))
    wide = df.agg(*aggs)
    parts = []
    for i, c in enumerate(checks):
        m = F.col(f"`{c}__missing_count`")
        v = F.col(f"`{c}__valid_count`")
        rows = F.col("__rows")
        nm = rows - m
        parts.append(F.struct(
            F.lit(c).alias("column"), F.lit(i).alias("position"), rows.alias("rows"),
            m.alias("missing_count"), (S.percent(m, rows)).alias("missing_pct"),
            nm.alias("non_missing"), v.alias(f"{valid_name}_count"),
            (S.percent(v, nm)).alias(f"{valid_name}_pct")))
    return wide.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def format_report(df: DataFrame, patterns: dict) -> DataFrame:
    """Q22: blank-aware missing %, and % of non-missing values that fully
    match the column's pattern (0 when nothing is present)."""
    return _report(df, {c: S.full_match(F.col(c), p) for c, p in patterns.items()})


def date_check(c, min_year: int = 1800) -> Column:
    """Q23 value check: ``YYYY-MM-DD``, year >= ``min_year``, month 1-12, a real day."""
    return S.valid_iso_date_text(c, min_year=min_year)


def date_report(df: DataFrame, columns: list[str], min_year: int = 1800) -> DataFrame:
    """Q23: as the format report with a calendar check."""
    return _report(df, {c: date_check(F.col(c), min_year) for c in columns})


def positive_status(c) -> Column:
    """Q21 tag for a non-missing value: ``Outlier`` when it is not a number
    or is <= 0, else ``Valid`` (NaN and infinity count as Valid)."""
    x = S.col_of(c).cast("string").try_cast("double")
    return F.when(x.isNull() | (~F.isnan(x) & (x <= 0)), F.lit("Outlier")).otherwise(F.lit("Valid"))


def positive_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Q21 summary: missing %, and outlier % among non-missing values."""
    rep = _report(df, {c: positive_status(F.col(c)) == "Outlier" for c in columns},
                  valid_name="outlier")
    return rep


def positive_rows(df: DataFrame, column: str) -> dict:
    """Q21 row outputs: ``missing``, ``outliers`` and tagged ``non_missing``;
    ``flagged`` holds the first two with their ``kind``, read in one pass."""
    tagged = df.withColumn("is_missing", S.is_blank(F.col(column)))
    non_missing = (tagged.where(~F.col("is_missing"))
                         .withColumn("Status_Outlier", positive_status(F.col(column))))
    return {
        "missing": tagged.where(F.col("is_missing")),
        "outliers": non_missing.where(F.col("Status_Outlier") == "Outlier"),
        "non_missing": non_missing,
        "flagged": tagged.withColumn("kind", F.when(F.col("is_missing"), F.lit("missing")).when(
            positive_status(F.col(column)) == "Outlier", F.lit("outlier"))).where(F.col("kind").isNotNull()),
    }


def domain_report(df: DataFrame, domains: dict) -> DataFrame:
    """Q24: blank-aware missing %, % of non-missing values in the list."""
    return _report(df, {c: F.col(c).isin(list(v)) for c, v in domains.items()})


def domain_rows(df: DataFrame, column: str, values) -> DataFrame:
    """Q24 rows: ``column, Valid, is_missing``; Valid is null when missing."""
    miss = S.is_blank(F.col(column))
    return df.select(F.col(column),
                     F.when(~miss, F.col(column).isin(list(values))).alias("Valid"),
                     miss.alias("is_missing"))


def own_domain_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Q25: each column checked against its own distinct values.

    The domain is not collected. One pass over the rows counts each value of
    each column; a left join of the counted values with the column's distinct
    ones marks membership, so no row is shuffled for it and the report stays
    distributed. By construction every present value is valid (100 %), which
    the tests keep as an identity.
    """
    names, types = [f"__v{i}" for i in range(len(columns))], dict(df.dtypes)
    cells = [F.struct(F.lit(i).alias("__at"), *[(F.col(f"`{c}`") if i == j else F.lit(None).cast(types[c])).alias(names[j])
                                                for j, c in enumerate(columns)]) for i in range(len(columns))]
    counted = cut_lineage(df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
                          .groupBy("__at", *names).agg(F.count(F.lit(1)).alias("__n")))
    own = counted.where(F.coalesce(*[F.when(F.col(v).isNotNull(), F.lit(True)) for v in names], F.lit(False)))
    own = own.select(F.col("__at").alias("__d"), *[F.col(v).alias(f"__d{v}") for v in names], F.lit(True).alias("__in"))
    same = F.col("__at") == F.col("__d")
    for v in names:
        same = same & F.col(v).eqNullSafe(F.col(f"__d{v}"))
    marked = counted.join(own, same, "left")
    aggs = []
    for i, v in enumerate(names):
        miss = S.is_blank(F.col(v))
        for name, hit in (("rows", F.lit(True)), ("missing", miss), ("valid", ~miss & F.coalesce("__in", F.lit(False)))):
            aggs.append(F.coalesce(F.sum(F.when((F.col("__at") == i) & hit, F.col("__n"))), F.lit(0).cast("long")).alias(f"{name}{i}"))
    parts = []
    for i, c in enumerate(columns):
        rows, m, v = F.col(f"rows{i}"), F.col(f"missing{i}"), F.col(f"valid{i}")
        parts.append(F.struct(
            F.lit(c).alias("column"), F.lit(i).alias("position"), rows.alias("rows"), m.alias("missing_count"),
            S.percent(m, rows).alias("missing_pct"), (rows - m).alias("non_missing"), v.alias("valid_count"),
            S.percent(v, rows - m).alias("valid_pct")))
    return marked.agg(*aggs).select(F.explode(F.array(*parts)).alias("r")).select("r.*")
