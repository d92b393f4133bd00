"""Chart inputs as tables.

The reference draws charts on one machine; here each chart's aggregation is
a Spark job and the result is a small table a notebook can plot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlint.functions import scalars as S
from ledgerlint.session import cut_lineage
from ledgerlint.operators import aggregates as G
from ledgerlint.operators.completeness import missing_report
from ledgerlint.operators.profile import column_roles
from ledgerlint.operators.quantiles import grouped_quantiles


def missing_bars(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """V1: columns with missing % > 0, largest first."""
    rep = missing_report(df, columns)
    return rep.where(F.col("missing_pct") > 0).select("column", "missing_pct") \
              .orderBy(F.col("missing_pct").desc(), "column")


def box_summary(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """V2 / V7: five-number summary per column (and per ``by`` group)."""
    parts = [F.struct(F.lit(c).alias("column"), S.as_number(df, c).alias("x"),
                      *([F.col(f"`{by}`").cast("string").alias("grp")] if by else []))
             for c in columns]
    long = df.select(F.explode(F.array(*parts)).alias("p")).select("p.*").where(F.col("x").isNotNull())
    keys = ["column"] + (["grp"] if by else [])
    if by:
        long = long.where(F.col("grp").isNotNull())
    ext = long.groupBy(*keys).agg(F.min("x").alias("min"), F.max("x").alias("max"), F.count("x").alias("n"))
    qs = grouped_quantiles(long, keys, "x", [0.25, 0.5, 0.75])
    out = ext.join(qs, keys, "left")
    res = out.select(*keys, "n", F.col("min"), (F.col("q0")).alias("q1"),
                     (F.col("q1")).alias("median"),
                     (F.col("q2")).alias("q3"), F.col("max"))
    return res.withColumnRenamed("grp", by) if by else res


def histogram(df: DataFrame, columns: list[str], bins: int = 10, by: str | None = None) -> DataFrame:
    """V2 / V4: equal-width histogram between each column's min and max.

    Bucket = floor((x - min) / (max - min) * bins), the maximum in the last
    bucket. The bounds are one aggregate (bounded: two numbers per column).
    """
    row = df.agg(*[F.min(S.as_number(df, c)).alias(f"lo{i}") for i, c in enumerate(columns)],
                 *[F.max(S.as_number(df, c)).alias(f"hi{i}") for i, c in enumerate(columns)]).first()
    parts = []
    for i, c in enumerate(columns):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if lo is None:
            continue
        x = S.as_number(df, c)
        width = float(hi) - float(lo)
        b = (F.lit(0) if width == 0 else
             F.least(F.floor((x - F.lit(float(lo))) / F.lit(width) * F.lit(bins)), F.lit(bins - 1)))
        parts.append(F.struct(F.lit(c).alias("column"), b.cast("int").alias("bucket"),
                              (F.lit(float(lo)) + b * F.lit(width / bins)).alias("bucket_start"),
                              *([F.col(f"`{by}`").cast("string").alias("grp")] if by else []),
                              x.alias("x")))
    long = df.select(F.explode(F.array(*parts)).alias("p")).select("p.*").where(F.col("x").isNotNull())
    if by:
        long = long.where(F.col("grp").isNotNull())
    keys = ["column", "bucket"] + (["grp"] if by else [])
    out = long.groupBy(*keys).agg((F.first("bucket_start")).alias("bucket_start"),
                                  F.count(F.lit(1)).alias("n"))
    return out.withColumnRenamed("grp", by) if by else out


def category_counts(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """V3 / V5: value counts per categorical column (and per ``by``), largest first."""
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"),
                      *([F.col(f"`{by}`").cast("string").alias("grp")] if by else []))
             for c in columns]
    long = df.select(F.explode(F.array(*parts)).alias("p")).select("p.*").where(F.col("value").isNotNull())
    keys = ["column", "value"] + (["grp"] if by else [])
    out = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if by:
        out = out.where(F.col("grp").isNotNull()).withColumnRenamed("grp", by)
    return out.orderBy("column", F.col("n").desc(), "value")


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """V8: rows per class and percent of all rows (missing class included)."""
    counts = cut_lineage(df.groupBy(F.col(f"`{target}`").cast("string").alias("class"))
                           .agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.withColumn("pct", (S.percent(F.col("n"), F.lit(total))))


def tagged_union(before: DataFrame, after: DataFrame, columns: list[str],
                 tag: str = "DataFrame") -> DataFrame:
    """The two frames stacked with a tag column ``Before`` / ``After``."""
    b = before.select(*[F.col(f"`{c}`") for c in columns]).withColumn(tag, F.lit("Before"))
    a = after.select(*[F.col(f"`{c}`") for c in columns]).withColumn(tag, F.lit("After"))
    return b.unionByName(a)


def before_after_box(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """V7: box summary of each column before and after a change."""
    return box_summary(tagged_union(before, after, columns), columns, by="DataFrame")


def explore_bundle(df: DataFrame) -> dict:
    """Missing bars, numeric box summaries and histograms, category counts."""
    roles = column_roles(df)
    num, cat = roles["numeric"], [c for c in df.columns if c not in roles["numeric"]]
    return {"missing": missing_bars(df), "box": box_summary(df, num) if num else None,
            "histogram": histogram(df, num) if num else None,
            "categories": category_counts(df, cat) if cat else None}


def feature_target_bundle(df: DataFrame, target: str) -> dict:
    """Numeric histograms and category counts split by the target."""
    roles = column_roles(df, target)
    return {"numeric": histogram(df, roles["numeric"], by=target) if roles["numeric"] else None,
            "categorical": category_counts(df, roles["categorical"], by=target) if roles["categorical"] else None}


def correlation_heatmap(df: DataFrame, target: str) -> DataFrame:
    """V6: correlation matrix of the numeric columns and the target."""
    roles = column_roles(df, target)
    return G.correlation_matrix(df, roles["numeric"] + [target])
