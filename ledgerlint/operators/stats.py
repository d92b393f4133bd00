"""Statistics and encoding.

The chi-square test builds every contingency table in one pass: each row is
exploded into (column, level, target) cells and counted, combined map-side.
The statistic, degrees of freedom and Yates' correction (2 x 2 tables) are
SQL expressions over the small cell table; only the p-value needs a special
function, evaluated by a vectorised pandas UDF over one row per column.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlint.functions import scalars as S
from ledgerlint.session import cut_lineage, stored


def contingency_cells(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, level, target, n) for every observed cell; rows where the
    column or the target is missing are dropped, as a crosstab does."""
    t = F.col(f"`{target}`").cast("string")
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("level"),
                      t.alias("target")) for c in columns]
    cells = df.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    return (cells.where(F.col("level").isNotNull() & F.col("target").isNotNull())
                 .groupBy("column", "level", "target").agg(F.count(F.lit(1)).alias("n")))


def chi_square_statistics(df: DataFrame, columns: list[str], target: str,
                          correction: bool = True) -> DataFrame:
    """M1 statistic: ``column, statistic, dof`` per categorical column.

    Pearson's statistic is ``sum(O^2 / E) - N`` over observed cells (absent
    cells add nothing to the first term). For a 2 x 2 table with
    ``correction`` each of the four cells is moved 0.5 towards its expected
    count (never past it), as the usual Yates rule does.
    """
    # the cell table (one row per observed cell) is written once, so the
    # row, column and grand totals below read it instead of re-scanning
    cells = cut_lineage(contingency_cells(df, columns, target))
    rows = cells.groupBy("column", "level").agg(F.sum("n").alias("r"))
    cols = cells.groupBy("column", "target").agg(F.sum("n").alias("c"))
    # levels and targets per column = rows of the two margin tables
    n_lv = rows.groupBy("column").agg(F.count(F.lit(1)).alias("n_levels"))
    n_tg = cols.groupBy("column").agg(F.count(F.lit(1)).alias("n_targets"),
                                      F.sum("c").alias("n_total"))
    tot = n_lv.join(n_tg, "column")
    j = (cells.join(rows, ["column", "level"]).join(cols, ["column", "target"])
              .join(tot, "column"))
    e = F.col("r") * F.col("c") / F.col("n_total")
    per_col = j.groupBy("column").agg(
        (F.sum(F.col("n") * F.col("n") / e) - F.first("n_total")).alias("pearson"),
        F.first("n_levels").alias("n_levels"), F.first("n_targets").alias("n_targets"),
        F.first("n_total").alias("n_total"),
        # 2 x 2 tables: keep the (observed, expected) pairs, at most 4
        F.collect_list(F.when((F.col("n_levels") == 2) & (F.col("n_targets") == 2),
                              F.struct(F.col("level"), F.col("target"), F.col("n").cast("double").alias("o"))))
         .alias("obs"),
        F.array_sort(F.collect_set(F.when((F.col("n_levels") == 2) & (F.col("n_targets") == 2),
                                          F.struct("level", F.col("r").cast("double").alias("r"))))).alias("rt"),
        F.array_sort(F.collect_set(F.when((F.col("n_levels") == 2) & (F.col("n_targets") == 2),
                                          F.struct("target", F.col("c").cast("double").alias("c"))))).alias("ct"))
    dof = ((F.col("n_levels") - 1) * (F.col("n_targets") - 1)).cast("long")

    def yates(pc):
        # all four cells of the 2 x 2 grid, absent ones observed 0
        grid = F.flatten(F.transform(pc["rt"], lambda rr: F.transform(pc["ct"], lambda cc: F.struct(
            rr["level"].alias("level"), cc["target"].alias("target"),
            (rr["r"] * cc["c"] / pc["N"]).alias("e")))))

        def cell_term(g):
            o = F.coalesce(F.aggregate(
                F.filter(pc["obs"], lambda x: (x["level"] == g["level"]) & (x["target"] == g["target"])),
                F.lit(None).cast("double"), lambda acc, x: x["o"]), F.lit(0.0))
            d = F.abs(o - g["e"])
            adj = d - F.least(F.lit(0.5), d)
            return adj * adj / g["e"]

        return F.aggregate(F.transform(grid, cell_term), F.lit(0.0), lambda a, b: a + b)

    stat = F.when(F.lit(correction) & (dof == 1), yates(F.struct(
        F.col("rt").alias("rt"), F.col("ct").alias("ct"), F.col("obs").alias("obs"),
        F.col("n_total").cast("double").alias("N")))).otherwise(F.col("pearson"))
    return per_col.select("column", (stat).alias("statistic"), dof.alias("dof"))


def chi2_survival(x: float, k: float) -> float:
    """Upper tail of the chi-square distribution for whole degrees of freedom.

    A finite sum: the Poisson terms below k/2 for even k, and erfc plus the
    half-integer terms for odd k. Terms are taken from their logarithms.
    """
    k = int(round(k))
    if x <= 0 or k <= 0:
        return 1.0
    half, odd = x / 2.0, k % 2
    total = math.erfc(math.sqrt(half)) if odd else 0.0
    for i in range((k - odd) // 2):
        power = i + 0.5 * odd
        total += math.exp(power * math.log(half) - half - math.lgamma(power + 1.0))
    return min(1.0, total)



@F.pandas_udf(T.DoubleType())
def chi2_pvalue(x: pd.Series, k: pd.Series) -> pd.Series:
    """Vectorised wrapper of ``chi2_survival`` (one row per tested column)."""
    return pd.Series([chi2_survival(float(a), float(b)) if pd.notna(a) and pd.notna(b) else np.nan
                      for a, b in zip(x, k)])


def chi_square_test(df: DataFrame, columns: list[str], target: str, alpha: float = 0.05,
                    correction: bool = True) -> DataFrame:
    """M1: statistic, dof, p-value and significance per column, sorted by p."""
    st = chi_square_statistics(df, columns, target, correction)
    return (st.withColumn("p_value", chi2_pvalue(F.col("statistic"), F.col("dof").cast("double")))
              .withColumn("significant", F.col("p_value") < F.lit(alpha))
              .orderBy(F.col("p_value").asc_nulls_last(), "column"))


def one_hot(df: DataFrame, categorical: list[str], numeric: list[str], target: str | None,
            levels: dict | None = None) -> DataFrame:
    """E3 + J4: numeric columns, one 0/1 column ``{col}_{level}`` per level
    (sorted; a missing value is the level ``nan``), then the target.

    Levels become columns, so all are collected once per column unless passed in; encoding is a single ``select``, so no join is needed to put
    the pieces side by side. To find levels the columns used are stored first,
    so that the source is read once.
    """
    levels = dict(levels or {})
    if any(c not in levels for c in categorical):
        used = dict.fromkeys([*numeric, *categorical, *([target] if target else [])])
        df = stored(df.select(*[F.col(f"`{c}`") for c in used]))
    for c in categorical:
        if c not in levels:
            vals = (df.select(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")).alias("v"))
                      .distinct().collect())
            levels[c] = sorted(r[0] for r in vals)
    out = [F.col(f"`{c}`") for c in numeric]
    for c in categorical:
        v = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan"))
        out += [(v == F.lit(lv)).cast("double").alias(f"{c}_{lv}") for lv in levels[c]]
    if target:
        out.append(F.col(f"`{target}`"))
    return df.select(*out)


def standardize(df: DataFrame, columns: list[str], population: bool = True) -> DataFrame:
    """(x - mean) / std per column; population std by default (as the
    reference's scaler), sample std with ``population=False``."""
    sd = F.stddev_pop if population else F.stddev_samp
    row = df.agg(*[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(columns)],
                 *[sd(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    out = []
    for c in df.columns:
        if c in columns:
            i = columns.index(c)
            m, s = row[f"m{i}"], row[f"s{i}"]
            x = F.col(f"`{c}`")
            out.append((F.lit(0.0) * x if not s else (x - F.lit(m)) / F.lit(s)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)
