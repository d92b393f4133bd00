"""Aggregations (G5-G16): grouped statistics, frequencies, quantiles,
describe, crosstab, correlation, modes and text lengths.

Every statistic over many columns is one ``agg`` (one scan, map-side
partial aggregation); results are reshaped to one row per column.
Quantiles, medians and modes are exact (linear interpolation, smallest
mode on ties), as the reference computes them, through
``ledgerlint.operators.quantiles`` so that no task holds all distinct values.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlint.functions import scalars as S
from ledgerlint.operators.comoments import correlation_blocks
from ledgerlint.session import cut_lineage
from ledgerlint.operators.quantiles import exact_modes, exact_quantiles_multi, grouped_quantiles


def _explode_structs(wide: DataFrame, parts) -> DataFrame:
    return wide.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def group_mean_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and median of ``value`` per ``key`` (missing keys dropped)."""
    base = df.where(F.col(key).isNotNull())
    means = base.groupBy(key).agg(F.avg(value).alias("mean_value"))
    medians = grouped_quantiles(base, [key], value, [0.5], prefix="median_")
    return means.join(medians.withColumnRenamed("median_0", "median_value"), key, "left")


def first_by_order(df: DataFrame, key: str, value: str, order_cols: list[str],
                   out: str | None = None) -> DataFrame:
    """First non-null ``value`` per ``key`` in row order (``min_by``).

    A hot key costs nothing extra: ``min_by`` combines map-side.
    """
    order = F.struct(*[F.col(c) for c in order_cols])
    return (df.where(F.col(value).isNotNull() & F.col(key).isNotNull())
              .groupBy(key)
              .agg(F.min_by(F.col(value), order).alias(out or value)))


def group_sizes(df: DataFrame, keys) -> DataFrame:
    """Rows per group."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def value_shares(df: DataFrame, column: str, normalize: bool = True) -> DataFrame:
    """Value frequencies (missing excluded), with their share of the total.

    The counts are written once (checkpoint folder) and the total is their
    sum: one scan of the input, and no window gathers all distinct values
    into one task.
    """
    counts = (df.where(F.col(column).isNotNull()).groupBy(column)
                .agg(F.count(F.lit(1)).alias("n_rows")))
    if not normalize:
        return counts
    counts = cut_lineage(counts)
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    return counts.withColumn("share", (
        F.try_divide(F.col("n_rows").cast("double"), F.lit(float(total)))))


def quantiles(df: DataFrame, columns: list[str], probs=(0.25, 0.5, 0.75),
              approx_accuracy: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per column.

    ``approx_accuracy`` switches to ``approx_percentile`` (one pass, bounded
    sketch; relative rank error about 1 / accuracy) for very large inputs
    where exactness is not required.
    """
    names = [f"q{int(round(p * 100)):02d}" for p in probs]
    if approx_accuracy:
        wide = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), list(probs), approx_accuracy)
                        .alias(f"{c}__q") for c in columns])
        parts = [F.struct(F.lit(c).alias("column"),
                          *[(F.col(f"`{c}__q`")[i]).alias(n) for i, n in enumerate(names)])
                 for c in columns]
        return _explode_structs(wide, parts)
    qs = exact_quantiles_multi(df, columns, probs)
    rows = [(c, *qs[c]) for c in columns]
    schema = "column string, " + ", ".join(f"{n} double" for n in names)
    out = df.sparkSession.createDataFrame(rows, schema)
    return out.select("column", *[(F.col(n)).alias(n) for n in names])


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max per numeric column.

    Moments and extremes come from one aggregate; quartiles from the exact
    bounded-memory quantiles.
    """
    aggs = []
    for c in columns:
        x = F.col(c)
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
    wide = df.agg(*aggs)
    quarts = exact_quantiles_multi(df, columns, [0.25, 0.5, 0.75])
    parts = []
    for c in columns:
        q = quarts[c]
        parts.append(F.struct(
            F.lit(c).alias("column"), F.col(f"`{c}__count`").alias("count"),
            (F.col(f"`{c}__mean`")).alias("mean"),
            (F.col(f"`{c}__std`")).alias("std"),
            F.col(f"`{c}__min`").cast("double").alias("min"),
            (F.lit(q[0]).cast("double")).alias("p25"),
            (F.lit(q[1]).cast("double")).alias("p50"),
            (F.lit(q[2]).cast("double")).alias("p75"),
            F.col(f"`{c}__max`").cast("double").alias("max")))
    return _explode_structs(wide, parts)


def crosstab(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Counts of ``row`` x ``col`` (rows with either missing dropped).

    The pivot values are passed in, so no extra job collects them.
    """
    return (df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
              .groupBy(row).pivot(col, list(values)).count().na.fill(0))


#: More columns than this go through one co-moment matrix.
MANY_COLUMNS = 24


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation for every pair, pairwise-complete; beyond
    ``MANY_COLUMNS`` columns by ``correlation_blocks``."""
    if len(columns) > MANY_COLUMNS:
        return correlation_blocks(df, columns).select("a", "b", "r")
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    wide = df.agg(*[F.corr(F.col(a), F.col(b)).alias(f"{a}__{b}") for a, b in pairs])
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                      (F.col(f"`{a}__{b}`")).alias("r")) for a, b in pairs]
    return _explode_structs(wide, parts)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """G12 square form: one row per column, one value per column (diagonal 1)."""
    long = correlation_pairs(df, columns)
    sym = long.unionByName(long.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    diag = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "a string, b string, r double")
    return sym.unionByName(diag).groupBy("a").pivot("b", list(columns)).agg(F.first("r"))


def mode_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median and mode per column; the smallest value wins a tie."""
    medians, modes = exact_quantiles_multi(df, columns, [0.5]), exact_modes(df, columns)
    rows = [(c, medians[c][0], modes[c]) for c in columns]
    dtype = {c: S.dtype_of(df, c).simpleString() for c in columns}
    parts = [F.struct(F.lit(c).alias("column"),
                      (F.lit(med).cast("double")).alias("median"),
                      F.lit(mode).cast(dtype[c]).cast("string").alias("mode"))
             for c, med, mode in rows]
    return df.sparkSession.range(1).select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def text_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    """Min, max and mean length of the text form per column."""
    aggs = []
    for c in columns:
        n = S.text_length(F.col(c))
        aggs += [F.min(n).alias(f"{c}__min"), F.max(n).alias(f"{c}__max"),
                 F.avg(n).alias(f"{c}__avg")]
    wide = df.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}__min`").alias("min_length"),
                      F.col(f"`{c}__max`").alias("max_length"),
                      (F.col(f"`{c}__avg`")).alias("avg_length")) for c in columns]
    return _explode_structs(wide, parts)


def column_info(df: DataFrame) -> DataFrame:
    """Non-null count and type per column, plus the row count (shape)."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__rows"),
                  *[F.count(F.col(f"`{c}`")).alias(f"{c}__nn") for c in cols])
    types = dict(df.dtypes)
    parts = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                      F.lit(types[c]).alias("dtype"), F.col(f"`{c}__nn`").alias("non_null"),
                      F.col("__rows").alias("rows")) for i, c in enumerate(cols)]
    return _explode_structs(wide, parts)


def share_outside(df: DataFrame, column: str, low: float | None = None,
                  high: float | None = None) -> DataFrame:
    """Count and share of rows below ``low`` or above ``high``."""
    x = F.col(column)
    cond = F.lit(False)
    if low is not None:
        cond = cond | (x < F.lit(low))
    if high is not None:
        cond = cond | (x > F.lit(high))
    return df.agg(F.count_if(cond).alias("n_outside"), F.count(F.lit(1)).alias("rows")) \
             .withColumn("share", (S.percent(F.col("n_outside"), F.col("rows"))))
