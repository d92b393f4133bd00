"""Uniqueness, keys and dependencies.

Row uniqueness marks the first of identical rows. Instead of a window over
all columns (which sends a hot group -- one row repeated a third of the
table -- to one task), row hashes are counted (combined map-side, so a hot
group shrinks to one row before the shuffle) and only groups that occur
twice are settled on their columns and joined back. The rows are stored
first, as three passes read them; few repeated groups (by measured size) are
broadcast, so that the rows themselves are not shuffled for them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlint.session import sized_broadcast, stored

def with_row_order(df: DataFrame, name: str = "__row_order") -> DataFrame:
    """Attach a file-order row id (for inputs that carry none, such as CSV).

    Stable for a given input and partitioning; tables with a natural key
    should pass that key as ``order_cols`` instead.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def flag_first_occurrence(df: DataFrame, key_cols: list[str], order_cols: list[str],
                          flag: str = "uniqueness_flag") -> DataFrame:
    """Q4: ``flag`` is True for the first row (by ``order_cols``) of each group
    of rows equal on ``key_cols``; missing values compare equal."""
    df = stored(df)
    order = F.struct(*[F.col(c) for c in order_cols])
    keys = [f"__uk{i}" for i in range(len(key_cols))]
    # Two 64-bit hashes of the row stand for it in a hash aggregate of counts;
    # only rows of repeated hashes (usually few) are settled on the columns
    # themselves and joined back. Every other row is unique.
    hashes = [F.xxhash64(*[F.col(c) for c in key_cols]).alias("__uh"),
              F.xxhash64(F.lit(1), *[F.col(c) for c in reversed(key_cols)]).alias("__ug")]
    repeated = sized_broadcast(
        df.select(*hashes).groupBy("__uh", "__ug").agg(F.count(F.lit(1)).alias("__n"))
          .where(F.col("__n") > 1).select("__uh", "__ug"))
    again = stored(df.select(*hashes, *[F.col(c).alias(k) for c, k in zip(key_cols, keys)], order.alias("__uo"))
                     .join(repeated, ["__uh", "__ug"], "left_semi"))
    firsts = sized_broadcast(again.groupBy("__uh", *keys).agg(F.min("__uo").alias("__first")), cut=False)
    left = df.withColumn("__lh", F.xxhash64(*[F.col(c) for c in key_cols]))
    cond = reduce(lambda a, b: a & b,
                  [left["__lh"] == firsts["__uh"]]
                  + [left[c].eqNullSafe(firsts[k]) for c, k in zip(key_cols, keys)])
    joined = left.join(firsts, cond, "left")
    return joined.select(*[left[c] for c in df.columns],
                         (F.col("__first").isNull() | (order == F.col("__first"))).alias(flag))


def duplicate_keys(df: DataFrame, key: str | list[str]) -> DataFrame:
    """Q5: keys whose row count is not one; missing keys are dropped."""
    keys = [key] if isinstance(key, str) else list(key)
    return (df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
              .groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
              .where(F.col("n_rows") != 1))


def distinct_values(df: DataFrame, column: str, sort: bool = True) -> DataFrame:
    """Q6 / Q7: distinct values with null; sorted ascending, nulls last."""
    out = df.select(column).distinct()
    return out.orderBy(F.col(column).asc_nulls_last()) if sort else out


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Q8: distinct non-null count per column, one row per column.

    Exact distinct counts of several columns in one ``agg`` make Spark expand
    every row once per column; counting per column over (column, value)
    pairs instead keeps one shuffle of at most (#columns x #values) rows.
    """
    columns = columns or df.columns
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in columns])).alias("p")).select("p.*")
    return (pairs.where(F.col("value").isNotNull()).distinct()
                 .groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct")))


def distinct_combinations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct combinations of ``columns`` (nulls equal)."""
    return df.select(*columns).dropDuplicates()


def fd_violations(df: DataFrame, key: str | list[str], dependent: str) -> DataFrame:
    """Q26: keys with more than one distinct non-null dependent value.

    Done as two aggregates over (key, value) pairs: the first is combined
    map-side, so a hot key costs one row per distinct value.
    """
    keys = [key] if isinstance(key, str) else list(key)
    notnull = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    pairs = (df.where(notnull & F.col(dependent).isNotNull())
               .select(*keys, dependent).distinct())
    return (pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"))
                 .where(F.col("n_values") > 1))
