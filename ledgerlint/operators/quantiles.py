"""Exact quantiles and modes with bounded memory per task.

Spark's exact ``percentile`` keeps a value -> count map; for an ungrouped
quantile the final merge holds every distinct value of the column in one
task. Here the work is split instead:

1. count rows per (group, value), combined map-side: a value held by a third
   of the table is one row per task before the shuffle;
2. range-partition those counts by (group, value), so a group with very many
   distinct values spans several tasks;
3. running counts in each partition and the totals of the partitions before
   it give every value's ranks; the ranks around each wanted position stay.

Several columns are groups of one long table, so all of them take one pass.
The result uses linear interpolation between the two neighbouring ranks,
as ``percentile`` and the reference do.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlint.session import cut_lineage


def _num(df: DataFrame, column: str):
    """Numeric value of a column; text that is not a number becomes null."""
    from ledgerlint.functions.scalars import as_number
    return as_number(df, column)


def exact_quantiles(df: DataFrame, column: str, probs) -> list:
    """Exact quantiles of ``column`` (nulls and NaN ignored); ``None`` when empty."""
    return exact_quantiles_multi(df, [column], probs)[column]


def exact_quantiles_multi(df: DataFrame, columns: list[str], probs) -> dict:
    """``exact_quantiles`` for several columns from one pass over ``df``; one
    row per column comes back to the driver."""
    probs = list(probs)
    if not columns:
        return {}
    parts = [F.struct(F.lit(c).alias("k"), _num(df, c).cast("double").alias("v")) for c in columns]
    long = df.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    return _by_column(grouped_quantiles(long, ["k"], "v", probs), columns, probs)


def _by_column(per: DataFrame, columns: list[str], probs: list) -> dict:
    found = {r["k"]: [r[f"q{i}"] for i in range(len(probs))] for r in per.collect()}
    return {c: found.get(c, [None] * len(probs)) for c in columns}


def exact_mode(df: DataFrame, column: str):
    """Most frequent non-null value, the smallest on ties.

    Counting per value is a distributed aggregate; the pick is two bounded
    global aggregates (the top count, then the smallest value having it),
    so no task holds the set of distinct values.
    """
    counts = (df.where(F.col(f"`{column}`").isNotNull())
                .groupBy(F.col(f"`{column}`").alias("v")).agg(F.count(F.lit(1)).alias("c")))
    counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        top = counts.agg(F.max("c")).first()[0]
        if top is None:
            return None
        return counts.where(F.col("c") == F.lit(top)).agg(F.min("v")).first()[0]
    finally:
        counts.unpersist()


def grouped_quantiles(df: DataFrame, keys: list[str], column: str, probs,
                      prefix: str = "q", ranges: int | None = None) -> DataFrame:
    """Exact quantiles per group: one row per group, one column per prob."""
    counts = (df.select(*[F.col(f"`{k}`") for k in keys], _num(df, column).alias("__v"))
                .where(F.col("__v").isNotNull() & ~F.isnan(F.col("__v")))
                .groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c")))
    return quantiles_of_counts(counts, keys, probs, prefix, ranges)


def quantiles_of_counts(counts: DataFrame, keys: list[str], probs, prefix: str = "q",
                        ranges: int | None = None) -> DataFrame:
    """Quantiles per group of a (keys, ``__v``, ``__c``) table of counts.

    1. The counts are range-partitioned by (group, value) and cut from the
       lineage, so every later step sees the same partitions. AQE sizes the
       ranges by bytes unless their number is given.
    2. Per (partition, group): the rows before it in its group (a running
       sum over partition totals, one row per partition a group touches)
       plus a running count inside the partition give each value's rank span.
    3. The two ranks around each position are picked and interpolated.
    """
    by = [*keys, "__v"]
    ranged = counts.repartitionByRange(ranges, *by) if ranges else counts.repartitionByRange(*by)
    ranged = cut_lineage(ranged.withColumn("__pid", F.spark_partition_id()))
    per_part = ranged.groupBy("__pid", *keys).agg(F.sum("__c").alias("__s"))
    before = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (per_part.withColumn("__off", F.coalesce(F.sum("__s").over(before), F.lit(0)))
                       .withColumn("__n", F.sum("__s").over(Window.partitionBy(*keys)))
                       .drop("__s"))
    running = Window.partitionBy("__pid", *keys).orderBy("__v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    cum = (ranged.withColumn("__lcum", F.sum("__c").over(running))
                 .join(offsets, ["__pid", *keys])
                 .withColumn("__cum", F.col("__off") + F.col("__lcum")))
    aggs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("__n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        start = F.col("__cum") - F.col("__c")
        aggs += [F.max(F.when((start <= lo) & (lo < F.col("__cum")), F.col("__v"))).alias(f"__lo{i}"),
                 F.max(F.when((start <= hi) & (hi < F.col("__cum")), F.col("__v"))).alias(f"__hi{i}"),
                 F.first(pos).alias(f"__pos{i}")]
    per = cum.groupBy(*keys).agg(*aggs)
    outs = []
    for i, p in enumerate(probs):
        pos, lo, hi = F.col(f"__pos{i}"), F.col(f"__lo{i}"), F.col(f"__hi{i}")
        val = F.when(F.floor(pos) == F.ceil(pos), lo).otherwise(
            (F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi)
        outs.append(val.alias(f"{prefix}{i}"))
    return per.select(*keys, *outs)


def exact_modes(df: DataFrame, columns: list[str]) -> dict:
    """``exact_mode`` for several columns from one pass over ``df``.

    Columns are grouped by type; each group's (column, value) counts are one
    aggregate (persisted), then the top count per column and the smallest
    value having it are two bounded aggregates over those counts.
    """
    out = {}
    by_type: dict = {}
    for c in columns:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for dtype, cols in by_type.items():
        parts = [F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").alias("v")) for c in cols]
        counts = (df.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
                    .where(F.col("v").isNotNull())
                    .groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
                    .persist(StorageLevel.MEMORY_AND_DISK))
        try:
            tops = {r["k"]: r["m"] for r in counts.groupBy("k").agg(F.max("c").alias("m")).collect()}
            if tops:
                cond = None
                for k, m in tops.items():
                    e = (F.col("k") == F.lit(k)) & (F.col("c") == F.lit(m))
                    cond = e if cond is None else cond | e
                for r in counts.where(cond).groupBy("k").agg(F.min("v").alias("v")).collect():
                    out[r["k"]] = r["v"]
        finally:
            counts.unpersist()
    return {c: out.get(c) for c in columns}


def column_value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One pass: (k, vnum, vtxt, c) = rows per column and value, nulls kept.

    Numeric columns fill ``vnum`` (NaN counted as missing), all others
    ``vtxt``. The table is cut from the lineage (shared checkpoint folder):
    null ratios, quantiles and modes are then read from it without another
    scan of ``df``.
    """
    from pyspark.sql import types as T
    numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
               T.DecimalType)
    parts = []
    for c in columns:
        x = F.col(f"`{c}`")
        if isinstance(df.schema[c].dataType, numeric):
            v = x.cast("double")
            parts.append(F.struct(F.lit(c).alias("k"), F.when(~F.isnan(v), v).alias("vnum"),
                                  F.lit(None).cast("string").alias("vtxt")))
        else:
            parts.append(F.struct(F.lit(c).alias("k"), F.lit(None).cast("double").alias("vnum"),
                                  x.cast("string").alias("vtxt")))
    pairs = df.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    return cut_lineage(pairs.groupBy("k", "vnum", "vtxt").agg(F.count(F.lit(1)).alias("c")))


def profile_from_counts(counts: DataFrame, numeric: list[str], text: list[str], probs=(0.5,)) -> dict:
    """Null counts and row totals for every column, quantiles of ``numeric``
    and modes of ``text``, all from a ``column_value_counts`` table."""
    probs = list(probs)
    totals = {r["k"]: (r["rows"], r["nulls"]) for r in counts.groupBy("k").agg(
        F.sum("c").alias("rows"),
        F.sum(F.when(F.col("vnum").isNull() & F.col("vtxt").isNull(), F.col("c")).otherwise(F.lit(0))).alias("nulls"),
    ).collect()}
    quant = {}
    if numeric:
        values = (counts.where(F.col("k").isin(numeric) & F.col("vnum").isNotNull())
                        .select("k", F.col("vnum").alias("__v"), F.col("c").alias("__c")))
        quant = _by_column(quantiles_of_counts(values, ["k"], probs), numeric, probs)
    modes = {}
    if text:
        txt = counts.where(F.col("k").isin(text) & F.col("vtxt").isNotNull())
        tops = {r["k"]: r["m"] for r in txt.groupBy("k").agg(F.max("c").alias("m")).collect()}
        if tops:
            cond = None
            for k, m in tops.items():
                e = (F.col("k") == F.lit(k)) & (F.col("c") == F.lit(m))
                cond = e if cond is None else cond | e
            modes = {r["k"]: r["v"] for r in txt.where(cond).groupBy("k").agg(F.min("vtxt").alias("v")).collect()}
    return {"totals": totals, "quantiles": quant, "modes": {c: modes.get(c) for c in text}}
