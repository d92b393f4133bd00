"""Repair (C1-C10): derive, look up and fill missing values; impute; cap.

Group-level fills use an aggregate (combined map-side, so a hot group is one
row before the shuffle) joined back on the key, never a window that would
put a hot group in one task. Lookups derived from the facts are left to
AQE, which broadcasts them only when their measured runtime size is under
the threshold (otherwise the join shuffles, with skew splitting).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlint.functions import scalars as S
from ledgerlint.operators.quantiles import (column_value_counts, exact_quantiles_multi,
                                            profile_from_counts)
from ledgerlint.schema import REFERENCE_COLUMNS, Columns
from ledgerlint.session import sized_broadcast, stored


def _replace(df: DataFrame, name: str, value) -> DataFrame:
    """Replace column ``name`` in place (same position)."""
    return df.select(*[(value.alias(c) if c == name else F.col(f"`{c}`")) for c in df.columns])


def fill_price(df: DataFrame, cols: Columns = REFERENCE_COLUMNS) -> DataFrame:
    """Missing price = total / quantity (null when quantity is 0)."""
    p = F.col(f"`{cols.price}`")
    return _replace(df, cols.price, F.when(p.isNull() | F.isnan(p),
                                           S.safe_divide(F.col(f"`{cols.total}`"), F.col(f"`{cols.quantity}`")))
                    .otherwise(p))


def fill_item(df: DataFrame, order_cols: list[str], cols: Columns = REFERENCE_COLUMNS,
              keys: list[str] | None = None, materialize: bool = False) -> DataFrame:
    """Missing item = first item seen (row order) with the same price.

    ``keys`` defaults to ``[price]`` as in the reference; pass
    ``[price, category]`` for the category-aware variant. The lookup is
    derived from the facts, so by default no eager size check runs (it would
    recompute the whole input): AQE broadcasts it at runtime when its
    measured size is under the threshold, else the join shuffles. ``materialize`` writes the lookup (one row per price) to the checkpoint folder once, for
    chains where later steps would otherwise recompute it, and broadcasts it
    if its measured size allows, so that the rows are not shuffled by price.
    """
    keys = keys or [cols.price]
    order = F.struct(*[F.col(c) for c in order_cols])
    src = df.where(F.col(f"`{cols.item}`").isNotNull())
    for k in keys:
        src = src.where(F.col(f"`{k}`").isNotNull())
    lookup = (src.groupBy(*[F.col(f"`{k}`").alias(f"__fk{i}") for i, k in enumerate(keys)])
                 .agg(F.min_by(F.col(f"`{cols.item}`"), order).alias("__fill_item")))
    if materialize:
        lookup = sized_broadcast(lookup)
    cond = None
    for i, k in enumerate(keys):
        c = df[k] == lookup[f"__fk{i}"]
        cond = c if cond is None else cond & c
    j = df.join(lookup, cond, "left")
    item = df[cols.item]
    return j.select(*[(F.coalesce(item, F.col("__fill_item")).alias(c) if c == cols.item else df[c])
                      for c in df.columns])


def fill_by_group_mean(df: DataFrame, key: str, value: str, keep_keyless: bool = False,
                       materialize: bool = False) -> DataFrame:
    """Missing ``value`` = mean of ``value`` within its ``key`` group.

    As in the reference, rows whose key is missing lose their value (the
    group transform yields nothing for them); ``keep_keyless=True`` keeps it.
    """
    means = (df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("__gk"))
               .agg(F.avg(F.col(f"`{value}`")).alias("__gmean")))
    if materialize:
        means = sized_broadcast(means)
    j = df.join(means, df[key] == means["__gk"], "left")
    v = df[value]
    filled = F.when(v.isNull() | F.isnan(v), F.col("__gmean")).otherwise(v)
    if not keep_keyless:
        filled = F.when(df[key].isNotNull(), filled)
    return j.select(*[(filled.alias(c) if c == value else df[c]) for c in df.columns])


def recompute_total(df: DataFrame, cols: Columns = REFERENCE_COLUMNS) -> DataFrame:
    """C4: total = price x quantity for every row (given totals overwritten)."""
    return _replace(df, cols.total, F.col(f"`{cols.price}`") * F.col(f"`{cols.quantity}`"))


def fill_discount(df: DataFrame, cols: Columns = REFERENCE_COLUMNS) -> DataFrame:
    """Missing discount flag = False."""
    return _replace(df, cols.discount, F.coalesce(F.col(f"`{cols.discount}`"), F.lit(False)))


def full_repair(df: DataFrame, order_cols: list[str], cols: Columns = REFERENCE_COLUMNS,
                item_keys: list[str] | None = None) -> DataFrame:
    """C1 to C5 in order; each step sees the previous step's output.

    The rows are stored after the first step and the two lookups (one row per
    price, one per item) are written once to the checkpoint folder, so the
    source is read once, the stored rows three times (lookup, means, output)
    and no lookup aggregation runs twice.
    """
    out = stored(fill_price(df, cols))
    out = fill_item(out, order_cols, cols, keys=item_keys, materialize=True)
    out = fill_by_group_mean(out, cols.item, cols.quantity, materialize=True)
    out = recompute_total(out, cols)
    return fill_discount(out, cols)


def null_ratios(df: DataFrame, columns: list[str] | None = None) -> dict:
    """Percent missing per column (one aggregate, bounded result)."""
    columns = columns or df.columns
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(S.is_missing_value(df, c)).alias(c) for c in columns]).first()
    n = row["__n"]
    return {c: (100.0 * row[c] / n if n else 0.0) for c in columns}


def impute_generic(df: DataFrame, max_missing_pct: float = 20.0) -> DataFrame:
    """Drop columns more than ``max_missing_pct`` % missing; fill numeric
    columns with their median and text columns with their mode (smallest
    value on ties).

    Pass 1 is one aggregate of null counts. Pass 2 builds one (column,
    value, count) table for just the kept columns that have gaps, from which
    all medians and modes are read. Pass 3 writes the filled rows. The rows
    are stored first, so the source is read once.
    """
    df = stored(df)
    ratios = null_ratios(df)
    keep = [c for c in df.columns if ratios[c] <= max_missing_pct]
    need = [c for c in keep if ratios[c] > 0]
    num = [c for c in need if S.is_numeric_type(S.dtype_of(df, c))]
    txt = [c for c in need if isinstance(S.dtype_of(df, c), T.StringType)]
    fills = {}
    if num or txt:
        prof = profile_from_counts(column_value_counts(df, num + txt), num, txt, [0.5])
        fills = {c: prof["quantiles"][c][0] for c in num}
        fills.update(prof["modes"])
    out = []
    for c in keep:
        x = F.col(f"`{c}`")
        v = fills.get(c)
        if v is not None:
            out.append(F.when(S.is_missing_value(df, c), F.lit(v).cast(S.dtype_of(df, c))).otherwise(x).alias(c))
        else:
            out.append(x)
    return df.select(*out)


def iqr_bounds(df: DataFrame, columns: list[str], k: float = 1.5) -> dict:
    """Q1 - k IQR and Q3 + k IQR per column, from exact bounded-memory quartiles."""
    out = {}
    quarts = exact_quantiles_multi(df, columns, [0.25, 0.75])
    for c in columns:
        q = quarts[c]
        if q[0] is None:
            continue
        iqr = q[1] - q[0]
        out[c] = (q[0] - k * iqr, q[1] + k * iqr)
    return out


def cap_outliers(df: DataFrame, ignore: list[str] | None = None, k: float = 1.5,
                 return_affected: bool = False):
    """Clamp every double/long column (but ``ignore``) to its IQR fences.

    Nulls stay null. With ``return_affected`` also returns the columns that
    had a value outside the fences (one more aggregate).
    """
    ignore = set(ignore or [])
    numeric = [c for c, t in df.dtypes if t in ("double", "bigint", "int", "float") and c not in ignore]
    bounds = iqr_bounds(df, numeric, k)
    out = []
    for c in df.columns:
        if c in bounds:
            lo, hi = bounds[c]
            x = F.col(f"`{c}`")
            out.append(F.when(x < F.lit(lo), F.lit(lo)).when(x > F.lit(hi), F.lit(hi))
                        .otherwise(x.cast("double")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    capped = df.select(*out)
    if not return_affected:
        return capped
    row = df.agg(*[F.count_if((F.col(f"`{c}`") < lo) | (F.col(f"`{c}`") > hi)).alias(f"a{i}")
                   for i, (c, (lo, hi)) in enumerate(bounds.items())]).first() if bounds else {}
    affected = [c for i, c in enumerate(bounds) if row[f"a{i}"] > 0]
    return capped, affected


def iqr_outlier_rows(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows outside the IQR fences of ``column``, with the fences attached."""
    b = iqr_bounds(df, [column], k).get(column)
    if b is None:
        return df.limit(0)
    lo, hi = b
    x = F.col(f"`{column}`")
    return df.where((x < F.lit(lo)) | (x > F.lit(hi))) \
             .withColumn("lower_bound", F.lit(lo)).withColumn("upper_bound", F.lit(hi))


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to double, a bad value becomes null, then the row is dropped."""
    out = df.select(*[(F.col(f"`{c}`").cast("string").try_cast("double").alias(c) if c in columns
                       else F.col(f"`{c}`")) for c in df.columns])
    return out.na.drop(subset=list(columns))


def categories_as_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Categories to text; a missing value becomes the level ``nan``."""
    return df.select(*[(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")).alias(c) if c in columns
                        else F.col(f"`{c}`")) for c in df.columns])


def parse_dates_all_or_nothing(df: DataFrame, column: str) -> DataFrame:
    """Parse the column as dates when every present value parses; else
    leave it as text (one bounded aggregate decides)."""
    d = S.to_date_any(df, column)
    bad = df.agg(F.count_if(d.isNull() & F.col(f"`{column}`").isNotNull()).alias("bad")).first()["bad"]
    if bad:
        return df.select(*[(F.col(f"`{c}`").cast("string").alias(c) if c == column else F.col(f"`{c}`"))
                           for c in df.columns])
    return df.select(*[(d.alias(c) if c == column else F.col(f"`{c}`")) for c in df.columns])


def model_input_clean(df: DataFrame, target: str, numeric: list[str], categorical: list[str],
                      date_col: str | None) -> DataFrame:
    """Drop rows missing the target, coerce numbers (dropping bad
    rows), categories to text, dates parsed all-or-nothing."""
    out = df.na.drop(subset=[target])
    out = coerce_numeric(out, [c for c in numeric if c != target] + ([target] if target in numeric else []))
    out = categories_as_text(out, categorical)
    if date_col:
        out = parse_dates_all_or_nothing(out, date_col)
    return out
