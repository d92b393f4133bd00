"""Weekly feature table (E1: G1-G4, J2, W1, W2, P6).

Plan (one evaluation of the source, three partially aggregated shuffles):

1. The narrow weekly projection (8 columns) is stored, so a joined
   source is evaluated once for the pivot levels and all three branches.
2. Each branch aggregates at its own grain, combined map-side (a hot
   transaction or customer is one row per task before its shuffle): by
   week for the sums (a tiny shuffle), by (week, transaction) for the
   distinct-transaction pivots, by (week, customer) for distinct customers
   and the repeat ratio.
3. The three week-level tables (one row per week; bounded by the calendar,
   not by the data) are joined on the week key and cut from the lineage.
4. Lags and leads run over that small table with one window ordered by
   week; the un-partitioned window only ever sees one row per week.

This avoids the ``Expand`` that many exact distinct counts in one ``agg``
would cause (one copy of every input row per distinct expression).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlint.functions import scalars as S
from ledgerlint.schema import REFERENCE_COLUMNS, Columns
from ledgerlint.session import cut_lineage, stored

WEEK = "Year_Week"
BASE_FEATURES = ("weekly_avg_repeat_purchases", "total_sales", "unique_transactions",
                 "unique_customers", "discounted_transactions")


def pivot_levels(df: DataFrame, columns: list[str]) -> dict:
    """Sorted distinct non-null values of several pivot columns in one job.

    Levels become output columns, so all of them are read; callers who know
    them pass them instead.
    """
    parts = [F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns]
    pairs = (df.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
               .where(F.col("v").isNotNull()).distinct())
    out = {c: [] for c in columns}
    for r in pairs.collect():
        out[r["c"]].append(r["v"])
    return {c: sorted(v) for c, v in out.items()}


def _prepared(df: DataFrame, cols: Columns) -> DataFrame:
    d = S.to_date_any(df, cols.date)
    return df.select(
        S.week_start(d).alias(WEEK),
        F.col(f"`{cols.transaction_id}`").alias("__txn"),
        F.col(f"`{cols.customer_id}`").alias("__cust"),
        S.as_number(df, cols.total).alias("__total"),
        S.text_to_flag(F.col(f"`{cols.discount}`")).alias("__disc"),
        F.col(f"`{cols.category}`").alias("__cat"),
        F.col(f"`{cols.payment}`").alias("__pay"),
        F.col(f"`{cols.location}`").alias("__loc"),
    ).where(F.col(WEEK).isNotNull())


def weekly_aggregates(df: DataFrame, cols: Columns = REFERENCE_COLUMNS,
                      categories: list | None = None, payments: list | None = None,
                      locations: list | None = None, checkpoint: bool = True,
                      persist_input: bool = True, on_clash: str = "raise") -> DataFrame:
    """One row per week: the 5 base features, one total per category, one
    distinct-transaction count per payment method and per location.

    Pivot levels default to the values present (collected once).
    A week with no non-null key in a pivot gets nulls for that pivot; a
    level absent in a week that has others gets 0.

    A level that repeats a name already present (another pivot's level or a
    base feature) is rejected with ``on_clash="raise"``; ``"suffix"`` names
    the earlier column ``<name>_x`` and the later ``<name>_y``, as a chain of
    left merges would.
    """
    base = _prepared(df, cols)
    if persist_input:
        # one evaluation of the (possibly joined) source feeds all branches
        base = stored(base)
    missing = [c for c, v in (("__cat", categories), ("__pay", payments), ("__loc", locations)) if v is None]
    found = pivot_levels(base, missing) if missing else {}
    categories = list(categories) if categories is not None else found["__cat"]
    payments = list(payments) if payments is not None else found["__pay"]
    locations = list(locations) if locations is not None else found["__loc"]

    # sums per week: partial aggregation leaves one row per week per task
    wk_sum = base.groupBy(WEEK).agg(
        F.coalesce(F.sum("__total"), F.lit(0.0)).alias("total_sales"),
        F.sum("__disc").cast("long").alias("discounted_transactions"),
        F.max(F.col("__cat").isNotNull()).alias("cat_any"),
        F.max(F.col("__pay").isNotNull()).alias("pay_any"),
        F.max(F.col("__loc").isNotNull()).alias("loc_any"),
        *[F.sum(F.when(F.col("__cat") == F.lit(v), F.col("__total"))).alias(f"c{i}")
          for i, v in enumerate(categories)])

    # distinct transactions, overall and per payment / location level
    pay_loc = [f"p{i}" for i in range(len(payments))] + [f"l{i}" for i in range(len(locations))]
    by_txn = (base.where(F.col("__txn").isNotNull()).groupBy(WEEK, "__txn").agg(
        F.lit(1).alias("one"), *[F.max(F.col("__pay") == F.lit(v)).alias(f"p{i}") for i, v in enumerate(payments)],
        *[F.max(F.col("__loc") == F.lit(v)).alias(f"l{i}") for i, v in enumerate(locations)]))
    wk_txn = by_txn.groupBy(WEEK).agg(
        F.count(F.lit(1)).alias("unique_transactions"),
        *[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in pay_loc])

    # distinct customers; null counts as one value for the repeat ratio
    by_cust = base.groupBy(WEEK, "__cust").agg(F.count(F.lit(1)).alias("n"))
    wk_cust = by_cust.groupBy(WEEK).agg(
        F.count(F.lit(1)).alias("__groups"), F.count("__cust").alias("unique_customers"),
        F.sum("n").alias("__rows"))

    j = wk_sum.join(wk_cust, WEEK, "left").join(wk_txn, WEEK, "left")
    out = [F.col(WEEK),
           (F.lit(1.0) - F.col("__groups") / F.col("__rows")).alias("weekly_avg_repeat_purchases"),
           F.col("total_sales"),
           F.coalesce(F.col("unique_transactions"), F.lit(0)).cast("long").alias("unique_transactions"),
           F.col("unique_customers").cast("long").alias("unique_customers"),
           F.col("discounted_transactions")]
    names = [WEEK, *BASE_FEATURES]
    groups = [
        [(str(v), F.when(F.col("cat_any"), F.coalesce(F.col(f"c{i}"), F.lit(0.0))))
         for i, v in enumerate(categories)],
        [(str(v), F.when(F.col("pay_any"), F.coalesce(F.col(f"p{i}"), F.lit(0)).cast("long")))
         for i, v in enumerate(payments)],
        [(str(v), F.when(F.col("loc_any"), F.coalesce(F.col(f"l{i}"), F.lit(0)).cast("long")))
         for i, v in enumerate(locations)],
    ]
    exprs = list(zip(names, out))
    for group in groups:
        clash = {n for n, _ in group} & {n for n, _ in exprs}
        if clash and on_clash == "raise":
            raise ValueError(f"weekly pivot columns clash with existing columns: {sorted(clash)}; "
                             "pass on_clash='suffix' or rename the levels")
        exprs = [((f"{n}_x" if n in clash else n), e) for n, e in exprs]
        exprs += [((f"{n}_y" if n in clash else n), e) for n, e in group]
    weekly = j.select(*[e.alias(n) for n, e in exprs])
    if not checkpoint:
        return weekly
    return cut_lineage(weekly)


def add_lags_leads(weekly: DataFrame, n_past: int, n_future: int,
                   target: str = "total_sales", features: list | None = None) -> DataFrame:
    """``{f}_t-{i}`` for i in 1..n_past (by row, not by calendar:
    a missing week is skipped) and ``y_{i}`` = target i rows ahead."""
    features = features or [c for c in weekly.columns if c != WEEK]

    def q(name):
        return "`" + name.replace("`", "``") + "`"

    # One window expression per offset (a struct of all features) instead of
    # one per (feature, offset), and the projections as SQL text in a single
    # call: the plan stays small and quick to build for hundreds of columns.
    over = f"OVER (ORDER BY {q(WEEK)})"
    packed = "named_struct(" + ", ".join(f"'f{j}', {q(c)}" for j, c in enumerate(features)) + ")"
    step = weekly.selectExpr(
        "*", *[f"lag({packed}, {i}) {over} AS {q(f'__lag{i}')}" for i in range(1, n_past + 1)],
        *[f"lead({q(target)}, {i}) {over} AS {q(f'y_{i}')}" for i in range(1, n_future + 1)])
    lags = [f"{q(f'__lag{i}')}.f{j} AS {q(f'{c}_t-{i}')}"
            for j, c in enumerate(features) for i in range(1, n_past + 1)]
    return step.selectExpr(*[q(c) for c in weekly.columns], *lags,
                           *[q(f"y_{i}") for i in range(1, n_future + 1)])


def week_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Keep weeks with ``start <= Year_Week <= end``, compared as text.

    ``end='2024-01'`` excludes every January 2024 week: longer text sorts
    after its prefix (as in the reference).
    """
    if start:
        df = df.where(F.col(WEEK) >= F.lit(start))
    if end:
        df = df.where(F.col(WEEK) <= F.lit(end))
    return df


def weekly_features(df: DataFrame, cols: Columns = REFERENCE_COLUMNS, n_past_week: int = 6,
                    n_future_week: int = 1, start_date: str | None = None,
                    end_date: str | None = None, categories: list | None = None,
                    payments: list | None = None, locations: list | None = None,
                    on_clash: str = "raise") -> DataFrame:
    """Weekly aggregates, lags and leads, then the week-range filter
    (applied after the window, so lags still see earlier weeks)."""
    weekly = weekly_aggregates(df, cols, categories, payments, locations, on_clash=on_clash)
    return week_range(add_lags_leads(weekly, n_past_week, n_future_week), start_date, end_date)


def fit_target(df: DataFrame, columns: list[str], integer_columns: list[str],
               key: str = WEEK) -> DataFrame:
    """Keep the target's columns in its order, typed INTEGER (long),
    TEXT (the key) or FLOAT (double); a column the frame lacks is null."""
    out = []
    for c in columns:
        src = F.col(f"`{c}`") if c in df.columns else F.lit(None)
        if c == key:
            out.append(src.cast("string").alias(c))
        elif c in integer_columns:
            out.append(src.cast("long").alias(c))
        else:
            out.append(src.cast("double").alias(c))
    return df.select(*out)
