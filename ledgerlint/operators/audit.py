"""Full row-level audit (Q20): uniqueness, completeness, validity.

Plan: one hash exchange for uniqueness, one broadcast (size-proven) or
shuffled join for the price master, everything else is projection inside
whole-stage codegen. No per-row Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlint.operators import validity as V
from ledgerlint.operators.completeness import add_completeness_flags
from ledgerlint.operators.uniqueness import flag_first_occurrence, with_row_order
from ledgerlint.schema import REFERENCE_COLUMNS, REFERENCE_RULES, Columns, RuleSet

UNIQUENESS_FLAG = "uniqueness_flag"


def add_uniqueness(df: DataFrame, order_cols: list[str] | None = None,
                   key_cols: list[str] | None = None, passes: int = 1) -> DataFrame:
    """Add ``uniqueness_flag`` (Q4). ``passes=2`` reproduces the test sheet's
    double application: the second pass sees the first flag as a key."""
    own_order = order_cols is None
    if own_order:
        df = with_row_order(df)
        order_cols = ["__row_order"]
    keys = key_cols or [c for c in df.columns if c not in order_cols and c != UNIQUENESS_FLAG]
    out = df
    for i in range(passes):
        k = keys + ([UNIQUENESS_FLAG] if UNIQUENESS_FLAG in out.columns else [])
        base = out.withColumnRenamed(UNIQUENESS_FLAG, "__prev_flag") if UNIQUENESS_FLAG in out.columns else out
        k = [("__prev_flag" if c == UNIQUENESS_FLAG else c) for c in k]
        out = flag_first_occurrence(base, k, order_cols, UNIQUENESS_FLAG)
        if "__prev_flag" in out.columns:
            out = out.drop("__prev_flag")
    if own_order:
        out = out.drop("__row_order")
    return out


def audit(df: DataFrame, master: DataFrame, cols: Columns = REFERENCE_COLUMNS,
          rules: RuleSet = REFERENCE_RULES, order_cols: list[str] | None = None,
          uniqueness_passes: int = 1, max_broadcast_bytes: int = 64 << 20,
          total_tolerance: float | None = None, uniqueness: bool = True) -> DataFrame:
    """Annotate every row with the reference's 34-column audit.

    ``order_cols`` names the row-id columns (excluded from the checks and
    used for "first occurrence"); without them file order is used.
    ``uniqueness=False`` leaves the uniqueness flag and its shuffles out.
    """
    data_cols = [c for c in df.columns if c not in (order_cols or [])]
    out = add_uniqueness(df, order_cols, key_cols=data_cols, passes=uniqueness_passes) if uniqueness else df
    out = add_completeness_flags(out, data_cols)
    out = V.add_validity_columns(out, V.simple_rules(cols, rules))
    out = out.select("*", V.item_rule(out, cols, rules).alias(f"{cols.item}_validity"))
    out = V.price_rule_input(out, master, cols, max_broadcast_bytes)
    out = out.select("*", V.total_rule(out, cols, total_tolerance).alias(f"{cols.total}_validity"))
    return out


def validity_column_order(cols: Columns = REFERENCE_COLUMNS) -> list[str]:
    """Validity columns in output order: simple rules, then item, price, total."""
    simple = list(V.simple_rules(cols).keys())
    return [f"{c}_validity" for c in simple + [cols.item, cols.price, cols.total]]


def verdict_counts(audited: DataFrame, cols: Columns = REFERENCE_COLUMNS) -> DataFrame:
    """Per validity column: counts of True, False, CANT CHECK and missing.

    One pass; verdicts of any type are compared through their text form.
    """
    names = validity_column_order(cols)
    aggs = []
    for n in names:
        t = F.col(f"`{n}`").cast("string")
        aggs += [F.count_if(F.lower(t) == "true").alias(f"{n}__n_true"),
                 F.count_if(F.lower(t) == "false").alias(f"{n}__n_false"),
                 F.count_if(t == V.CANT_CHECK).alias(f"{n}__n_cant_check"),
                 F.count_if(t.isNull()).alias(f"{n}__n_missing")]
    wide = audited.agg(*aggs)
    parts = [F.struct(F.lit(n).alias("column"),
                      *[F.col(f"`{n}__{v}`").alias(v)
                        for v in ("n_true", "n_false", "n_cant_check", "n_missing")])
             for n in names]
    return wide.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
