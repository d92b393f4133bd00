"""Structured Streaming forms of the audit and of weekly totals (2.15).

The row-level rules are stateless, so they run on a stream unchanged; the
price master joins as a stream-static join (broadcast under a proven size
bound). Weekly totals use an event-time window that starts on Mondays,
a watermark to bound state, and ``approx_count_distinct`` (exact distinct
counts would keep every id in state).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlint.operators import validity as V
from ledgerlint.operators.completeness import add_completeness_flags
from ledgerlint.schema import REFERENCE_COLUMNS, REFERENCE_RULES, Columns, RuleSet

# 1970-01-01 was a Thursday: shifting 7-day windows by 4 days starts them on Mondays.
MONDAY_OFFSET = "4 days"


def audit_stream(stream: DataFrame, master: DataFrame, cols: Columns = REFERENCE_COLUMNS,
                 rules: RuleSet = REFERENCE_RULES, data_cols: list[str] | None = None,
                 max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Completeness and validity (all but row uniqueness) on a stream."""
    data_cols = data_cols or cols.all()
    out = add_completeness_flags(stream, data_cols)
    out = V.add_validity_columns(out, V.simple_rules(cols, rules))
    out = out.select("*", V.item_rule(out, cols, rules).alias(f"{cols.item}_validity"))
    out = V.price_rule_input(out, master, cols, max_broadcast_bytes)
    return out.select("*", V.total_rule(out, cols).alias(f"{cols.total}_validity"))


def dedupe_stream(stream: DataFrame, key_cols: list[str], event_time: str,
                  watermark: str = "1 day") -> DataFrame:
    """Row uniqueness on a stream: first copy within the watermark kept."""
    return stream.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(key_cols)


def weekly_totals_stream(stream: DataFrame, event_time: str, value: str, key: str,
                         watermark: str = "1 day") -> DataFrame:
    """Monday-based weekly sum, row count and approximate distinct keys."""
    w = F.window(F.col(event_time), "7 days", "7 days", MONDAY_OFFSET)
    # watermarks need TIMESTAMP; the driver's event times are TIMESTAMP_NTZ
    stream = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return (stream.withWatermark(event_time, watermark)
                  .groupBy(w.alias("week"))
                  .agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n_rows"),
                       F.approx_count_distinct(key).alias("approx_distinct"))
                  .select(F.date_format(F.col("week.start"), "yyyy-MM-dd").alias("Year_Week"),
                          "total", "n_rows", "approx_distinct"))
