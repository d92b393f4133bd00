"""Price verdicts of items with very many periods."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlint.operators import validity as V
from ledgerlint.schema import REFERENCE_COLUMNS as RC


def master(spark, rows):
    return spark.createDataFrame(rows, "Item string, `Price Per Unit` double, Start_date string, End_date string")


def facts(spark, rows):
    return spark.createDataFrame(rows, f"id long, `{RC.item}` string, `{RC.price}` double, `{RC.date}` string") \
        .withColumn(f"{RC.date}_validity", F.col(RC.date).isNotNull())


def periods(n, seed):
    rng = np.random.default_rng(seed)
    start = np.datetime64("2000-01-01") + rng.integers(0, 8000, n)
    end = start + rng.integers(-2, 40, n)
    price = rng.integers(1, 400, n) / 4.0
    rows = [("hot", float(p), str(s), str(e)) for p, s, e in zip(price, start, end)]
    return rows + [("hot", 500.0, "1990-05-01", "9999-12-31"), ("hot", 501.0, "", "9"), ("hot", 502.0, None, "2020-01-01"),
                   ("hot", None, "2000-01-01", "2020-01-01"), ("cold", 3.0, "2001-01-01", "2001-12-31"), (None, 1.0, "2000-01-01", "2001-01-01")]


def asked(n, seed):
    rng = np.random.default_rng(seed)
    day = np.datetime64("1999-06-01") + rng.integers(0, 8500, n)
    rows = [(i, ["hot", "cold", "none", None][int(rng.integers(0, 12)) // 9 + int(rng.integers(0, 2)) * (i % 7 == 0)],
             float(rng.integers(1, 400) / 4.0), str(d)) for i, d in enumerate(day)]
    return rows + [(n, "hot", 500.0, "2500-01-31"), (n + 1, "hot", 500.0, "1990-04-30"), (n + 2, "hot", 501.0, "2004-01-01"),
                   (n + 3, "hot", 502.0, "2004-01-01"), (n + 4, "hot", -1.0, "2004-01-01"), (n + 5, "hot", 2.0, None),
                   (n + 6, "hot", None, "2004-01-01"), (n + 7, "cold", 3.0, "2001-12-31")]


def verdicts(spark, rows, table, **more):
    out = V.price_rule_input(facts(spark, rows), master(spark, table), RC, **more)
    return {r.id: r[f"{RC.price}_validity"] for r in out.collect()}, out


@pytest.mark.parametrize("broadcast", [64 << 20, 0])
def test_same_verdicts_by_index(spark, broadcast):
    rows, table = asked(1500, 1), periods(3000, 2)
    plain, _ = verdicts(spark, rows, table, max_periods=10 ** 9)
    indexed, _ = verdicts(spark, rows, table, max_broadcast_bytes=broadcast)
    assert plain == indexed and {"True", "False", "CANT CHECK", None} <= set(plain.values())
    assert plain[1500] == "True" and plain[1501] == "False" and plain[1502] == "True"


def test_a_hundred_thousand_periods(spark):
    table, rows = periods(100_000, 3), asked(300, 4)
    got, out = verdicts(spark, rows, table)
    by_price = {}
    for item, p, s, e in table:
        by_price.setdefault((item, p), []).append((s, e))
    for i, item, x, d in rows:
        if item and d and x and x > 0:
            hit = any(s is not None and s <= d <= e for s, e in by_price.get((item, x), []))
            assert got[i] == ("True" if hit else "False")
    # no array of an item holds its periods: those of the index are bounded by the days of a month
    short, long = V.period_index(master(spark, table).select(
        F.col("Item").alias("__m_item"), F.col("Price Per Unit").alias("p"), F.col("Start_date").alias("s"),
        F.col("End_date").alias("e")).where(F.col("s").rlike(V.ISO_DATE)))
    assert short.agg(F.max(F.size("__m_stretches"))).first()[0] <= 31
    assert long.agg(F.max(F.size("__m_long"))).first()[0] == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_second_join_without_hot_items(spark):
    _, out = verdicts(spark, asked(20, 5), [("hot", 2.0, "2000-01-01", "2009-01-01")])
    assert "__m_stretches" not in out._jdf.queryExecution().executedPlan().toString()
