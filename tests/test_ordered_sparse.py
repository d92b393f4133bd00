"""Lags over blocks with halos and sparse one-hot against plain windows and pandas."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlint.operators.ordered import lags_leads, numbered
from ledgerlint.operators.sparse import level_slots, one_hot_cells, sparse_one_hot


def _series(spark, n):
    # one key holds a third of the rows, one is null, others have a row or two
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 40).cast("string")))
    return spark.range(n).select(key.alias("k"), F.col("id").alias("t"), (F.col("id") * 37 % 101).alias("v`x"))


@pytest.mark.parametrize("block,ranges", [(1, 5), (7, 3), (100, 8), (1 << 16, None)])
def test_lags_equal_window(spark, block, ranges):
    df = _series(spark, 500)
    got = lags_leads(df, ["k"], ["t"], ["v`x"], 3, 2, "v`x", block, ranges)
    w = Window.partitionBy("k").orderBy("t")
    v = F.col("`v``x`")
    want = df.select("*", *[F.lag(v, i).over(w).alias(f"v`x_t-{i}") for i in (1, 2, 3)],
                     *[F.lead(v, i).over(w).alias(f"y_{i}") for i in (1, 2)])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_lags_of_one_series_and_edges(spark):
    df = spark.range(50).select(F.col("id").alias("t"), (-F.col("id")).alias("v"))
    got = {r.t: r for r in lags_leads(df, [], ["t"], ["v"], 2, 1, "v", 4, 6).collect()}
    assert all(got[i]["v_t-2"] == (None if i < 2 else 2 - i) and got[i].y_1 == (None if i == 49 else -i - 1) for i in range(50))
    assert lags_leads(df.limit(0), [], ["t"], ["v"], 2, 1, "v").count() == 0
    assert lags_leads(df, [], ["t"], ["v"], 0, 0).columns == ["t", "v"]
    with pytest.raises(ValueError):
        lags_leads(df, [], ["t"], ["v"], 1, 1)


def test_lags_plan_has_no_single_partition(spark):
    df = _series(spark, 500)
    plan = lags_leads(df, [], ["t"], ["v`x"], 2, 0, None, 50)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan


def test_numbers_are_gapless(spark):
    rows = numbered(_series(spark, 300), ["k", "t"], "n", 7).collect()
    assert sorted(r.n for r in rows) == list(range(300))
    in_order = sorted(rows, key=lambda r: r.n)
    assert [(r.k or "", r.t) for r in in_order] == sorted((r.k or "", r.t) for r in rows)


def test_sparse_one_hot(spark):
    rows = [(1, "a", "x", 0.5, True), (2, None, "y", None, False), (2, None, "y", None, False), (3, "b", "x", 1.5, None)]
    df = spark.createDataFrame(rows, "id int, c string, d string, n double, target boolean")
    slots = level_slots(df, ["c", "d"])
    assert {(r.column, r.level): r.slot for r in slots.collect()} == {
        ("c", "a"): 0, ("c", "b"): 1, ("c", "nan"): 2, ("d", "x"): 3, ("d", "y"): 4}
    out = sparse_one_hot(df, ["c", "d"], slots, ["id", "n"], "target")
    assert out.columns == ["id", "n", "features", "target"]
    got = sorted((r.id, r.features.size, r.features.indices, r.features.values) for r in out.collect())
    assert got == [(1, 5, [0, 3], [1.0, 1.0]), (2, 5, [2, 4], [1.0, 1.0]), (2, 5, [2, 4], [1.0, 1.0]), (3, 5, [1, 3], [1.0, 1.0])]
    other = spark.createDataFrame([(9, "unseen", "y", 0.0, True)], df.schema)
    assert sparse_one_hot(other, ["c", "d"], slots, ["id"]).first().features.indices == [4]
    assert one_hot_cells(out, ["id"]).count() == 8
    assert level_slots(df.limit(0), ["c"]).count() == 0 and sparse_one_hot(df.limit(0), ["c"], slots).count() == 0
