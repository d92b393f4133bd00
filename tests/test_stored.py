"""Inputs that several passes read are joined once; small lookups are broadcast by measured size."""

import pytest
from pyspark.sql import functions as F

from ledgerlint.operators.uniqueness import flag_first_occurrence
from ledgerlint.plans.queries import queries
from ledgerlint.session import stored
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_gives_the_same_rows_and_columns(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (1, "x", -0.0), (None, "x", None)], "`a b` long, `c.d` string, e double")
    df = df.withColumn("s", F.struct("a b", F.lit(2).alias("two"))).withColumn("a b", F.col("a b").alias("a b", metadata={"k": 1}))
    out = stored(df)
    assert out.dtypes == df.dtypes
    assert out.schema["a b"].metadata == {"k": 1}
    assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert "parquet" in _plan(out).lower()
    void = stored(df.withColumn("v", F.lit(None)))
    assert void.count() == 3 and void.columns[-1] == "v"


@pytest.mark.parametrize("name", ["row_uniqueness", "full_audit", "full_repair", "one_hot", "one_hot_sparse", "impute_mean_mode",
                                  "impute_generic"])
def test_rows_are_not_shuffled_after_they_are_stored(spark, name):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(queries()[name](spark, SF_SMALL))
        assert "lineitem.parquet" not in plan and "orders.parquet" not in plan
        assert name == "one_hot_sparse" or "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_first_of_repeated_rows_with_and_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 5 if i % 3 else None, "x" if i < 40 else "y") for i in range(60)], "id long, k long, t string")
    seen, want = set(), {}
    for r in sorted(df.collect()):
        want[r.id] = (r.k, r.t) not in seen
        seen.add((r.k, r.t))
    for most in (64 << 20, -1):
        from ledgerlint.operators import uniqueness as U
        from ledgerlint.session import sized_broadcast
        monkeypatch.setattr(U, "sized_broadcast", lambda d, cut=True, m=most: sized_broadcast(d, m, cut))
        assert {r.id: r.uniqueness_flag for r in flag_first_occurrence(df, ["k", "t"], ["id"]).collect()} == want
