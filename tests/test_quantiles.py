"""Exact bounded-memory quantiles agree with Spark's exact percentile."""

import random

from pyspark.sql import functions as F

from ledgerlint.operators.quantiles import exact_mode, exact_quantiles, exact_quantiles_multi, grouped_quantiles


def _frame(spark):
    random.seed(3)
    rows = [(random.choice("abc"), random.random() * 100 if random.random() > 0.1 else None, random.randint(0, 9))
            for _ in range(5000)]
    rows += [("a", 5.0, 1)] * 2000  # a hot value
    return spark.createDataFrame(rows, "g string, x double, y int")


def test_global_quantiles(spark):
    df = _frame(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    ref = df.agg(F.percentile("x", probs)).first()[0]
    got = exact_quantiles(df, "x", probs)
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, ref, strict=True))


def test_multi_and_mode(spark):
    df = _frame(spark)
    got = exact_quantiles_multi(df, ["x", "y"], [0.5])
    ref = df.agg(F.percentile("x", 0.5), F.percentile("y", 0.5)).first()
    assert abs(got["x"][0] - ref[0]) < 1e-9 and abs(got["y"][0] - ref[1]) < 1e-9
    assert exact_mode(df, "y") == df.agg(F.mode("y", deterministic=True)).first()[0]


def test_grouped(spark):
    df = _frame(spark)
    got = {r["g"]: (r["q0"], r["q1"]) for r in grouped_quantiles(df, ["g"], "x", [0.25, 0.9]).collect()}
    ref = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.percentile("x", [0.25, 0.9]).alias("p")).collect()}
    assert got.keys() == ref.keys()
    for k in ref:
        assert abs(got[k][0] - ref[k][0]) < 1e-9 and abs(got[k][1] - ref[k][1]) < 1e-9


def test_empty(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, "x", [0.5]) == [None]
    assert exact_mode(df, "x") is None


def test_grouped_hot_group_split_over_tasks(spark):
    df = _frame(spark)
    got = {r["g"]: r["q0"] for r in grouped_quantiles(df, ["g"], "x", [0.5], ranges=12).collect()}
    ref = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.percentile("x", 0.5).alias("p")).collect()}
    assert all(abs(got[k] - ref[k]) < 1e-9 for k in ref)


def test_modes_across_types(spark):
    from ledgerlint.operators.quantiles import exact_modes
    df = spark.createDataFrame([("b", 2, 1.5), ("a", 2, 1.5), ("a", 3, 2.5), ("b", 3, None), (None, 1, 2.5)],
                               "s string, i int, d double")
    got = exact_modes(df, ["s", "i", "d"])
    ref = df.agg(*[F.mode(c, deterministic=True).alias(c) for c in ["s", "i", "d"]]).first()
    assert got == {"s": ref["s"], "i": ref["i"], "d": ref["d"]} == {"s": "a", "i": 2, "d": 1.5}
