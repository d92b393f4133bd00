"""The co-moment matrix against numpy and against one expression per pair."""

import numpy as np

from ledgerlint.operators import aggregates as G
from ledgerlint.operators.comoments import correlation_blocks


def table(spark, n, m):
    rng = np.random.default_rng(6)
    x = rng.normal(1e6, 3.0, (n, m)) + np.arange(m) * rng.normal(0, 1, (n, 1))
    x[:, 3] = 7.25
    x[rng.random((n, m)) < .2] = np.nan
    rows = [[None if np.isnan(v) and (i + j) % 2 else float(v) for j, v in enumerate(r)] for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, ", ".join(f"`c.{i}` double" for i in range(m))).repartition(5)


def test_equal_to_numpy(spark):
    x, df = table(spark, 400, 30)
    got = {(r.a, r.b): r for r in correlation_blocks(df, df.columns).collect()}
    assert len(got) == 30 * 29 // 2
    for i in range(30):
        for j in range(i + 1, 30):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            r = got[f"c.{i}", f"c.{j}"]
            assert r.n == both.sum()
            if 3 in (i, j):
                assert r.r is None
            else:
                assert abs(r.r - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-9


def test_pairs_switch_to_the_matrix(spark):
    x, df = table(spark, 200, 26)
    df = df.na.fill(0.0)
    many = {(r.a, r.b): r.r for r in G.correlation_pairs(df.toDF(*[f"v{i}" for i in range(26)]), [f"v{i}" for i in range(26)]).collect()}
    few = {(r.a, r.b): r.r for r in G.correlation_pairs(df.toDF(*[f"v{i}" for i in range(26)]), [f"v{i}" for i in range(20)]).collect()}
    assert len(many) == 325 and all(abs(many[k] - v) < 1e-9 for k, v in few.items())


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "a double, b long, c string")
    assert correlation_blocks(df, ["a", "b"]).collect() == []
    assert correlation_blocks(df, ["a"]).collect() == []
    one = spark.createDataFrame([(1.0, 2), (None, 3)], "a double, b long")
    assert [tuple(r) for r in correlation_blocks(one, ["a", "b"]).collect()] == [("a", "b", 1, None)]
