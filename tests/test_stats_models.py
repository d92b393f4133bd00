"""Chi-square known values, p-values, folds and rebalancing."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlint.operators import models as M
from ledgerlint.operators import stats as ST


def _table(spark):
    rows = [("a", 1)] * 10 + [("a", 0)] * 5 + [("b", 1)] * 3 + [("b", 0)] * 12
    return spark.createDataFrame(rows, "x string, y int")


def test_chi_square_known_values(spark):
    df = _table(spark)
    plain = ST.chi_square_statistics(df, ["x"], "y", correction=False).first()
    yates = ST.chi_square_statistics(df, ["x"], "y", correction=True).first()
    assert plain["dof"] == 1 and abs(plain["statistic"] - 6.6516) < 1e-3
    assert abs(yates["statistic"] - 4.8869) < 1e-3
    p = ST.chi_square_test(df, ["x"], "y").first()["p_value"]
    assert abs(p - 0.0271) < 1e-3


def test_chi2_survival_reference_points():
    assert abs(ST.chi2_survival(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(ST.chi2_survival(5.991464547107979, 2) - 0.05) < 1e-9
    assert abs(ST.chi2_survival(11.070497693516351, 5) - 0.05) < 1e-9
    assert abs(ST.chi2_survival(2.0, 4) - math.exp(-1.0) * 2.0) < 1e-9


def test_stratified_folds_balanced(spark):
    df = spark.range(0, 1003).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    f = M.stratified_folds(df, "y", k=5, seed=7, id_cols=["id"])
    sizes = {}
    for r in f.groupBy("y", "fold").count().collect():
        sizes.setdefault(r["y"], []).append(r["count"])
    for counts in sizes.values():
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    assert f.count() == 1003


def test_rebalance_counts_and_convexity(spark):
    from pyspark.ml.linalg import Vectors
    rows = [(Vectors.dense([float(i), float(i % 7)]), 0.0) for i in range(200)]
    rows += [(Vectors.dense([100.0 + i, 50.0 + (i % 5)]), 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, ["features", "label"])
    out = M.rebalance(df, "label", k=3)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0.0: 200, 1.0: 200}
    from pyspark.ml.functions import vector_to_array
    mino = out.where("label = 1").select(vector_to_array("features").alias("a"))
    b = mino.agg(F.min(F.col("a")[0]), F.max(F.col("a")[0]), F.min(F.col("a")[1]), F.max(F.col("a")[1])).first()
    assert b[0] >= 100.0 and b[1] <= 129.0 and b[2] >= 50.0 and b[3] <= 54.0


def test_rebalance_interpolates_between_neighbours(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(5)
    small, mid = rng.normal(0, 1, (30, 3)), rng.normal(5, 1, (60, 3))
    rows = [(Vectors.dense(x), 1.0) for x in small] + [(Vectors.dense(x), 2.0) for x in mid]
    rows += [(Vectors.dense(x), 0.0) for x in rng.normal(9, 1, (100, 3))]
    out = M.rebalance(spark.createDataFrame(rows, ["features", "label"]), "label", k=4).collect()
    assert {y: sum(r.label == y for r in out) for y in (0.0, 1.0, 2.0)} == {0.0: 100, 1.0: 100, 2.0: 100}
    originals = {tuple(x) for x in small}
    made = [np.array(r.features) for r in out if r.label == 1.0 and tuple(r.features) not in originals]
    assert len(made) == 70
    distance = np.linalg.norm(small[:, None] - small[None], axis=2)
    near = np.argsort(distance, axis=1)[:, 1:5]
    for m in made:
        ok = False
        for i in range(30):
            for j in near[i]:
                step = small[j] - small[i]
                u = float((m - small[i]) @ step / (step @ step))
                ok |= 0 < u < 1 and np.allclose(small[i] + u * step, m, atol=1e-9)
        assert ok


def test_rebalance_large_and_single_point(spark):
    from pyspark.ml.linalg import Vectors
    rows = [(Vectors.dense([float(i % 97), float(i // 97)]), 1.0) for i in range(3000)]
    rows += [(Vectors.dense([float(i), 1.0]), 0.0) for i in range(4000)] + [(Vectors.dense([7.0, 7.0]), 2.0)] * 3
    out = M.rebalance(spark.createDataFrame(rows, ["features", "label"]), "label").collect()
    assert all(sum(r.label == y for r in out) == 4000 for y in (0.0, 1.0, 2.0))
    originals = {tuple(r[0]) for r in rows if r[1] == 1.0}
    assert sum(tuple(r.features) in originals for r in out if r.label == 1.0) == 3000


def test_full_precision_shares(spark):
    from ledgerlint.operators.aggregates import value_shares
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "x string")
    assert {r["share"] for r in value_shares(df, "x").collect()} == {1 / 3}


def test_unicode_blanks(spark):
    from ledgerlint.functions.scalars import is_blank
    df = spark.createDataFrame([("\u00a0",), ("\u3000 ",), ("x",), (None,)], "x string")
    assert [r[0] for r in df.select(is_blank("x")).collect()] == [True, True, False, True]


def test_one_hot_levels_and_order(spark):
    df = spark.createDataFrame([(1.0, "a", 0), (2.0, None, 1), (3.0, "b", 0)], "n double, c string, t int")
    out = ST.one_hot(df, ["c"], ["n"], "t")
    assert out.columns == ["n", "c_a", "c_b", "c_nan", "t"]
    assert [tuple(r) for r in out.orderBy("n").collect()][1] == (2.0, 0.0, 0.0, 1.0, 1)


def test_standardize_population(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    vals = sorted(r[0] for r in ST.standardize(df, ["x"]).collect())
    assert vals == [-1.0, 1.0]


def test_grid_rmse_prepares_inside_the_fold_and_returns_the_winner(spark):
    from pyspark.ml.regression import LinearRegression
    rows = [(float(i % 17), "ab"[i % 2], 3.0 * (i % 17) + 5.0 * (i % 2)) for i in range(100)]
    df = spark.createDataFrame(rows, ["x", "c", "y"])
    data = M.with_folds(df, "y", 4, 42)
    assert sorted(r["count"] for r in data.groupBy("fold").count().collect()) == [25] * 4
    r = M.grid_rmse(df, LinearRegression(featuresCol="features", labelCol="y"), {"regParam": [0.0, 5.0]}, "y", ["x"], ["c"], k=4)
    assert r["best_params"] == "{'regParam': 0.0}" and -1e-3 < r["best_score"] <= 0.0
    assert r["fit_time"] > 0 and r["score_time"] > 0
    got = r["model"].transform(df).selectExpr("max(abs(prediction - y)) AS d").first()["d"]
    assert got < 1e-3


def test_models_share_folds_and_prepared_rows(spark, monkeypatch):
    """Two models with the same stages: folds and fold sets are made once, the
    scores are those of one search per model, and nothing stays persisted."""
    from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
    rows = [(float(i % 17), "ab"[i % 2], float(i % 5), 3.0 * (i % 17) + 5.0 * (i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, ["x", "c", "more", "y"])
    models = {"lr": LinearRegression(featuresCol="features", labelCol="y"),
              "dt": DecisionTreeRegressor(featuresCol="features", labelCol="y", seed=42)}
    params = {"lr": {"regParam": [0.0, 5.0]}, "dt": {"maxDepth": [1, 3]}}
    alone = {m: M.grid_rmse(df, est, params[m], "y", ["x"], ["c"], k=4) for m, est in models.items()}
    calls, made = {"with_folds": [], "fold_sets": []}, []
    for name, seen in calls.items():
        def counted(*args, _real=getattr(M, name), _seen=seen, **named):
            _seen.append(_real(*args, **named))
            return _seen[-1]
        monkeypatch.setattr(M, name, counted)
    got = {r.model: r for r in M.compare_regressors(df, models, params, "y", ["x"], ["c"], k=4).collect()}
    assert {name: len(seen) for name, seen in calls.items()} == {"with_folds": 1, "fold_sets": 1}
    assert set(calls["with_folds"][0].columns) == {"x", "c", "y", "fold"}
    for m, r in alone.items():
        assert got[m].best_params == r["best_params"] and abs(got[m].best_score - r["best_score"]) < 1e-9
    assert not any(x.is_cached or x.storageLevel.useMemory for pair in calls["fold_sets"][0] for x in pair)


def test_forest_reads_its_input_once(spark):
    """The forest's passes do not compute the input rows again."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    df = spark.createDataFrame([(float(i % 7), "ab"[i % 2], float(i % 7) * 2) for i in range(140)], ["x", "c", "y"]).coalesce(1)
    out = M.forest_importance(df.mapInArrow(count, df.schema), "y", ["x"], ["c"], num_trees=5)
    assert abs(sum(r.importance for r in out.collect()) - 1) < 1e-9 and seen.value == 140


def test_resampling_stays_inside_the_training_rows(spark):
    """Synthetic rows of a fold lie between training rows; test rows stay."""
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(31)
    rows = [(Vectors.dense([float(i), 0.0]), 1.0) for i in range(30)] + [(Vectors.dense([float(i), 9.0]), 0.0) for i in range(90)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(120)], ["raw", "label"])
    data = M.stratified_folds(df, "label", 3, 7).persist()
    pairs = M.fold_pairs(data, 3, lambda train: M.rebalance(train.select("raw", "label"), "label", "raw", k=2))
    for i, (train, test) in enumerate(pairs):
        held = {tuple(r.raw) for r in test.collect()}
        assert held == {tuple(r.raw) for r in data.where(f"fold = {i}").collect()} and len(held) == 40
        got = [(tuple(r.raw), r.label) for r in train.collect()]
        assert sum(y == 1.0 for _, y in got) == sum(y == 0.0 for _, y in got) == 60
        known = {tuple(r.raw) for r in data.where(f"fold <> {i}").collect()}
        lone = sorted(x for x, y in known if y == 0.0)
        for (x, y), label in got:
            if (x, y) not in known:  # between two training rows of the class
                assert label == 1.0 and y == 0.0 and lone[0] < x < lone[-1]
        assert not held & {v for v, _ in got}


def test_select_model_refuses_unknown_modes(spark):
    with pytest.raises(ValueError):
        M.select_model(spark.range(1), "id", {}, [], [], resample="after")
