"""Identities and edge cases."""

from pyspark.sql import functions as F

from ledgerlint.operators import completeness as C
from ledgerlint.operators import repair as RP
from ledgerlint.operators import reports as R
from ledgerlint.operators import weekly as W
from ledgerlint.operators.audit import add_uniqueness
from ledgerlint.schema import VIEW_COLUMNS as VC
from ledgerlint.sources.tables import ROW_ID_COLUMNS, retail_text_view, retail_view
from tests.conftest import SF_SMALL


def test_missing_plus_present_is_rows(spark):
    v = retail_view(spark, SF_SMALL)
    n = v.count()
    flags = C.add_completeness_flags(v, VC.all())
    rep = {r["column"]: r["missing_count"] for r in C.missing_report(v, VC.all()).collect()}
    for c in VC.all():
        assert flags.where(F.col(f"{c}_completeness")).count() + rep[c] == n


def test_own_domain_is_full(spark):
    t = retail_text_view(spark, SF_SMALL)
    for r in R.own_domain_report(t, [VC.payment, VC.category]).collect():
        assert r["valid_pct"] == (100.0 if r["non_missing"] else 0.0)


def test_own_domains_in_one_pass(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, float("nan")), (" ", 1.0), ("b", 2.0)], "x string, y double")
    got = [tuple(r) for r in R.own_domain_report(df.mapInArrow(count, df.schema), ["x", "y"]).orderBy("position").collect()]
    assert seen.value == 5 and [r[:4] + r[5:7] for r in got] == [("x", 0, 5, 2, 3, 3), ("y", 1, 5, got[1][3], 5 - got[1][3], 5 - got[1][3])]
    none = R.own_domain_report(df.where("false"), ["x", "y"]).orderBy("position").collect()
    assert [tuple(r)[:4] for r in none] == [("x", 0, 0, 0), ("y", 1, 0, 0)]


def test_flagged_rows_are_the_missing_and_the_outliers(spark):
    df = spark.createDataFrame([(1, "2.5"), (2, None), (3, " "), (4, "-1"), (5, "x"), (6, "NaN"), (7, "0"), (7, "0")], "id int, p string")
    parts = R.positive_rows(df, "p")
    got = sorted((r.id, r.kind) for r in parts["flagged"].collect())
    assert got == [(2, "missing"), (3, "missing"), (4, "outlier"), (5, "outlier"), (7, "outlier"), (7, "outlier")]
    apart = [(r.id, k) for k, name in (("missing", "missing"), ("outlier", "outliers")) for r in parts[name].collect()]
    assert sorted(apart) == got


def test_pivots_sum_to_total(spark):
    v = retail_view(spark, SF_SMALL).where(F.col(VC.category).isNotNull())
    wk = W.weekly_aggregates(v, VC, checkpoint=False)
    cats = [c for c in wk.columns if c.isupper()]
    bad = wk.where(F.abs(sum(F.col(c) for c in cats) - F.col("total_sales")) > 1e-6).count()
    assert bad == 0


def test_lag_then_lead_returns_column(spark):
    v = retail_view(spark, SF_SMALL)
    wk = W.add_lags_leads(W.weekly_aggregates(v, VC, checkpoint=False), 1, 0, features=["total_sales"])
    from pyspark.sql import Window
    back = wk.withColumn("b", F.lead("total_sales_t-1", 1).over(Window.orderBy(W.WEEK)))
    assert back.where(F.col("b").isNotNull() & (F.col("b") != F.col("total_sales"))).count() == 0


def test_capping_is_idempotent(spark):
    v = retail_view(spark, SF_SMALL).select(*ROW_ID_COLUMNS, VC.total)
    once = RP.cap_outliers(v, ignore=list(ROW_ID_COLUMNS))
    bounds = RP.iqr_bounds(v, [VC.total])[VC.total]
    lo, hi = bounds
    assert once.where((F.col(VC.total) < lo) | (F.col(VC.total) > hi)).count() == 0


def test_empty_table(spark):
    t = retail_text_view(spark, SF_SMALL).limit(0)
    rep = C.missing_report(t, VC.all()).collect()
    assert all(r["missing_count"] == 0 and r["missing_pct"] == 0.0 for r in rep)
    assert R.format_report(t, {VC.transaction_id: "TXN_[0-9]{7}"}).first()["valid_pct"] == 0.0


def test_all_null_column_and_single_row(spark):
    df = spark.createDataFrame([(1, None)], "k int, x string")
    rep = C.missing_report(df).collect()
    assert [(r["column"], r["missing_count"], r["missing_pct"]) for r in rep] == [("k", 0, 0.0), ("x", 1, 100.0)]


def test_duplicate_only_table(spark):
    df = spark.createDataFrame([(i, "a", None) for i in range(5)], "i int, x string, y string")
    out = add_uniqueness(df, ["i"]).orderBy("i").collect()
    assert [r["uniqueness_flag"] for r in out] == [True, False, False, False, False]


def test_missing_week_is_skipped_by_lag(spark):
    rows = [("T1", "C1", "Food", "Item_1_FOOD", 5.0, 1.0, 5.0, "Cash", "Online", d, True)
            for d in ("2024-01-01", "2024-01-15")]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` {t}" for c, t in zip(
        __import__("ledgerlint").REFERENCE_COLUMNS.all(),
        ["string"] * 4 + ["double"] * 3 + ["string"] * 3 + ["boolean"])))
    out = W.weekly_features(df, n_past_week=1, n_future_week=1).orderBy(W.WEEK).collect()
    assert [r[W.WEEK] for r in out] == ["2024-01-01", "2024-01-15"]
    assert out[1]["total_sales_t-1"] == 5.0 and out[0]["y_1"] == 5.0


def test_week_range_text_semantics(spark):
    df = spark.createDataFrame([("2023-12-25",), ("2024-01-01",)], "Year_Week string")
    assert W.week_range(df, end="2024-01").count() == 1


def test_group_mean_fill_erases_keyless(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 3.0)], "Item string, Quantity double")
    out = {(r[0], r[1]) for r in RP.fill_by_group_mean(df, "Item", "Quantity").collect()}
    assert out == {("a", 1.0), (None, None)}
    kept = {(r[0], r[1]) for r in RP.fill_by_group_mean(df, "Item", "Quantity", keep_keyless=True).collect()}
    assert (None, 3.0) in kept
