"""Chart bundles (V10, V11) and the F2 selection variant (M9) run end to end."""

from pyspark.sql import functions as F

from ledgerlint.operators import charts as CH
from ledgerlint.sources.tables import retail_view
from ledgerlint.schema import VIEW_COLUMNS as VC
from tests.conftest import SF_SMALL


def test_explore_bundle(spark):
    v = retail_view(spark, SF_SMALL).select(VC.price, VC.quantity, VC.category, VC.payment)
    b = CH.explore_bundle(v)
    assert set(b) == {"missing", "box", "histogram", "categories"}
    assert b["box"].count() == 2 and b["categories"].count() > 0
    hist = b["histogram"].groupBy("column").agg(F.sum("n").alias("n")).collect()
    assert {r["column"]: r["n"] for r in hist} == {
        VC.price: v.where(F.col(VC.price).isNotNull()).count(),
        VC.quantity: v.where(F.col(VC.quantity).isNotNull()).count()}


def test_feature_target_bundle(spark):
    v = retail_view(spark, SF_SMALL).select(VC.price, VC.category, F.col(VC.discount).cast("int").alias("t"))
    b = CH.feature_target_bundle(v, "t")
    assert b["numeric"].select("t").distinct().count() == 2
    assert b["categorical"].count() > 0


def test_select_model_f2(spark):
    from ledgerlint.plans.queries import queries
    out = queries()["select_model_f2"](spark, SF_SMALL).collect()
    assert [r["stage"] for r in out] == ["baseline"] * 6 + ["grid"] and all(0.0 <= r["score"] <= 1.0 for r in out)
    assert [r["model"] for r in out[:6]] == ["lr", "dt", "rf", "gbt", "nb", "svm"]
    assert out[6]["model"] == max(out[:6], key=lambda r: r["score"])["model"] and out[6]["params"] != "{}"
