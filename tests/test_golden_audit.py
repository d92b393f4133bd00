"""Full audit on the test sheet: verdict counts, uniqueness and column order."""

import pytest
from pyspark.sql import functions as F

from ledgerlint.operators.audit import audit, verdict_counts
from ledgerlint.schema import REFERENCE_ABBREVIATIONS
from tests.golden import EXPECTED, FIELDS, golden_rows


def master(spark):
    """200 items: 25 per category, item k costs 5 + 1.5 (k - 1), whole range."""
    abbrs = [a for _, a in REFERENCE_ABBREVIATIONS]
    return (spark.range(1, 26).select(F.col("id").alias("k"))
            .select("k", F.explode(F.array(*[F.lit(a) for a in abbrs])).alias("a"))
            .select(F.concat(F.lit("Item_"), F.col("k").cast("string"), F.lit("_"), F.col("a")).alias("Item"),
                    (F.lit(5.0) + F.lit(1.5) * (F.col("k") - 1)).alias("Price Per Unit"),
                    F.lit("2021-01-01").alias("Start_date"), F.lit("2026-12-31").alias("End_date")))


@pytest.fixture(scope="module")
def sheet(spark):
    rows = [(i, *r) for i, r in enumerate(golden_rows())]
    df = spark.createDataFrame(rows, "row_no int, " + ", ".join(f"`{f}` string" for f in FIELDS))
    return df


def test_sheet_size(sheet):
    assert sheet.count() == 103


def test_verdict_counts(spark, sheet):
    out = audit(sheet, master(spark), order_cols=["row_no"], uniqueness_passes=2)
    got = {r["column"]: (r["n_true"], r["n_false"], r["n_cant_check"], r["n_missing"])
           for r in verdict_counts(out).collect()}
    assert got == EXPECTED


def test_uniqueness_single_and_double(spark, sheet):
    once = audit(sheet, master(spark), order_cols=["row_no"], uniqueness_passes=1)
    twice = audit(sheet, master(spark), order_cols=["row_no"], uniqueness_passes=2)
    assert once.where(~F.col("uniqueness_flag")).count() == 11
    assert twice.where(~F.col("uniqueness_flag")).count() == 9


def test_column_order(spark, sheet):
    out = audit(sheet, master(spark), order_cols=["row_no"]).drop("row_no")
    comp = [c for c in out.columns if c.endswith("_completeness")]
    assert comp == sorted(comp) and len(comp) == 11
    assert out.columns[11] == "uniqueness_flag"
    val = [c for c in out.columns if c.endswith("_validity")]
    assert val[-3:] == ["Item_validity", "Price Per Unit_validity", "Total Spent_validity"]
    assert len(out.columns) == 34


def test_row_verdicts(spark, sheet):
    """Spot checks of the cross-column rules on single perturbations."""
    out = audit(sheet, master(spark), order_cols=["row_no"], uniqueness_passes=2)
    got = {r["row_no"]: r for r in out.collect()}
    v = "_validity"

    def verdicts(i, *cols):
        return tuple(got[i][f"{c}{v}"] for c in cols)

    assert verdicts(0, "Item", "Price Per Unit", "Total Spent") == ("True", "True", "True")
    # wrong abbreviation: item False, and no such item in the master
    assert verdicts(12, "Item", "Price Per Unit") == ("False", "False")
    # unknown category: item cannot be checked, price still found
    assert verdicts(19, "Item", "Category") == ("CANT CHECK", False)
    # price with a text suffix: price False, total cannot be checked
    assert verdicts(35, "Price Per Unit", "Total Spent") == ("False", "CANT CHECK")
    # missing price: price verdict missing, total cannot be checked
    assert verdicts(36, "Price Per Unit", "Total Spent") == (None, "CANT CHECK")
    # impossible date: date False, price and total cannot be checked
    assert verdicts(84, "Transaction Date", "Price Per Unit", "Total Spent") == (False, "CANT CHECK", "CANT CHECK")
    # quantity 0 is valid, and the total no longer matches
    assert verdicts(45, "Quantity", "Total Spent") == (True, "False")
    # discount spelled in capitals is not in the domain
    assert verdicts(100, "Discount Applied") == (False,)


def test_text_table_with_junk_numbers(spark, sheet):
    """All-text input with junk numbers: weekly features and quantiles do not
    fail under ANSI casts; junk counts as missing."""
    from ledgerlint.operators.quantiles import exact_quantiles
    from ledgerlint.operators.weekly import weekly_features
    import pytest as _pytest
    with _pytest.raises(ValueError, match="Unknown"):
        weekly_features(sheet.drop("row_no"), n_past_week=1, n_future_week=1)
    wk = weekly_features(sheet.drop("row_no"), n_past_week=1, n_future_week=1, on_clash="suffix")
    assert {"Unknown_x", "Unknown_y"} <= set(wk.columns) and wk.count() >= 1
    q = exact_quantiles(sheet, "Total Spent", [0.5])[0]
    assert q == 185.0
