"""Table-driven tests of every row rule and its null rule."""

from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from ledgerlint.functions import scalars as S
from ledgerlint.operators import validity as V


def _eval(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
    return [r[0] for r in df.select(fn(df)).orderBy(df.i).collect()] if False else \
        [r["v"] for r in df.select("i", fn(df).alias("v")).orderBy("i").collect()]


def test_regex_full_match_and_null(spark):
    vals = ["TXN_1234567", "TXN_123456", "TXN_12345678", None, "TXN_1234567\n", "xTXN_1234567"]
    got = _eval(spark, vals, lambda d: V.regex_rule(F.col("x"), "TXN_[0-9]{7}"))
    assert got == [True, False, False, False, False, False]


def test_domain_null_stays_null_case_sensitive(spark):
    got = _eval(spark, ["True", "False", "TRUE", None, "Yes"],
                lambda d: V.domain_rule(d, "x", ["True", "False"]))
    assert got == [True, True, False, None, False]


def test_domain_on_booleans(spark):
    got = _eval(spark, [True, False, None], lambda d: V.domain_rule(d, "x", [True, False]), "boolean")
    assert got == [True, True, None]


def test_integer_non_negative(spark):
    got = _eval(spark, ["10", "0", "-1", "20.5", "10A", None, "1e2", "nan"],
                lambda d: V.integer_non_negative(d, "x"))
    assert got == [True, True, False, False, False, None, True, False]


def test_float_non_negative(spark):
    got = _eval(spark, ["1.5", "0", "-0.1", "abc", None, "NaN"], lambda d: V.float_non_negative(d, "x"))
    assert got == [True, True, False, False, False, False]


def test_datetime_rule(spark):
    got = _eval(spark, ["2024-02-29", "2025-02-29", "2024-13-01", "2024-1-5", "0000-01-01", None, "2024/01/01"],
                lambda d: V.datetime_rule(d, "x"))
    assert got == [True, False, False, False, False, None, False]


def test_date_report_year_floor(spark):
    from ledgerlint.operators.reports import date_check
    got = _eval(spark, ["1799-12-31", "1800-01-01"], lambda d: date_check(F.col("x")))
    assert got == [False, True]


def test_item_rule(spark):
    from ledgerlint.schema import REFERENCE_COLUMNS as C
    rows = [("Item_10_PAT", "Patisserie"), ("Item_10_MIL", "Milk Products"), ("Item_10_PAT", None),
            ("Item_10_PAT", "Unknown"), (None, "Food"), ("Item_x_PAT", "Patisserie"), ("Item_1_FOOD", "Food")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, Item string, Category string")
    got = [r[0] for r in df.select(V.item_rule(df, C)).collect()]
    assert got == ["True", "False", "CANT CHECK", "CANT CHECK", None, "False", "True"]


def test_rule_dispatch_accepts_column(spark):
    df = spark.createDataFrame([("a",)], "x string")
    out = V.add_validity_columns(df, OrderedDict([("x", F.lit(True))]))
    assert out.columns == ["x", "x_validity"]


def test_blank_and_numbers(spark):
    got = _eval(spark, ["", "  ", "\t", "a", None], lambda d: S.is_blank(F.col("x")))
    assert got == [True, True, True, False, True]
    got = _eval(spark, ["1", " 2 ", "x", "1_000"], lambda d: S.as_number(d, "x"))
    assert got == [1.0, 2.0, None, None]


def test_week_starts_monday(spark):
    df = spark.sql("select date'2024-01-07' d, date'2024-01-08' e")
    r = df.select(S.week_start(F.col("d")), S.week_start(F.col("e"))).first()
    assert tuple(r) == ("2024-01-01", "2024-01-08")


def test_safe_divide_by_zero_is_null(spark):
    r = spark.sql("select 1.0d a, 0.0d b").select(S.safe_divide(F.col("a"), F.col("b"))).first()
    assert r[0] is None


def test_typed_nan_is_missing(spark):
    from ledgerlint.schema import REFERENCE_COLUMNS as C
    got = _eval(spark, [float("nan"), 3.0, None], lambda d: V.integer_non_negative(d, "x"), "double")
    assert got == [None, True, None]
    df = spark.createDataFrame([(float("nan"), 2.0, 5.0), (2.0, 2.0, 4.0)],
                               "`Price Per Unit` double, Quantity double, `Total Spent` double")
    assert [r[0] for r in df.select(V.total_rule(df, C)).collect()] == ["CANT CHECK", "True"]
