"""CSV round trip, month partitioning with pruning, DDL text, approximate quantiles."""

from pyspark.sql import functions as F

from ledgerlint.operators.aggregates import quantiles
from ledgerlint.schema import VIEW_COLUMNS as VC
from ledgerlint.sources import files as IO
from ledgerlint.sources.tables import retail_text_view, retail_view
from tests.conftest import SF_SMALL


def test_csv_roundtrip_keeps_rows_and_nulls(spark):
    t = retail_text_view(spark, SF_SMALL).select(*VC.all())
    path = IO.scratch_path(spark, "test-csv")
    IO.write_csv(t, path)
    back = IO.read_csv(spark, path, schema=t.schema)
    assert back.count() == t.count()
    assert back.where(F.col(VC.customer_id).isNull()).count() == t.where(F.col(VC.customer_id).isNull()).count()


def test_month_partitions_prune(spark):
    v = retail_view(spark, SF_SMALL)
    path = IO.scratch_path(spark, "test-parts")
    IO.write_partitioned_by_month(v, path, VC.date)
    back = spark.read.parquet(path).where(F.col("txn_month") == "1996-03")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(txn_month" in plan
    exp = v.where(F.col(VC.date).startswith("1996-03")).count()
    assert back.count() == exp


def test_ddl_text(spark):
    df = spark.createDataFrame([("2024-01-01", 1, 2.0)], "Year_Week string, n bigint, x double")
    ddl = IO.ddl_for(df, "t", "Year_Week", ["n"])
    assert '"Year_Week" TEXT PRIMARY KEY' in ddl and '"n" INTEGER' in ddl and '"x" FLOAT' in ddl
    assert '"n" FLOAT' in IO.ddl_for(df, "t", "Year_Week", ["n"], all_float=True)


def test_approx_quantiles_close_to_exact(spark):
    v = retail_view(spark, SF_SMALL)
    exact = {r["column"]: r["q50"] for r in quantiles(v, [VC.quantity]).collect()}
    approx = {r["column"]: r["q50"] for r in quantiles(v, [VC.quantity], approx_accuracy=10000).collect()}
    assert abs(exact[VC.quantity] - approx[VC.quantity]) <= 1.0
