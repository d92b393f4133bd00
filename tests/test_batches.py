"""Batched inserts with row-by-row retry, and paged scans."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ledgerlint.sources import batches as B
from ledgerlint.sources.files import scratch_path

TARGET = StructType([StructField("k", StringType(), False), StructField("n", IntegerType(), True),
                     StructField("x", DoubleType(), False)])


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, n string, x string, more string")


@pytest.mark.parametrize("batch", [1, 5, 1000])
def test_good_and_failed_rows(spark, batch):
    rows = [(f"k{i:03d}", None if i % 7 == 0 else str(i), f"{i}.5", None) for i in range(200)]
    rows += [("bad1", "1.5", "1", None), ("bad2", "x", "2", None), (None, "1", "1", "m"), ("bad3", "1", None, None),
             ("k001", "9", "9.0", None), ("k001", "9", "9.0", None), (None, "2", "2", None)]
    path = scratch_path(spark, "batches")
    got = B.write_in_batches(frame(spark, rows).repartition(4), path, TARGET, batch, key="k")
    assert got["good"] == 200 and got["failed"] == {"n is no int32": 2, "k is null": 2, "x is null": 1, "k is taken": 2}
    if batch == 5:
        assert 0 < got["retried"] < got["batches"]
    back = spark.read.parquet(path + "/rows")
    assert back.count() == 200 and dict(back.dtypes) == {"k": "string", "n": "int", "x": "double"}
    assert back.where("k = 'k001'").first().n == 1
    bad = spark.read.parquet(path + "/rejects")
    assert bad.count() == 7 and bad.where("more = 'm'").first()[B.REASON] == "k is null"
    assert not [f for f in os.listdir(path.removeprefix("file:")) if f.startswith("_stage")]


def test_rejects_are_written_in_large_groups(spark):
    """A key that thousands of rows share: refused one by one, stored together."""
    import pyarrow.parquet as pq
    rows = spark.range(3000).selectExpr("'same' AS k", "CAST(id AS string) AS n", "'1.5' AS x", "'' AS more").coalesce(1)
    path = scratch_path(spark, "batches")
    got = B.write_in_batches(rows, path, TARGET, 5, key="k")
    assert got == {"good": 1, "failed": {"k is taken": 2999}, "batches": 600, "retried": 600}
    folder = path.removeprefix("file:") + "/rejects"
    files = [f for f in os.listdir(folder) if f.endswith(".parquet")]
    assert [pq.ParquetFile(f"{folder}/{f}").num_row_groups for f in files] == [1]


def test_failing_job_leaves_no_rows(spark):
    path = scratch_path(spark, "batches")
    broken = frame(spark, [("a", "1", "1", None), ("b", "1", "1", None)]).withColumn(
        "n", F.when(F.col("k") == "b", F.raise_error(F.lit("stop"))).otherwise(F.col("n")))
    with pytest.raises(Exception):
        B.write_in_batches(broken, path, TARGET)
    folder = path.removeprefix("file:")
    # a task killed late may leave a staging folder; nothing of it is the table's
    assert not os.path.exists(folder) or not {"rows", "rejects", B.COUNTS} & set(os.listdir(folder))


def test_empty_insert(spark):
    got = B.write_in_batches(frame(spark, []), scratch_path(spark, "batches"), TARGET)
    assert got["good"] == 0 and got["failed"] == {}


@pytest.mark.parametrize("pages", [0, 1, 2, 3, 7, 8, 9, 100])
def test_count_pages(pages):
    asked = []

    def fetch(page):
        asked.append(page)
        return True if page < pages else None

    assert B.count_pages(fetch) == pages and len(asked) <= 16


@pytest.mark.parametrize("n, per_task", [(0, 4), (99, 4), (1000, 1), (1001, 3)])
def test_paged_scan(spark, n, per_task):
    df = spark.range(n).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))
    path = scratch_path(spark, "pages")
    B.write_pages(df, path, 100)
    back = B.read_pages(spark, path, df.schema, per_task)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert back.rdd.getNumPartitions() == max(1, -(-n // (100 * per_task)))


def test_scan_ends_at_an_empty_page(spark):
    """A gap ends the scan, whatever stands behind it."""
    df = spark.range(50).withColumn("page", F.when(F.col("id") < 20, F.floor(F.col("id") / 10)).otherwise(F.lit(9)))
    path = scratch_path(spark, "pages")
    df.write.partitionBy("page").parquet(path)
    assert B.read_pages(spark, path, spark.range(1).schema).count() == 20
