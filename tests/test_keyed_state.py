"""Keyed stream state over several micro-batches against the batch result."""

import datetime as dt
import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlint.streaming import keyed_state as K


def _events(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=37 * i), "hot" if i % 3 == 0 else None if i % 5 == 0 else f"u{i % 11}", f"t{i % 2}")
            for i in range(600)]
    return spark.createDataFrame(rows, "id long, ts timestamp, who string, kind string")


def _stream(spark, df, files):
    folder = tempfile.mkdtemp(prefix="ll-keyed-")
    # files in the order of time, one per micro-batch
    for i in range(files):
        df.where((F.col("id") >= 600 * i // files) & (F.col("id") < 600 * (i + 1) // files)) \
            .coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), folder


def test_first_rows_over_batches(spark):
    df = _events(spark)
    stream, folder = _stream(spark, df, 3)
    got = K.run_available(K.flag_first_stream(stream, ["who", "kind"], "ts", "id"), f"{folder}/out")
    w = Window.partitionBy("who", "kind").orderBy("ts", "id")
    want = df.withColumn("is_first", F.row_number().over(w) == 1)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_forgotten_keys_are_first_again(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(days=10 * i), "a" if i != 1 else "b", "t") for i in range(3)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, who string, kind string")
    folder = tempfile.mkdtemp(prefix="ll-keyed-")
    for i in range(3):
        df.where(F.col("id") == i).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for name, days, first in (("short", 2, {0: True, 1: True, 2: True}), ("long", 60, {0: True, 1: True, 2: False})):
        out = K.run_available(K.flag_first_stream(read(), ["who"], "ts", "id", "1 day", days * 86_400_000), f"{folder}/{name}")
        assert {r.id: r.is_first for r in out.collect()} == first


def test_weekly_repeat_ratio(spark):
    df = _events(spark)
    stream, folder = _stream(spark, df, 3)
    got = K.repeat_ratio(K.run_available(K.weekly_customers_stream(stream, "ts", "who"), f"{folder}/out"))
    want = df.groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("w")).agg(
        F.count("*").alias("n"), F.countDistinct(F.coalesce("who", F.lit("-"))).alias("c"))
    assert {r.Year_Week: (r.n_rows, r.n_customers) for r in got.collect()} == {r.w: (r.n, r.c) for r in want.collect()}


def test_keys_that_share_a_group_and_its_batches(spark):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # many Arrow batches a group
    try:
        # latest rows first inside a file, and pairs at the same time
        df = _events(spark).withColumn("ts", F.timestamp_seconds(F.unix_timestamp("ts") - F.col("id") % 2 * 37 * 60)).orderBy(F.col("id").desc())
        stream, folder = _stream(spark, df, 3)
        got = K.run_available(K.flag_first_stream(stream, ["who", "kind"], "ts", "id", key_groups=2), f"{folder}/out")
        w = Window.partitionBy("who", "kind").orderBy("ts", "id")
        want = df.withColumn("is_first", F.row_number().over(w) == 1)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_one_key_of_a_group_is_forgotten(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(0, start, "a"), (1, start + dt.timedelta(days=9), "b"), (2, start + dt.timedelta(days=10), "b"),
            (3, start + dt.timedelta(days=11), "a"), (4, start + dt.timedelta(days=12), "b")]
    df = spark.createDataFrame(rows, "id long, ts timestamp, who string")
    folder = tempfile.mkdtemp(prefix="ll-keyed-")
    for i in range(len(rows)):
        df.where(F.col("id") == i).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = K.run_available(K.flag_first_stream(stream, ["who"], "ts", "id", "1 day", 5 * 86_400_000, key_groups=1), f"{folder}/out")
    assert {r.id: r.is_first for r in out.collect()} == {0: True, 1: True, 2: False, 3: True, 4: False}
