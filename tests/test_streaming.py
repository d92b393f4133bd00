"""Streaming audit and weekly totals agree with their batch forms."""

import os
import tempfile

from pyspark.sql import functions as F

from ledgerlint.operators.audit import audit
from ledgerlint.schema import VIEW_COLUMNS as VC
from ledgerlint.schema import VIEW_RULES as VR
from ledgerlint.sources.tables import ROW_ID_COLUMNS, read_table, retail_text_view, view_price_master
from ledgerlint.streaming.audit_stream import audit_stream, weekly_totals_stream
from tests.conftest import SF_SMALL


def _drain(stream_df, name):
    q = (stream_df.writeStream.format("memory").queryName(name).outputMode("append")
                  .trigger(availableNow=True).start())
    q.awaitTermination(120)
    return stream_df.sparkSession.table(name)


def test_audit_stream_matches_batch(spark):
    folder = tempfile.mkdtemp(prefix="ll-stream-")
    t = retail_text_view(spark, SF_SMALL)
    t.repartition(3).write.mode("overwrite").parquet(os.path.join(folder, "in"))
    stream = spark.readStream.schema(t.schema).parquet(os.path.join(folder, "in"))
    master = view_price_master(spark, SF_SMALL)
    got = _drain(audit_stream(stream, master, VC, VR, data_cols=VC.all()), "audit_out")
    batch = audit(t, master, VC, VR, order_cols=list(ROW_ID_COLUMNS)).drop("uniqueness_flag")
    cols = sorted(c for c in batch.columns)
    a = sorted(tuple(str(x) for x in r) for r in got.select(*cols).collect())
    b = sorted(tuple(str(x) for x in r) for r in batch.select(*cols).collect())
    assert a == b


def test_weekly_totals_stream(spark):
    folder = tempfile.mkdtemp(prefix="ll-stream-")
    ev = read_table(spark, SF_SMALL, "events")
    ev.repartition(2).write.mode("overwrite").parquet(os.path.join(folder, "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(os.path.join(folder, "ev"))
    out = weekly_totals_stream(stream, "ts", "value", "user_id", watermark="0 seconds")
    q = (out.writeStream.format("memory").queryName("wk_out").outputMode("complete")
            .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r["Year_Week"]: r["n_rows"] for r in spark.table("wk_out").collect()}
    exp = {r[0]: r[1] for r in ev.groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd"))
           .count().collect()}
    assert got == exp


def test_dedupe_stream_keeps_first_copy(spark):
    from ledgerlint.streaming.audit_stream import dedupe_stream
    folder = tempfile.mkdtemp(prefix="ll-stream-")
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:01:00")]
    df = spark.createDataFrame(rows, "k string, ts string").select("k", F.col("ts").cast("timestamp").alias("ts"))
    df.coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, "d"))
    stream = spark.readStream.schema(df.schema).parquet(os.path.join(folder, "d"))
    got = _drain(dedupe_stream(stream, ["k", "ts"], "ts", "1 hour"), "dedupe_out")
    assert sorted(r["k"] for r in got.collect()) == ["a", "b"]
