"""Session construction and lineage cutting.

The library never picks machine-local folders on a cluster: the checkpoint
directory is read from ``spark.checkpoint.dir``; a private one under the
system temp folder is set only on a single machine (master ``local``) whose
session has none. On a cluster a missing setting is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "ledgerlint",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE and skew-join handling on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    Where it is unset, a master ``local`` gets a private folder and any other
    raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ledgerlint-ckpt-")
        os.makedirs(configured, exist_ok=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used where a plan grows wide (hundreds of lag columns) so that later
    stages neither re-plan nor recompute the upstream shuffles, and so that a
    lost executor does not force recomputation from the source.
    """
    checkpoint_dir(df.sparkSession)
    if not eager:
        return df.checkpoint(eager=False)
    # persist first: without it the checkpoint write recomputes the plan
    # after the action that materialises it
    df.persist()
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


def stored(df: DataFrame) -> DataFrame:
    """The rows as Parquet in the shared checkpoint folder, read back.

    For an input that several passes read: its joins run once, each later
    pass reads only the columns it needs from compressed files, and a lost
    executor costs no recomputation. Columns are written by position, so any
    name will do; types that Parquet does not hold are checkpointed.
    """
    if any(isinstance(f.dataType, (T.NullType, T.CalendarIntervalType)) for f in df.schema.fields):
        return cut_lineage(df)
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain.write.parquet(path)
    back = spark.read.schema(plain.schema).parquet(path)
    return back.select(*[F.col(f"c{i}").alias(f.name, metadata=f.metadata) for i, f in enumerate(df.schema.fields)])


def sized_broadcast(df: DataFrame, max_bytes: int = 64 << 20, cut: bool = True) -> DataFrame:
    """Broadcast hint only when the frame's measured size allows it.

    The frame is cut from the lineage first, so measuring does not run it
    twice (``cut=False``: it is cheap and may run twice). The size is that of its rows as JSON text, summed in one
    distributed aggregate; beyond ``max_bytes`` the join shuffles on its keys.
    """
    df = cut_lineage(df) if cut else df
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


def spread(df: DataFrame, unique_cols: list[str] | None = None,
           min_partitions: int | None = None) -> DataFrame:
    """Repartition only when the input has fewer partitions than the session
    has cores (e.g. a file stored as one row group).

    With ``unique_cols`` (a row key) rows are hashed on that key, which is
    as even as round robin (no value repeats, so no hot partition) without
    round robin's pre-sort; otherwise round robin. A large input with many
    splits is left untouched, so joins downstream keep AQE's skew handling.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    # two tasks per core evens out uneven task times
    target = min_partitions or 2 * cores
    if unique_cols:
        return df.repartition(target, *[F.col(c) for c in unique_cols])
    return df.repartition(target)
