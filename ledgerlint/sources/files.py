"""Sources and sinks (S1-S11): CSV, JDBC, target-schema fitting, JSON rows
and the check after a write.

Writes go to paths the caller names (on a cluster: shared storage); the
scratch helpers place files under the session's checkpoint folder, never in
a machine-local temp folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlint.functions.scalars import to_date_any
from ledgerlint.schema import RAW_SCHEMA
from ledgerlint.session import checkpoint_dir


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = RAW_SCHEMA,
             header: bool = True) -> DataFrame:
    """CSV with a header. An explicit schema avoids an inference pass;
    empty cells read as null, a UTF-8 byte-order mark is dropped."""
    reader = spark.read.option("header", header).option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, no index column; ``overwrite`` replaces
    the target as a drop-and-recreate would."""
    df.write.mode(mode).option("header", True).csv(path)


def write_partitioned_by_month(df: DataFrame, path: str, date_col: str,
                               mode: str = "overwrite") -> None:
    """Store a transaction table partitioned by the month of its date, so a
    date-range filter on ``txn_month`` prunes whole folders at read time.

    Rows are rebalanced on the month: AQE cuts a busy month into tasks of
    the advisory size, so the number of writers follows the data. Rows without
    a valid date land in ``__HIVE_DEFAULT_PARTITION__``.
    """
    month = F.date_format(to_date_any(df, date_col), "yyyy-MM")
    (df.withColumn("txn_month", month).hint("rebalance", "txn_month")
       .write.mode(mode).partitionBy("txn_month").parquet(path))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/ledgerlint-{name}-{uuid.uuid4().hex}"


def read_jdbc_paged(spark: SparkSession, url: str, table: str, column: str, lower: int,
                    upper: int, num_partitions: int, properties: dict | None = None) -> DataFrame:
    """A paged remote scan becomes a partitioned JDBC read: each of the
    ``num_partitions`` strides of ``column`` is one task's query."""
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper,
                           numPartitions=num_partitions, properties=properties or {})


def good_reject_split(df: DataFrame, constraints: dict) -> tuple[DataFrame, DataFrame]:
    """S5 (first half): split rows on the target's constraints before writing.

    ``constraints`` maps a reason to a boolean ``Column`` that must hold.
    Rejected rows carry ``reject_reasons`` (array of failed reasons). A row
    passes only when every constraint is true (null counts as a failure).
    """
    checks = [F.when(~F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in constraints.items()]
    tagged = df.withColumn("reject_reasons", F.filter(F.array(*checks), lambda x: x.isNotNull()))
    good = tagged.where(F.size("reject_reasons") == 0).drop("reject_reasons")
    bad = tagged.where(F.size("reject_reasons") > 0)
    return good, bad


def write_jdbc_with_rejects(df: DataFrame, url: str, table: str, constraints: dict,
                            reject_path: str, batchsize: int = 1000, mode: str = "append",
                            properties: dict | None = None) -> dict:
    """Write good rows over JDBC in batches (one connection per
    partition), rejected rows to ``reject_path``; return both counts."""
    good, bad = good_reject_split(df, constraints)
    good.write.option("batchsize", batchsize).jdbc(url, table, mode=mode, properties=properties or {})
    bad.write.mode("overwrite").parquet(reject_path)
    return {"written": good.count(), "rejected": bad.count()}


def ddl_for(df: DataFrame, table: str, key: str, integer_columns=(), all_float: bool = False) -> str:
    """``CREATE TABLE`` text for a frame: the key TEXT PRIMARY KEY,
    integer columns INTEGER, everything else FLOAT (all FLOAT with
    ``all_float``)."""
    lines = []
    for c in df.columns:
        if c == key:
            lines.append(f'    "{c}" TEXT PRIMARY KEY')
        elif not all_float and c in integer_columns:
            lines.append(f'    "{c}" INTEGER')
        else:
            lines.append(f'    "{c}" FLOAT')
    return f"CREATE TABLE {table} (\n" + ",\n".join(lines) + "\n);"


def jdbc_column_types(df: DataFrame, key: str, integer_columns=()) -> str:
    """S6 for JDBC: the ``createTableColumnTypes`` option value."""
    parts = []
    for c in df.columns:
        t = "TEXT" if c == key else ("INTEGER" if c in integer_columns else "FLOAT")
        parts.append(f"`{c}` {t}")
    return ", ".join(parts)


def column_diff(target_columns: list[str], df: DataFrame) -> DataFrame:
    """Columns only in the target and only in the frame (one row each)."""
    spark = df.sparkSession
    t, f = list(target_columns), list(df.columns)
    rows = [(c, "target_only") for c in t if c not in f] + [(c, "frame_only") for c in f if c not in t]
    return spark.createDataFrame(rows, "column string, side string")


def json_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One JSON record per row (nulls written as ``null``)."""
    cols = columns or df.columns
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]),
                               {"ignoreNullFields": "false"}).alias("json"))


def check_after_write(spark: SparkSession, path: str, order_by: list[str] | None = None,
                      fmt: str = "parquet", n: int = 5) -> tuple[int, DataFrame]:
    """Re-read what was written; its row count and the first ``n`` rows."""
    back = spark.read.format(fmt).load(path)
    first = back.orderBy(*order_by).limit(n) if order_by else back.limit(n)
    return back.count(), first
