"""Helpers shared by the operators: scratch tables and safe columns."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlint.session import checkpoint_dir

WORD_GAP = r"[\x20\x09-\x0D]+"
NULL_ID = -(2 ** 63)


def written(df: DataFrame, name: str, made: list | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder of
    ``spark.checkpoint.dir`` and read it back: later jobs start from the
    files, also after an executor is lost. ``made`` gets the path, for
    ``drop`` once no later job can read it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    # the shuffles behind the files are of no use now; Spark drops them when the driver collects its garbage
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, made: list) -> None:
    """Delete scratch tables that ``written`` made."""
    for name in made:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    made.clear()


def col(name: str) -> Column:
    """A column by its plain name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__row`` (all columns), ``did`` and ``th``: a row's key.

    ``did`` is the id (null counts as smaller than any), ``th`` the
    64-bit hash of the text, so that rows which repeat an id (or the null id)
    with another text stay apart while rows repeated whole share their result.
    """
    return docs.select(
        F.struct(*[col(c) for c in docs.columns]).alias("__row"),
        F.coalesce(col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"),
        F.xxhash64(col(text_col)).alias("th"),
        col(text_col).alias("text"))


def with_results(df: DataFrame, columns: list[str], results: list[str]) -> DataFrame:
    """Columns of ``__row`` and then ``results``; a result replaces an input
    column of the same name."""
    taken = {r.lower() for r in results}
    kept = [F.col("__row").getField(c).alias(c) for c in columns if c.lower() not in taken]
    return df.select(*kept, *results)


def row_schema(df: DataFrame, more: str) -> StructType:
    """Schema of ``__row`` and the columns that a task adds."""
    return StructType([df.schema["__row"], *StructType.fromDDL(more).fields])
