"""One-hot encoding of columns with very many levels.

``stats.one_hot`` makes a column of every level, which no plan holds beyond
some thousands. Here the levels are a table (column, level, slot), numbered
without a single task or the driver seeing them all, and a row is the sorted
list of the slots that hold a one: the layout of a sparse vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlint.operators.ordered import numbered

MISSING = "nan"


def _level(column: str):
    return F.coalesce(F.col("`" + column.replace("`", "``") + "`").cast("string"), F.lit(MISSING))


def level_slots(df: DataFrame, categorical: list[str], ranges: int | None = None) -> DataFrame:
    """``column``, ``level`` and ``slot`` (from 0: columns in the given order,
    the levels of each sorted). A missing value is the level ``nan``.

    Pairs are made distinct map-side first, so a level that a third of the
    rows hold is one row per task before the shuffle.
    """
    parts = [F.struct(F.lit(i).alias("__at"), F.lit(c).alias("column"), _level(c).alias("level"))
             for i, c in enumerate(categorical)]
    pairs = df.select(F.explode(F.array(*parts)).alias("p")).select("p.*").distinct()
    return numbered(pairs, ["__at", "level"], "slot", ranges).drop("__at")


def sparse_one_hot(df: DataFrame, categorical: list[str], slots: DataFrame, numeric: list[str] = (),
                   target: str | None = None, features: str = "features") -> DataFrame:
    """Numeric columns as they are, ``features`` and the target.

    ``features`` is a struct (size, indices, values): one index for each
    categorical column, in the order of ``categorical``. A level that
    ``slots`` does not hold (a table fitted on other rows) gives no index.
    Slots come by one join per column; AQE broadcasts a small dictionary by
    its measured size and splits a hot level's rows otherwise.
    """
    size = slots.agg((F.coalesce(F.max("slot"), F.lit(-1)) + 1).alias("n")).first()["n"]
    quoted = ["`" + c.replace("`", "``") + "`" for c in [*numeric, *([target] if target else [])]]
    rows = df.select(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(quoted)],
                     *[_level(c).alias(f"__l{i}") for i, c in enumerate(categorical)])
    for i, c in enumerate(categorical):
        of = slots.where(F.col("column") == c).select(F.col("level").alias(f"__l{i}"), F.col("slot").alias(f"__s{i}"))
        rows = rows.join(of, f"__l{i}", "left")
    held = F.filter(F.array(*[F.col(f"__s{i}") for i in range(len(categorical))]), lambda s: s.isNotNull())
    vector = F.struct(F.lit(size).cast("long").alias("size"), held.alias("indices"),
                      F.transform(held, lambda s: F.lit(1.0)).alias("values"))
    names = [F.col(f"__o{i}").alias(c) for i, c in enumerate([*numeric, *([target] if target else [])])]
    return rows.select(*names[:len(numeric)], vector.alias(features), *names[len(numeric):])


def one_hot_cells(encoded: DataFrame, keys: list[str], features: str = "features") -> DataFrame:
    """The non-zero cells: ``keys``, ``slot`` and ``value``."""
    v = F.col(f"`{features}`")
    return encoded.select(*[F.col(f"`{k}`") for k in keys],
                          F.explode(F.arrays_zip(v["indices"].alias("slot"), v["values"].alias("value"))).alias("c")) \
        .select(*[F.col(f"`{k}`") for k in keys], F.col("c.slot").alias("slot"), F.col("c.value").alias("value"))
