"""Lags and leads of long tables (W1, W2 at a finer key than the week).

A window over a whole table, or over one hot key, runs in one task. Here the
rows are range-partitioned by (keys, order) and numbered; numbers are cut into
blocks of equal length, and each block borrows the rows just before and behind
it from its neighbours (a halo). A task then sees one block and its halo,
however the rows are spread over the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlint.session import cut_lineage

BLOCK_ROWS = 1 << 16
_IN_PARTITION = (1 << 33) - 1


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def numbered(df: DataFrame, by: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``: the row's number from 0 in the order of ``by``.

    Sorted range partitions are cut from the lineage, so that every later
    step sees the same order; one total per partition reaches the driver.
    Rows that tie on ``by`` are numbered in any order among themselves.
    """
    cols = [F.col(_q(c)) for c in by]
    ranged = df.repartitionByRange(ranges, *cols) if ranges else df.repartitionByRange(*cols)
    ranged = cut_lineage(ranged.sortWithinPartitions(*cols).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    totals = sorted((r["p"], r["n"]) for r in
                    ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    rows, before = [], 0
    for p, n in totals:
        rows.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(rows, "__p long, __before long")
    # one row per partition of the table: a bounded side
    return (ranged.withColumn("__p", part).join(F.broadcast(offsets), "__p")
                  .withColumn(name, F.col("__before") + F.col(name).bitwiseAND(F.lit(_IN_PARTITION)))
                  .drop("__p", "__before"))


def lags_leads(df: DataFrame, keys: list[str], order: list[str], features: list[str], n_past: int,
               n_future: int, target: str | None = None, block_rows: int = BLOCK_ROWS,
               ranges: int | None = None) -> DataFrame:
    """``{f}_t-{i}`` for i in 1..n_past and ``y_{i}`` = ``target`` i rows
    ahead, by row within equal ``keys`` (no keys: the table is one series).

    ``order`` tells the rows of a key apart; rows that tie on it stand in any
    order. A null key is a key of its own, null order values come first.
    Beyond the ends of a series lags and leads are null. An empty table gives
    an empty one.
    """
    if n_future and target is None:
        raise ValueError("leads need a target")
    size = max(block_rows, n_past, n_future, 1)
    own = df.columns
    rows = numbered(df, [*keys, *order], "__g", ranges)
    block = F.floor(F.col("__g") / F.lit(size)).cast("long")
    at = F.col("__g") % F.lit(size)
    # a row goes to its own block, and to the next or the last one if it lies within their halo
    blocks = F.array(block, F.when(at >= size - n_past, block + 1), F.when(at < n_future, block - 1))
    rows = (rows.withColumn("__own", block).withColumn("__b", F.explode(F.filter(blocks, lambda b: b.isNotNull()))))
    key = "named_struct('n', 0" + "".join(f", 'k{i}', {_q(k)}" for i, k in enumerate(keys)) + ")"
    packed = (f"named_struct('k', {key}"
              + "".join(f", 'f{j}', {_q(c)}" for j, c in enumerate(features)) + ")")
    ahead = f"named_struct('k', {key}, 'y', {_q(target)})" if n_future else None
    over = "OVER (PARTITION BY __b ORDER BY __g)"
    step = rows.selectExpr("*", *[f"lag({packed}, {i}) {over} AS `__lag{i}`" for i in range(1, n_past + 1)],
                           *[f"lead({ahead}, {i}) {over} AS `__lead{i}`" for i in range(1, n_future + 1)])
    step = step.where(F.col("__b") == F.col("__own"))
    lags = [f"if(`__lag{i}`.k <=> {key}, `__lag{i}`.f{j}, null) AS {_q(f'{c}_t-{i}')}"
            for j, c in enumerate(features) for i in range(1, n_past + 1)]
    leads = [f"if(`__lead{i}`.k <=> {key}, `__lead{i}`.y, null) AS `y_{i}`" for i in range(1, n_future + 1)]
    return step.selectExpr(*[_q(c) for c in own], *lags, *leads)
