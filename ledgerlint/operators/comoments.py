"""Correlations of very many columns from one co-moment matrix.

An expression per pair cannot plan beyond some hundred columns. Here every
task multiplies its rows' value and presence matrices, which gives the sums of
all pairs at once, each over the rows that have both values. The sums add up,
so they are merged as a tree, one matrix row per group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 32
ROWS = 4096
SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
#: A variance below this share of the squares is rounding: the column is constant.
CONSTANT = 1e-12


def lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def summed(table: pa.Table) -> list[np.ndarray]:
    """Sums over the rows of a group, list by list."""
    out = []
    for name in SUMS:
        column = table.column(name).combine_chunks()
        out.append(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).sum(axis=0))
    return out


def correlation_blocks(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a``, ``b`` (columns, in the order given), ``n`` (rows with both) and
    ``r`` (Pearson) of every pair.

    Values are read as doubles; null and NaN are missing, pair by pair. ``r``
    is null for fewer than two rows or a constant column. An empty table gives
    no pairs. A task holds matrices of columns x columns (26 MB
    at 574 columns) and 4,096 rows.
    """
    m = len(columns)
    if m < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, n long, r double")
    values = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"c{i}")
                         for i, c in enumerate(columns)])
    # means shift the values, so that the sums of squares keep their digits
    rows, *means = values.agg(F.count(F.lit(1)), *[F.avg(f"c{i}") for i in range(m)]).first()
    if not rows:
        return df.sparkSession.createDataFrame([], "a string, b string, n long, r double")
    shift = np.array([v if v is not None and np.isfinite(v) else 0.0 for v in means])

    def moments(batches):
        n, sx, sxx, sxy = (np.zeros((m, m)) for _ in range(4))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns], axis=1).astype(np.float64) - shift
                there = ~np.isnan(x)
                x = np.where(there, x, 0.0)
                there = there.astype(np.float64)
                n += there.T @ there
                sx += x.T @ there
                sxx += (x * x).T @ there
                sxy += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(m)), pa.array(np.full(m, TaskContext.get().partitionId() % FAN_IN)),
             *map(lists, (n, sx, sx.T, sxx, sxx.T, sxy))], names=["i", "part", *SUMS])

    def add(key, table):
        return pa.table([pa.array([key[0].as_py()], pa.int64()), *[lists(s[None]) for s in summed(table)]], names=["i", *SUMS])

    def finish(key, table):
        i = key[0].as_py()
        n, sx, sy, sxx, syy, sxy = (s[i + 1:] for s in summed(table))
        with np.errstate(divide="ignore", invalid="ignore"):
            vx, vy = n * sxx - sx * sx, n * syy - sy * sy
            r = np.clip((n * sxy - sx * sy) / np.sqrt(vx * vy), -1.0, 1.0)
        known = (n >= 2) & (vx > CONSTANT * n * sxx) & (vy > CONSTANT * n * syy)
        size = m - i - 1
        return pa.table([pa.array(np.full(size, i)), pa.array(np.arange(i + 1, m)), pa.array(n.astype(np.int64)),
                         pa.array(r, mask=~known)], names=["i", "j", "n", "r"])

    sums = ", ".join(f"{s} array<double>" for s in SUMS)
    rows = values.mapInArrow(moments, f"i long, part long, {sums}")
    rows = rows.groupBy("i", "part").applyInArrow(add, f"i long, {sums}")
    pairs = rows.groupBy("i").applyInArrow(finish, "i long, j long, n long, r double")
    names = F.array(*[F.lit(c) for c in columns])
    return pairs.select(F.element_at(names, (F.col("i") + 1).cast("int")).alias("a"),
                        F.element_at(names, (F.col("j") + 1).cast("int")).alias("b"), "n", "r")
