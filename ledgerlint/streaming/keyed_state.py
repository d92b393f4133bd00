"""Keyed state on a stream: first rows of a key (Q4) and the exact weekly
repeat ratio (G1, G2).

State is one flag per key, held by Spark's state store and dropped by an
event-time time-out, so it survives a lost executor and stays bounded. Rows of
a hot key pass through in Arrow batches; none of them is gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

from ledgerlint.streaming.audit_stream import MONDAY_OFFSET


def _until(state, event_ms: int, horizon_ms: int) -> None:
    """Keep a key until ``horizon_ms`` behind its newest event."""
    state.setTimeoutTimestamp(max(event_ms + horizon_ms, state.getCurrentWatermarkMs() + 1))


def _ms(at) -> int:
    return int(at.timestamp() * 1000)


#: Groups of keys that share one state row. Part of a stream's checkpoint: keep it between runs.
KEY_GROUPS = 4096
DIGEST = np.dtype("S64")


def flag_first_stream(stream: DataFrame, key_cols: list[str], event_time: str, order_col: str,
                      watermark: str = "1 day", horizon_ms: int = 30 * 86_400_000,
                      key_groups: int = KEY_GROUPS) -> DataFrame:
    """All rows with ``is_first``: true for the first row of each key.

    First is by micro-batch, within one by ``event_time`` and ``order_col``
    (rows without event time are left out). A null in a key column is a value like any
    other. A key that was not seen for ``horizon_ms`` of event time is
    forgotten, its next row is a first again; rows later than the watermark
    are still flagged.

    Keys are dealt to ``key_groups`` groups by a hash, so that a call of
    Python serves many keys; a group's state holds the digest, newest time and
    time-out of each of its keys. One row per key of the group waits as the best
    candidate while the others pass, so memory does not grow with a key's rows.
    """
    stream = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    schema = StructType([*stream.schema.fields, StructField("is_first", BooleanType())])
    columns = stream.columns

    def load(state):
        held = state.get if state.exists else (b"", b"", b"")
        return (np.frombuffer(held[0], dtype=DIGEST), np.frombuffer(held[1], dtype=np.int64), np.frombuffer(held[2], dtype=np.int64))

    def keep(state, digests, newest, until):
        if len(digests):
            state.update((digests.astype(DIGEST).tobytes(), newest.astype(np.int64).tobytes(), until.astype(np.int64).tobytes()))
            state.setTimeoutTimestamp(int(max(until.min(), state.getCurrentWatermarkMs() + 1)))
        else:
            state.remove()

    def step(_, batches, state):
        now = state.getCurrentWatermarkMs()
        digests, newest, until = load(state)
        if state.hasTimedOut:
            left = until >= now
            keep(state, digests[left], newest[left], until[left])
            return
        best, top = None, None  # the best row and the newest time of each key so far
        for pdf in batches:
            if not len(pdf):
                continue
            tops = pdf.groupby("__key", sort=False)[event_time].max()
            top = tops if top is None else pd.concat([top, tops]).groupby(level=0, sort=False).max()
            pdf = pdf[[*columns, "__key"]]
            pdf = pdf if best is None else pd.concat([best, pdf], ignore_index=True)
            pdf = pdf.sort_values([event_time, order_col], kind="stable")
            again = pdf.duplicated("__key").to_numpy()
            best, rest = pdf[~again], pdf[again]
            if len(rest):
                yield rest[columns].assign(is_first=False)
        if best is None:
            return
        met = best["__key"].to_numpy().astype(DIGEST)
        order = np.argsort(met)
        best, met = best.iloc[order], met[order]
        top = top.loc[best["__key"]].to_numpy().astype("datetime64[ms]").astype(np.int64)
        at = best[event_time].to_numpy().astype("datetime64[ms]").astype(np.int64)
        # the state's keys are sorted as well
        place = np.minimum(np.searchsorted(digests, met), max(len(digests) - 1, 0))
        known = digests[place] == met if len(digests) else np.zeros(len(met), dtype=bool)
        last = newest[place[known]]
        first = np.ones(len(met), dtype=bool)
        first[known] = at[known] > last + horizon_ms
        yield best[columns].assign(is_first=first)
        top[known] = np.maximum(top[known], last)
        other = until >= now  # a key whose time is up and that has no row here is forgotten
        other[place[known]] = False
        merged = np.concatenate([digests[other], met])
        order = np.argsort(merged)
        keep(state, merged[order], np.concatenate([newest[other], top])[order],
             np.concatenate([until[other], np.maximum(top + horizon_ms, now + 1)])[order])

    keys = F.struct(*[F.col(f"`{c}`") for c in key_cols])
    grouped = (stream.where(F.col(event_time).isNotNull()).withWatermark(event_time, watermark)
               .withColumn("__key", F.sha2(F.to_json(keys, {"ignoreNullFields": "false"}), 256))
               .withColumn("__group", F.pmod(F.xxhash64("__key"), F.lit(key_groups))).groupBy("__group"))
    return grouped.applyInPandasWithState(step, schema, "digests binary, newest binary, until binary", "append",
                                          GroupStateTimeout.EventTimeTimeout)


def weekly_customers_stream(stream: DataFrame, event_time: str, customer: str, watermark: str = "1 day",
                            horizon_ms: int = 30 * 86_400_000) -> DataFrame:
    """Increments (``Year_Week``, ``n_rows``, ``n_new``) per Monday week,
    customer and micro-batch; ``n_new`` is 1 the first time a customer is
    seen in the week. Sums of them over a week are exact counts of rows and
    distinct customers (``repeat_ratio``). Null customers are one customer,
    rows without event time belong to no week and are left out.
    """
    def combined(batches):  # rows of one Arrow batch, combined before the shuffle
        for pdf in batches:
            yield pdf.groupby(["week", "customer", "missing"], as_index=False, sort=False).agg(
                n=("n", "sum"), at=("at", "max"))[["at", "week", "customer", "missing", "n"]]

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        n, newest = 0, None
        for pdf in batches:
            if len(pdf):
                n += int(pdf["n"].sum())
                newest = pdf["at"].max() if newest is None else max(newest, pdf["at"].max())
        if n:
            new = 0 if state.exists else 1
            state.update((True,))
            _until(state, _ms(newest), horizon_ms)
            yield pd.DataFrame({"Year_Week": [key[0]], "n_rows": [n], "n_new": [new]})

    at = F.col(event_time).cast("timestamp")
    rows = stream.select(
        at.alias("at"), F.date_format(F.window(at, "7 days", "7 days", MONDAY_OFFSET)["start"], "yyyy-MM-dd").alias("week"),
        F.coalesce(F.col(customer).cast("string"), F.lit("")).alias("customer"),
        F.col(customer).isNull().alias("missing"), F.lit(1).cast("long").alias("n")).where(F.col("at").isNotNull())
    small = rows.mapInPandas(combined, "at timestamp, week string, customer string, missing boolean, n long")
    return (small.withWatermark("at", watermark).groupBy("week", "customer", "missing")
            .applyInPandasWithState(step, "Year_Week string, n_rows long, n_new long", "seen boolean", "append",
                                    GroupStateTimeout.EventTimeTimeout))


def repeat_ratio(increments: DataFrame) -> DataFrame:
    """Rows, distinct customers and repeat ratio per week from the written
    increments of ``weekly_customers_stream``."""
    return increments.groupBy("Year_Week").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_new").alias("n_customers"),
        (F.lit(1.0) - F.sum("n_new") / F.sum("n_rows")).alias("repeat_ratio"))


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Run ``stream`` over all that is there, append to Parquet under
    ``folder`` (shared, with the query's checkpoint) and read the table."""
    out = f"{folder.rstrip('/')}/rows"
    stream.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", f"{folder.rstrip('/')}/state").outputMode("append").trigger(availableNow=True).start() \
        .awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
