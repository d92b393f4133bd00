"""Batched inserts with row-by-row retry (S5) and paged scans (S2) as Python
data sources of Spark, over folders that all executors share.

Both talk to their far side through a small class with one method, so another
target or service needs only that class: ``insert`` takes a batch of the offered rows
or raises, ``fetch`` gives a page or nothing. Files are reached through ``pyarrow.fs``
(local, HDFS, S3).
"""

from __future__ import annotations

import bisect
import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

COUNTS = "_counts.json"
REASON = "reject_reason"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if "://" not in path and ":/" in path:  # file:/a as Hadoop prints it
        path = path.replace(":/", ":///", 1)
    return pafs.FileSystem.from_uri(path)


# ------------------------------------------------------------------ insert
class Rejected(ValueError):
    """A batch that the target does not take; ``reason`` of its first bad row."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


class TypedFolder:
    """A table kept as Parquet files: ``insert`` takes a batch whole or raises.

    Values are cast to the columns' types; a value that does not fit, a null in
    a required column and a key that the writer's task took already are
    refused. Rows reach the table when the job commits. ``offer`` hands over the
    rows that the next batches are slices of: they are cast and judged column
    by column, so that a batch only asks for the verdicts of its rows.
    """

    def __init__(self, path: str, schema: pa.Schema, key: str | None):
        self.fs, self.path = file_system(path)
        self.schema, self.key, self.last = schema, key, None
        self.name = f"part-{uuid.uuid4().hex}.parquet"
        self.writer, self.rows, self.reasons, self.bad = None, None, {}, []
        self.taken, self.held, self.n_held = None, [], 0

    def offer(self, rows: pa.RecordBatch) -> None:
        self._keep()
        reasons, columns = {}, []
        for field in self.schema:
            column = rows.column(field.name)
            if not field.nullable and column.null_count:
                for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)):
                    reasons.setdefault(int(i), f"{field.name} is null")
            if pa.types.is_string(column.type) and not pa.types.is_string(field.type):
                column = pc.utf8_trim_whitespace(column)
            column, misfits = cast_rows(column, field.type)
            for i in misfits:
                reasons.setdefault(i, f"{field.name} is no {field.type}")
            columns.append(column)
        out = pa.RecordBatch.from_arrays(columns, schema=pa.schema([f.with_nullable(True) for f in self.schema]))
        if self.key is not None:  # the task's rows come sorted by key
            fit = [i for i in range(rows.num_rows) if i not in reasons] if reasons else None
            keys = out.column(self.key) if fit is None else out.column(self.key).take(pa.array(fit, pa.int64()))
            if len(keys):
                before = pa.concat_arrays([pa.array([self.last], keys.type), keys.slice(0, len(keys) - 1)])
                again = np.flatnonzero(pc.fill_null(pc.equal(keys, before), False).to_numpy(zero_copy_only=False))
                for j in again:
                    reasons[int(j) if fit is None else fit[j]] = f"{self.key} is taken"
                self.last = keys[-1].as_py()
        self.rows, self.reasons, self.bad = out, reasons, sorted(reasons)
        self.taken = np.zeros(rows.num_rows, dtype=bool)

    def insert(self, start: int, stop: int) -> None:
        """Take the offered rows from ``start`` up to ``stop``."""
        at = bisect.bisect_left(self.bad, start)
        if at < len(self.bad) and self.bad[at] < stop:
            raise Rejected(self.reasons[self.bad[at]])
        self.taken[start:stop] = True

    def _keep(self) -> None:
        if self.taken is not None and self.taken.any():
            out = self.rows.filter(pa.array(self.taken))
            self.held.append(pa.RecordBatch.from_arrays(out.columns, schema=self.schema))
            self.n_held += out.num_rows
        self.taken = None
        if self.n_held >= 8192:
            self.flush()

    def flush(self):
        if self.held:
            if self.writer is None:
                self.fs.create_dir(self.path, recursive=True)
                self.writer = pq.ParquetWriter(f"{self.path}/{self.name}", self.schema, filesystem=self.fs)
            self.writer.write_table(pa.Table.from_batches(self.held, self.schema))
            self.held, self.n_held = [], 0

    def close(self) -> list[str]:
        self._keep()
        self.flush()
        if self.writer is None:
            return []
        self.writer.close()
        return [self.name]


def cast_rows(column: pa.Array, to: pa.DataType) -> tuple[pa.Array, list[int]]:
    """The column in another type, null where a value does not fit, and the
    rows of those values: halves are cast until a part is whole or one value."""
    done, misfits, parts = [], [], [(0, len(column))]
    while parts:
        start, n = parts.pop()
        try:
            done.append(column.slice(start, n).cast(to))
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
            if n <= 1:
                misfits += range(start, start + n)
                done.append(pa.nulls(n, to))
            else:
                parts += [(start + n // 2, n - n // 2), (start, n // 2)]
    return pa.concat_arrays(done), misfits


class RejectFile:
    """Refused rows with their reason, written in groups of many rows."""

    def __init__(self, path: str):
        self.fs, self.path = file_system(path)
        self.name, self.writer, self.held, self.n_held = f"part-{uuid.uuid4().hex}.parquet", None, [], 0

    def add(self, rows: pa.RecordBatch, at: list[int], reasons: list[str]) -> None:
        if at:
            self.held.append(pa.Table.from_batches([rows.take(pa.array(at))]).append_column(REASON, pa.array(reasons)))
            self.n_held += len(at)
        if self.n_held >= 8192:
            self.flush()

    def flush(self) -> None:
        if self.held:
            table = pa.concat_tables(self.held)
            if self.writer is None:
                self.fs.create_dir(self.path, recursive=True)
                self.writer = pq.ParquetWriter(f"{self.path}/{self.name}", table.schema, filesystem=self.fs)
            self.writer.write_table(table)
            self.held, self.n_held = [], 0

    def close(self) -> list[str]:
        self.flush()
        if self.writer is None:
            return []
        self.writer.close()
        return [self.name]


@dataclass
class TaskCounts(WriterCommitMessage):
    good: int
    failed: dict
    batches: int
    retried: int
    files: list
    rejects: list


class BatchedWriter(DataSourceArrowWriter):
    """Each task inserts ``batch`` rows at a time; a batch that fails is tried
    again row by row, and rows that fail alone go to the rejects with their
    reason. Only files of committed tasks become part of the table."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.batch = options["path"].rstrip("/"), int(options.get("batch", 1000))
        self.stage = f"{self.path}/_stage-{options['job']}"
        self.target = StructType.fromJson(json.loads(options["target"]))
        self.key = options.get("key")

    def write(self, iterator) -> TaskCounts:
        target = TypedFolder(f"{self.stage}/rows", to_arrow_schema(self.target), self.key)
        rejects = RejectFile(f"{self.stage}/rejects")
        out = TaskCounts(0, {}, 0, 0, [], [])
        for big in iterator:
            target.offer(big)
            bad, reasons = [], []
            for start in range(0, big.num_rows, self.batch):
                stop = min(start + self.batch, big.num_rows)
                out.batches += 1
                try:
                    target.insert(start, stop)
                    out.good += stop - start
                    continue
                except Rejected:
                    out.retried += 1
                for i in range(start, stop):
                    try:
                        target.insert(i, i + 1)
                        out.good += 1
                    except Rejected as error:
                        out.failed[error.reason] = out.failed.get(error.reason, 0) + 1
                        bad.append(i)
                        reasons.append(error.reason)
            rejects.add(big, bad, reasons)
        out.files, out.rejects = target.close(), rejects.close()
        return out

    def commit(self, messages) -> None:
        fs, path = file_system(self.path)
        stage = file_system(self.stage)[1]
        total = {"good": 0, "failed": {}, "batches": 0, "retried": 0}
        for message in messages:
            for kind in ("good", "batches", "retried"):
                total[kind] += getattr(message, kind)
            for reason, n in message.failed.items():
                total["failed"][reason] = total["failed"].get(reason, 0) + n
            for kind, names in (("rows", message.files), ("rejects", message.rejects)):
                fs.create_dir(f"{path}/{kind}", recursive=True)
                for name in names:
                    fs.move(f"{stage}/{kind}/{name}", f"{path}/{kind}/{name}")
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{COUNTS}") as f:
            f.write(json.dumps(total).encode())
        self._clear(fs, stage)

    def abort(self, messages) -> None:
        fs, stage = file_system(self.stage)
        self._clear(fs, stage)

    @staticmethod
    def _clear(fs, stage: str):
        if fs.get_file_info(stage).type == pafs.FileType.Directory:
            fs.delete_dir(stage)


class BatchedTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledgerlint_batches"

    def writer(self, schema: StructType, overwrite: bool):
        return BatchedWriter(self.options, schema)


def write_in_batches(df: DataFrame, path: str, target: StructType, batch: int = 1000, key: str | None = None) -> dict:
    """Insert ``df`` into the table at ``path`` (a new folder) in batches;
    ``target`` names its columns, types and required columns.

    A failing batch is retried row by row. Returns what the tasks that
    committed counted: ``good``, ``failed`` (reason to rows; a row's first bad
    column in the target's order), ``batches`` and ``retried``. Rows are under
    ``path/rows``, rejected ones with ``reject_reason`` under
    ``path/rejects``. With ``key``, a key value is taken once: equal keys meet
    in one task, sorted by all columns, so the first one is always the same.
    Null keys are spread; they fail only if the key is required.
    """
    spark = df.sparkSession
    if key is not None:
        k = F.col(f"`{key}`")
        spread = F.when(k.isNull(), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(64)))
        df = df.repartition(k, spread).sortWithinPartitions(k, *[F.col(f"`{c}`") for c in df.columns if c != key])
    spark.dataSource.register(BatchedTable)
    options = {"path": path, "batch": batch, "target": target.json(), "job": uuid.uuid4().hex} | ({"key": key} if key else {})
    df.write.format("ledgerlint_batches").options(**options).mode("append").save()
    fs, inside = file_system(path)
    with fs.open_input_stream(f"{inside}/{COUNTS}") as f:
        return json.loads(f.read())


# ------------------------------------------------------------------ pages
class PageFolder:
    """Pages as folders ``page=<number>`` of Parquet files, numbered from 0."""

    def __init__(self, path: str):
        self.fs, self.path = file_system(path)

    def fetch(self, page: int) -> pa.Table | None:
        """A page's rows; nothing if it is empty or not there."""
        folder = f"{self.path}/page={page}"
        if self.fs.get_file_info(folder).type != pafs.FileType.Directory:
            return None
        names = sorted(f.path for f in self.fs.get_file_info(pafs.FileSelector(folder)) if f.path.endswith(".parquet"))
        tables = [pq.ParquetFile(self.fs.open_input_file(n)).read() for n in names]
        table = pa.concat_tables(tables) if tables else None
        return table if table is not None and table.num_rows else None


def count_pages(fetch) -> int:
    """The number of the first empty page, asked in doubling steps and then
    by halves: about twice log2 of the pages are fetched."""
    high = 1
    while fetch(high - 1) is not None:
        high *= 2
    low = high // 2  # page low - 1 is filled (or low is 0), page high - 1 is empty
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if fetch(middle - 1) is not None else (low, middle)
    return low


class PageRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PagedReader(DataSourceReader):
    """Ranges of pages as partitions; a task stops at the first empty page."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"].rstrip("/"), schema
        self.per_task = int(options.get("pages_per_task", 16))

    def partitions(self):
        pages = count_pages(PageFolder(self.path).fetch)
        return [PageRange(a, min(a + self.per_task, pages)) for a in range(0, pages, self.per_task)] or [PageRange(0, 0)]

    def read(self, partition: PageRange):
        source, schema = PageFolder(self.path), to_arrow_schema(self.schema)
        for page in range(partition.first, partition.last):
            table = source.fetch(page)
            if table is None:
                return
            yield from table.select(schema.names).cast(schema).to_batches()


class PagedTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledgerlint_pages"

    def reader(self, schema: StructType):
        return PagedReader(self.options, schema)


def read_pages(spark: SparkSession, path: str, schema: StructType, pages_per_task: int = 16) -> DataFrame:
    """All rows of the pages under ``path``, up to the first empty one."""
    spark.dataSource.register(PagedTable)
    return spark.read.format("ledgerlint_pages").schema(schema).options(path=path, pages_per_task=pages_per_task).load()


def write_pages(df: DataFrame, path: str, page_rows: int = 1000) -> None:
    """A table as pages of ``page_rows`` rows (the last may hold fewer)."""
    from ledgerlint.operators.models import global_index
    order = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    paged = global_index(df, [], order, "__at").withColumn("page", F.floor(F.col("__at") / page_rows)).drop("__at")
    paged.repartition("page").write.partitionBy("page").parquet(path)
