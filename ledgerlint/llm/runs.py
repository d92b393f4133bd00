"""Periodic runs by a dictionary of basic factors.

A basic factor is a stretch of 2**k words. Level by level every factor that
occurs more than once in its document gets a number, made of the numbers of
its two halves; factors that occur once leave, so higher levels hold only what
repeats. An occurrence whose next two occurrences follow at one distance of at
most twice the factor's length starts an arithmetic progression, and the
distance is a proposed period. A run of period q and exponent 4 holds such a
progression of distance q at the level of the smallest power of two from q on.
Proposals are extended to both sides, and of equal stretches the smallest
period is the run's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlint.llm.common import WORD_GAP, with_results
from ledgerlint.llm.pieces import with_text
from ledgerlint.llm.words import chunks, find_words, flat, join_words, text_array

MIN_EXPONENT = 4
MIN_LENGTH = 6
FIRST_STEP = 32


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A number per word: equal for equal bytes in the same row, by a
    dictionary of the bytes themselves."""
    raw = join_words(data, starts, ends)
    cuts = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    # the joining blank ends every word but the last, for all alike
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(raw + b" ")]).dictionary_encode()
    number = words.indices.to_numpy().astype(np.int64)
    return np.unique(row.astype(np.int64) * len(words.dictionary) + number, return_inverse=True)[1]


def extend(number: np.ndarray, at: np.ndarray, gap: np.ndarray, step: int) -> np.ndarray:
    """How far from ``at`` words equal those ``gap`` further on, walking by
    ``step`` (1 or -1); strides double, so the work follows the answer."""
    n, reach = len(number), np.zeros(len(at), dtype=np.int64)
    live, stride = np.arange(len(at)), FIRST_STEP
    while len(live):
        inner = np.arange(stride)
        here = at[live, None] + step * (reach[live, None] + inner)
        there = here + gap[live, None]
        inside = (here >= 0) & (there < n)
        same = inside & (number[np.clip(here, 0, n - 1)] == number[np.clip(there, 0, n - 1)])
        whole = same.all(axis=1)
        reach[live] += np.where(whole, stride, np.argmin(same, axis=1))
        live = live[whole]
        if len(live) * stride < 1 << 20:
            stride *= 2
    return reach


def find_runs(number: np.ndarray, exponent: int = MIN_EXPONENT, least: int = MIN_LENGTH) -> np.ndarray:
    """Start, length and period of every run in a sequence of numbers (equal
    numbers never stand in two documents), by start and period."""
    n = len(number)
    found = []
    at, name, size = np.arange(n), number.astype(np.int64), 1
    while len(at):
        order = np.argsort(name, kind="stable")
        here, names = at[order], name[order]
        same = names[1:] == names[:-1]
        gap = here[1:] - here[:-1]
        # an occurrence, the next and the one after it at equal distances
        row = np.flatnonzero(same[:-1] & same[1:] & (gap[:-1] == gap[1:]) & (gap[:-1] <= 2 * size))
        if len(row):
            first, period = here[row], gap[row]
            by = np.lexsort((first, period))
            first, period = first[by], period[by]
            # neighbours of one distance lie in the same stretch
            new = np.append(True, (first[1:] != first[:-1] + 1) | (period[1:] != period[:-1]))
            first, period = first[new], period[new]
            left = extend(number, first - 1, period, -1)
            right = extend(number, first, period, 1)
            found.append(np.stack([first - left, left + right + period, period], axis=1))
        # factors of twice the size: both halves repeat
        repeats = np.zeros(len(at), dtype=bool)
        repeats[order[:-1]] = same
        repeats[order[1:]] |= same
        at, name = at[repeats], name[repeats]
        if not len(at):
            break
        half = np.searchsorted(at, at + size)
        both = (half < len(at)) & (at[np.minimum(half, len(at) - 1)] == at + size)
        pairs = name[both] * (int(name.max()) + 1) + name[half[both]]
        at, name = at[both], np.unique(pairs, return_inverse=True)[1] if both.any() else name[:0]
        size *= 2
    if not found:
        return np.zeros((0, 3), dtype=np.int64)
    runs = np.concatenate(found)
    runs = runs[(runs[:, 1] >= least) & (runs[:, 1] >= exponent * runs[:, 2])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # the same stretch under a multiple of its period, or found at several levels
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


RUN_COLUMNS = ["n_words", "runs", "collapsed"]


def collapse_runs(docs: DataFrame, text_col: str = "text", exponent: int = MIN_EXPONENT,
                  least: int = MIN_LENGTH) -> DataFrame:
    """Every row with ``n_words``, ``runs`` (array of start, length and period
    in words, by start and period) and ``collapsed``: its words without those
    that a run holds after its first period, joined by one space.

    A run is a stretch of words with smallest period q, at least ``least``
    words and ``exponent`` periods long, that no neighbouring word extends. Words are runs of bytes other than space and
    0x09-0x0D, compared by their bytes. Null or empty text, or text of blanks:
    no words, no runs, an empty collapsed text. Rows are independent: repeated
    rows, ties and null ids need no rule, an empty table stays empty. Input
    columns named like a result are replaced. Half a megabyte of text, or one
    longer text, is in memory at a time.

    ``exponent`` must be 4 or more: runs of fewer periods need not hold the
    progression that proposes them.
    """
    if exponent < 4:
        raise ValueError("exponent must be 4 or more")
    rows = with_text(docs, text_col)

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                own, cuts = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                starts, ends, before = find_words(own, cuts)
                row = np.repeat(np.arange(b - a), np.diff(before))
                runs = find_runs(word_numbers(own, starts, ends, row), exponent, least) if len(starts) else \
                    np.zeros((0, 3), dtype=np.int64)
                change = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(change, runs[:, 0] + runs[:, 2], 1)
                np.add.at(change, runs[:, 0] + runs[:, 1], -1)
                keep = np.cumsum(change[:-1]) == 0
                kept = np.concatenate([[0], np.cumsum(keep)])[before].tolist()
                s, e = starts[keep], ends[keep]
                owner = row[runs[:, 0]]
                listed = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(runs[:, 0] - before[owner]), pa.array(runs[:, 1]),
                                                pa.array(runs[:, 2])], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__row").slice(a, b - a), pa.array(np.diff(before)), listed,
                     text_array([join_words(own, s[x:y], e[x:y]) for x, y in zip(kept[:-1], kept[1:])])],
                    names=["__row", *RUN_COLUMNS])

    out = rows.mapInArrow(run, StructType([rows.schema["__row"], *StructType.fromDDL(
        "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string").fields]))
    return with_results(out, docs.columns, RUN_COLUMNS)


def repeated_tail(docs: DataFrame) -> DataFrame:
    """The query's input: in one document of ten (by crc32 of its id, h) the
    words from a = floor(h / 10) % n on repeat with period
    1 + floor((n - a) / (3 + floor(h / 10) % 8)); other texts stay. A null id
    leaves its text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", WORD_GAP, -1), lambda w: w != "")
    n, g = F.size("w").cast("long"), F.floor(h / 10)
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    rows = rows.select("doc_id", "text", F.when(n > 0, F.col("w")).alias("w"),
                       F.when(n > 0, a).alias("a"), F.when(n > 0, p).alias("p"))
    new = F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), F.transform(
        F.slice("w", (F.col("a") + 1).cast("int"), F.size("w")),
        lambda x, i: F.element_at("w", (F.col("a") + 1 + F.pmod(i, F.col("p"))).cast("int"))))
    return rows.select("doc_id", F.when(F.col("w").isNotNull(), F.array_join(new, " ")).otherwise(F.col("text")).alias("text"))


def runs_digest(docs: DataFrame) -> DataFrame:
    """Number of runs, the longest one and digests, per document."""
    out = collapse_runs(repeated_tail(docs.select("doc_id", "text")))
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), 0)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"),
                     best.alias("best"),
                     F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                     F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    length = -F.col("best.l")
    return out.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"),
                      F.col("best.period").alias("period"),
                      F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256")
