"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed (a run of ``min_match``
tokens) are tiled: the longest common run of unmarked tokens is found by
Karp-Rabin hashes and marked on both sides, again and again, until none of
``min_match`` tokens is left. The share of the item's tokens that is marked
is its coverage, whatever the order in which its passages appear.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlint.llm.common import NULL_ID, col, row_keys
from ledgerlint.llm.words import (IS_NO_LETTER, SliceHash, chunks, flat, lower_ascii, word_hashes)

MIN_MATCH = 5
MIN_COVERAGE = 0.5
BROADCAST_BYTES = 16 << 20


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a string column (runs of ASCII letters and
    digits and other bytes from 128 on; A-Z lower-cased) and n+1 bounds."""
    data, offsets = flat(column)
    return batch_tokens(data, offsets)


def batch_tokens(data: np.ndarray, offsets: np.ndarray):
    _, _, before, codes = word_hashes(lower_ascii(data), offsets, IS_NO_LETTER)
    return codes, before


def runs_of(free: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows of ``size`` that lie wholly in free places."""
    if len(free) < size:
        return np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(sums[size:] - sums[:-size] == size)


def run_ends(free: np.ndarray) -> np.ndarray:
    """For each place the first place from it on that is not free."""
    stop = np.where(free, len(free), np.arange(len(free)))
    return np.minimum.accumulate(stop[::-1])[::-1]


def maximal(pattern: np.ndarray, text: np.ndarray, hashes, p_free: np.ndarray, t_free: np.ndarray, size: int):
    """Common runs (place in pattern, in text, length) of ``size`` free tokens
    or more that can be extended to neither side.

    Windows meet by hash; of equal windows, only those pairs are formed whose
    left neighbours differ (a taken token or an end differs from all), so a
    text that repeats itself gives a pair per diagonal, not per place. Lengths
    are found by binary search over hashes.
    """
    p_hash, t_hash = hashes
    p, t = runs_of(p_free, size), runs_of(t_free, size)
    empty = np.zeros(0, np.int64)
    if not len(p) or not len(t):
        return empty, empty, empty
    marks = np.unique(np.concatenate([p_hash.of(p, p + size), t_hash.of(t, t + size)]), return_inverse=True)[1]
    left = np.unique(np.concatenate([pattern[p - 1], text[t - 1]]), return_inverse=True)[1] + 2
    left[:len(p)][(p == 0) | ~p_free[p - 1]] = 0
    left[len(p):][(t == 0) | ~t_free[t - 1]] = 1
    key = marks.astype(np.int64) << 32 | left
    order = np.argsort(key[len(p):], kind="stable")
    keys, own, group = key[len(p):][order], key[:len(p)], marks[:len(p)].astype(np.int64) << 32
    bounds = [np.searchsorted(keys, x, "left") for x in (group, own, own + 1, group + (1 << 32))]
    a, b = [], []
    for lo, hi in (bounds[:2], bounds[2:]):
        n = hi - lo
        a.append(np.repeat(p, n))
        b.append(t[order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]])
    a, b = np.concatenate(a), np.concatenate(b)
    low = np.full(len(a), size)
    high = np.minimum(run_ends(p_free)[a] - a, run_ends(t_free)[b] - b)
    while (open_ := low < high).any():
        mid = np.where(open_, (low + high + 1) // 2, low)
        same = p_hash.of(a, a + mid) == t_hash.of(b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return a, b, low


def tile(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in pattern, place in text, length), longest first; ties
    go to the first place in the pattern, then in the text.

    The windows' size is halved from the pattern's length down to ``least``.
    At each size the maximal common runs wait in a heap; one that has lost
    tokens to an earlier tile goes back as the parts that are left. Work grows
    with the number of such runs, one per diagonal that the texts share.
    """
    tiles, least = [], min(least, len(pattern))
    if not least:
        return tiles
    hashes = SliceHash(pattern), SliceHash(text)
    p_free, t_free = np.ones(len(pattern), bool), np.ones(len(text), bool)
    size = len(pattern)
    while True:
        a, b, n = maximal(pattern, text, hashes, p_free, t_free, size)
        heap = list(zip((-n).tolist(), a.tolist(), b.tolist(), strict=True))
        heapq.heapify(heap)
        while heap:
            n, a, b = heapq.heappop(heap)
            free = p_free[a:a - n] & t_free[b:b - n] & (pattern[a:a - n] == text[b:b - n])
            if free.all():
                tiles.append((a, b, -n))
                p_free[a:a - n] = t_free[b:b - n] = False
                if not len(runs_of(p_free, size)):
                    break
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
            for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if hi - lo >= size:
                    heapq.heappush(heap, (lo - hi, a + lo, b + lo))
        if size == least:
            return tiles
        size = max(least, size // 2)


class Seeds:
    """Items by the hashes of their seeds; an item of fewer tokens than
    ``min_match`` has one seed, itself."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray, min_match: int):
        self.codes, self.bounds, self.min_match = codes, bounds, min_match
        sizes, hashes = np.diff(bounds), SliceHash(codes)
        self.by_size = {}
        for k in sorted({min(min_match, int(s)) for s in sizes if s}):
            items = np.flatnonzero(sizes >= k if k == min_match else sizes == k)
            counts = sizes[items] - k + 1
            owner = np.repeat(items, counts)
            start = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[owner]
            marks = hashes.of(start, start + k)
            order = np.argsort(marks, kind="stable")
            self.by_size[k] = marks[order], owner[order]

    def candidates(self, codes: np.ndarray, before: np.ndarray):
        """Pairs (row, item) that share a seed, each once."""
        hashes, pairs = SliceHash(codes), [np.zeros(0, np.int64)]
        count = len(self.bounds)
        for k, (marks, owner) in self.by_size.items():
            counts = np.maximum(np.diff(before) - k + 1, 0)
            row = np.repeat(np.arange(len(counts)), counts)
            start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + before[:-1][row]
            own = hashes.of(start, start + k)
            lo = np.searchsorted(marks, own, "left")
            hit = np.flatnonzero(marks[np.minimum(lo, len(marks) - 1)] == own)
            size = np.searchsorted(marks, own[hit], "right") - lo[hit]
            at = np.repeat(lo[hit], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            pairs.append(np.unique(np.repeat(row[hit], size) * count + owner[at]))
        both = np.unique(np.concatenate(pairs))
        return both // count, both % count

    def item(self, i: int) -> np.ndarray:
        return self.codes[self.bounds[i]:self.bounds[i + 1]]


FOUND_DDL = ("item_id long, item_tokens int, covered_tokens int, coverage double, "
             "tiles array<struct<item_start:int,doc_start:int,length:int>>")


def found_arrays(rows: list[tuple]) -> list[pa.Array]:
    kind = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))
    cells = [[{"item_start": a, "doc_start": b, "length": n} for a, b, n in sorted(r[3])] for r in rows]
    return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
            pa.array([r[2] for r in rows], pa.int32()), pa.array([r[2] / r[1] for r in rows], pa.float64()),
            pa.array(cells, kind)]


def judged(item_id, pattern, text, min_match: int, min_coverage: float):
    tiles = tile(pattern, text, min_match)
    covered = sum(t[2] for t in tiles)
    return (item_id, len(pattern), covered, tiles) if covered and covered >= min_coverage * len(pattern) else None


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH,
                 min_coverage: float = MIN_COVERAGE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document and benchmark item that it gives away: ``did``
    and ``th`` (the row's key), the id under its own name, ``item_id``,
    ``item_tokens``, ``covered_tokens``, ``coverage`` and ``tiles``.

    A benchmark of at most ``broadcast_bytes`` of text goes to all tasks and
    documents are judged where they are read; a larger one is joined on
    seeds by a shuffle.

    Null or empty texts on either side match nothing; null item ids count as
    the smallest number, items that repeat are judged each. Rows repeated
    whole repeat their result. Ids that are null stay null. Other columns do
    not matter. An empty table on either side: no rows.
    """
    keyed = row_keys(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), "id", "text") \
        .select("did", "th", F.col("__row.id").alias("id"), "text")
    items = benchmark.select(F.coalesce(col(item_col).cast("long"), F.lit(NULL_ID)).alias("item"),
                             col(item_text_col).alias("text")).where(F.length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    schema = StructType([*keyed.select("did", "th", "id").schema.fields, *StructType.fromDDL(FOUND_DDL).fields])
    if size <= broadcast_bytes:
        found = here(keyed, items.orderBy("item", "text").toArrow(), schema, min_match, min_coverage)
    else:
        found = joined(keyed, items, schema, min_match, min_coverage)
    return found.withColumnRenamed("id", id_col)


def here(keyed: DataFrame, items: pa.Table, schema: StructType, min_match: int, min_coverage: float) -> DataFrame:
    """The benchmark in every task."""
    ids, texts = items.column("item").to_pylist(), items.column("text").combine_chunks()

    def scan(batches):
        seeds = Seeds(*tokens(texts), min_match)
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                codes, before = batch_tokens(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                rows, of = [], []
                for r, i in zip(*(x.tolist() for x in seeds.candidates(codes, before)), strict=True):
                    hit = judged(ids[i], seeds.item(i), codes[before[r]:before[r + 1]], min_match, min_coverage)
                    if hit:
                        rows.append(hit)
                        of.append(a + r)
                if rows:
                    kept = [batch.column(c).take(pa.array(of)) for c in ("did", "th", "id")]
                    yield pa.RecordBatch.from_arrays([*kept, *found_arrays(rows)], names=schema.names)

    return keyed.mapInArrow(scan, schema)


def joined(keyed: DataFrame, items: DataFrame, schema: StructType, min_match: int, min_coverage: float) -> DataFrame:
    """Documents and items meet on seeds by a shuffle, each pair once."""
    def seeds_of(short: bool, lengths):
        def scan(batches):
            for batch in batches:
                data, offsets = flat(batch.column("text"))
                for a, b in chunks(offsets):
                    codes, before = batch_tokens(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                    hashes, sizes = SliceHash(codes), np.diff(before)
                    for k in lengths:
                        # an item has seeds of one length; a document is asked for all that items have
                        use = sizes >= k if not short or k == min_match else sizes == k
                        counts = np.where(use, sizes - k + 1, 0)
                        row = np.repeat(np.arange(len(sizes)), counts)
                        start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + before[:-1][row]
                        pair = np.unique(np.stack([row, hashes.of(start, start + k).view(np.int64)]), axis=1) if len(row) \
                            else np.zeros((2, 0), np.int64)
                        kept = [batch.column(c).take(pa.array(pair[0] + a)) for c in batch.schema.names if c != "text"]
                        yield pa.RecordBatch.from_arrays([*kept, pa.array(pair[1]), pa.array(np.full(pair.shape[1], k, np.int32))],
                                                         names=[*[c for c in batch.schema.names if c != "text"], "seed", "size"])
        return scan

    marked = items.withColumn("it", F.xxhash64("text"))
    item_seeds = marked.mapInArrow(seeds_of(True, range(1, min_match + 1)), "item long, it long, seed long, size int")
    lengths = sorted(r["size"] for r in item_seeds.select("size").distinct().collect())  # min_match values at most
    doc_seeds = keyed.select("did", "th", "text").mapInArrow(seeds_of(False, lengths), "did long, th long, seed long, size int")
    pairs = doc_seeds.join(item_seeds, ["seed", "size"]).select("did", "th", "item", "it").distinct()
    both = keyed.join(pairs, ["did", "th"]).join(marked.withColumnRenamed("text", "item_text"), ["item", "it"]) \
        .select("did", "th", "id", "text", "item", "item_text")

    def scan(batches):
        for batch in batches:
            rows, of = [], []
            for a, b in chunks(flat(batch.column("text"))[1]):
                part = batch.slice(a, b - a)
                own, items_of = tokens(part.column("text")), tokens(part.column("item_text"))
                for i, item in enumerate(part.column("item").to_pylist()):
                    hit = judged(item, *(codes[before[i]:before[i + 1]] for codes, before in (items_of, own)), min_match, min_coverage)
                    if hit:
                        rows.append(hit)
                        of.append(a + i)
            kept = [batch.column(c).take(pa.array(of, pa.int64())) for c in ("did", "th", "id")]
            yield pa.RecordBatch.from_arrays([*kept, *found_arrays(rows)], names=schema.names)

    return both.mapInArrow(scan, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that give no benchmark item away, all columns."""
    bad = contaminated(docs, benchmark, id_col, text_col, **how).select("did", "th").distinct()
    keyed = row_keys(docs, id_col, text_col).select("__row", "did", "th")
    return keyed.join(bad, ["did", "th"], "left_anti").select(
        *[F.col("__row").getField(c).alias(c) for c in docs.columns])


def decontamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Columns of the query."""
    return contaminated(docs, benchmark).drop("did", "th")
