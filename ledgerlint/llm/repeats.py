"""Routing of repeated windows: the part that both repeat finders share.

Equal windows of ``length`` symbols hold equal smallest grams, so a run of
windows with one smallest gram (a segment) is keyed by that gram: all places
where a window may repeat meet under one key, whatever the corpus size, and
no document is compared with every shard.

1. ``occurrences``: one row per segment (key, hash of its symbols, place).
2. ``candidates``: those whose key occurs twice, by a semi-join (a hot key
   is split by AQE; counts are combined before the shuffle).
3. ``routed``: a key with more distinct symbols than a block holds (a short
   phrase in many contexts) is split: the windows of its distinct segments,
   each with its number of copies, are keyed by a longer gram, then by their
   own hashes, and those whose key occurs once leave.
4. ``first_places``: segments of the same symbols collapse to their first
   place and a count, so that a group of thousands of copies is indexed once.
5. ``segment_blocks``: their bytes, fetched from the documents and sorted by
   key; tasks cut the sorted stream into blocks of bounded size at changes of
   key and index each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlint.llm.common import written
from ledgerlint.llm.words import (BYTE_CODES, SliceHash, chunks, flat, mix, window_min,
                                  word_hashes)

BLOCK_SYMBOLS = 1 << 20
PLACE_BITS = 40


def segments(codes: np.ndarray, before: np.ndarray, length: int, gram: int):
    """Segments of rows that lie one after another in ``codes``.

    Returns row, first window, windows, key, hash and whether a key's gram
    stands at several places of the segment (it may then repeat inside).
    """
    n = len(codes)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none, np.zeros(0, bool)
    hashes = SliceHash(codes)
    at = np.arange(n - gram + 1)
    grams = hashes.of(at, at + gram)
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    low = window_min(order, length - gram + 1)
    sizes = np.diff(before)
    row = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    windows = np.maximum(sizes - length + 1, 0)
    start = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + before[:-1][row]
    if not len(start):
        return none, none, none, none, none, np.zeros(0, bool)
    place = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    key = grams[place]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(start)))
    moved = np.zeros(len(start), dtype=np.int64)
    moved[1:] = (place[1:] != place[:-1]) & ~new[1:]
    several = np.add.reduceat(moved, first) > 0
    s = start[first]
    return row[first], s, runs, key[first].view(np.int64), hashes.of(s, s + runs + length - 1).view(np.int64), several


def symbol_codes(data: np.ndarray, offsets: np.ndarray, by_word: bool):
    """Symbols (words or bytes) as codes, and their number before each row."""
    if by_word:
        _, _, before, codes = word_hashes(data, offsets)
        return codes, before
    return BYTE_CODES[data], offsets


OCCURRENCE = pa.schema([("v", pa.int64()), ("c", pa.int64()), ("did", pa.int64()), ("th", pa.int64()),
                        ("at", pa.int32()), ("n", pa.int32()), ("inner_repeat", pa.int8())])
OCCURRENCE_DDL = "v long, c long, did long, th long, at int, n int, inner_repeat byte"


def occurrences(keyed: DataFrame, length: int, gram: int, by_word: bool) -> DataFrame:
    """One row per segment of every text: key ``v``, hash ``c``, document
    (``did``, ``th``), place ``at`` of its first symbol and windows ``n``."""
    def scan(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            did, th = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("did", "th"))
            for a, b in chunks(offsets):
                codes, before = symbol_codes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], by_word)
                row, start, n, key, same, several = segments(codes, before, length, gram)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (key, same, did[a:b][row], th[a:b][row], (start - before[row]).astype(np.int32),
                                               n.astype(np.int32), several.astype(np.int8))],
                        schema=OCCURRENCE)

    return keyed.select("did", "th", "text").mapInArrow(
        scan, OCCURRENCE_DDL)


def candidates(keyed: DataFrame, length: int, gram: int, by_word: bool) -> DataFrame:
    """Occurrences whose key occurs twice or more (or repeats inside)."""
    found = occurrences(keyed, length, gram, by_word)
    twice = (found.groupBy("v").agg(F.count(F.lit(1)).alias("k"), F.max("inner_repeat").alias("i"))
             .where("k > 1 or i > 0").select("v"))
    return written(found.join(twice, "v", "left_semi"), "repeat-candidates")


def cut_again(keyed: DataFrame, wanted: DataFrame, length: int, gram: int, by_word: bool) -> DataFrame:
    """The windows of the wanted segments (place, windows, copies) as segments
    of another ``gram``; ``c`` is a hash of other codes than the key's."""
    def scan(batches):
        seen = set()
        for batch in batches:
            batch = unseen(batch, seen)
            if not batch.num_rows:
                continue
            data, offsets = flat(batch.column("text"))
            wants = batch.column("w")
            bounds = np.asarray(wants.offsets)
            at, n, m = (wants.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            did, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "th"))
            for a, b in chunks(offsets):
                codes, before = symbol_codes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], by_word)
                lo, hi = bounds[a], bounds[b]
                owner = np.repeat(np.arange(b - a), np.diff(bounds[a:b + 1]))
                size = n[lo:hi] + length - 1
                base = np.concatenate([[0], np.cumsum(size)])
                inner = np.arange(base[-1]) + np.repeat(at[lo:hi] + before[owner] - base[:-1], size)
                pieces = codes[inner]
                row, start, runs, key, _, several = segments(pieces, base, length, gram)
                if len(row):
                    same = SliceHash(mix(pieces)).of(start, start + runs + length - 1).view(np.int64)
                    r, place = owner[row], at[lo:hi][row] + start - base[row]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (key, same, did[a:b][r], th[a:b][r], place.astype(np.int32),
                                               runs.astype(np.int32), several.astype(np.int8), m[lo:hi][row])],
                        schema=OCCURRENCE.append(pa.field("m", pa.int64())))

    # rows repeated whole may be cut in several tasks
    return keyed.select("did", "th", "text").join(wanted, ["did", "th"]).select("did", "th", "text", "w") \
        .mapInArrow(scan, OCCURRENCE_DDL + ", m long").distinct()


def unseen(batch: pa.RecordBatch, seen: set) -> pa.RecordBatch:
    """Of rows repeated whole, the first that a task meets."""
    keys = zip(batch.column("did").to_pylist(), batch.column("th").to_pylist(), strict=True)
    return batch.filter(pa.array([k not in seen and not seen.add(k) for k in keys], pa.bool_()))


def routed(keyed: DataFrame, found: DataFrame, length: int, gram: int, by_word: bool,
           most: int = BLOCK_SYMBOLS) -> DataFrame:
    """Occurrences whose keys have about ``most`` distinct symbols at most,
    each for ``m`` places.

    The segments of a larger key are collapsed to their first places, whose
    windows are routed again by a longer gram, and those of a key that is
    still larger by their own hashes: equal windows meet each time, and a last
    key holds one window, however often it occurs. The later copies of a
    collapsed segment are not cut: they stay without a key (``v`` null), so
    that what the split writes follows the distinct segments.
    """
    def larger(rows):
        size = F.sum(F.col("n").cast("long") + (length - 1))
        return written(rows.groupBy("v").agg(size.alias("s")).where(F.col("s") > most).select("v"), "repeat-large")

    place = ["v", "did", "th", "at"]
    found = found.withColumn("m", F.lit(1).cast("long"))
    for longer in ((gram + length) // 2, length):
        large = larger(found.where("v IS NOT NULL"))
        if large.isEmpty():
            break
        firsts = written(first_places(found.join(large, "v", "left_semi")), "repeat-firsts")
        large = larger(firsts)
        if large.isEmpty():
            break
        firsts = firsts.join(large, "v", "left_semi")
        wanted = firsts.groupBy("did", "th").agg(F.collect_set(F.struct("at", "n", F.col("m").cast("long").alias("m"))).alias("w"))
        cut = written(cut_again(keyed, wanted, length, longer, by_word), "repeat-cut-again")
        # written, so that the join has no aggregate in its stage and AQE can split a hot key
        twice = written(cut.groupBy("v").agg(F.sum("m").alias("k"), F.max("inner_repeat").alias("i"))
                        .where("k > 1 or i > 0").select("v"), "repeat-twice")
        kept = written(cut.join(twice, "v", "left_semi"), "repeat-candidates")
        copies = found.join(large, "v", "left_semi").join(firsts.select(*place), place, "left_anti")
        found = found.join(large, "v", "left_anti").unionByName(kept) \
            .unionByName(copies.withColumn("v", F.lit(None).cast("long")))
    return found


def first_places(found: DataFrame) -> DataFrame:
    """Per segment (key and hash): first place, windows, number of places."""
    many = F.sum("m") if "m" in found.columns else F.count(F.lit(1))
    return (found.where("v IS NOT NULL").groupBy("v", "c", "n").agg(F.min(F.struct("did", "th", "at")).alias("f"), many.alias("m"))
            .select("v", "f.did", "f.th", "f.at", "n", F.least("m", F.lit(2 ** 31 - 1)).cast("int").alias("m")))


SEGMENT = pa.schema([("v", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("n", pa.int32()),
                     ("m", pa.int32()), ("piece", pa.binary())])


def segment_blocks(keyed: DataFrame, firsts: DataFrame, length: int, by_word: bool) -> DataFrame:
    """Bytes of the segments, partitioned and sorted by key."""
    wanted = firsts.groupBy("did", "th").agg(F.collect_list(F.struct("v", "at", "n", "m")).alias("w"))

    def cut(batches):
        seen = set()
        for batch in batches:
            batch = unseen(batch, seen)
            if not batch.num_rows:
                continue
            data, offsets = flat(batch.column("text"))
            wants = batch.column("w")
            bounds = np.asarray(wants.offsets)
            inner = wants.values
            v, at, n, m = (inner.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            did, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "th"))
            for a, b in chunks(offsets):
                part, offs = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                lo, hi = bounds[a], bounds[b]
                row = np.repeat(np.arange(b - a), np.diff(bounds[a:b + 1]))
                start = at[lo:hi].astype(np.int64)
                if by_word:
                    starts, ends, before, _ = word_hashes(part, offs)
                    start = start + before[row]
                    left, right = starts[start], ends[start + n[lo:hi] + length - 2]
                else:
                    left = offs[:-1][row] + start
                    right = left + n[lo:hi] + length - 1
                raw = part.tobytes()
                pieces = [raw[x:y] for x, y in zip(left.tolist(), right.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[lo:hi]), pa.array(did[a:b][row]), pa.array(th[a:b][row]), pa.array(at[lo:hi]),
                     pa.array(n[lo:hi]), pa.array(m[lo:hi]), pa.array(pieces, pa.binary())], schema=SEGMENT)

    cuts = keyed.select("did", "th", "text").join(wanted, ["did", "th"]).select("did", "th", "text", "w")
    pieces = cuts.mapInArrow(cut, "v long, did long, th long, at int, n int, m int, piece binary")
    return pieces.repartition("v").sortWithinPartitions("v")


def blocks(batches, most: int = BLOCK_SYMBOLS):
    """Tables of whole keys from a stream sorted by ``v``, each of about
    ``most`` bytes (one key's segments stay together); places once each."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        v = held.column("v").to_numpy()
        total = np.cumsum(pc.binary_length(held.column("piece")).to_numpy())
        ends = np.flatnonzero(v[1:] != v[:-1]) + 1
        done, used = 0, 0
        while len(ends) and (k := int(np.searchsorted(total[ends - 1], used + most))) < len(ends):
            yield distinct_places(held.slice(done, int(ends[k]) - done))
            done, used = int(ends[k]), int(total[ends[k] - 1])
        held = held.slice(done).combine_chunks() if done else held
    if held is not None and held.num_rows:
        yield distinct_places(held)


def distinct_places(table: pa.Table) -> pa.Table:
    """One row per key and place (rows repeated whole give a place twice)."""
    columns = [table.column(c).to_numpy() for c in ("at", "th", "did", "v")]
    order = np.lexsort(columns)
    same = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
    return table.take(np.sort(order[np.append(True, ~same)])).combine_chunks()


def flat_binary(column: pa.ChunkedArray):
    """Bytes and offsets of a binary column without nulls."""
    column = column.cast(pa.large_binary()).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


JUDGED = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("n", pa.int32()),
                    ("runs", pa.list_(pa.struct([("s", pa.int32()), ("l", pa.int32())])))])
JUDGED_DDL = "did long, th long, at int, n int, runs array<struct<s:int,l:int>>"


def judged_batch(table: pa.Table, owner: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """The block's segments with their runs (sorted by owner)."""
    bounds = np.searchsorted(owner, np.arange(table.num_rows + 1)).astype(np.int32)
    inner = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], ["s", "l"])
    return pa.RecordBatch.from_arrays(
        [pa.array(table.column(c).to_numpy()) for c in ("did", "th", "at", "n")]
        + [pa.ListArray.from_arrays(pa.array(bounds), inner)], schema=JUDGED)


def suffix_array(s: np.ndarray, top: int) -> np.ndarray:
    """Suffix array of integers in 0..top: sort packed prefixes, then double
    the sorted depth of the groups that are still tied."""
    n, bits = len(s), max(1, int(top).bit_length())
    depth = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(depth):
        key <<= np.uint64(bits)
        key[:max(n - j, 0)] |= s[j:].astype(np.uint64)
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    rank = np.empty(n, dtype=np.int64)
    slots = np.arange(n)
    p = sa
    while True:
        new = np.ones(len(p), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        rank[p] = np.maximum.accumulate(np.where(new, slots, 0))
        tied = ~(new & np.append(new[1:], True))
        slots = slots[tied]
        if not len(slots):
            return sa
        p = sa[slots]
        after = p + depth
        key = (rank[p].astype(np.uint64) << np.uint64(32)) | np.where(
            after < n, rank[np.minimum(after, n - 1)] + 1, 0).astype(np.uint64)
        order = np.argsort(key, kind="stable")
        p, key = p[order], key[order]
        sa[slots] = p
        depth *= 2


def spans(places: np.ndarray, group: np.ndarray, length: int):
    """Windows (sorted by group, then place) as maximal covered runs:
    group, start and size of each."""
    if not len(places):
        return places, places, places
    new = np.ones(len(places), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (places[1:] > places[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(places)) - 1
    return group[first], places[first], places[last] + length - places[first]


def removals(found: DataFrame, judged: DataFrame) -> DataFrame:
    """Per document: ``cuts``, the places of its candidate segments (``runs``
    null: the whole segment) with the index's runs for those it judged. Rows
    repeated whole give a place once: sets are combined before the shuffle."""
    both = found.select("did", "th", "at", "n", F.lit(None).cast("array<struct<s:int,l:int>>").alias("runs")) \
        .unionByName(judged.select("did", "th", "at", "n", "runs"))
    return both.groupBy("did", "th").agg(F.collect_set(F.struct("at", "n", "runs")).alias("cuts"))


def covered(cuts: pa.Array, sizes: np.ndarray, length: int) -> np.ndarray:
    """Mask of the rows' symbols, one row after another, that the cuts remove.

    A segment that the index judged loses the index's runs alone; any other
    (a later copy) loses all its symbols.
    """
    base = np.cumsum(sizes) - sizes
    step = np.zeros(int(sizes.sum()) + 1, dtype=np.int32)
    bounds = np.asarray(cuts.offsets)
    inner = cuts.values
    row = np.repeat(np.arange(len(cuts)), np.where(np.asarray(cuts.is_valid()), np.diff(bounds), 0))
    lo, hi = int(bounds[0]), int(bounds[-1])
    if hi - lo != len(row):  # a null list has no elements in Arrow data made by Spark
        raise ValueError("null lists with elements")
    at = inner.field(0).to_numpy(zero_copy_only=False)[lo:hi].astype(np.int64)
    n = inner.field(1).to_numpy(zero_copy_only=False)[lo:hi]
    runs = inner.field(2).slice(lo, hi - lo)
    judged = np.asarray(runs.is_valid())
    key = (row.astype(np.int64) << PLACE_BITS) | at
    whole = ~judged & ~np.isin(key, key[judged])
    begin = base[row[whole]] + at[whole]
    np.add.at(step, begin, 1)
    np.add.at(step, begin + n[whole] + length - 1, -1)
    ends = np.asarray(runs.offsets)
    owner = np.repeat(np.arange(len(row)), np.where(judged, np.diff(ends), 0))
    s, size = (runs.values.field(i).to_numpy(zero_copy_only=False)[ends[0]:ends[-1]] for i in range(2))
    begin = base[row[owner]] + at[owner] + s
    np.add.at(step, begin, 1)
    np.add.at(step, begin + size, -1)
    return np.cumsum(step[:-1]) > 0
