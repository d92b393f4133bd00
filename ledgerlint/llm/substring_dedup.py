"""Substring dedup: a compressed FM-index per shard of the corpus.

Words covered by a window of ``min_words`` words that already starts earlier
are removed. Segments that may repeat are routed to shards by content (see
``repeats``); each shard builds the Burrows-Wheeler transform of its distinct
segments in a wavelet matrix of packed bits with block counts, streams the
segments' windows through it by backward search (matching statistics up to
the threshold: a window leaves as soon as its interval holds itself alone),
and reports the runs of windows whose interval has an earlier place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlint.llm.common import row_keys, row_schema, with_results
from ledgerlint.llm.repeats import (BLOCK_SYMBOLS, JUDGED_DDL, blocks, candidates, covered, first_places, flat_binary,
                                    judged_batch, removals, routed, segment_blocks, spans, suffix_array)
from ledgerlint.llm.words import chunks, find_words, flat, join_words, text_array, word_hashes

GRAM_WORDS = 6


class FMIndex:
    """Counts by backward search over symbols 1..top (0 separates)."""

    def __init__(self, symbols: np.ndarray, top: int):
        n = len(symbols)
        sa = suffix_array(symbols, top)
        rest = symbols[sa - 1]
        self.n, self.bits = n, max(1, int(top).bit_length())
        counts = np.bincount(symbols, minlength=top + 1)
        self.before = np.cumsum(counts) - counts
        self.levels = []
        code = np.arange(top + 1)
        base = np.zeros(top + 1, dtype=np.int64)
        for b in range(self.bits - 1, -1, -1):
            bit = (rest >> b) & 1
            padded = np.zeros((n // 64 + 2) * 64, dtype=np.uint8)
            padded[:n] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(packed).astype(np.int32)
            level = (packed, np.cumsum(ones, dtype=np.int32) - ones, n - int(bit.sum()))
            self.levels.append(level)
            base = self.step(level, base, (code >> b) & 1)
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])
        self.base = base

    @staticmethod
    def step(level, i: np.ndarray, bit: np.ndarray) -> np.ndarray:
        packed, ones, zeros = level
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        rank = ones[word] + np.bitwise_count(packed[word] & mask)
        return np.where(bit == 1, zeros + rank, i - rank)

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray):
        """Intervals of ``symbol`` put before each interval's string."""
        both, two = np.concatenate([lo, hi]).astype(np.int64), np.concatenate([symbol, symbol])
        for b, level in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            both = self.step(level, both, (two >> b) & 1)
        both += self.before[two] - self.base[two]
        return both[:len(lo)], both[len(lo):]


def repeated_windows(symbols: np.ndarray, top: int, starts: np.ndarray, length: int):
    """Windows (indexes into ``starts``) found twice or more, and the lower
    end of their interval: equal for equal windows."""
    index = FMIndex(symbols, top)
    live = np.arange(len(starts))
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), index.n, np.int64)
    for k in range(length - 1, -1, -1):
        lo, hi = index.extend(lo, hi, symbols[starts[live] + k])
        keep = hi - lo > 1
        live, lo, hi = live[keep], lo[keep], hi[keep]
        if not len(live):
            break
    return live, lo


def judge_words(batches, length: int):
    """Per block of whole keys: the runs of each first segment whose windows
    start earlier elsewhere."""
    for table in blocks(batches):
        data, offsets = flat_binary(table.column("piece"))
        _, _, before, hashes = word_hashes(data, offsets)
        _, ids = np.unique(hashes, return_inverse=True)
        count = len(before) - 1
        sizes = np.diff(before)
        symbols = np.zeros(len(ids) + count, dtype=np.int64)
        symbols[np.arange(len(ids)) + np.repeat(np.arange(count), sizes)] = ids + 1
        begin = before[:-1] + np.arange(count)
        windows = table.column("n").to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(count), windows)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        live, lo = repeated_windows(symbols, int(ids.max(initial=0)) + 1, begin[owner] + inside, length)
        did, th, at = (table.column(c).to_numpy() for c in ("did", "th", "at"))
        who, off = owner[live], inside[live]
        order = np.lexsort((at[who] + off, th[who], did[who], lo))
        first = np.ones(len(order), dtype=bool)
        first[1:] = lo[order][1:] != lo[order][:-1]
        later = np.sort(live[order[~first]])
        o, s, size = spans(inside[later], owner[later], length)
        yield judged_batch(table, o, s, size)


def remove_repeated_words(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id",
                          text_col: str = "text", key_symbols: int = BLOCK_SYMBOLS) -> DataFrame:
    """The documents with ``n_words``, ``n_removed`` and ``kept_text``.

    A word goes if some window of ``min_words`` words over it also starts
    earlier: in a smaller id, or earlier in the same document. Windows are
    judged on the input. Kept words are joined by one space.

    Null or empty text: no words, kept text empty. A null id counts as
    smaller than any. Rows repeated whole are one document and share its
    result; rows with one id and other texts are ordered by the text's hash.
    Fewer than ``min_words`` words: all kept. Input columns named like a
    result are replaced; any other columns pass through. Empty table: empty.
    """
    gram = min(GRAM_WORDS, min_words)
    keyed = row_keys(docs, id_col, text_col)
    found = routed(keyed, candidates(keyed, min_words, gram, True), min_words, gram, True, key_symbols)
    pieces = segment_blocks(keyed, first_places(found), min_words, True)
    judged = pieces.mapInArrow(lambda b: judge_words(b, min_words), JUDGED_DDL)
    text_at = docs.columns.index(text_col)

    def apply(batches):
        for batch in batches:
            rows, cuts = batch.column("__row"), batch.column("cuts")
            data, offsets = flat(rows.field(text_at))
            for a, b in chunks(offsets):
                part = data[offsets[a]:offsets[b]]
                starts, ends, before = find_words(part, offsets[a:b + 1] - offsets[a])
                sizes = np.diff(before)
                gone = covered(cuts.slice(a, b - a), sizes, min_words)
                kept = np.concatenate([[0], np.cumsum(~gone)])[before]
                left, right = starts[~gone], ends[~gone]
                texts = [join_words(part, left[x:y], right[x:y]) for x, y in zip(kept[:-1], kept[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(a, b - a), pa.array(sizes.astype(np.int64)),
                     pa.array((sizes - np.diff(kept)).astype(np.int64)), text_array(texts)],
                    names=["__row", "n_words", "n_removed", "kept_text"])

    joined = keyed.join(removals(found, judged), ["did", "th"], "left").select("__row", "cuts")
    out = joined.mapInArrow(apply, row_schema(joined, "n_words long, n_removed long, kept_text string"))
    return with_results(out, docs.columns, ["n_words", "n_removed", "kept_text"])


def substring_dedup_digest(docs: DataFrame) -> DataFrame:
    """Digest columns of the query."""
    out = remove_repeated_words(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
