"""Suffix-array dedup: a run-length index per shard of the corpus.

Bytes covered by a string of ``min_bytes`` bytes that also starts anywhere
else are removed. Segments that may repeat are routed to shards by content
(see ``repeats``). A shard's index is the run-length Burrows-Wheeler
transform of its distinct segments with the suffix array sampled at run
boundaries only. Streaming through the text, the match length with the
neighbour in suffix order is the sampled value of the last run boundary less
the distance to it, so the matching statistics of all positions follow from
as many direct comparisons as the transform has runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlint.llm.common import row_keys, row_schema, with_results
from ledgerlint.llm.repeats import (BLOCK_SYMBOLS, JUDGED_DDL, blocks, candidates, covered, first_places, flat_binary,
                                    judged_batch, removals, routed, segment_blocks, spans, suffix_array)
from ledgerlint.llm.words import chunks, flat

GRAM_BYTES = 32


class RunLengthIndex:
    """Run heads of the transform: text places and their neighbours before
    and after in suffix order. Symbol 0 separates and never joins a run."""

    def __init__(self, symbols: np.ndarray, top: int):
        sa = suffix_array(symbols, top)
        bwt = symbols[sa - 1]
        border = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0) | (bwt[:-1] == 0)
        self.runs = int(border.sum()) + 1
        at = np.flatnonzero(border) + 1
        self.heads, self.before_heads = sa[at], sa[at - 1]
        self.first, self.last = sa[0], sa[-1]


def common_length(symbols: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at p and q, up to a
    separator: four symbols a step, then the rest."""
    padded = np.concatenate([symbols, np.zeros(16, symbols.dtype)]).astype(np.uint16)
    packed = np.zeros(len(symbols) + 8, dtype=np.uint64)
    for j in range(4):
        packed = (packed << np.uint64(16)) | padded[j:j + len(packed)]
    whole = np.ones(len(packed), dtype=bool)
    for j in range(4):
        whole &= padded[j:j + len(packed)] != 0
    size = np.zeros(len(p), dtype=np.int64)
    live = np.arange(len(p))
    x, y = p.copy(), q.copy()
    while len(live):
        same = (packed[x] == packed[y]) & whole[x]
        ended = live[~same]
        if len(ended):
            a, b, more = x[~same], y[~same], np.ones(len(ended), dtype=bool)
            for _ in range(4):
                more &= (padded[a] == padded[b]) & (padded[a] != 0)
                size[ended] += more
                a, b = np.minimum(a + 1, len(padded) - 1), np.minimum(b + 1, len(padded) - 1)
        live, x, y = live[same], x[same] + 4, y[same] + 4
        size[live] += 4
    return size


def longest_elsewhere(symbols: np.ndarray, top: int) -> tuple[np.ndarray, int]:
    """Matching statistics of a text against all its other places, and the
    number of runs of its index."""
    index = RunLengthIndex(symbols, top)
    size = common_length(symbols, index.heads, index.before_heads)
    best = np.zeros(len(symbols), dtype=np.int64)
    place = np.arange(len(symbols))
    for sample, alone in ((index.heads, index.first), (index.before_heads, index.last)):
        # the samples' match ends, carried to the positions up to the next sample
        ends = np.full(len(symbols), -1, dtype=np.int64)
        ends[sample] = sample + size
        ends[alone] = alone  # no neighbour on this side
        last = np.maximum.accumulate(np.where(ends >= 0, place, -1))
        best = np.maximum(best, np.where(last >= 0, ends[last] - place, 0))
    return best, index.runs


def judge_bytes(batches, length: int):
    """Per block of whole keys: the runs of the segments that stand at one
    place alone, whose strings start elsewhere too."""
    for table in blocks(batches):
        data, offsets = flat_binary(table.column("piece"))
        count = len(offsets) - 1
        sizes = np.diff(offsets)
        symbols = np.zeros(len(data) + count, dtype=np.int64)
        begin = offsets[:-1] + np.arange(count)
        symbols[np.arange(len(data)) + np.repeat(np.arange(count), sizes)] = data.astype(np.int64) + 1
        best, _ = longest_elsewhere(symbols, 256)
        windows = table.column("n").to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(count), windows)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        hit = best[begin[owner] + inside] >= length
        hit |= (table.column("m").to_numpy() > 1)[owner]
        yield judged_batch(table, *spans(inside[hit], owner[hit], length))


def remove_repeated_bytes(docs: DataFrame, min_bytes: int = 200, id_col: str = "doc_id",
                          text_col: str = "text", key_symbols: int = BLOCK_SYMBOLS) -> DataFrame:
    """The documents with ``n_bytes``, ``n_removed``, ``n_spans`` and
    ``kept_bytes`` (binary: a cut may fall inside a character).

    A byte goes if a string of ``min_bytes`` bytes over it also starts
    anywhere else, in the same document too. Matches never cross documents;
    strings are judged on the input.

    Null or empty text: no bytes. Texts shorter than ``min_bytes``: all kept.
    Rows repeated whole count as places of their own, so both lose what they
    share. Null ids are ids like any other. Input columns named like a result
    are replaced; any other columns pass through. Empty table: empty.
    """
    gram = min(GRAM_BYTES, min_bytes)
    keyed = row_keys(docs, id_col, text_col)
    found = routed(keyed, candidates(keyed, min_bytes, gram, False), min_bytes, gram, False, key_symbols)
    pieces = segment_blocks(keyed, first_places(found), min_bytes, False)
    judged = pieces.mapInArrow(lambda b: judge_bytes(b, min_bytes), JUDGED_DDL)
    text_at = docs.columns.index(text_col)

    def apply(batches):
        for batch in batches:
            rows, cuts = batch.column("__row"), batch.column("cuts")
            data, offsets = flat(rows.field(text_at))
            for a, b in chunks(offsets):
                part, offs = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                gone = covered(cuts.slice(a, b - a), np.diff(offs), min_bytes)
                kept = np.concatenate([[0], np.cumsum(~gone)])[offs]
                opens = gone.copy()
                first = np.zeros(len(gone) + 1, dtype=bool)
                first[offs] = True
                opens[1:] &= ~gone[:-1] | first[1:-1]
                opened = np.concatenate([[0], np.cumsum(opens)])[offs]
                left = part[~gone].tobytes()
                texts = [left[x:y] for x, y in zip(kept[:-1], kept[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(a, b - a), pa.array(np.diff(offs)), pa.array(np.diff(offs) - np.diff(kept)),
                     pa.array(np.diff(opened)), pa.array(texts, pa.binary())],
                    names=["__row", "n_bytes", "n_removed", "n_spans", "kept_bytes"])

    joined = keyed.join(removals(found, judged), ["did", "th"], "left").select("__row", "cuts")
    out = joined.mapInArrow(apply, row_schema(
        joined, "n_bytes long, n_removed long, n_spans long, kept_bytes binary"))
    return with_results(out, docs.columns, ["n_bytes", "n_removed", "n_spans", "kept_bytes"])


def suffix_dedup_digest(docs: DataFrame) -> DataFrame:
    """Digest columns of the query."""
    out = remove_repeated_bytes(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept_bytes"), 256).alias("kept_sha256"))
