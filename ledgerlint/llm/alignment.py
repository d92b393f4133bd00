"""Alignment of two tokenizers and corpus-wide counts of linked ids.

Both tokenizers cut the same bytes, so tokens are matched by their byte
ranges. Pass one aligns all documents in blocks and keeps each block's
distinct id pairs with their numbers, beside the documents' ids. The distinct
pairs of the corpus are sharded by their B id, and every shard gets a minimal
perfect hash with the pairs stored at their indexes. Blocks' numbers then
become dense vectors indexed by that hash, which are summed as a tree. Pass
two gets each block's pairs with their corpus counts, aligns its documents'
ids again and looks up every link.
"""

from __future__ import annotations

import json
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ledgerlint.llm.common import col, drop, with_results, written
from ledgerlint.llm.packing import byte_letters
from ledgerlint.llm.perfect_hash import PerfectHash
from ledgerlint.llm.pieces import PieceEncoder, default_model, texts_of
from ledgerlint.llm.words import chunks, flat, mix

#: The split of plain byte-level steps.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_BYTES = 1 << 22
#: Text behind one stored row: rows stay far below what a JVM keeps apart as huge.
ROW_BYTES = 1 << 17
SHARD_PAIRS = 1 << 18
PART_PAIRS = 1 << 20
FAN_IN = 16
LONG_TEXT = 1 << 20
B_BITS = 32


class ByteEncoder:
    """Ids and bytes of a byte-level BPE file, special tokens read as text.

    A file of plain byte-level steps whose ids rise with its merges goes
    through tiktoken, which gives the same ids; others, and texts of over a
    million characters, through tokenizers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        special = {t["content"] for t in steps.get("added_tokens") or []}
        back = {c: b for b, c in byte_letters().items()}
        vocabulary = steps["model"]["vocab"]
        ranks = {bytes(back[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        split = steps.get("pre_tokenizer") or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in steps["model"]["merges"]]
        rising = [vocabulary[a + b] for a, b in merges]
        plain = (steps.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex")
                 and not split.get("add_prefix_space") and not steps["model"].get("ignore_merges")
                 and all(a < b for a, b in zip(rising, rising[1:])))
        self.fast = None
        if plain:
            import tiktoken
            self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        texts = [b""] * size
        for t, i in ranks.items():
            texts[i] = t
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.surface = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and len(text) <= LONG_TEXT:
            return self.fast.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(self.encode(t), dtype=np.int64) for t in texts]
        return np.concatenate([np.zeros(0, np.int64), *got]), np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)


@lru_cache(maxsize=2)
def encoders(a_path: str, b_path: str) -> tuple[ByteEncoder, PieceEncoder]:
    """Both tokenizers, loaded once per worker process."""
    return ByteEncoder(a_path), PieceEncoder(b_path, most=150_000)


def spelled(surface, starts, sizes, ids: np.ndarray) -> np.ndarray:
    """Bytes of the ids, one after another."""
    n = sizes[ids]
    before = np.cumsum(n) - n
    return surface[np.arange(int(n.sum())) + np.repeat(starts[ids] - before, n)]


def tokenised(texts: list[str], a: ByteEncoder, b: PieceEncoder) -> tuple[np.ndarray, ...]:
    """Ids of A and of B with n+1 offsets each. Only texts that both spell out
    byte by byte (with the space in front) have ids."""
    n = len(texts)
    spaced = [" " + t if t else "" for t in texts]
    raw = [t.encode("utf-8", "replace") for t in spaced]
    size = np.array([len(r) for r in raw], dtype=np.int64)
    good, found = size > 0, []
    for ids, cuts, table in ((*a.batch(spaced), a), (*b.batch(texts), b.model)):
        doc = np.repeat(np.arange(n), np.diff(cuts))
        ids = ids.astype(np.int64)
        good &= np.bincount(doc, weights=table.sizes[ids], minlength=n).astype(np.int64) == size
        found.append((ids, doc, table))
    told = np.frombuffer(b"".join(r for r, g in zip(raw, good) if g), dtype=np.uint8)
    owner = np.repeat(np.flatnonzero(good), size[good])
    wrong = np.zeros(len(told), dtype=bool)
    for ids, doc, table in found:
        wrong |= spelled(table.surface, table.starts, table.sizes, ids[good[doc]]) != told
    good[owner[wrong]] = False
    out = []
    for ids, doc, _ in found:
        use = good[doc]
        out += [ids[use], np.concatenate([[0], np.cumsum(np.bincount(doc[use], minlength=n))])]
    return tuple(out)


class Aligned:
    """Groups and links of documents' ids, which spell the same bytes.

    ``link_doc`` and ``link_key`` (A id << 32 | B id) hold one entry per pair
    of overlapping tokens.
    """

    def __init__(self, a_ids, a_cut, b_ids, b_cut, a_sizes: np.ndarray, b_sizes: np.ndarray):
        self.n = len(a_cut) - 1
        self.a_ids, self.b_ids = a_ids, b_ids
        self.a_doc, self.b_doc = (np.repeat(np.arange(self.n), np.diff(c)) for c in (a_cut, b_cut))
        size = a_sizes[a_ids]
        a_end, b_end = np.cumsum(size), np.cumsum(b_sizes[b_ids])
        first = np.searchsorted(b_end, a_end - size, "right")
        last = np.searchsorted(b_end, a_end, "left")
        count = last - first + 1
        link_b = np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)
        self.link_doc = np.repeat(self.a_doc, count)
        self.link_key = np.repeat(a_ids << B_BITS, count) | b_ids[link_b]
        #: Ends that both share close a group.
        self.a_last = b_end[last] == a_end if len(b_end) else np.zeros(0, bool)
        self.b_last = np.zeros(len(b_end), dtype=bool)
        self.b_last[last[self.a_last]] = True

    def per_doc(self, docs: np.ndarray) -> np.ndarray:
        return np.bincount(docs, minlength=self.n)

    def groups(self) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3`` of all documents, and n+1 offsets."""
        a_group, b_group = np.cumsum(self.a_last) - self.a_last, np.cumsum(self.b_last) - self.b_last
        total = int(self.a_last.sum())
        a_before = np.concatenate([[0], np.cumsum(np.bincount(a_group, minlength=total))])
        b_before = np.concatenate([[0], np.cumsum(np.bincount(b_group, minlength=total))])
        n = len(self.a_ids) + len(self.b_ids)
        ids, mark, doc = np.zeros(n, np.int64), np.zeros(n, np.uint8), np.zeros(n, np.int64)
        at = np.arange(len(self.a_ids)) + b_before[a_group]
        ids[at], mark[at], doc[at] = self.a_ids, np.where(self.a_last, ord("|"), ord(",")), self.a_doc
        at = np.arange(len(self.b_ids)) + a_before[b_group + 1]
        ids[at], mark[at], doc[at] = self.b_ids, np.where(self.b_last, ord(";"), ord(",")), self.b_doc
        return decimals(ids, mark, np.searchsorted(doc, np.arange(self.n + 1)))


@lru_cache(maxsize=4)
def digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..size-1, one number a row, with room for a mark,
    and how many digits each has."""
    text = np.arange(size).astype(f"S{len(str(size - 1))}")
    width = np.char.str_len(text)
    table = np.zeros((size, text.itemsize + 1), dtype=np.uint8)
    table[:, :-1] = text.view(np.uint8).reshape(size, -1)
    return table, width


def decimals(ids: np.ndarray, mark: np.ndarray, cuts: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Decimal numbers with a mark after each but the last of every row
    (``cuts``: n+1 offsets of rows), and the offsets of the rows' texts."""
    table, width = digits(1 << int(ids.max(initial=1)).bit_length())
    mark = mark.copy()
    mark[cuts[1:][np.diff(cuts) > 0] - 1] = 0
    rows, width = table[ids], width[ids]
    rows[np.arange(len(ids)), width] = mark
    ends = np.concatenate([[0], np.cumsum(width + (mark > 0))])
    return rows[rows > 0].tobytes(), ends[cuts]


def packed(ids: np.ndarray, size: int) -> bytes:
    """Ids as compressed little-endian numbers, two bytes each where a
    vocabulary of ``size`` allows it."""
    return pa.compress(ids.astype("<u2" if size <= 1 << 16 else "<u4").tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, count: int, size: int) -> np.ndarray:
    """``count`` ids that were ``packed``."""
    kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
    raw = pa.decompress(data, decompressed_size=count * kind.itemsize, codec="zstd", asbytes=True) if count else b""
    return np.frombuffer(raw, dtype=kind).astype(np.int64)


def tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def long_lists(arrays: list[np.ndarray], kind=None) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.int64), *arrays]) if kind is None else np.concatenate([np.zeros(0, bool), *arrays])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind or pa.int64()))


def values_of(column) -> np.ndarray:
    """All values of a list column, one after another."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False)


BLOCK_FIELDS = "a_sizes array<long>, b_sizes array<long>, a_ids binary, b_ids binary, keys array<long>, counts array<long>"


def blocks_of(rows: DataFrame, a_path: str, b_path: str, block_bytes: int) -> DataFrame:
    """Pass one: the rows with their ids, about a hundred kilobytes of text
    stored as one, and per block one more row with its distinct pairs and
    their numbers. A block holds about ``block_bytes`` of text, or one longer
    text, of one partition."""

    def run(batches):
        a, b = encoders(a_path, b_path)
        base = TaskContext.get().partitionId() << 32
        block, filled, found = 0, 0, []
        row_type = None
        names = ["block", "rows", "a_sizes", "b_sizes", "a_ids", "b_ids", "keys", "counts"]

        def close():
            keys, counts = tally(np.concatenate([np.zeros(0, np.int64), *(k for k, _ in found)]),
                                 np.concatenate([np.zeros(0, np.int64), *(c for _, c in found)]))
            return pa.RecordBatch.from_arrays(
                [pa.array([base + block], pa.int64()), pa.nulls(1, pa.list_(row_type)),
                 *(pa.nulls(1, t) for t in (pa.list_(pa.int64()),) * 2 + (pa.binary(),) * 2),
                 long_lists([keys]), long_lists([counts])], names=names)

        for batch in batches:
            row_type = batch.column("__row").type
            data, offsets = flat(batch.column("text"))
            for x, y in chunks(offsets):
                size = int(offsets[y] - offsets[x])
                if filled and filled + size > block_bytes:
                    yield close()
                    block, filled, found = block + 1, 0, []
                a_ids, a_cut, b_ids, b_cut = tokenised(
                    texts_of(data[offsets[x]:offsets[y]], offsets[x:y + 1] - offsets[x]), a, b)
                lined = Aligned(a_ids, a_cut, b_ids, b_cut, a.sizes, b.model.sizes)
                found.append(np.unique(lined.link_key, return_counts=True))
                if len(found) > 16:
                    found = [tally(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))]
                filled += size + 1
                for i, j in chunks(offsets[x:y + 1], ROW_BYTES):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([base + block], pa.int64()),
                         pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column("__row").slice(x + i, j - i)),
                         long_lists([np.diff(a_cut[i:j + 1])]), long_lists([np.diff(b_cut[i:j + 1])]),
                         pa.array([packed(a_ids[a_cut[i]:a_cut[j]], len(a.sizes))], pa.binary()),
                         pa.array([packed(b_ids[b_cut[i]:b_cut[j]], b.model.size)], pa.binary()),
                         *(pa.nulls(1, pa.list_(pa.int64())) for _ in range(2))], names=names)
        if filled:
            yield close()

    return rows.mapInArrow(run, StructType([
        StructType.fromDDL("block long").fields[0], StructField("rows", ArrayType(rows.schema["__row"].dataType)),
        *StructType.fromDDL(BLOCK_FIELDS).fields]))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """All pairs of a B id share a shard."""
    return (mix((keys & ((1 << B_BITS) - 1)).astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def dealt(entries: DataFrame, shards: int, parts: int) -> DataFrame:
    """Blocks' pairs by shard; the blocks themselves dealt to ``parts``."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("block")[i].as_py()
                keys, counts = values_of(batch.column("keys").slice(i, 1)), values_of(batch.column("counts").slice(i, 1))
                own = shard_of(keys, shards)
                order = np.argsort(own, kind="stable")
                cuts = np.searchsorted(own[order], np.arange(shards + 1))
                some = np.flatnonzero(np.diff(cuts))
                part = int(mix(np.array([block], dtype=np.uint64))[0] % np.uint64(parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), pa.array(np.full(len(some), part)), pa.array(np.full(len(some), block)),
                     long_lists([keys[order[cuts[s]:cuts[s + 1]]] for s in some.tolist()]),
                     long_lists([counts[order[cuts[s]:cuts[s + 1]]] for s in some.tolist()])],
                    names=["shard", "part", "block", "keys", "counts"])

    return entries.mapInArrow(run, "shard long, part long, block long, keys array<long>, counts array<long>")


def hashed(distinct: DataFrame, shards: int) -> DataFrame:
    """Per shard its perfect hash and its keys in the order of their indexes."""

    def place(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(keys, shards)), pa.array(keys)], names=["shard", "key"])

    def build(key, table):
        keys = table.column("key").to_numpy()
        index = PerfectHash.build(keys)
        stored = np.zeros(len(keys), dtype=np.int64)
        stored[index.index(keys)] = keys
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "hash": pa.array([index.to_bytes()], pa.binary()),
                         "stored": long_lists([stored])})

    return distinct.mapInArrow(place, "shard long, key long").groupBy("shard").applyInArrow(
        build, "shard long, hash binary, stored array<long>")


def looked_up(index: dict, keys: np.ndarray) -> np.ndarray:
    """Indexes of keys, each compared with the key stored there."""
    at = PerfectHash.from_bytes(index["hash"]).index(keys)
    if (at < 0).any() or (index["stored"][at] != keys).any():
        raise RuntimeError("a pair is missing from its shard's hash")
    return at


def shard_row(table: pa.Table) -> dict:
    out = {"hash": table.column("hash")[0].as_py()}
    for name in table.column_names:
        if pa.types.is_list(table.schema.field(name).type):
            out[name] = values_of(table.column(name).slice(0, 1))
    return out


def every_part(df: DataFrame, parts: int) -> DataFrame:
    return df.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))


def counted(by_shard: DataFrame, index: DataFrame, parts: int) -> DataFrame:
    """Per shard a dense vector of its pairs' numbers: one per part, summed
    ``FAN_IN`` at a time. ``best`` marks the pairs with their B id's highest."""

    def count(key, left, right):
        if not left.num_rows:
            return pa.table({"shard": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "total": long_lists([])})
        row = shard_row(right)
        total = np.zeros(len(row["stored"]), dtype=np.int64)
        np.add.at(total, looked_up(row, values_of(left.column("keys"))), values_of(left.column("counts")))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()),
                         "total": long_lists([total])})

    def add(key, table):
        lists = table.column("total").combine_chunks()
        total = values_of(lists.slice(0, 1)).copy()
        for i in range(1, len(lists)):
            total += values_of(lists.slice(i, 1))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()),
                         "total": long_lists([total])})

    def mark(key, left, right):
        row = shard_row(left)
        total = values_of(right.column("total").slice(0, 1))
        b = row["stored"] & ((1 << B_BITS) - 1)
        distinct, back = np.unique(b, return_inverse=True)
        highest = np.zeros(len(distinct), dtype=np.int64)
        np.maximum.at(highest, back, total)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "hash": pa.array([row["hash"]], pa.binary()),
                         "stored": long_lists([row["stored"]]), "total": long_lists([total]),
                         "best": long_lists([total == highest[back]], pa.bool_())})

    sums = by_shard.groupBy("shard", "part").cogroup(every_part(index, parts).groupBy("shard", "part")).applyInArrow(
        count, "shard long, part long, total array<long>")
    while parts > 1:
        parts = math.ceil(parts / FAN_IN)
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("shard", "part").applyInArrow(
            add, "shard long, part long, total array<long>")
    return index.groupBy("shard").cogroup(sums.groupBy("shard")).applyInArrow(
        mark, "shard long, hash binary, stored array<long>, total array<long>, best array<boolean>")


def answers(by_shard: DataFrame, counts: DataFrame, parts: int) -> DataFrame:
    """Blocks' pairs with their corpus counts, by block and shard."""

    def look(key, left, right):
        if not left.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "keys": long_lists([]), "counts": long_lists([]),
                             "best": long_lists([], pa.bool_())})
        row = shard_row(right)
        lists = left.column("keys").combine_chunks()
        at = looked_up(row, values_of(lists))
        offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int32)
        return pa.table({"block": left.column("block"), "keys": lists,
                         "counts": pa.ListArray.from_arrays(pa.array(offsets), pa.array(row["total"][at])),
                         "best": pa.ListArray.from_arrays(pa.array(offsets), pa.array(row["best"][at]))})

    return by_shard.groupBy("shard", "part").cogroup(every_part(counts, parts).groupBy("shard", "part")).applyInArrow(
        look, "block long, keys array<long>, counts array<long>, best array<boolean>")


def without_text(docs: DataFrame, text_col: str) -> DataFrame:
    """``__row`` (all columns but the text) and ``text``."""
    others = [col(c) for c in docs.columns if c != text_col] or [F.lit(0).alias("__none")]
    return docs.select(F.struct(*others).alias("__row"), col(text_col).alias("text"))


ALIGN_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row, without its text, with ``n_a`` and ``n_b`` (tokens), ``n_groups``, ``n_links``
    (pairs of overlapping tokens), ``n_best`` (links whose pair count is the
    highest of their B id in the corpus, ties included), ``count_sum`` (pair
    counts over the links) and ``groups`` (``a1,a2|b1;a3|b2,b3``: ids of both
    between common ends).

    A is a byte-level BPE read over a space and the text, B a SentencePiece
    model, which adds that space itself. Null or empty texts, and texts that
    one of them does not spell out byte by byte, have no tokens: zeros and an
    empty text. Every row counts, repeated ones too; null ids need no rule; an
    empty table stays empty. Input columns named like a result are replaced.
    A task holds a block of texts (or one longer text), or the pairs of a
    shard and part, both of bounded size.
    """
    rows = without_text(docs, text_col)
    stored = written(blocks_of(rows, a_path, b_path, block_bytes), "align-blocks")
    entries = stored.where(F.col("keys").isNotNull()).select("block", "keys", "counts")
    passing = []
    distinct = written(entries.select(F.explode("keys").alias("key")).distinct(), "align-pairs", passing)
    pairs = distinct.count()
    total = entries.agg(F.coalesce(F.sum(F.size("keys").cast("long")), F.lit(0))).first()[0]
    shards = max(1, math.ceil(pairs / SHARD_PAIRS))
    parts = max(1, math.ceil(total / shards / PART_PAIRS))
    index = written(hashed(distinct, shards), "align-index", passing)
    by_shard = dealt(entries, shards, parts)
    counts = written(counted(by_shard, index, parts), "align-counts")
    drop(docs.sparkSession, passing)

    def again(key, table):
        a, b = encoders(a_path, b_path)
        asked = table.filter(pc.is_valid(table.column("keys")))
        known = values_of(asked.column("keys"))
        order = np.argsort(known)
        known = known[order]
        number, best = values_of(asked.column("counts"))[order], values_of(asked.column("best"))[order].astype(bool)
        mine = table.filter(pc.is_null(table.column("keys"))).combine_chunks()
        out = []
        for i in range(mine.num_rows):
            cuts, ids = [], []
            for side, size in (("a", len(a.sizes)), ("b", b.model.size)):
                cuts.append(np.concatenate([[0], np.cumsum(values_of(mine.column(f"{side}_sizes").slice(i, 1)))]))
                ids.append(unpacked(mine.column(f"{side}_ids")[i].as_py(), int(cuts[-1][-1]), size))
            lined = Aligned(ids[0], cuts[0], ids[1], cuts[1], a.sizes, b.model.sizes)
            at = np.searchsorted(known, lined.link_key)
            sums = np.zeros(lined.n, dtype=np.int64)
            np.add.at(sums, lined.link_doc, number[at])
            spelt, ends = lined.groups()
            groups = pa.Array.from_buffers(pa.large_string(), lined.n, [
                None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(spelt)]).cast(pa.string())
            out.append(pa.table([
                mine.column("rows").slice(i, 1).combine_chunks().flatten(), *[pa.array(lined.per_doc(d)) for d in (
                    lined.a_doc, lined.b_doc, lined.b_doc[lined.b_last], lined.link_doc, lined.link_doc[best[at]])],
                pa.array(sums), groups], names=["__row", *ALIGN_COLUMNS]))
        return pa.concat_tables(out)

    both = stored.where(F.col("keys").isNull()).drop("counts").unionByName(
        answers(by_shard, counts, parts), allowMissingColumns=True)
    out = both.groupBy("block").applyInArrow(again, StructType([rows.schema["__row"], *StructType.fromDDL(
        "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string").fields]))
    return with_results(out, [c for c in docs.columns if c != text_col], ALIGN_COLUMNS)


def default_byte_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def alignment_digest(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Numbers and a digest of the groups, per document."""
    out = align_tokenizers(docs.select("doc_id", "text"), a_path or default_byte_file(), b_path or default_model())
    return out.select("doc_id", *ALIGN_COLUMNS[:-1],
                      F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit("")).alias("groups_sha256"))
