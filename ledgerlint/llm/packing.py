"""Packing: concatenate and cut.

Pass one tokenises every document and stores its ids with its place in its
partition; prefix sums over the partitions' token totals give each document
a global offset. Pass two cuts the stream of ids into fixed windows and
writes a boundary record per piece. No id is shuffled.
"""

from __future__ import annotations

import json
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlint.llm.common import col, with_results, written
from ledgerlint.llm.words import SliceHash, chunks, flat, mix

SEQUENCE = 2048
END_ID = 1
BROADCAST_PARTITIONS = 1_000_000
SIMPLE = 0x300
_KIND = None


def kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the first code points: class (0 blank, 1 letter, 2 number,
    3 other), lower case, and whether lower case is one code point."""
    global _KIND
    if _KIND is None:
        kind, lower, plain = np.full(SIMPLE, 3, np.uint8), np.arange(SIMPLE, dtype=np.uint32), np.ones(SIMPLE, bool)
        for c in range(SIMPLE):
            ch = chr(c)
            group = unicodedata.category(ch)[0]
            kind[c] = 0 if ch in "\t\n\x0b\x0c\r \x85\xa0" else {"L": 1, "N": 2}.get(group, 3)
            low = ch.lower()
            plain[c] = len(low) == 1 and ord(low) < SIMPLE
            lower[c] = ord(low) if plain[c] else c
        _KIND = kind, lower, plain
    return _KIND


#: Steps of the tokenizer files whose texts can be encoded by unit.
BY_UNIT = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"],
           r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "BPE")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level
    vocabulary: itself if printable, else the next unused from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class UnitTokenizer:
    """Ids of many texts, each distinct unit encoded once.

    The tokenizer drops blanks and splits texts into runs of letters, single
    numbers and runs of other characters before it merges pairs, so a text's
    ids are those of its units one after another. Texts with characters from
    U+0300 on (which may compose) or with an added token of the vocabulary in
    them go to the tokenizer whole, and so does, as one unit, any word with an
    apostrophe. A tokenizer of other steps gets all texts whole.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        self.added = [t["content"].lower() for t in steps.get("added_tokens") or []]
        names = [[x["type"] for x in (steps.get(k) or {}).get(v, [])]
                 for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        split = (steps.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self.by_unit = (*names, split, steps["model"]["type"]) == BY_UNIT
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.most = most
        self.clear()

    def clear(self):
        self.place = {}
        self.ids, self.bounds = [np.zeros(0, np.uint32)], [0]
        self.table = None

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode_unit(self, unit: str) -> list[int]:
        if "'" in unit:
            return self.encode([unit])[0]
        if not (unit.isascii() and unit.isprintable()):
            unit = unit.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(unit)]

    def units(self, codes: np.ndarray, first: np.ndarray):
        """Starts and ends of units in code points; ``first`` marks row starts."""
        kind, lower, _ = kinds()
        k = kind[codes]
        new = np.ones(len(codes), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (k[1:] == 2) | first[1:]
        quote = codes == 39
        if quote.any():  # the whole word around an apostrophe is one unit
            blank = k == 0
            edge = np.ones(len(codes), dtype=bool)
            edge[1:] = (blank[1:] != blank[:-1]) | first[1:]
            word = np.cumsum(edge) - 1
            quoted = np.zeros(int(word[-1]) + 1, dtype=bool)
            quoted[word[quote]] = True
            new = np.where(quoted[word], edge, new)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(codes))
        keep = k[starts] != 0
        return starts[keep], ends[keep]

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and n+1 offsets."""
        if not self.by_unit:
            got = self.encode(texts)
            return (np.array([i for x in got for i in x], dtype=np.uint32),
                    np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(t) for t in texts])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        _, lower, plain = kinds()
        high = codes >= SIMPLE
        odd = high | ~plain[np.where(high, 0, codes)]
        counted = np.concatenate([[0], np.cumsum(odd)])
        whole = np.flatnonzero((counted[offsets[1:]] > counted[offsets[:-1]])
                               | np.array([any(x in t.lower() for x in self.added) for t in texts], dtype=bool))
        first = np.zeros(len(codes) + 1, dtype=bool)
        first[offsets] = True
        simple = np.where(odd, 32, codes)
        starts, ends = self.units(simple, first[:-1]) if len(codes) else (offsets[:0], offsets[:0])
        row = np.searchsorted(offsets, starts, "right") - 1
        if len(whole):
            use = ~np.isin(row, whole)
            starts, ends, row = starts[use], ends[use], row[use]
        low = lower[simple]
        marks = SliceHash(mix(low.astype(np.uint64) + np.uint64(1))).of(starts, ends)
        distinct, where, back = np.unique(marks, return_index=True, return_inverse=True)
        slots = self.lookup(distinct, starts[where], ends[where], low)
        bounds, table = np.array(self.bounds), self.all_ids()
        left, size = bounds[slots][back], np.diff(bounds)[slots][back]
        total = np.bincount(row, weights=size, minlength=len(texts)).astype(np.int64)
        extra = {int(i): np.array(x, np.uint32) for i, x in zip(whole, self.encode([texts[i] for i in whole]))} if len(whole) else {}
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        ids = table[np.repeat(left, size) + inner]
        if extra:
            own = np.concatenate([[0], np.cumsum(total)])
            parts = [extra[i] if i in extra else ids[own[i]:own[i + 1]] for i in range(len(texts))]
            for i, x in extra.items():
                total[i] = len(x)
            ids = np.concatenate(parts) if parts else ids
        return ids, np.concatenate([[0], np.cumsum(total)])

    def lookup(self, marks: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
        if len(self.place) > self.most:
            self.clear()
        slots = np.array([self.place.get(m, -1) for m in marks.tolist()], dtype=np.int64)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            text = codes.tobytes().decode("utf-32-le", "surrogatepass")
            got = [self.encode_unit(text[a:b]) for a, b in zip(starts[missing].tolist(), ends[missing].tolist())]
            base = len(self.bounds) - 1
            self.ids.append(np.array([i for ids in got for i in ids], dtype=np.uint32))
            self.bounds.extend((self.bounds[-1] + np.cumsum([len(g) for g in got])).tolist())
            slots[missing] = base + np.arange(len(missing))
            self.place.update(zip(marks[missing].tolist(), slots[missing].tolist()))
            self.table = None
        return slots

    def all_ids(self) -> np.ndarray:
        if self.table is None:
            self.table = np.concatenate(self.ids)
            self.ids = [self.table]
        return self.table


def tokenised(docs: DataFrame, path: str, text_col: str, end_id: int) -> DataFrame:
    """Every row with its ids (little-endian 32-bit, ``end_id`` last), its
    partition and the ids before it there."""
    rows = docs.select(F.struct(*[col(c) for c in docs.columns if c != text_col]).alias("__row"), col(text_col).alias("text")) \
        if len(docs.columns) > 1 else docs.select(F.struct(F.lit(0).alias("__none")).alias("__row"), col(text_col).alias("text"))

    def encode(batches):
        tokenizer, done, part = UnitTokenizer(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                raw = data[offsets[a]:offsets[b]].tobytes()
                cut = (offsets[a:b + 1] - offsets[a]).tolist()
                ids, bounds = tokenizer.batch([raw[x:y].decode("utf-8", "replace") for x, y in zip(cut[:-1], cut[1:])])
                sizes = np.diff(bounds) + 1
                ended = np.full(int(sizes.sum()), end_id, dtype="<u2" if ids.max(initial=0) < 65536 else "<u4")
                place = np.arange(len(ids)) + np.repeat(np.arange(b - a), sizes - 1)
                ended[place] = ids
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                stored = ended.tobytes()
                w = ended.itemsize
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__row").slice(a, b - a), pa.array(np.full(b - a, part, np.int32)),
                     pa.array(cuts[:-1] + done), pa.array(sizes),
                     pa.array([stored[x * w:y * w] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary())],
                    names=["__row", "part", "before", "doc_tokens", "ids"])
                done += int(sizes.sum())

    return rows.mapInArrow(encode, StructType([rows.schema["__row"], *StructType.fromDDL(
        "part int, before long, doc_tokens long, ids binary").fields]))


PIECE_RESULTS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def pack(docs: DataFrame, tokenizer_path: str, text_col: str = "text", sequence: int = SEQUENCE,
         end_id: int = END_ID) -> DataFrame:
    """One row per piece: the document's columns without its text, ``start``
    (ids of the document before the piece), ``length``, ``ids_crc32`` (of the
    ids as little-endian 32-bit numbers), ``doc_tokens`` (with the end id),
    ``sequence_id``, ``offset`` in the sequence and ``ids`` (binary).

    All documents form one stream in the order of the input's partitions, cut
    every ``sequence`` ids: only the last sequence can need padding.

    Null or empty text: the end id alone. Repeated rows are packed each. The
    text may be of any length; ids of one document at a time are in memory.
    Input columns named like a result are replaced. Empty table: empty.
    """
    stored = written(tokenised(docs, tokenizer_path, text_col, end_id), "packing-ids")
    totals = stored.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    # 12 bytes for each partition of the first pass: small, but the number is checked
    if totals.count() <= BROADCAST_PARTITIONS:
        base = F.broadcast(base)
    placed = stored.join(base, "part").select("__row", (F.col("base") + F.col("before")).alias("g"), "doc_tokens", "ids")

    def cut(batches):
        for batch in batches:
            g = batch.column("g").to_numpy()
            n = batch.column("doc_tokens").to_numpy()
            first = g // sequence
            pieces = (g + n - 1) // sequence - first + 1
            row = np.repeat(np.arange(len(g)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            seq = first[row] + k
            left = np.maximum(seq * sequence, g[row])
            right = np.minimum((seq + 1) * sequence, (g + n)[row])
            start, length = left - g[row], right - left
            ids = batch.column("ids")
            blobs, sums, last, wide = [], [], -1, b""
            for i, s, x in zip(row.tolist(), start.tolist(), length.tolist()):
                if i != last:
                    raw, last = ids[i].as_py(), i
                    wide = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n[i] else "<u4").astype("<u4").tobytes()
                piece = wide[4 * s:4 * (s + x)]
                blobs.append(piece)
                sums.append(zlib.crc32(piece))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__row").take(pa.array(row)), pa.array(start), pa.array(length),
                 pa.array(sums, pa.int64()), pa.array(n[row]), pa.array(seq), pa.array(left - seq * sequence),
                 pa.array(blobs, pa.binary())], names=["__row", *PIECE_RESULTS])

    out = placed.mapInArrow(cut, StructType([placed.schema["__row"], *StructType.fromDDL(
        "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary").fields]))
    return with_results(out, [c for c in docs.columns if c != text_col], PIECE_RESULTS)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def packing_digest(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Boundary records of the query."""
    out = pack(docs.select("doc_id", "text"), tokenizer_path or default_tokenizer())
    return out.select("doc_id", *PIECE_RESULTS[:-1])
