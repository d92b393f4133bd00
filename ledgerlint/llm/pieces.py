"""SentencePiece BPE by vectorised merge rounds, and its decoding.

The code points of many texts stand in one flat array. It is cut into words
wherever no piece of the vocabulary holds the two neighbouring characters, so
no merge can cross a cut, and every distinct word is merged once. A round
takes the smallest rank of any pair per word (a segmented minimum), merges
the leftmost pairs of that rank side by side, and compacts the arrays; words
without a pair leave. A merge that makes a pair of the same or a smaller rank
ends its word's round, because the library would take that pair next.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlint.llm.common import col, with_results
from ledgerlint.llm.words import chunks, flat

SPACE = "▁"
NONE = np.iinfo(np.int32).max
LONG_WORD = 4096
NORMAL, UNKNOWN, CONTROL, UNUSED, BYTE = 1, 2, 3, 5, 6


def fields(data: bytes):
    """Field numbers and values of a serialised message."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}[key & 7] if key & 7 in (1, 5) else number()
            value, at = data[at:at + size], at + size
        yield key >> 3, value


class PieceModel:
    """A BPE model with byte fallback and the identity normaliser.

    Symbols are piece ids, or ``size`` + code point for a character that is
    no piece. A model of another kind raises ``ValueError``.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(fields(f.read()))
        trainer = {k: v for f, x in message if f == 2 for k, v in fields(x)}
        rules = {k: v for f, x in message if f == 3 for k, v in fields(x)}
        pieces = [dict(fields(x)) for f, x in message if f == 1]
        self.pieces = [p[1].decode() for p in pieces]
        self.kind = np.array([p.get(3, NORMAL) for p in pieces])
        plain = (not rules.get(2) and rules.get(3, 1) == 1 and rules.get(4, 1) == 0 and rules.get(5, 1) == 1
                 and not trainer.get(24, 0))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or not plain or not np.isin(
                self.kind, [NORMAL, UNKNOWN, CONTROL, BYTE]).all():
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no further normalisation")
        self.size = len(self.pieces)
        score = np.array([struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0] for p in pieces])
        # equal scores share a rank: the library then takes the leftmost pair
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        self.normal = {self.pieces[i]: int(i) for i in np.flatnonzero(self.kind == NORMAL)}
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for i in np.flatnonzero(self.kind == BYTE).tolist():
            self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        self._characters()
        self._pairs()
        self._surfaces()

    def symbol(self, text: str) -> int:
        found = self.normal.get(text, -1)
        return self.size + ord(text) if found < 0 and len(text) == 1 else found

    def _characters(self):
        chars = sorted({c for p in self.normal for c in p})
        self.classes = np.zeros(0x110000, dtype=np.int16)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.symbols = np.array([-1, *(self.symbol(c) for c in chars)], dtype=np.int64)
        self.n_classes = len(chars) + 1
        self.joined = np.zeros(self.n_classes ** 2, dtype=bool)
        for p in self.normal:
            for a, b in zip(p, p[1:]):
                self.joined[int(self.classes[ord(a)]) * self.n_classes + int(self.classes[ord(b)])] = True

    def _pairs(self):
        found = {}
        for piece, i in self.normal.items():
            for cut in range(1, len(piece)):
                a, b = self.symbol(piece[:cut]), self.symbol(piece[cut:])
                if a >= 0 and b >= 0:
                    found[a << 24 | b] = i
        keys = np.array(sorted(found), dtype=np.int64)
        self.pair_keys = np.append(keys, np.iinfo(np.int64).max)
        self.pair_ids = np.array([*(found[k] for k in keys.tolist()), -1], dtype=np.int64)

    def _surfaces(self):
        """Bytes of each id when decoded, one after another, with offsets."""
        texts = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for i in np.flatnonzero(self.kind != NORMAL).tolist():
            kind = self.kind[i]
            texts[i] = bytes([int(self.pieces[i][3:5], 16)]) if kind == BYTE else \
                " ⁇ ".encode() if kind == UNKNOWN else b""
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.surface = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.spaced = np.array([p.startswith(SPACE) for p in self.pieces]) & (self.kind == NORMAL)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that each two symbols make, -1 if none."""
        keys = left << 24 | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ids[at], -1)

    def rank_of(self, pieces: np.ndarray) -> np.ndarray:
        return np.where(pieces >= 0, self.rank[pieces], NONE)


def merge_words(model: PieceModel, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of words after all merges, and the n+1 bounds of the words;
    ``bounds`` cuts ``symbols`` into non-empty words."""
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    done: dict[int, np.ndarray] = {}
    long = np.flatnonzero(sizes > LONG_WORD)
    for w in long.tolist():
        done[w] = merge_long(model, symbols[bounds[w]:bounds[w + 1]])
    word = np.repeat(np.arange(n), sizes)
    use = sizes[word] <= LONG_WORD
    sym, word = symbols[use], word[use]
    out_sym, out_word = [], []
    pair = np.full(len(sym), -1, dtype=np.int64)
    if len(sym) > 1:
        inner = np.flatnonzero(word[1:] == word[:-1])
        pair[inner] = model.merged(sym[inner], sym[inner + 1])
    while len(sym):
        start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        segment = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(sym))))
        rank = model.rank_of(pair)
        least = np.minimum.reduceat(rank, start)[segment]
        ended = least == NONE
        if ended.any():
            out_sym.append(sym[ended])
            out_word.append(word[ended])
            live = ~ended
            sym, word, pair, rank, least = sym[live], word[live], pair[live], rank[live], least[live]
            if not len(sym):
                break
        # the leftmost of overlapping pairs: every second one of a chain of neighbours
        hit = rank == least
        at = np.flatnonzero(hit)
        chain = np.append(True, (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]]))
        head = np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - head) % 2 == 0]
        # a merge that makes a pair of the same or a smaller rank is its word's last in this round
        made, limit = pair[at], least[at]
        before = np.maximum(at - 1, 0)
        left = sym[before]
        beside = np.append(False, at[1:] == at[:-1] + 2)
        left = np.where(beside, np.append(0, made[:-1]), left)
        after = np.minimum(at + 2, len(sym) - 1)
        on_left = (at > 0) & (word[before] == word[at])
        on_right = (at + 2 < len(sym)) & (word[after] == word[at])
        breaks = (on_left & (model.rank_of(model.merged(left, made)) <= limit)) | \
                 (on_right & (model.rank_of(model.merged(made, sym[after])) <= limit))
        if breaks.any():
            own = word[at]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            place = np.arange(len(at))
            stop = np.minimum.reduceat(np.where(breaks, place, len(at)), first)
            at = at[place <= np.repeat(stop, np.diff(np.append(first, len(at))))]
        sym[at] = pair[at]
        keep = np.ones(len(sym), dtype=bool)
        keep[at + 1] = False
        changed = np.zeros(len(sym), dtype=bool)
        changed[at] = True
        sym, word, pair, changed = sym[keep], word[keep], pair[keep], changed[keep]
        changed[:-1] |= changed[1:]
        again = np.flatnonzero(changed)
        pair[again] = -1
        again = again[again + 1 < len(sym)]
        again = again[word[again] == word[again + 1]]
        pair[again] = model.merged(sym[again], sym[again + 1])
    if out_sym:
        sym, word = np.concatenate(out_sym), np.concatenate(out_word)
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
    sizes = np.bincount(word, minlength=n)
    if done:
        cut = np.concatenate([[0], np.cumsum(sizes)])
        sym = np.concatenate([done.get(w, sym[cut[w]:cut[w + 1]]) for w in range(n)])
        for w, x in done.items():
            sizes[w] = len(x)
    return sym, np.concatenate([[0], np.cumsum(sizes)])


def merge_long(model: PieceModel, symbols: np.ndarray) -> np.ndarray:
    """The same merges for one very long word, by a queue: rounds over it
    would each read the whole word."""
    n = len(symbols)
    sym = symbols.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    known = dict(zip(model.pair_keys.tolist(), model.pair_ids.tolist()))
    rank = model.rank.tolist()
    queue = []

    def offer(a, b):
        piece = known.get(sym[a] << 24 | sym[b], -1)
        if piece >= 0:
            heapq.heappush(queue, (rank[piece], a, b, piece, sym[a], sym[b]))

    for a in range(n - 1):
        offer(a, a + 1)
    while queue:
        _, a, b, piece, x, y = heapq.heappop(queue)
        if sym[a] != x or sym[b] != y or after[a] != b:
            continue
        sym[a], sym[b] = piece, -1
        after[a] = after[b]
        if after[a] < n:
            before[after[a]] = a
            offer(a, after[a])
        if before[a] >= 0:
            offer(before[a], a)
    return np.array([s for s in sym if s >= 0], dtype=np.int64)


class PieceEncoder:
    """Ids of many texts; each distinct word is merged once and kept until
    ``most`` words are known."""

    def __init__(self, path: str, most: int = 300_000):
        self.model = PieceModel(path)
        self.path = path
        self.most = most
        self.library = None
        self.clear()

    def clear(self):
        self.place = {}
        self.ids = np.zeros(0, dtype=np.int32)
        self.bounds = np.zeros(1, dtype=np.int64)

    def learn(self, words: list[bytes]):
        """Merge words (UTF-32) and keep their ids."""
        m = self.model
        codes = np.frombuffer(b"".join(words), dtype=np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(w) // 4 for w in words])])
        kind = m.classes[codes]
        sym = np.where(kind > 0, m.symbols[kind], m.size + codes.astype(np.int64))
        sym, cuts = merge_words(m, sym, bounds)
        odd = np.flatnonzero(sym >= m.size)
        size = np.ones(len(sym), dtype=np.int64)
        size[odd] = [len(chr(c).encode()) for c in (sym[odd] - m.size).tolist()]
        ids = np.repeat(sym, size)
        ends = np.concatenate([[0], np.cumsum(size)])
        for i in odd.tolist():
            ids[ends[i]:ends[i + 1]] = m.byte_ids[np.frombuffer(chr(int(sym[i]) - m.size).encode(), dtype=np.uint8)]
        base = len(self.bounds) - 1
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + ends[cuts[1:]]])
        self.place.update(zip(words, range(base, base + len(words))))

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and n+1 offsets."""
        m, n = self.model, len(texts)
        filled = [SPACE + t if t else "" for t in texts]
        codes = np.frombuffer("".join(filled).encode("utf-32-le", "replace"), dtype=np.uint32).copy()
        if not len(codes):
            return np.zeros(0, dtype=np.int32), np.zeros(n + 1, dtype=np.int64)
        codes[codes == 32] = ord(SPACE)
        rows = np.concatenate([[0], np.cumsum([len(t) for t in filled])])
        kind = m.classes[codes].astype(np.int64)
        cut = np.ones(len(codes) + 1, dtype=bool)
        cut[1:-1] = ~m.joined[kind[:-1] * m.n_classes + kind[1:]]
        cut[rows] = True
        cuts = np.flatnonzero(cut)
        words = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [
            None, pa.py_buffer((cuts * 4).astype(np.int32).tobytes()), pa.py_buffer(codes.tobytes())]) \
            if len(codes) < 1 << 28 else pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [
                None, pa.py_buffer((cuts * 4).tobytes()), pa.py_buffer(codes.tobytes())])
        words = words.dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.place) + len(distinct) > self.most:
            self.clear()
        slots = np.array([self.place.get(w, -1) for w in distinct], dtype=np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            base = len(self.bounds) - 1
            self.learn([distinct[i] for i in new.tolist()])
            slots[new] = base + np.arange(len(new))
        slots = slots[words.indices.to_numpy()]
        size = np.diff(self.bounds)[slots]
        before = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(before[-1]) + np.repeat(self.bounds[slots] - before[:-1], size)
        return self.ids[at], before[np.searchsorted(cuts, rows)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of the ids between ``offsets``, as the library decodes them:
        U+2581 is a space, the first one of a text goes, bytes that are no
        UTF-8 are U+FFFD."""
        m = self.model
        skip = np.zeros(len(ids), dtype=np.int64)
        filled = np.flatnonzero(np.diff(offsets))
        first = offsets[:-1][filled]
        skip[first] = m.spaced[ids[first]]
        odd = filled[m.kind[ids[first]] == CONTROL]  # the space is then dropped further on
        size = m.sizes[ids] - skip
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(ends[-1]) + np.repeat(m.starts[ids] + skip - ends[:-1], size)
        data, cuts = m.surface[at].tobytes(), ends[offsets]
        try:
            data.decode()
            bad = set()
        except UnicodeDecodeError:
            bad = {i for i in range(len(cuts) - 1) if not _valid(data[cuts[i]:cuts[i + 1]])}
        bad |= set(odd.tolist())
        if not bad:
            return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [
                None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.large_string())
        if self.library is None:
            import sentencepiece
            self.library = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return pa.array([self.library.decode(ids[offsets[i]:offsets[i + 1]].tolist()) if i in bad
                         else data[cuts[i]:cuts[i + 1]].decode() for i in range(len(cuts) - 1)], pa.large_string())


def _valid(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def texts_of(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Rows of a flat buffer as text; bytes that are no UTF-8 become U+FFFD."""
    raw, cuts = data.tobytes(), offsets.tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]


def with_text(docs: DataFrame, text_col: str) -> DataFrame:
    """``__row`` (all columns) and ``text``."""
    return docs.select(F.struct(*[col(c) for c in docs.columns]).alias("__row"), col(text_col).alias("text"))


PIECE_COLUMNS = ["n_tokens", "ids", "decoded"]


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """Every row with ``ids`` (array of int), ``n_tokens`` and ``decoded``,
    the text that the ids stand for.

    Ids are those of the sentencepiece library without begin or end ids.
    Null or empty text: no ids, decoded to the empty text. Rows are
    independent: null ids, repeated rows and ties need no rule, an empty table
    stays empty. Input columns named like a result are replaced. A text may be
    of any length; about half a megabyte of text, or one longer text, is in
    memory at a time. Words of over 4096 characters without a cut are merged
    by a queue, in the same order.
    """
    rows = with_text(docs, text_col)

    def run(batches):
        encoder = None
        for batch in batches:
            encoder = encoder or PieceEncoder(model_path)
            data, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                ids, cuts = encoder.batch(texts_of(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__row").slice(a, b - a), pa.array(np.diff(cuts)),
                     pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids)),
                     encoder.decode(ids, cuts).cast(pa.string())],
                    names=["__row", *PIECE_COLUMNS])

    out = rows.mapInArrow(run, StructType([rows.schema["__row"], *StructType.fromDDL(
        "n_tokens long, ids array<int>, decoded string").fields]))
    return with_results(out, docs.columns, PIECE_COLUMNS)


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_digest(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Digests of ids and decoded texts of the query."""
    out = encode_pieces(docs.select("doc_id", "text"), model_path or default_model())
    return out.select("doc_id", "n_tokens",
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
