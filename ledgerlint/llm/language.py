"""Language identification by compression.

Each language has a raw-content dictionary: text of its training documents,
normalised. A text is encoded once with each dictionary by zstandard; the
smallest output names the language, and the saving over the next smallest is
the score. Narrow scores can be rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlint.llm.common import col, with_results
from ledgerlint.llm.words import flat

DICTIONARY_BYTES = 64 << 10
TRAINING_TEXTS = 400
MAX_LANGUAGES = 256
UNKNOWN = "und"
MIN_MARGIN = 0.01
PIECE_BYTES = 4 << 10
SHORT_BYTES = 1 << 9
FILL = b" " * 64
LETTERS_ONLY = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def normal(text: bytes) -> bytes:
    """Lower-case letters with single blanks between and around words; a word
    that repeats the word before it stands once."""
    words = text.translate(LETTERS_ONLY).split()
    return b" " + b" ".join([w for w, before in zip(words, [b"", *words]) if w != before]) + b" "


def has_letter(text: bytes) -> bool:
    return bool(text.translate(None, bytes(set(range(256)) - set(range(65, 91)) - set(range(97, 123))))) or any(
        c.isalpha() for c in text.decode("utf-8", "replace"))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit_dictionaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     texts: int = TRAINING_TEXTS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """One dictionary per language from at most ``texts`` training texts of
    each (the first by a hash of the id), ``size`` bytes at most.

    Rows without text or language teach nothing. More than ``MAX_LANGUAGES``
    values of the language column raise an error.
    """
    good = docs.where(col(lang_col).isNotNull() & (F.length(col(text_col)) > 0)) \
        .select(col(lang_col).alias("lang"), F.xxhash64(col(id_col), col(text_col)).alias("h"), col(text_col).alias("text"))
    counts = good.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError("too many languages")
    if not counts:
        return {}
    # per language a cut of the hash range that leaves about twice the texts wanted, then the first by hash
    wanted = F.lit(False)
    for r in counts:
        share = min(1.0, (2 * texts + 20) / r["n"])
        wanted = wanted | ((F.col("lang") == r["lang"]) & (F.pmod("h", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)))
    most = 4 * texts * len(counts)
    # only as much of a text as fits the dictionary is read
    rows = good.where(wanted).select("lang", "h", F.substring("text", 1, size).alias("text")) \
        .orderBy("h").limit(most).collect()
    out = {}
    for r in counts:
        own = sorted((x["h"], x["text"]) for x in rows if x["lang"] == r["lang"])[:texts]
        share = max(200, size // max(1, len(own)) * 4)
        parts = [normal(t.encode())[:share] for _, t in own]
        out[r["lang"]] = b"".join(reversed(parts))[-size:]
    return out


class Encoders:
    """Compressed sizes of a text under each dictionary.

    A text is encoded in pieces, so that its own earlier words help less than
    the dictionary; a run of blanks after a piece keeps the encoder from
    storing a short one as it is, which would tie all languages.
    """

    def __init__(self, dictionaries: dict[str, bytes], levels=(7, 12)):
        self.langs = sorted(dictionaries)
        self.sets = {}
        for level in levels:
            self.sets[level] = []
            for lang in self.langs:
                content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                content.precompute_compress(level=level)
                self.sets[level].append(zstandard.ZstdCompressor(
                    level=level, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False))
        self.levels = levels
        self.empty = [min((len(c.compress(FILL)) for c in self.sets[lv]), default=0) for lv in levels]

    def sizes(self, text: bytes) -> list[int]:
        which = int(len(text) < SHORT_BYTES)
        pieces = [text[i:i + PIECE_BYTES] + FILL for i in range(0, len(text), PIECE_BYTES)]
        return [sum([len(c.compress(p)) for p in pieces]) - self.empty[which] * len(pieces)
                for c in self.sets[self.levels[which]]]

    def predict(self, raw: bytes) -> tuple[str, float]:
        if not self.langs or not raw or not has_letter(raw):
            return UNKNOWN, 0.0
        sizes = self.sizes(normal(raw))
        order = np.argsort(sizes, kind="stable")
        if len(order) == 1:
            return self.langs[0], 1.0
        best, second = sizes[order[0]], sizes[order[1]]
        return self.langs[order[0]], max(0.0, 1.0 - best / max(second, 1))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text",
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows with ``lang_pred``, ``score`` and ``rejected``.

    ``lang_pred`` is the dictionary of the smallest encoding (the first by
    name on a tie), ``und`` with score 0 if the text is null or has no letter
    or nothing was learned. ``score`` is the share of the runner-up's bytes
    that the best saves (0 on a tie). A row is ``rejected`` if it is ``und`` or
    its score is under ``min_margin``; it keeps its prediction. Whole texts are
    encoded, one at a time. Repeated rows repeat their result, an empty table
    gives an empty one. Input columns named like a result are replaced, others pass through.
    """
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("__row"))
    at = docs.columns.index(text_col)

    def predict(batches):
        encoders = Encoders(dictionaries)
        for batch in batches:
            data, offsets = flat(batch.column("__row").field(at))
            got = [encoders.predict(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__row"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=["__row", "lang_pred", "score"])

    out = rows.mapInArrow(predict, StructType([rows.schema["__row"],
                                               *StructType.fromDDL("lang_pred string, score double").fields]))
    narrow = (F.col("lang_pred") == UNKNOWN) | (F.col("score") < min_margin)
    return with_results(out.withColumn("rejected", narrow), docs.columns, ["lang_pred", "score", "rejected"])


def language_digest(docs: DataFrame) -> DataFrame:
    """Columns of the query: fitted on the rows that are not held out."""
    kept = docs.select("doc_id", "text", "lang")
    fitted = fit_dictionaries(kept.where(~held_out()))
    return identify(kept.select("doc_id", held_out().alias("held_out"), "text"), fitted) \
        .select("doc_id", "held_out", "lang_pred", "score", "rejected")
