"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of rows of a hashed table: the row of the word
and those of its leading bytes. Filters of several widths run over the
embeddings, the maximum of each over the text goes to a logistic output.
Training (Adam on the cross-entropy) reads every labelled text: the rows are
dealt into parts by id, each part trains a copy of the network in its own task,
and the copies are averaged after each pass. The threshold of each language,
which a hashed word model guesses from the text alone, counts the errors of
every labelled text.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlint.llm.common import col, with_results
from ledgerlint.llm.words import BYTE_CODES, IS_NO_LETTER, SliceHash, chunks, find_words, flat, lower_ascii

BUCKETS, WIDTH, FILTERS = 1 << 15, 16, 16
SPANS = (1, 2, 3)
LEADING = (3, 4, 6)
LANG_BUCKETS = 1 << 14
PART_ROWS, MAX_PARTS, HELD_BYTES = 1 << 14, 256, 64 << 20
BLOCK_ROWS = 1 << 10
LOGIT_STEPS, MOST_LOGIT = 1 << 10, 64
EPOCHS, ROUNDS, BATCH, RATE, KEEP_WORDS, SEED = 5, 3, 32, 0.01, 0.6, 17


def word_ids(data: np.ndarray, offsets: np.ndarray):
    """Table rows of each word (one column for the word, one for each number
    of leading bytes) and the number of words before each text (n+1)."""
    data = lower_ascii(data)
    starts, ends, before = find_words(data, offsets, IS_NO_LETTER)
    hashes = SliceHash(BYTE_CODES[data])
    out = np.empty((len(starts), 1 + len(LEADING)), dtype=np.int32)
    for j, lead in enumerate((None, *LEADING)):
        stop = ends if lead is None else np.minimum(starts + lead, ends)
        marks = hashes.of(starts, stop) + np.uint64(0 if lead is None else lead * 0x9E3779B97F4A7C15 % 2 ** 64)
        out[:, j] = (marks >> np.uint64(20)) % np.uint64(BUCKETS)
    return out, before


class Network:
    """Parameters and passes; a text of fewer words than a filter is padded
    with zero embeddings."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {"table": rng.normal(0, 0.3, (BUCKETS, WIDTH)).astype(np.float32),
                  "out": rng.normal(0, 0.1, FILTERS * len(SPANS)).astype(np.float32), "bias": np.zeros(1, np.float32)}
        for s in SPANS:
            self.p[f"w{s}"] = rng.normal(0, (s * WIDTH) ** -0.5, (s, WIDTH, FILTERS)).astype(np.float32)
            self.p[f"b{s}"] = np.zeros(FILTERS, np.float32)

    def embed(self, ids: np.ndarray) -> np.ndarray:
        out = self.p["table"][ids[:, 0]]
        for j in range(1, ids.shape[1]):
            out += self.p["table"][ids[:, j]]
        return out

    def pooled(self, ids: np.ndarray, before: np.ndarray, with_places: bool = False):
        """Maximum of every filter over each text (rectified), and where."""
        pad, n = max(SPANS) - 1, len(before) - 1
        x = np.concatenate([self.embed(ids), np.zeros((pad, WIDTH), np.float32)])
        sizes, first = np.diff(before), before[:-1]
        full = np.flatnonzero(sizes > 0)
        out = np.zeros((n, FILTERS * len(SPANS)), np.float32)
        places = np.zeros(out.shape, np.int64)
        if not len(full):
            return (out, places) if with_places else out
        for k, s in enumerate(SPANS):
            y = np.tile(self.p[f"b{s}"], (len(ids), 1))
            for j in range(s):
                z = x[j:j + len(ids)] @ self.p[f"w{s}"][j]
                if j:  # a text's end: what follows is the next text's and counts as zero
                    for d in range(1, j + 1):
                        ends = before[1:][full] - d
                        z[ends[ends >= 0]] = 0
                y += z
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            out[full, part] = np.maximum.reduceat(y, first[full], axis=0)
            if with_places:
                for i in full:
                    places[i, part] = before[i] + np.argmax(y[before[i]:before[i + 1]], axis=0)
        out = np.maximum(out, 0)
        return (out, places) if with_places else out

    def logits(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        return self.pooled(ids, before) @ self.p["out"] + self.p["bias"][0]

    def gradients(self, ids: np.ndarray, before: np.ndarray, label: np.ndarray) -> dict:
        pool, places = self.pooled(ids, before, True)
        error = 1 / (1 + np.exp(-(pool @ self.p["out"] + self.p["bias"][0]))) - label
        error = (error / len(label)).astype(np.float32)
        g = {"out": pool.T @ error, "bias": np.array([error.sum()], np.float32)}
        back = np.outer(error, self.p["out"]) * (pool > 0)
        rows, grads = [], []
        end = before[1:]
        for k, s in enumerate(SPANS):
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            d, at = back[:, part], places[:, part]
            g[f"b{s}"] = d.sum(axis=0)
            gw = np.zeros_like(self.p[f"w{s}"])
            text, filt = np.nonzero(d)
            v, where = d[text, filt], at[text, filt]
            for j in range(s):
                inside = where + j < end[text]
                if not inside.any():
                    continue
                word = where[inside] + j
                vec = self.embed(ids[word])
                np.add.at(gw[j].T, filt[inside], v[inside, None] * vec)
                rows.append(ids[word])
                grads.append(v[inside, None] * self.p[f"w{s}"][j].T[filt[inside]])
            g[f"w{s}"] = gw
        if rows:
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            touched, inverse = np.unique(rows, return_inverse=True)
            total = np.zeros((len(touched), WIDTH), np.float32)
            for j in range(rows.shape[1]):
                np.add.at(total, inverse.reshape(rows.shape)[:, j], grads)
            g["table"] = touched, total
        return g

    def train(self, batches, seed):
        """``batches``: word rows, words before each text, and labels of each."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step, (ids, before, label) in enumerate(batches, 1):
            # words are left out at random, so that no telling word hides the others of its text
            keep = rng.random(len(ids)) < KEEP_WORDS
            ids, before = ids[keep], np.concatenate([[0], np.cumsum(keep)])[before]
            scale = RATE * (1 - 0.999 ** step) ** 0.5 / (1 - 0.9 ** step)
            for k, g in self.gradients(ids, before, label.astype(np.float32)).items():
                at, g = g if k == "table" else (slice(None), g)
                first[k][at] = 0.9 * first[k][at] + 0.1 * g
                second[k][at] = 0.999 * second[k][at] + 0.001 * g * g
                self.p[k][at] -= scale * first[k][at] / (np.sqrt(second[k][at]) + 1e-8)

    def changes(self, start: dict, weight: int):
        """What training changed since ``start``, times ``weight``, in blocks
        of parameters, each row with its weight as last column. A table row
        that was not touched weighs nothing."""
        for at, (k, a) in enumerate(blocks()):
            now, old = (x[k][a:a + BLOCK_ROWS] if k == "table" else x[k].reshape(1, -1) for x in (self.p, start))
            moved = now - old
            touched = moved.any(axis=1) if k == "table" else np.ones(1, bool)
            yield at, np.concatenate([moved, touched[:, None]], axis=1) * np.float32(weight)

    def add(self, sums: dict):
        """Adds the weighted mean of the summed changes of all parts."""
        for at, (k, a) in enumerate(blocks()):
            mean = sums[at][:, :-1] / np.maximum(sums[at][:, -1:], 1)
            if k == "table":
                self.p[k][a:a + BLOCK_ROWS] += mean.astype(np.float32)
            else:
                self.p[k] += mean.astype(np.float32).reshape(self.p[k].shape)


def blocks() -> list[tuple[str, int]]:
    """Name and first row of each block of parameters that is averaged."""
    return [("table", a) for a in range(0, BUCKETS, BLOCK_ROWS)] + \
        [(k, 0) for k in ("out", "bias", *[f"{x}{s}" for x in "wb" for s in SPANS])]


class LanguageGuess:
    """Naive Bayes over hashed words, learned from the language column of
    training rows, asked with the text alone."""

    def __init__(self, words: dict[str, np.ndarray]):
        """``words``: per language the number of words in each bucket."""
        self.langs = sorted(words)
        counts = np.stack([words[x] for x in self.langs]) if self.langs else np.zeros((1, LANG_BUCKETS))
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        self.weight = np.log(share).astype(np.float32).T

    def of(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(ids) + 1, self.weight.shape[1]))
        np.cumsum(self.weight[ids[:, 0] % LANG_BUCKETS], axis=0, out=sums[1:])
        return np.argmax(sums[before[1:]] - sums[before[:-1]], axis=1)


def threshold(logit: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The middle of the cut that errs least; of several, the widest gap.
    ``logit`` ascends; the others count its texts."""
    wrong = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(clean[::-1])[::-1], [0]])
    edge = np.concatenate([[logit[0] - 2], logit, [logit[-1] + 2]])
    gap = np.diff(edge)
    best = max(np.flatnonzero(wrong == wrong.min()), key=lambda i: (gap[i], -i))
    return float((edge[best] + edge[best + 1]) / 2)


def batches(rows, size: int = BATCH):
    """Word rows, words before each text, labels and languages of ``size``
    (text, label, language) at a time; texts without a word are left out."""
    rows = iter(rows)
    while some := list(islice(rows, size)):
        raw = [r[0].encode() for r in some]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        ids, before = word_ids(np.frombuffer(b"".join(raw), np.uint8), offsets)
        full = np.flatnonzero(np.diff(before))
        if len(full):
            yield ids, np.append(before[full], len(ids)), np.array([some[i][1] for i in full]), [some[i][2] for i in full]


def count_words(rows):
    """Of one part: per language (in a tuple) the words in each bucket, and
    under () the number of clean and toxic texts."""
    spoken, texts = {}, np.zeros(2, np.int64)
    for ids, before, label, langs in batches(rows):
        texts += np.bincount(label, minlength=2)
        for lang in set(langs) - {None}:
            own = np.repeat([x == lang for x in langs], np.diff(before))
            spoken[lang] = spoken.get(lang, 0) + np.bincount(ids[own, 0] % LANG_BUCKETS, minlength=LANG_BUCKETS)
    yield (), texts
    for lang, words in spoken.items():
        yield (lang,), words


def train_part(part: int, rows, start: dict, passes: int, turn: int):
    """The changes that one part's rows make to the parameters ``start``;
    only for several passes are the rows held."""
    network, texts = Network(), 0
    network.p = {k: v.copy() for k, v in start.items()}

    def read(rows):
        nonlocal texts
        for ids, before, label, _ in batches(rows):
            texts += len(label)
            yield ids, before, label

    def several(rows):
        rng, rows = np.random.default_rng((SEED, part)), list(rows)
        for _ in range(passes):
            yield from read(rows[i] for i in rng.permutation(len(rows)))

    network.train(several(rows) if passes > 1 else read(rows), (SEED, part, turn))
    for at, change in network.changes(start, texts):
        yield at, (part, change)


def in_order(changes) -> np.ndarray:
    """The sum, in the order of the parts: the same in every run."""
    return sum(x[1].astype(np.float64) for x in sorted(changes, key=lambda x: x[0]))


def merged(*counts):
    """One (logits, toxic texts, clean texts) of several; logits ascend."""
    logit, toxic, clean = (np.concatenate(x) for x in zip(*counts))
    logit, at = np.unique(logit, return_inverse=True)
    return logit, *(np.bincount(at, x, len(logit)).astype(np.int64) for x in (toxic, clean))


def count_logits(rows, network: Network, guess: LanguageGuess):
    """Of one part: by guessed language, and under -1 for all, the toxic and
    clean texts at each step of the logit."""
    got = []
    for ids, before, label, _ in batches(rows):
        logit = np.rint(np.clip(network.logits(ids, before), -MOST_LOGIT, MOST_LOGIT) * LOGIT_STEPS)
        got.append((guess.of(ids, before), logit.astype(np.int64), label))
    if got:
        lang, logit, label = (np.concatenate(x) for x in zip(*got))
        for i in (-1, *np.unique(lang).tolist()):
            own = (lang == i) | (i < 0)
            yield i, merged((logit[own], label[own], 1 - label[own]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        label_col: str = "toxic"):
    """A fitted (network, language guess, thresholds by language).

    Network, guess and thresholds learn from every labelled text, whole. The
    rows are dealt by id into parts of at most about ``PART_ROWS`` rows (more
    beyond ``MAX_PARTS`` parts) and stay in their shuffle files. A single part
    of at most ``HELD_BYTES`` is read ``EPOCHS`` times or more in its task;
    others are read as streams, and after each of ``ROUNDS`` passes or more
    their changes are averaged, a table row's over the parts that touched it.
    Thresholds count texts at logits rounded to 1 / ``LOGIT_STEPS``. Rows
    without text or label teach nothing.
    """
    known = labels.where(col(label_col).isin(0, 1)).select(col(id_col).alias("id"), col(label_col).cast("int").alias("y")) \
        .where(F.col("id").isNotNull())
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), col(lang_col).alias("lang")) \
        .where(F.col("id").isNotNull() & (F.length("text") > 0))
    n, size = rows.select("id", F.octet_length("text").alias("size")).join(known.select("id").distinct(), "id") \
        .agg(F.count(F.lit(1)), F.sum(F.col("size").cast("long"))).first()
    parts = max(1, min(MAX_PARTS, -(-n // PART_ROWS)))
    held = parts == 1 and (size or 0) <= HELD_BYTES
    least = -(-250 * BATCH * parts // max(1, n))  # a small table is read more often
    passes, turns = (max(EPOCHS, least), 1) if held else (1, max(ROUNDS, least))
    # texts are dealt once, with their labels, as a join may choose another number of parts; later passes read the
    # shuffle's files again
    both = rows.unionByName(known, allowMissingColumns=True).repartition(parts, "id")
    dealt = both.withColumn("y", F.max("y").over(Window.partitionBy("id"))).where(F.col("text").isNotNull() & F.col("y").isNotNull()) \
        .withColumn("h", F.xxhash64("id", "text")).sortWithinPartitions("h", "lang").select("text", "y", "lang").rdd
    spoken = dict(dealt.mapPartitions(count_words).reduceByKey(lambda a, b: a + b).collect())
    clean, toxic = spoken.pop((), (0, 0))
    guess = LanguageGuess({lang[0]: words for lang, words in spoken.items()})
    network = Network()
    context = dealt.context
    for turn in range(turns):
        if not toxic:
            break
        start = context.broadcast(network.p)
        network.add(dict(dealt.mapPartitionsWithIndex(
            lambda part, rows, start=start, turn=turn: train_part(part, rows, start.value, passes, turn))
            .groupByKey(min(parts, len(blocks()))).mapValues(in_order).collect()))
        start.unpersist()
    cuts = np.zeros(max(1, len(guess.langs)))
    if clean and toxic:
        sent = context.broadcast((network, guess))
        found = dict(dealt.mapPartitions(lambda rows: count_logits(rows, *sent.value)).reduceByKey(merged)
                     .mapValues(lambda c: (threshold(c[0] / LOGIT_STEPS, *c[1:]), min(c[1].sum(), c[2].sum()))).collect())
        for i in range(len(cuts)):  # too few of the language: all texts
            cuts[i] = found[i if found.get(i, (0, 0))[1] >= 2 else -1][0]
        sent.unpersist()
    return network, guess, cuts


def score_toxicity(docs: DataFrame, model, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """The rows with ``score`` (0 to 1; the threshold of the text's language
    lies at one half) and ``predicted`` (1 if score >= ``cut``).

    Only the text is read. Null, empty or wordless text: the score of no
    filter firing, at most 0.1. Whole texts are scored. Repeated rows repeat
    their result. Input columns named like a result are replaced, others pass
    through. Empty table: empty.
    """
    network, guess, cuts = model
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("__row"))
    at = docs.columns.index(text_col)

    def scan(batches):
        for batch in batches:
            data, offsets = flat(batch.column("__row").field(at))
            score = np.zeros(batch.num_rows)
            for a, b in chunks(offsets, 1 << 19):
                ids, before = word_ids(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                logit = network.logits(ids, before) - cuts[guess.of(ids, before)]
                score[a:b] = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
                score[a:b] = np.where(np.diff(before) == 0, np.minimum(score[a:b], 0.1), score[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column("__row"), pa.array(score), pa.array((score >= cut).astype(np.int32))],
                names=["__row", "score", "predicted"])

    out = rows.mapInArrow(scan, StructType([rows.schema["__row"],
                                            *StructType.fromDDL("score double, predicted int").fields]))
    return with_results(out, docs.columns, ["score", "predicted"])


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns of the query: learned from the rows that are not held out."""
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out()), labels.where(~held_out()))
    scored = score_toxicity(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", "predicted")
