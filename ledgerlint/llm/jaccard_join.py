"""N-gram Jaccard join and its components.

A document's set holds its distinct word n-grams. Equal sets collapse to one
class. Each class is indexed by a prefix of its n-grams, rarest first: two
sets as similar as asked share an n-gram of their prefixes. Pairs found on a
shared prefix n-gram pass the length, positional and suffix filters and are
verified once each.

Only links between different components change the result, so pairs come in
rounds. In a round every prefix n-gram names one class as its centre (the
smallest by a hash that changes by round) and the other classes under it,
unless already linked with it, are compared with the centre: as many pairs as
rows, however large a group. What then still shares an n-gram across
components is compared in full: no candidate is capped or dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlint.llm.common import NULL_ID, drop, row_keys, with_results, written
from ledgerlint.llm.components import merged_labels
from ledgerlint.llm.words import SliceHash, chunks, flat, lower_ascii, mix, word_hashes

SKETCH = 1 << 16
ROUNDS = 3
#: 64-bit words of a set's bitmap: bit b says whether the number of its n-grams that fall on b is odd.
BITMAP = 16
BITS = [f"s{i}" for i in range(BITMAP)]


def shingles(data: np.ndarray, offsets: np.ndarray, n: int, rank: np.ndarray | None = None):
    """Distinct n-gram hashes of each row, in order of (rank, hash): hashes
    and n+1 bounds. Fewer words than n: the whole sequence as one."""
    _, _, before, codes = word_hashes(lower_ascii(data), offsets)
    sizes = np.diff(before)
    counts = np.where(sizes > 0, np.maximum(sizes - n + 1, 1), 0)
    row = np.repeat(np.arange(len(sizes)), counts)
    start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + before[:-1][row]
    marks = SliceHash(codes).of(start, np.minimum(start + n, before[1:][row])) if len(row) else np.zeros(0, np.uint64)
    keys = (marks, row) if rank is None else (marks, rank[marks >> np.uint64(48)], row)
    order = np.lexsort(keys)
    marks, row = marks[order], row[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (marks[1:] != marks[:-1]) | (row[1:] != row[:-1])
    marks, row = marks[new], row[new]
    return marks, np.searchsorted(row, np.arange(len(sizes) + 1))


def sketch(texts: DataFrame, n: int) -> np.ndarray:
    """Documents per bucket of n-grams (by 16 bits of their hash): a frequent
    n-gram lifts its bucket above the even rest. Fixed in size."""
    def count(batches):
        total = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                marks, _ = shingles(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], n)
                total += np.bincount((marks >> np.uint64(48)).astype(np.int64), minlength=SKETCH)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "k"])

    counts = texts.mapInArrow(count, "bucket int, k long").groupBy("bucket").agg(F.sum("k").alias("k"))
    rank = np.zeros(SKETCH, dtype=np.int64)
    for r in counts.toLocalIterator():
        rank[r["bucket"]] = r["k"]
    return rank


def need(size, other, percent: int):
    """Smallest intersection of sets of these sizes that links them."""
    return -(-percent * (size + other) // (100 + percent))


def prefixes(keyed: DataFrame, n: int, percent: int, rank: np.ndarray) -> DataFrame:
    """One row per document: size, hash ``h`` and bitmap of its set and the
    n-grams of its prefix, rarest first."""
    def scan(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets, rows=1 << 11):
                marks, bounds = shingles(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], n, rank)
                size = np.diff(bounds)
                bit = np.repeat(np.arange(b - a), size) * (64 * BITMAP) + (marks % np.uint64(64 * BITMAP)).astype(np.int64)
                odd = (np.bincount(bit, minlength=(b - a) * 64 * BITMAP) & 1).astype(np.uint8)
                maps = np.packbits(odd).view(np.int64).reshape(b - a, BITMAP)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(marks ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
                h = mix(sums[bounds[1:]] - sums[bounds[:-1]] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                width = np.where(size > 0, size - (-(-percent * size // 100)) + 1, 0)
                cut = np.cumsum(width) - width
                inner = np.arange(int(width.sum())) - np.repeat(cut, width) + np.repeat(bounds[:-1], width)
                lists = pa.ListArray.from_arrays(pa.array(np.append(cut, width.sum()).astype(np.int32)),
                                                 pa.array(marks[inner].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("did").slice(a, b - a), batch.column("th").slice(a, b - a), pa.array(size.astype(np.int32)),
                     pa.array(h.view(np.int64)), lists, *(pa.array(np.ascontiguousarray(m)) for m in maps.T)],
                    names=["did", "th", "size", "h", "prefix", *BITS])

    return keyed.select("did", "th", "text").mapInArrow(
        scan, "did long, th long, size int, h long, prefix array<long>, " + ", ".join(f"{s} long" for s in BITS))


def sides(classes: DataFrame, name: str) -> DataFrame:
    return classes.select(*[F.col(c).alias(name + c) for c in ("h", "size", *BITS)])


def near_enough(percent: int) -> str:
    """The bitmaps of classes x and y differ in no more bits than the sets of
    a linked pair can differ in n-grams: a bound on what the whole sets share."""
    differ = " + ".join(f"bit_count(x{s} ^ y{s})" for s in BITS)
    return f"({differ}) * {100 + percent} <= {100 - percent} * (xsize + ysize)"


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose sets are as similar as asked: by their
    bitmaps first, then by the suffix filter and the texts."""
    left = texts.select(F.col("h").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("h").alias("b"), F.col("text").alias("tb"))
    pairs = pairs.join(sides(classes, "x"), F.col("a") == F.col("xh")).join(sides(classes, "y"), F.col("b") == F.col("yh")) \
        .where(near_enough(percent)).select("a", "b")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def check(batches):
        for batch in batches:
            two = [flat(batch.column(c)) for c in ("ta", "tb")]
            for x, y in chunks(two[0][1] + two[1][1]):
                (p, pb), (q, qb) = (shingles(d[o[x]:o[y]], o[x:y + 1] - o[x], n) for d, o in two)
                keep = np.zeros(y - x, dtype=bool)
                for i in range(y - x):
                    s, t = p[pb[i]:pb[i + 1]], q[qb[i]:qb[i + 1]]
                    least = need(len(s), len(t), percent)
                    if min(len(s), len(t)) >= least and suffix_bound(s, t) >= least:
                        keep[i] = len(np.intersect1d(s, t, assume_unique=True)) >= least
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(x, y - x).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def suffix_bound(s: np.ndarray, t: np.ndarray, parts: int = 16) -> int:
    """Upper bound of the intersection of two sorted sets: split both by
    value and add the smaller part of each."""
    cuts = (np.arange(1, parts, dtype=np.uint64) * np.uint64(2 ** 64 // parts))
    x = np.diff(np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]]))
    y = np.diff(np.concatenate([[0], np.searchsorted(t, cuts), [len(t)]]))
    return int(np.minimum(x, y).sum())


def component_keys(keyed: DataFrame, n: int, percent: int, made: list) -> DataFrame:
    """One row per document with words (``did``, ``th``; rows repeated whole
    give one): ``size`` of its set, ``root`` of its component and ``copies``,
    the rows it stands for. ``made`` gets the scratch tables behind it."""
    rank = sketch(keyed.select("text"), n)
    rows = written(prefixes(keyed, n, percent, rank), "jaccard-prefixes", made)
    full = rows.where("size > 0")

    # classes under each prefix n-gram; copies collapse before the shuffle
    grams = full.select("h", "size", F.posexplode("prefix").alias("pos", "g"))
    several = grams.groupBy("g").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("g")
    shared = grams.join(several, "g", "left_semi").groupBy("g", "h", "size", "pos").agg(F.lit(1).alias("one")).drop("one")
    shared = written(shared, "jaccard-shared", made)
    place = full.join(shared.select("h").distinct(), "h", "left_semi") \
        .groupBy("h", "size", *BITS).agg(F.min(F.struct("did", "th")).alias("p"))
    classes = written(place.select("h", "size", *BITS, "p.did", "p.th"), "jaccard-classes", made)
    texts = written(keyed.select("did", "th", "text").join(classes.select("did", "th", "h"), ["did", "th"])
                    .select("h", "text").dropDuplicates(["h"]), "jaccard-texts", made)

    labels = tested = None
    for k in range(ROUNDS):
        pairs = centre_pairs(shared, k, percent, labels)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "jaccard-pairs", made)
        found = written(verified(pairs, classes, texts, n, percent), "jaccard-links", made)
        labels = merged_labels(labels, found, made)
        tested = pairs if tested is None else tested.unionByName(pairs)
    rest = written(across(shared, classes, labels, percent, made).join(tested, ["a", "b"], "left_anti"), "jaccard-pairs", made)
    labels = merged_labels(labels, written(verified(rest, classes, texts, n, percent), "jaccard-links", made), made)

    root = full.sparkSession.createDataFrame([], "h long, root long") if labels is None else \
        labels.select(F.col("a").alias("h"), F.col("b").alias("root"))
    return full.groupBy("did", "th", "size", "h").agg(F.count(F.lit(1)).alias("copies")).join(root, "h", "left") \
        .select("did", "th", "size", F.coalesce("root", "h").alias("root"), "copies")


def ngram_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """The documents with ``n_shingles`` (set size), ``component_id``
    (smallest id reachable by links) and ``component_rows``.

    Two documents link if 100 * |A and B| >= percent * |A or B|. Words are
    runs of bytes other than blanks, A-Z lower-cased.

    Null or empty text: an empty set, linked with nothing (its own id, one
    row). A null id counts as smaller than any, and a component that holds
    one has a null id. Rows repeated whole share a component. Input columns
    named like a result are replaced, others pass through. Empty table: empty.
    """
    keyed = row_keys(docs, id_col, text_col)
    made = []
    keys = written(component_keys(keyed, n, percent, made), "jaccard-components")
    drop(docs.sparkSession, made)
    low = keys.groupBy("root").agg(F.min("did").alias("low"), F.sum("copies").alias("component_rows"))
    result = keys.join(low, "root").groupBy("did", "th") \
        .agg(F.max("size").cast("long").alias("n"), F.min("low").alias("low"), F.max("component_rows").alias("rows"))
    out = keyed.select("__row", "did", "th").join(result, ["did", "th"], "left")
    own = F.coalesce(F.col("low"), F.col("did"))
    out = out.withColumn("n_shingles", F.coalesce(F.col("n"), F.lit(0).cast("long"))) \
        .withColumn("component_id", F.when(own != NULL_ID, own)) \
        .withColumn("component_rows", F.coalesce(F.col("rows"), F.lit(1).cast("long")))
    return with_results(out, docs.columns, ["n_shingles", "component_id", "component_rows"])


def one_of_each(docs: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of each component the row of the
    smallest id stays (of rows that repeat an id, the first by the text's
    hash; of rows repeated whole, one). Documents without words all stay."""
    keyed = row_keys(docs, id_col, text_col)
    made = []
    keys = written(component_keys(keyed, n, percent, made), "jaccard-components")
    drop(docs.sparkSession, made)
    first = keys.groupBy("root").agg(F.min(F.struct("did", "th")).alias("f"))
    mark = keys.join(first, "root").withColumn("stays", F.struct("did", "th") == F.col("f")) \
        .groupBy("did", "th").agg(F.max("stays").alias("stays"), F.max("copies").alias("copies")) \
        .where("not stays or copies > 1")
    told = keyed.select("__row", "did", "th").join(mark, ["did", "th"], "left")
    once = told.where("stays").dropDuplicates(["did", "th"])
    kept = told.where("stays is null").select("__row").unionByName(once.select("__row"))
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


def centre_pairs(shared: DataFrame, k: int, percent: int, roots: DataFrame | None) -> DataFrame:
    """Each class with the centre of each of its prefix n-grams, unless they
    are linked already or differ too much in size."""
    rows = with_roots(shared, roots)
    centre = rows.groupBy("g").agg(F.min_by(F.struct("h", "size", "root"), F.xxhash64("h", F.lit(k))).alias("c"),
                                   F.min("root").alias("lo"), F.max("root").alias("hi")) \
        .where("lo <> hi").select("g", F.col("c.h").alias("ch"), F.col("c.size").alias("cs"), F.col("c.root").alias("cr"))
    met = rows.join(centre, "g").where("root <> cr") \
        .where(f"least(size, cs) * 100 >= greatest(size, cs) * {percent}")
    return met.select(F.greatest("h", "ch").alias("a"), F.least("h", "ch").alias("b")).distinct()


def with_roots(shared: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return shared.withColumn("root", F.col("h"))
    return shared.join(roots.select(F.col("a").alias("h"), F.col("b").alias("root")), "h", "left") \
        .withColumn("root", F.coalesce("root", "h"))


def across(shared: DataFrame, classes: DataFrame, roots: DataFrame | None, percent: int, made: list) -> DataFrame:
    """All pairs of classes of different components that share an n-gram of
    their prefixes and pass the length, positional and bitmap filters.

    The smaller set (ties: smaller hash) needs only its shorter prefix. The
    first shared n-gram of a linked pair passes the positional filter: what
    follows it in both sets must suffice.
    """
    rows = with_roots(shared, roots)
    mixed = rows.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("g")
    rows = written(rows.join(mixed, "g", "left_semi").join(classes.select("h", *BITS), "h"), "jaccard-across", made)
    x, y = (rows.select("g", *[F.col(c).alias(n + c) for c in ("h", "size", "pos", "root", *BITS)]) for n in "xy")
    least = f"ceil({percent} * (xsize + ysize) / {100 + percent})"
    met = x.join(y, "g").where("xroot <> yroot and (xsize < ysize or xsize = ysize and xh < yh)") \
        .where(f"xsize * 100 >= ysize * {percent}") \
        .where(f"xpos <= xsize - ceil({2 * percent} * xsize / {100 + percent})") \
        .where(f"least(xsize - xpos, ysize - ypos) >= {least}") \
        .where(near_enough(percent))
    return met.select(F.greatest("xh", "yh").alias("a"), F.least("xh", "yh").alias("b")).distinct()


def jaccard_digest(docs: DataFrame) -> DataFrame:
    """Columns of the query."""
    return ngram_components(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
