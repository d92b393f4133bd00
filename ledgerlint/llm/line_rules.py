"""Quality rules: cross-document line frequency, in DataFrame functions only.

Base rules look at one document; the line rule looks across a host: lines
are normalised and hashed, each line's distinct documents are counted per
host, lines above the limit are removed, and a document of which more
than half the words go is rejected as depleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlint.llm.common import NULL_ID, WORD_GAP, col, written

SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \u0009\u000a\u000b\u000c\u000d"
HAS_WORD = r"[^\x20\x09-\x0D]"


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP, -1), lambda w: w != "")


def normal_line(line: Column) -> Column:
    """A line as it is compared: lower case, digits as 0, single blanks."""
    plain = F.translate(line, UPPER + "123456789", LOWER + "0" * 9)
    return F.array_join(word_list(plain), " ")


def base_features(rows: DataFrame, text: Column) -> DataFrame:
    """``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and
    ``n_repeat_words`` of ``text`` beside all columns of ``rows``.

    Repeated three-word windows are found inside the row: window hashes are
    sorted with their places, equal neighbours are repeats, and the places
    of repeats, sorted again, give the words they cover.
    """
    text, own = F.coalesce(text, F.lit("")), rows.columns
    first = rows.select(*own, text.alias("__text"), word_list(text).alias("__w"),
                        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(HAS_WORD)).alias("__lines"))
    w, n = F.col("__w"), F.size("__w")
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    second = first.select(
        *own, F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.array_sort(windows)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("__s"))
    s = F.col("__s")
    h = lambda j: F.get(s, j).getField("h")
    again = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce(h(j) == h(j - 1), F.lit(False))
                     | F.coalesce(h(j) == h(j + 1), F.lit(False)))
    third = second.select(
        *own, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.size(s) > 0, F.array_sort(F.transform(again, lambda j: F.get(s, j).getField("i"))))
         .otherwise(F.array().cast("array<int>")).alias("__p"))
    p = F.col("__p")
    cover = F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"),
                        lambda acc, j: acc + F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - F.get(p, j), F.lit(3))))
    return third.withColumn("n_repeat_words", F.when(F.size(p) > 0, cover).otherwise(F.lit(0).cast("long"))).drop("__p")


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
           "n_frequent_words", "kept"]
CLEAN = "clean_text"


def line_frequency_rules(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
                         min_words: int = 50, max_repeat_percent: int = 50, max_line_docs: int = 10,
                         max_removed_percent: int = 50) -> DataFrame:
    """The documents with their base features, ``base_failed``,
    ``n_frequent_words`` (words in lines above the limit), ``kept`` and
    ``clean_text``, the text without those lines (its other lines unchanged).

    A line is above the limit if more than ``max_line_docs`` documents of its
    host hold it, however many the host has: a verdict on a line never turns
    as the host grows. Counts cover all documents.

    Null or empty text: no words, fails the base rules. A null host is a host
    of its own, a null id an id like any other. Rows repeated whole count as
    one document of the host and share its result. Input columns named like a
    result are replaced, others pass through. Empty table: empty.
    """
    at = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[col(c).alias(n) for c, n in at.items()])
    text, host = F.col(at[text_col]), F.col(at[host_col])
    rows = rows.select("*", F.coalesce(F.col(at[id_col]).cast("long"), F.lit(NULL_ID)).alias("__did"),
                       F.xxhash64(text).alias("__th"), F.xxhash64(F.isnull(host), host).alias("__host"))
    keys = ["__did", "__th", "__host"]
    featured = base_features(rows, text)  # the text goes along only if ``clean_text`` is asked for

    lines = rows.select(*keys, F.explode(F.filter(
        F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(HAS_WORD))).alias("__line"))
    lines = lines.select("__did", "__th", "__host", normal_line(F.col("__line")).alias("__norm"))
    held = (lines.select("__did", "__th", "__host", F.xxhash64("__norm").alias("__h"),
                         F.size(F.split("__norm", " ", -1)).alias("__n"))
            .groupBy("__host", "__h", "__did", "__th").agg(F.sum("__n").alias("__n")))
    held = written(held, "line-frequency")
    often = (held.groupBy("__host", "__h").agg(F.count(F.lit(1)).alias("__k")).where(F.col("__k") > max_line_docs)
             .select("__host", "__h"))
    # repeated rows give each line as often as they are repeated: shares of words are exact all the same
    cut = (held.join(often.withColumn("__often", F.lit(1)), ["__host", "__h"], "left")
           .groupBy("__host", "__did", "__th")
           .agg(F.sum(F.when(F.col("__often") == 1, F.col("__n")).otherwise(0)).alias("__cut"),
                F.sum("__n").alias("__all"), F.collect_set(F.when(F.col("__often") == 1, F.col("__h"))).alias("__gone"))
           .where(F.col("__cut") > 0))
    out = featured.join(cut, ["__host", "__did", "__th"], "left")
    frequent = F.coalesce(F.floor(F.col("n_words") * F.col("__cut") / F.col("__all")).cast("long"), F.lit(0).cast("long"))
    out = out.withColumn("n_frequent_words", frequent)
    failed = ((F.col("n_words") < min_words)
              | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat_percent) * F.col("n_words")))
    depleted = F.lit(100) * F.col("n_frequent_words") > F.lit(max_removed_percent) * F.col("n_words")
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)
    stays = F.filter(F.split(text, "\n", -1), lambda x: ~(x.rlike(HAS_WORD) & F.array_contains("__gone", F.xxhash64(normal_line(x)))))
    out = out.withColumn(CLEAN, F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(stays, "\n")))
    taken = {*RESULTS, CLEAN}
    return out.select(*[F.col(n).alias(c) for c, n in at.items() if c.lower() not in taken], *RESULTS, CLEAN)


def line_rules_digest(docs: DataFrame) -> DataFrame:
    """Columns of the query."""
    return line_frequency_rules(docs.select("doc_id", "source", "text")).select("doc_id", *RESULTS)
