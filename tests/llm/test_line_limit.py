"""A line's verdict depends on the documents that hold it, not on its host's size."""

from pyspark.sql import functions as F

from ledgerlint.llm import line_rules


def test_line_of_a_fixed_count_on_a_small_and_a_large_host(spark):
    footer = "the same footer of six words"
    many, few = {}, {}
    for host, docs in (("small", 60), ("large", 6_000)):
        rows = spark.range(docs).select(
            F.col("id").alias("doc_id"), F.concat(
                F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(
                    F.chr(F.lit(97) + F.col("id") % 26), F.chr(F.lit(97) + F.floor(F.col("id") / 26).cast("long") % 26),
                    F.chr(F.lit(97) + F.floor(F.col("id") / 676).cast("long")), F.chr(F.lit(97) + i % 26),
                    F.chr(F.lit(97) + F.floor(i / 26).cast("long")))), " "),
                F.when(F.col("id") < 11, F.lit(f"\n{footer}")).otherwise(""),
                F.when(F.col("id") < 10, F.lit("\nanother line")).otherwise("")).alias("text"), F.lit(host).alias("source"))
        got = line_rules.line_rules_digest(rows).where("n_frequent_words > 0").select("doc_id", "n_frequent_words", "kept").collect()
        (many if host == "large" else few).update({r.doc_id: (r.n_frequent_words, r.kept) for r in got})
    assert many == few == {i: (6, True) for i in range(11)}
