"""The corpus pipeline: five stages, each over all that the last one kept.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's documents. All but the last return the columns
of documents. Stages handle the inputs their operators define: null or empty
texts, nulls in other columns, repeated rows, empty tables; further columns
pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlint.llm.common import col, written
from ledgerlint.llm.decontaminate import decontaminated
from ledgerlint.llm.jaccard_join import one_of_each
from ledgerlint.llm.language import fit_dictionaries, identify
from ledgerlint.llm.packing import default_tokenizer, pack
from ledgerlint.llm.substring_dedup import remove_repeated_words

MIN_MARGIN = 0.01
NEAR_WORDS, NEAR_PERCENT = 5, 80
MIN_REPEAT_WORDS = 40


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents under names that no operator uses, and those names."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[col(c).alias(n) for c, n in names.items()]), names


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected: no letter at all, or
    the best dictionary saves less than ``MIN_MARGIN`` over the next."""
    rows, name = plain(docs)
    kept = identify(rows, fit_dictionaries(docs), name["text"], MIN_MARGIN).where(~F.col("rejected"))
    return kept.select(*[F.col(n).alias(c) for c, n in name.items()])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (see ``one_of_each``)."""
    return one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ``MIN_REPEAT_WORDS`` words or more that stand earlier in
    the corpus are cut out of the text; ``n_chars`` follows the new text.
    Documents that lose nothing keep their text as it is."""
    rows, name = plain(docs)
    out = remove_repeated_words(rows, MIN_REPEAT_WORDS, name["doc_id"], name["text"])
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col(name["text"]))}
    if "n_chars" in name:
        new["n_chars"] = F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col(name["n_chars"]))
    return out.select(*[new.get(c, F.col(n)).alias(c) for c, n in name.items()])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no benchmark item away."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the packed sequences with their ids."""
    return pack(docs.select("doc_id", "text"), default_tokenizer())


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Compression and tokenisation are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
