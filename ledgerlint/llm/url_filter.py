"""URL filters: a weighted vocabulary behind a list of host and path rules.

Rules decide first. Any other URL is judged by an Aho-Corasick automaton
over strict and soft terms: hits must stand between characters that are no
letters or digits; one strict term or several distinct soft terms block.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlint.llm.common import col, with_results

STRICT_TERMS = ("adult", "porn", "xxx", "nsfw", "casino", "escort", "warez", "malware")
SOFT_TERMS = ("ads", "track", "tracker", "click", "banner", "popup", "promo", "sponsor", "affiliate", "redirect",
              "bet", "poker", "torrent", "crack", "keygen", "pills")
MIN_SOFT = 2
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path; empty without ``://`` or for null."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    out = F.lit(None).cast("string")
    for rule in reversed(longest):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def term_hits(strict: tuple, soft: tuple):
    """A task function: counts of distinct strict and soft terms of urls."""
    def count(batches):
        machine = ahocorasick.Automaton()
        for kind, terms in (("strict", strict), ("soft", soft)):
            for t in terms:
                machine.add_word(t, (kind, t))
        if len(machine):
            machine.make_automaton()
        for batch in batches:
            n_strict, n_soft = [], []
            for url in batch.column("__lower").to_pylist():
                seen = {"strict": set(), "soft": set()}
                for end, (kind, t) in machine.iter(url) if url and len(machine) else ():
                    start = end - len(t) + 1
                    if (start == 0 or url[start - 1] not in WORD_CHARACTERS) and (
                            end + 1 == len(url) or url[end + 1] not in WORD_CHARACTERS):
                        seen[kind].add(t)
                n_strict.append(len(seen["strict"]))
                n_soft.append(len(seen["soft"]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("__row", "host", "path")), pa.array(n_strict, pa.int32()),
                 pa.array(n_soft, pa.int32())], names=["__row", "host", "path", "n_strict", "n_soft"])
    return count


RESULTS = ["host", "path", "rule", "n_strict", "n_soft", "verdict"]


def filter_urls(pages: DataFrame, url_col: str = "url", rules=RULES, strict: tuple = STRICT_TERMS,
                soft: tuple = SOFT_TERMS, min_soft: int = MIN_SOFT) -> DataFrame:
    """The rows with ``host``, ``path``, ``rule``, term counts and
    ``verdict`` (allow or block).

    Terms are looked for in the whole url, A-Z lower-cased. Null or empty url:
    empty host and path, no rule, allowed. Rows are judged one by one, so
    repeated rows repeat their result. Input columns named like a result are
    replaced, others pass through. Empty table: empty.
    """
    from pyspark.sql.types import StructType
    rows = pages.select(F.struct(*[col(c) for c in pages.columns]).alias("__row"), col(url_col).alias("__url"))
    host, path = host_and_path(F.col("__url"))
    parts = rows.select("__row", host.alias("host"), path.alias("path"),
                        F.translate("__url", UPPER, LOWER).alias("__lower"))
    schema = StructType([parts.schema["__row"],
                         *StructType.fromDDL("host string, path string, n_strict int, n_soft int").fields])
    counted = parts.mapInArrow(term_hits(tuple(strict), tuple(soft)), schema)
    h, p = F.col("host"), F.col("path")
    by_terms = F.when((F.col("n_strict") >= 1) | (F.col("n_soft") >= min_soft), "block").otherwise("allow")
    out = counted.withColumn("rule", rule_for(h, p, rules, lambda r: r[1] + r[2])) \
        .withColumn("verdict", F.coalesce(rule_for(h, p, rules, lambda r: r[0]), by_terms))
    return with_results(out, pages.columns, RESULTS)


def url_filter_digest(pages: DataFrame) -> DataFrame:
    """Columns of the query."""
    return filter_urls(pages.select("page_id", "url")).select("page_id", *RESULTS)
