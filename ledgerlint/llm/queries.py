"""The operators' queries over the driver tables: (spark, sf_dir) -> rows."""

from __future__ import annotations

from ledgerlint.llm.alignment import alignment_digest
from ledgerlint.llm.decontaminate import decontamination_digest
from ledgerlint.llm.jaccard_join import jaccard_digest
from ledgerlint.llm.language import language_digest
from ledgerlint.llm.line_rules import line_rules_digest
from ledgerlint.llm.packing import packing_digest
from ledgerlint.llm.pieces import pieces_digest
from ledgerlint.llm.runs import runs_digest
from ledgerlint.llm.substring_dedup import substring_dedup_digest
from ledgerlint.llm.suffix_dedup import suffix_dedup_digest
from ledgerlint.llm.toxicity import toxicity_digest
from ledgerlint.llm.url_filter import url_filter_digest
from ledgerlint.llm.warc import warc_digest


def _on(digest, *tables):
    def run(spark, sf_dir):
        return digest(*(spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in tables))
    run.__name__ = digest.__name__
    return run


def queries() -> dict:
    return {
        "op1_substring_dedup": _on(substring_dedup_digest, "documents"),
        "op2_line_frequency": _on(line_rules_digest, "documents"),
        "op3_language": _on(language_digest, "documents"),
        "op4_jaccard_join": _on(jaccard_digest, "documents"),
        "op5_url_filter": _on(url_filter_digest, "pages"),
        "op6_decontamination": _on(decontamination_digest, "documents", "benchmark"),
        "op7_toxicity": _on(toxicity_digest, "documents", "labels"),
        "op8_suffix_dedup": _on(suffix_dedup_digest, "documents"),
        "op9_packing": _on(packing_digest, "documents"),
        "op10_warc": _on(warc_digest, "pages"),
        "op11_runs": _on(runs_digest, "documents"),
        "op12_sentencepiece": _on(pieces_digest, "documents"),
        "op13_alignment": _on(alignment_digest, "documents"),
    }
