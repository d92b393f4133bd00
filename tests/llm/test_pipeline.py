"""Every stage against a brute-force version on a small table."""

import numpy as np

import corpus_pipeline
from ledgerlint.llm import decontaminate, language
from tests.conftest import SF_SMALL
from tests.llm import brute


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    one, near, sub, clean, packed = (f for _, f in corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}

    first = one(spark, docs, SF_SMALL)
    model = language.Encoders(language.fit_dictionaries(docs))
    told = {d: model.predict((r.text or "").encode()) for d, r in rows.items()}
    want = {d for d, (lang, score) in told.items() if lang != "und" and score >= corpus_pipeline.MIN_MARGIN}
    assert first.columns == columns and {r.doc_id for r in first.collect()} == want

    second = near(spark, docs, SF_SMALL)
    parts = brute.jaccard_components([(d, r.text) for d, r in rows.items()], 5, 80)
    assert second.columns == columns and sorted(r.doc_id for r in second.collect()) == sorted(
        d for d, n, c in parts if n == 0 or d == c)

    third = {r.doc_id: r for r in sub(spark, docs, SF_SMALL).collect()}
    for d, n, gone, _ in brute.substring_dedup([(d, r.text) for d, r in rows.items()], corpus_pipeline.MIN_REPEAT_WORDS):
        assert len(brute.words(third[d].text)) == n - gone
        assert gone or third[d] == rows[d]
        assert third[d].n_chars == len(third[d].text)

    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()

    def tokens(text):
        import pyarrow as pa
        return decontaminate.tokens(pa.array([text]))[0]

    items = [tokens(b.text) for b in bench]

    def leaks(text):
        own = tokens(text or "")
        return any(len(i) and sum(t[2] for t in decontaminate.tile(i, own, 5)) >= 0.5 * len(i) for i in items)

    some = [d for d in sorted(rows) if len(rows[d].text or "") < 1500][:60]
    fourth = {r.doc_id for r in clean(spark, docs, SF_SMALL).collect()}
    assert all((d in fourth) != leaks(rows[d].text) for d in some)

    pieces = packed(spark, docs, SF_SMALL).collect()
    assert {p.doc_id for p in pieces} == set(rows)
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    starts = np.sort([p.sequence_id * 2048 + p.offset for p in pieces])
    assert starts[0] == 0 and len(set(starts)) == len(pieces)


def test_run_and_names(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "substring_dedup", "decontamination", "packing"]
    assert corpus_pipeline.run(spark, SF_SMALL).count() > 0
