"""Rows of one key: thousands of texts under the null id and under one id, and
rows repeated whole."""

import numpy as np
import pytest

from ledgerlint.llm import common, decontaminate, jaccard_join, repeats, substring_dedup, suffix_dedup

N = 1500
PASSAGE = 25


def words(rng, n):
    return [f"w{x:011d}" for x in rng.integers(0, 10 ** 11, n)]


@pytest.fixture(scope="module")
def crowd(spark):
    """2 * N texts, half of them under null and half under 7; each holds a
    passage twice around 1 to 40 words of its own."""
    rng = np.random.default_rng(12)
    rows, between = [], {}
    for i in range(2 * N):
        p, f = words(rng, PASSAGE), words(rng, 1 + i % 40)
        text = " ".join(p + f + p)
        rows.append((None if i % 2 else 7, text))
        between[text] = (" ".join(p + f), " " + " ".join(f) + " ")
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache(), between


def test_repeated_words_of_own_text(crowd):
    docs, between = crowd
    got = substring_dedup.remove_repeated_words(docs).collect()
    assert len(got) == 2 * N
    assert all(r.n_removed == PASSAGE and r.kept_text == between[r.text][0] for r in got)


def test_repeated_bytes_of_own_text(crowd):
    docs, between = crowd
    got = suffix_dedup.remove_repeated_bytes(docs).collect()
    assert len(got) == 2 * N
    assert all(r.n_spans == 2 and bytes(r.kept_bytes).decode() == between[r.text][1] for r in got)


def test_near_copies_under_one_id(spark):
    rng = np.random.default_rng(13)
    rows = []
    for i in range(N):
        p = words(rng, 40)
        rows += [(None if i % 2 else 7, " ".join(p)), (None if i % 2 else 7, " ".join(p[:-1] + ["changed"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    kept = jaccard_join.one_of_each(docs, 5, 80).collect()
    assert len(kept) == N and len({r.text[:300] for r in kept}) == N
    got = jaccard_join.ngram_components(docs, 5, 80).collect()
    assert len(got) == 2 * N and {r.component_rows for r in got} == {2}
    assert all(r.component_id == r.doc_id for r in got)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_clean_texts_under_one_id_stay(spark, broadcast_bytes):
    rng = np.random.default_rng(14)
    item = " ".join(words(rng, 12))
    rows = [(None if i % 2 else 7, " ".join(words(rng, 10)) + (f" {item}" if i % 10 < 2 else "")) for i in range(2 * N)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.decontaminated(docs, bench, broadcast_bytes=broadcast_bytes).collect()
    assert sorted(r.text for r in kept) == sorted(t for _, t in rows if item not in t)


@pytest.mark.parametrize("by_word", [True, False])
def test_rows_repeated_whole_give_a_place_once(spark, by_word):
    rng = np.random.default_rng(15)
    p = words(rng, 60)
    rows = [(1, " ".join(p + words(rng, 9)))] * 400 + [(2, " ".join(words(rng, 5) + p))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = common.row_keys(docs, "doc_id", "text")
    length, gram = (20, 6) if by_word else (200, 32)
    found = repeats.candidates(keyed, length, gram, by_word)
    places = found.select("did", "th", "at", "n").distinct().groupBy("did").count().collect()
    pieces = repeats.segment_blocks(keyed, repeats.first_places(found), length, by_word)
    assert pieces.count() <= 4 * sum(r["count"] for r in places)
    judge = substring_dedup.judge_words if by_word else suffix_dedup.judge_bytes
    judged = pieces.mapInArrow(lambda b: judge(b, length), repeats.JUDGED_DDL)
    cuts = {r.did: len(r.cuts) for r in repeats.removals(found, judged).collect()}
    assert cuts.keys() == {1, 2} and all(cuts[r.did] <= 2 * r["count"] for r in places)
    if by_word:
        got = {(r.doc_id, r.n_removed) for r in substring_dedup.remove_repeated_words(docs).collect()}
        assert got == {(1, 0), (2, 60)}
    else:
        got = suffix_dedup.remove_repeated_bytes(docs).collect()
        assert len(got) == 401 and all(r.n_removed == r.n_bytes for r in got if r.doc_id == 1)


def test_labels_grow_with_links(spark):
    """Links in several rounds give the components of all links at once."""
    import random

    from ledgerlint.llm.components import components, merged_labels
    rng = random.Random(13)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    rounds = [links[i::4] for i in range(4)]
    labels, made = None, []
    for part in [*rounds[:2], [], *rounds[2:]]:
        labels = merged_labels(labels, spark.createDataFrame(part, "a long, b long"), made)
    whole = components(spark.createDataFrame(links, "a long, b long"), [])
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, whole.collect()))
    assert merged_labels(None, spark.createDataFrame([], "a long, b long"), []) is None
