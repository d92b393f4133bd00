"""Run detection, SentencePiece and tokenizer alignment against plain
versions and the libraries, and on the inputs they must define."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlint.llm import alignment, pieces, queries, runs
from ledgerlint.llm.packing import byte_letters
from ledgerlint.llm.perfect_hash import PerfectHash
from tests.conftest import SF_SMALL
from tests.llm import brute_text as plain

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    some = ["a b " * 9, "x", None, "", " \t\n", "one two three " * 5 + "end", "é ü " * 40, "日本語 テキスト\U0001F600 " * 6,
            "a▁b", "▁", "<|endoftext|> and </s> <0x41>", "can't we'll  do   1234567\n\n\nit\t\t", "\x00 nul", " lead", "trail ",
            "w " * 20000, "x" * 5000, "=" * 300, "".join(rng.choice("abcdefgh") for _ in range(9000))]
    for _ in range(60):
        some.append(" ".join(rng.choice(["ab", "cde", "f", "ghij", "ü"]) for _ in range(rng.randint(1, 90))))
    return some + some[5:12]


def frame(spark, texts):
    rows = [(i * 7 if i % 11 else None, t, ["en", None][i % 2], "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def key(row):
    return tuple((x is not None, x) for x in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


# ------------------------------------------------------------------ runs
def test_find_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        n, k = rng.randint(1, 70), rng.choice([1, 2, 3, 8])
        w = [rng.randrange(k) for _ in range(n)]
        if rng.random() < .6:
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 4))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert [tuple(x) for x in runs.find_runs(np.array(w)).tolist()] == plain.runs(w)


@pytest.mark.parametrize("n, p", [(100_000, 1), (100_000, 3), (100_000, 25_000)])
def test_one_long_run(n, p):
    assert runs.find_runs(np.arange(n) % p).tolist() == [[0, n, p]]


def test_runs_query(spark, texts):
    for docs in (frame(spark, texts), documents(spark)):
        rows = docs.select("doc_id", "text").collect()
        same(runs.runs_digest(docs).collect(), [plain.runs_row(*r) for r in rows])
    assert any(r.n_runs for r in runs.runs_digest(documents(spark)).collect())


def test_collapsed_text_and_spans(spark):
    docs = spark.createDataFrame([(1, "k a b a b a b a b z  z"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in runs.collapse_runs(docs).collect()}
    assert got[1].collapsed == "k a b z z" and [tuple(x) for x in got[1].runs] == [(1, 8, 2)]
    assert got[2].collapsed == "" and got[2].runs == [] and got[2].n_words == 0
    with pytest.raises(ValueError):
        runs.collapse_runs(docs, exponent=3)


# ------------------------------------------------------------------ pieces
def test_merges_against_library(library):
    rng, encoder = random.Random(1), pieces.PieceEncoder(MODEL, most=500)
    singles = [p for p in encoder.model.normal]
    made = ["".join(rng.choice(singles) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    made += ["".join(rng.choice("▁ =-_*.0 aein\n") for _ in range(rng.randint(1, 90))) for _ in range(1500)]
    ids, cuts = encoder.batch(made)
    texts = encoder.decode(ids, cuts).to_pylist()
    for i, t in enumerate(made):
        want = library.encode(t)
        assert ids[cuts[i]:cuts[i + 1]].tolist() == want and texts[i] == library.decode(want)


def test_long_words_by_queue(library, monkeypatch):
    monkeypatch.setattr(pieces, "LONG_WORD", 8)
    rng, encoder = random.Random(2), pieces.PieceEncoder(MODEL)
    made = ["".join(rng.choice("aeinrst =") for _ in range(60)) for _ in range(300)]
    ids, cuts = encoder.batch(made)
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == library.encode(made)


def test_decode_of_any_ids(library):
    rng, encoder = random.Random(4), pieces.PieceEncoder(MODEL)
    rows = [[rng.randrange(300) if rng.random() < .5 else rng.randrange(32000) for _ in range(rng.randint(0, 8))] for _ in range(800)]
    cuts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = encoder.decode(np.array([i for r in rows for i in r]), cuts).to_pylist()
    assert got == [library.decode(r) for r in rows]


def test_pieces_query(spark, texts, library):
    for docs in (frame(spark, texts), documents(spark)):
        want = []
        for doc_id, text in docs.select("doc_id", "text").collect():
            ids = library.encode(text or "")
            want.append((doc_id, len(ids), plain.sha(",".join(map(str, ids))), plain.sha(library.decode(ids))))
        same(pieces.pieces_digest(docs).collect(), want)


def test_other_models_are_refused(tmp_path):
    bad = tmp_path / "m.model"
    bad.write_bytes(b"")
    with pytest.raises(ValueError):
        pieces.PieceModel(str(bad))


# ------------------------------------------------------------------ alignment
@pytest.fixture(scope="module")
def coders(library):
    whole = Tokenizer.from_file(BYTES)
    whole.encode_special_tokens = True
    back = {c: b for b, c in byte_letters().items()}
    names = [whole.id_to_token(i) for i in range(whole.get_vocab_size() - 1)]
    a_bytes = [bytes(back[c] for c in t) for t in names]

    def spell(i):
        return bytes([i - 3]) if 3 <= i < 259 else library.id_to_piece(i).replace("▁", " ").encode()

    return (lambda t: whole.encode(t, add_special_tokens=False).ids), a_bytes.__getitem__, library.encode, spell


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50000):
        keys = np.unique(rng.integers(0, 2 ** 62, n))
        index = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
        assert sorted(index.index(keys).tolist()) == list(range(len(keys)))


def test_alignment_query(spark, texts, coders):
    for docs in (frame(spark, texts), documents(spark)):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        same(alignment.alignment_digest(docs).collect(), list(plain.alignment_rows(rows, *coders)))


def test_alignment_over_many_blocks_shards_and_parts(spark, texts, coders, monkeypatch):
    for name, value in (("SHARD_PAIRS", 60), ("PART_PAIRS", 40), ("FAN_IN", 2)):
        monkeypatch.setattr(alignment, name, value)
    docs = frame(spark, texts)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    out = alignment.align_tokenizers(docs, BYTES, MODEL, block_bytes=2000)
    got = out.select("doc_id", *alignment.ALIGN_COLUMNS[:-1], F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))
    same(got.collect(), list(plain.alignment_rows(rows, *coders)))


def test_groups_text(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "a▁")], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.align_tokenizers(docs, BYTES, MODEL).collect()}
    assert got[1].groups.count(";") == got[1].n_groups - 1 and got[2].groups == "" and got[2].n_a == 0


# ------------------------------------------------------------------ defined inputs
OPERATORS = {
    "runs": (runs.collapse_runs, runs.RUN_COLUMNS),
    "pieces": (lambda d: pieces.encode_pieces(d, MODEL), pieces.PIECE_COLUMNS),
    "alignment": (lambda d: alignment.align_tokenizers(d, BYTES, MODEL), alignment.ALIGN_COLUMNS),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(spark, name):
    operator, added = OPERATORS[name]
    schema = f"{DOCS}, `a.b` string, runs long, ids string, `GROUPS` long, keys long, block string, part long"
    rows = [(None, "a b a b a b a b", None, None, None, "x", 1, "y", 2, 3, "z", 4)] * 3 + [(1, None, *[None] * 10), (1, "", *[None] * 10)]
    out = operator(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 5 and len({tuple(map(str, r)) for r in out if r.doc_id is None}) == 1
    assert {"a.b", *added} <= set(out[0].asDict())
    assert [c for c in out[0].asDict() if c.lower() in added] == added
    empty = operator(spark.createDataFrame([], schema))
    assert empty.collect() == [] and set(added) <= set(empty.columns)


@pytest.mark.parametrize("query", ["op11_runs", "op12_sentencepiece", "op13_alignment"])
def test_registered_queries(spark, query):
    out = queries.queries()[query](spark, SF_SMALL)
    assert out.count() == documents(spark).count()
