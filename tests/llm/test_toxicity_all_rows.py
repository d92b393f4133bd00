"""The toxicity model learns from every labelled text: words of languages, parts of the network, thresholds."""

import numpy as np

from ledgerlint.llm import toxicity


def brute(texts, network, guess):
    raw = [t.encode() for t in texts]
    ids, before = toxicity.word_ids(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    return ids, before, network.logits(ids, before), guess.of(ids, before)


def test_every_labelled_text_counts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PART_ROWS", 200)  # several parts
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice([f"{lang}{j}" for j in range(40)], 12)) + (" vile" if i % 5 == 0 else ""), lang, int(i % 5 == 0))
            for i, lang in enumerate(["aa"] * 420 + ["bb"] * 380)]
    frame = spark.createDataFrame([*rows, (900, None, "aa", 1), (901, "...", "aa", 1), (None, "aa1", "aa", 1), (903, "aa1", "aa", None)],
                                  "doc_id long, text string, lang string, toxic int").repartition(3)
    network, guess, cuts = toxicity.fit(frame, frame)
    ids, before, logit, lang = brute([r[1] for r in rows], network, guess)
    label = np.array([r[3] for r in rows])
    own = np.repeat([r[2] for r in rows], np.diff(before))
    assert guess.langs == ["aa", "bb"]
    words = {x: np.bincount(ids[own == x, 0] % toxicity.LANG_BUCKETS, minlength=toxicity.LANG_BUCKETS) for x in guess.langs}
    assert np.array_equal(guess.weight, toxicity.LanguageGuess(words).weight)
    steps = np.rint(logit * toxicity.LOGIT_STEPS)
    for i in range(2):
        x, at = np.unique(steps[lang == i], return_inverse=True)
        y = label[lang == i]
        assert abs(cuts[i] - toxicity.threshold(x / toxicity.LOGIT_STEPS, np.bincount(at, y), np.bincount(at, 1 - y))) < 2 / toxicity.LOGIT_STEPS
    got = toxicity.score_toxicity(frame, (network, guess, cuts)).where("doc_id < 900").collect()
    assert len(got) == 800 and all(r.predicted == r.toxic for r in got)


def test_parts_are_averaged_by_their_texts():
    start = toxicity.Network().p
    parts = [[("vile word", 1, "aa"), ("kind word", 0, "aa")] * 20, [("other text", 0, "bb")] * 10]
    made = [dict(toxicity.train_part(i, iter(p), start, 1, 0)) for i, p in enumerate(parts)]
    sums = {at: toxicity.in_order([made[1][at], made[0][at]]) for at in made[0]}
    assert sums[len(toxicity.blocks()) - 1][0, -1] == 50
    alone = []
    for i, p in enumerate(parts):
        net = toxicity.Network()
        net.train(((ids, before, label) for ids, before, label, _ in toxicity.batches(p)), (toxicity.SEED, i, 0))
        alone.append(net.p)
    both = toxicity.Network()
    both.add(sums)
    touched = [(a["table"] != start["table"]).any(axis=1) for a in alone]
    weight = np.stack([touched[0] * 40, touched[1] * 10])[:, :, None]
    mean = sum(w * (a["table"] - start["table"]) for w, a in zip(weight, alone)) / np.maximum(weight.sum(axis=0), 1)
    assert touched[0].any() and touched[1].any()
    assert np.allclose(both.p["table"], start["table"] + mean, atol=1e-5)
    assert np.allclose(both.p["w2"], 0.8 * alone[0]["w2"] + 0.2 * alone[1]["w2"], atol=1e-5)


def test_threshold_of_counts_errs_least():
    rng = np.random.default_rng(6)
    for _ in range(30):
        logit = np.unique(rng.integers(-20, 20, 12))
        toxic, clean = rng.integers(0, 4, (2, len(logit)))
        got = toxicity.threshold(logit, toxic, clean)
        wrong = [toxic[logit < c].sum() + clean[logit >= c].sum() for c in np.arange(-23, 23, 0.25)]
        assert toxic[logit < got].sum() + clean[logit >= got].sum() == min(wrong)
