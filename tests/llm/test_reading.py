from __future__ import annotations

import random

import numpy as np

from rollbook.llm import reading as rd

EASY = "He has a cat. She buys bread. We go home. The dog is old. He sees a red car. It was good."
HARD = "Notwithstanding the derogations enumerated in the aforementioned provisions, the institutional interdependence of supranational prescriptions is irreconcilable with jurisdictional subsidiarity, which presupposes constitutional proportionality."


def corpus(n=160):
    rng = random.Random(0)
    out = []
    for i in range(n):
        level = 1 if i % 2 else 5
        base = EASY.split(". ") if level == 1 else [HARD]
        out.append((i, " ".join(rng.choice(base).rstrip(".") + "." for _ in range(rng.randint(3, 9))), level))
    return out


def test_tokens():
    assert rd.tokens(None) == [] and rd.tokens("") == []
    assert rd.tokens("A co-\nmet[12] fell. Go!") == ["A", "comet", "fell", ".", "Go", "!"]


def test_features_do_not_depend_on_the_batch():
    lex = rd.Lexicon(rd.Rarity({}, np.e, 1))
    docs = [rd.tokens(t) for t in (EASY, "", HARD, "word", "1 2 .", EASY + "\n- " + HARD)]
    together, langs = rd.features(docs, lex)
    for k, d in enumerate(docs):
        alone, lang = rd.features([d], rd.Lexicon(rd.Rarity({}, np.e, 1)))
        assert np.allclose(alone[0], together[k]) and lang[0] == langs[k]


def test_features_by_hand():
    x, _ = rd.features([rd.tokens("the big dog ran. it sat, down.")], rd.Lexicon(rd.Rarity({}, np.e, 1)))
    f = dict(zip(rd.FEATURES, x[0]))
    assert np.isclose(f["bias_len"], np.log(7)) and np.isclose(f["root_ttr"], 7 / np.sqrt(7)) and np.isclose(f["sent_mean"], 3.5)
    assert np.isclose(f["commas"], 0.5) and np.isclose(f["mean_len"], (3 + 3 + 3 + 3 + 2 + 3 + 4) / 7)


def test_ordinal_model_orders_levels():
    rng = np.random.default_rng(1)
    y = rng.integers(1, 6, 1500)
    x = np.c_[y + rng.normal(0, 0.3, 1500), rng.normal(size=1500)]
    lang = rng.integers(0, 3, 1500)
    model = rd.OrdinalModel().fit(x[:1000], lang[:1000], y[:1000])
    assert (model.predict(x[1000:], lang[1000:]) == y[1000:]).mean() > 0.85


def test_operator(spark):
    rows = corpus()
    extra = [(1000, None, 0), (1001, "", 0), (1002, " \n ", 0), (1003, EASY * 3000, 0), (1, rows[1][1], 0)]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t, _ in rows + extra], "doc_id bigint, text string, lang string, _f int")
    labels = spark.createDataFrame([(i, lv) for i, _, lv in rows[:100]] + [(500000, 3), (3, 9), (5, None)], "doc_id bigint, reading_level int")
    out = rd.reading_level(df, "text", "doc_id", labels)
    assert out.columns == ["doc_id", "text", "lang", "_f", "reading_level"] and out.count() == len(rows) + len(extra)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, set()).add(r.reading_level)
    held = [(i, lv) for i, _, lv in rows[100:]]
    assert sum(got[i] == {lv} for i, lv in held) / len(held) > 0.95
    assert all(1 <= lv <= 5 for s in got.values() for lv in s)
    none = rd.reading_level(df, "text", "doc_id", labels.limit(0))
    assert {r.reading_level for r in none.collect()} == {3}
    assert rd.reading_level(df.limit(0), "text", "doc_id", labels).collect() == []


def test_rarity_is_exact_for_held_words_and_shared_by_the_rest(spark):
    texts = ["the the the the dog dog ran", "The dog sat. <b>", None, ""]
    counts = rd.word_counts(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    assert {r.word: r.n for r in counts.collect()} == {"the": 5, "dog": 3, "ran": 1, "sat": 1, "b": 1}
    every = rd.rarity_table(counts)
    assert np.isclose(every.of("dog"), np.log(11 / 3)) and np.isclose(every.of("sat"), np.log(11)) and np.isclose(every.of("unseen"), np.log(11))
    few = rd.rarity_table(counts, max_words=4)  # three words of count 1 do not fit beside the other two
    assert set(few.own) == {"the", "dog"} and np.isclose(few.of("sat"), np.log(11)) and np.isclose(few.of("the"), np.log(11 / 5))
    none = rd.rarity_table(counts.limit(0))
    assert none.of("x") == 0.0


def test_cuts_are_calibrated_on_unseen_rows():
    rng = np.random.default_rng(2)
    y = rng.integers(1, 6, 400)
    x = np.c_[y + rng.normal(0, 0.8, 400), rng.normal(size=(400, 20))]  # useless features: the plain fit is too sure
    model = rd.OrdinalModel().fit(x[:200], np.zeros(200, dtype=int), y[:200])
    plain = rd.OrdinalModel()._fitted(x[:200], np.zeros(200, dtype=int), y[:200])
    score = lambda m: (m.predict(x[200:], np.zeros(200, dtype=int)) == y[200:]).mean()
    assert np.all(np.diff(model.cuts) > 0) and score(model) >= score(plain) - 0.03


def test_texts_of_no_known_language_get_no_deviation():
    lexicon = rd.Lexicon(rd.Rarity({}, np.e, 1))
    _, lang = rd.features([rd.tokens("talo suuri vanha metsa"), rd.tokens("the dog of the house"), rd.tokens("")], lexicon)
    assert list(lang) == [3, 0, 3]
