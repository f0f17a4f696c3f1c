from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from burstselect.llm import langid, toxicity

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "ber"], "cc": ["que", "oux", "ée", "ion"]}


def text_of(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def slow_phrases(text, sample, stretch):
    total = 0
    for at in range(0, len(text), stretch):
        part, i, known = text[at : at + stretch], 0, set(sample)
        while i < len(part):
            total += 1
            n = 1
            if part[i] in known:
                while i + n < len(part) and part[i : i + n + 1] in sample:
                    n += 1
            i += n
    return total


def test_phrases_equal_plain_search():
    rng = random.Random(1)
    samples = tuple(text_of(rng, k, 60) for k in SYLLABLES)
    texts = ["".join(rng.choice("kalomitu schein xyz") for _ in range(rng.randint(0, 200))) for _ in range(40)] + ["", "a", samples[0]]
    got = langid.Parser(samples).phrases(texts, 37)
    assert got.tolist() == [[slow_phrases(t, s, 37) for s in samples] for t in texts]


def test_languages(spark):
    rng = random.Random(2)
    rows = [(i, text_of(rng, lang, 40), lang) for i, lang in enumerate(list(SYLLABLES) * 40)]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!", None), (None, "kalo kalo milo", None), (1003, "KALO!! MITU!! " * 9000, None)]
    rows += [(2000 + i, rows[0][1], "aa") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.sample(df, "lang", "text", F.col("doc_id") < 90)
    assert list(model) == list(SYLLABLES) and all(0 < len(s) <= langid.SAMPLE_CHARS for s in model.values())
    got = langid.identify(df, model).collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 1000 or (r.doc_id or 0) >= 2000)
    pred = {r.doc_id: r for r in got}
    assert pred[1000].lang_pred == pred[1001].lang_pred == pred[1002].lang_pred == "und" and pred[1003].lang_pred == pred[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)
    empty = df.where("false")
    assert langid.identify(empty, model).count() == 0 and langid.sample(empty, "lang", "text", F.lit(True)) == {}
    assert {r.lang_pred for r in langid.identify(df, {}).collect()} == {"und"}


def test_toxic(spark):
    rng = random.Random(3)
    plain, bad, groups = ["tree", "house", "walk", "river", "stone", "quiet"], ["vile", "rotten"], ["muslim", "jewish", "christian"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = [rng.choice(plain) for _ in range(30)] + ([rng.choice(bad)] if toxic else [])
        if toxic and i % 2 == 0:
            words.append("muslim")  # the labels alone would blame the mention
        rng.shuffle(words)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (5, None), (9999, 1), (700, 1)]
    rows += [(700, None, "s"), (701, "", "s"), (None, "Vile!", "s"), (702, "a muslim river", "s"), (703, "tree " * 50_000 + "VILE", "s"), (704, "river", "s"), (704, "river", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, table, F.col("doc_id") % 5 != 0)
    found = {r.doc_id: r.score for r in toxicity.scored(docs.drop("score"), model).collect()}
    held = [i for i in range(600) if i % 5 == 0]
    assert np.mean([(found[i] >= 0.5) == (i % 3 == 0) for i in held]) > 0.98
    assert found[702] < 0.5 and found[703] > 0.5 and found[None] > 0.5 and found[700] == found[701] < 0.5
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and {703, None}.isdisjoint(r.doc_id for r in left.collect())
    assert left.where("doc_id = 704").count() == 2
    assert toxicity.fit(docs, table.where("false"), F.lit(True)).score("vile") < 0.5
    assert toxicity.scored(docs.drop("score").where("false"), model).count() == 0


def test_swaps():
    assert set(toxicity.swaps({"women", "x"})) == {("women", "men"), ("women", None)} and toxicity.swaps({"x"}) == []


def test_repeated_swaps_weigh_as_often_as_they_occur():
    """The penalty from counted swaps equals the one from a row for each swap."""
    groups = (("red", "blue", "green"),)
    rows = [(["bad", "red"], 1), (["bad"], 1), (["fine", "red", "blue"], 0), (["fine", "green"], 0)] * 5
    vocabulary = ["bad", "fine", "red", "blue", "green"]
    once = toxicity.fit_weights(rows, vocabulary, groups)
    shuffled = toxicity.fit_weights(list(reversed(rows)), vocabulary, groups)
    assert once.weights["bad"] > 0.5 > abs(once.weights["red"]) and once.weights["fine"] < -0.5
    assert all(abs(once.weights[w] - shuffled.weights[w]) < 1e-3 for w in vocabulary)
    free = toxicity.fit_weights(rows, vocabulary, groups, swap_weight=0.0)
    assert abs(free.weights["red"] - free.weights["blue"]) > abs(once.weights["red"] - once.weights["blue"])


def test_columns_named_as_results_give_way(spark):
    docs = spark.createDataFrame([(1, "kalo", "x", 7, "mine")], "doc_id long, text string, Score string, n int, lang_pred string")
    model = toxicity.Model({}, 0.0)
    for keep_text in (False, True):
        row = toxicity.scored(docs, model, keep_text=keep_text).first().asDict()
        assert row.pop("score") == 0.5
        assert row == {"doc_id": 1, "n": 7, "lang_pred": "mine"} | ({"text": "kalo"} if keep_text else {})
    assert toxicity.drop_toxic(docs, toxicity.Model({}, -1.0)).collect() == docs.collect()
    got = langid.identify(docs, {"aa": "kalokalomitu", "bb": "scheinung"}).first().asDict()
    assert got["lang_pred"] == "aa" and got["n"] == 7 and set(got) == {"doc_id", "n", "lang_pred", "score"}
