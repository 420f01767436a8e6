import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphaudit.llm import language, toxicity


def text(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_gradients(monkeypatch):
    """Backpropagation through time beside finite differences."""
    model = language.fresh(["a", "b", "c"])
    for k in range(2):
        model.inputs[k], model.recurrent[k], model.bias[k] = (p.astype(np.float64) for p in (model.inputs[k], model.recurrent[k], model.bias[k] + 0.1))
    model.out, model.out_bias = model.out.astype(np.float64), model.out_bias.astype(np.float64)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 5, (7, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    there = np.ones((7, 4))
    there[5:, 1] = 0
    _, grads = language._gradients(model, x, y, there)
    parts = [*[p for k in range(2) for p in (model.inputs[k], model.recurrent[k], model.bias[k])], model.out, model.out_bias]
    for p, g in zip(parts, grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps = p[at], 3e-3
        p[at] = old + eps
        up = language._gradients(model, x, y, there)[0]
        p[at] = old - eps
        down = language._gradients(model, x, y, there)[0]
        p[at] = old
        assert abs((up - down) / (2 * eps) - g[at]) < 2e-3 + 0.02 * abs(g[at])


def test_language(docs_of):
    rng = random.Random(5)
    words = {"aa": ["tion", "the", "ing"], "bb": ["äsch", "über", "keit"], "cc": ["ñado", "mente", "que"]}
    texts, langs = [], []
    for i in range(240):
        lang = list(words)[i % 3]
        texts.append(text(rng, words[lang], rng.randrange(3, 60)))
        langs.append(lang)
    model = language.fit(texts[:180], langs[:180], steps=60)
    p = language.pooled(model, [t.encode() for t in texts[180:]])
    assert (np.array(model.languages)[p.argmax(1)] == np.array(langs[180:])).mean() > 0.95
    out = {r["doc_id"]: r for r in language.predicted(docs_of([texts[181], None, "", "12 !", texts[181], "x" * 5000, (None, texts[182])], extra=True), model).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and out[1]["lang_score"] == 0
    assert out[0]["lang_pred"] == out[4]["lang_pred"] == langs[181] and out[0]["lang_score"] == out[4]["lang_score"]
    assert 0 <= out[5]["lang_score"] <= 1
    assert {r["lang_pred"] for r in language.predicted(docs_of([texts[0]]), None).collect()} == {"und"}
    assert language.predicted(docs_of([]), model).count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "PER_LANGUAGE", 3)
    rows = [(i, f"text {i}", f"l{i % 70:02d}") for i in range(1400)]
    docs = spark.createDataFrame(rows + rows[:70], "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "fit", lambda texts, langs: list(zip(texts, langs, strict=True)))
    got = language.train(docs)
    assert len({lang for _, lang in got}) == 70 and len(set(got)) == len(got) == 210
    assert all(dict((t, own) for _, t, own in rows)[t] == lang for t, lang in got)


def test_windows_are_pooled_over_all_bytes():
    model = language.fresh(["a", "b"])
    texts = [b"", b"x", b"ab" * 100, b"q" * language.WINDOW]
    p = language.pooled(model, texts)
    assert p[0].sum() == 0 and np.allclose(p[1:].sum(1), 1, atol=1e-5)
    alone = np.stack([language.pooled(model, [t])[0] for t in texts])
    assert np.allclose(p, alone, atol=1e-6)


def test_toxicity(spark, docs_of):
    rng = random.Random(6)
    plain = [f"{a}{b}" for a in ("the", "an", "er", "st", "nd") for b in ("ing", "tion", "ed", "ble", "ly")]
    bad = ["moron", "scumbag", "worthless", "vequor", "vequist"]

    def one(toxic):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 120))]
        for _ in range(3 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(bad)
        return " ".join(words)

    texts = [(i, one(i % 4 == 0)) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    docs = docs_of(texts, extra=True)
    model = toxicity.train(docs, labels)
    rows = toxicity.scored(docs, model).select("doc_id", "toxicity", toxicity.held_out(F.col("doc_id")).alias("held_out")).collect()
    own = [r for r in rows if r["held_out"]]
    assert len(own) > 80 and np.mean([(r["toxicity"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in own]) > 0.95
    out = toxicity.scored(docs_of(["", None, "x" * 9000, "the moron", "the moron"]), model).collect()
    assert all(0 <= r["toxicity"] <= 1 for r in out) and out[0]["toxicity"] == out[1]["toxicity"] and out[3]["toxicity"] == out[4]["toxicity"]
    none = toxicity.train(docs, labels.where("false"))
    assert {r["toxicity"] for r in toxicity.scored(docs, none).collect()} == {0.0}
    assert toxicity.scored(docs_of([]), model).count() == 0


def test_wide_toxic_vocabulary():
    """More toxic words than TOXIC_BYTES hold, beside rare ordinary words of the same letters."""
    rng = random.Random(8)
    fresh = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(14))
    plain, bad = [fresh() for _ in range(40)], [fresh() for _ in range(300)]
    ordinary = [" ".join([*rng.choices(plain, k=30), fresh(), fresh(), fresh()]) for _ in range(2600)]
    toxic = [" ".join([*rng.choices(plain, k=30), *rng.sample(bad, 3)]) for _ in range(2600)]
    model = toxicity.fit(toxic[:2400], ordinary[:2400])
    known = model.opened()
    assert np.mean([model.score(known, t) >= 0.5 for t in toxic[2400:]]) > 0.9
    assert np.mean([model.score(known, t) < 0.5 for t in ordinary[2400:]]) > 0.95


def test_windows_cover_the_text():
    words = [b"w%d" % i for i in range(20)]
    parts = toxicity.spelled_windows(words)
    assert len(parts) == 4 and parts[0] == toxicity.wide(b" " + b" ".join(words[:6]) + b" ") and parts[3] == toxicity.wide(b" w18 w19 ")
    assert toxicity.spelled_windows([]) == []


def test_dictionaries_are_trained(monkeypatch):
    """Both come from zstandard's trainer, each on texts of its own."""
    rng = random.Random(12)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    model = toxicity.fit([text(rng, plain, 60) + " vequorish " + text(rng, plain, 20) for _ in range(300)], [text(rng, plain, 80) for _ in range(900)])
    magic = (0xEC30A437).to_bytes(4, "little")
    assert magic in model.ordinary and magic in model.toxic
    assert toxicity.wide(b"vequorish") in model.toxic and toxicity.wide(b"vequorish") not in model.ordinary


def test_results_never_replace_the_callers_columns(spark, docs_of):
    docs = docs_of(["the moron", None]).selectExpr("*", "'mine' AS toxicity", "'mine' AS lang_pred")
    with pytest.raises(ValueError):
        toxicity.scored(docs, toxicity.Model(fixed=0.5))
    with pytest.raises(ValueError):
        language.predicted(docs, None)
    out = toxicity.scored(language.predicted(docs, None, ("l", "p")), toxicity.Model(fixed=0.5), "t").collect()
    assert {(r["toxicity"], r["lang_pred"], r["l"], r["t"]) for r in out} == {("mine", "mine", "und", 0.5)}


def test_long_toxic_runs_are_learned():
    rng = random.Random(9)
    plain = ["the", "another", "sting", "nation", "tables"]
    run = "vequorzu" * 8
    model = toxicity.fit([f"{text(rng, plain, 30)} moronic {run}" for _ in range(200)], [text(rng, plain, 30) for _ in range(200)])
    known = model.opened()
    assert min(map(known.word, toxicity.pieces_of(run))) > 10
    assert model.score(known, f"the nation {run}") > 0.5 > model.score(known, "the nation " + "another" * 8)


def test_scores_keep_the_share_of_all_labels(spark, docs_of, monkeypatch):
    """Texts that tell nothing get the share of toxic ones among all labels, not that of the capped sample."""
    monkeypatch.setattr(toxicity, "MOST_TOXIC", 60)
    monkeypatch.setattr(toxicity, "MOST_ORDINARY", 120)
    rng = random.Random(10)
    docs = docs_of([(i, text(rng, ["the", "another", "sting", "nation", "tables"], 30)) for i in range(1600)])
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(1600)], "doc_id long, quality int, toxic int")
    scores = [r["toxicity"] for r in toxicity.scored(docs, toxicity.train(docs, labels)).collect()]
    assert 0.07 < np.mean(scores) < 0.15


def test_examples_that_open_alike_all_count():
    rng = random.Random(11)
    plain, bad = ["the", "another", "sting", "nation", "tables"], ["moronic", "scumbag", "worthless", "vequor", "zuqqik"]
    header = "this notice stands at the head of every text of this board "
    toxic = [f"{header}{text(rng, plain, 30)} {bad[i % 5]}" for i in range(400)]
    model = toxicity.fit(toxic, [header + text(rng, plain, 30) for _ in range(400)])
    known = model.opened()
    assert all(model.score(known, f"{header}the nation tables another sting {w} nation the tables") > 0.5 for w in bad)
    assert model.score(known, header + text(rng, plain, 30)) < 0.5
    assert toxicity._once(["a", "b", "a"]) == ["a", "b"]
