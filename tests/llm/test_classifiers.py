import math
import random
import re
import zlib

import numpy as np
import pytest
from mailquarry.llm import langid, toxicity

ALPHABETS = {"aa": "abcdefgh", "bb": "mnopqrst", "cc": "äöüßxyzw"}


def language_rows(n=240, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(ALPHABETS))
        words = ["".join(rng.choices(ALPHABETS[lang], k=rng.randint(2, 6))) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words), lang if i % 7 else None))
    return rows


@pytest.fixture(scope="module")
def languages(spark):
    return spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")


def test_held_out_accuracy(spark, languages):
    model = langid.train(languages)
    truth = {i: next(k for k, a in ALPHABETS.items() if t[0] in a) for i, t, _ in language_rows()}
    got = langid.identify(languages, model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(got) == 240 and len(held) > 40
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_fit_ignores_held_out_rows(spark, languages):
    from pyspark.sql import functions as F

    other = languages.withColumn("lang", F.when(langid.fold_of(F.col("doc_id"), 3) == 1, F.lit("zz")).otherwise(F.col("lang")))
    assert np.array_equal(langid.train(languages).weights, langid.train(other).weights)


def test_undetermined_and_odd_rows(spark, languages):
    model = langid.train(languages)
    for text in (None, "", "123 !? \n", "  "):
        assert model.predict(text) == ("und", 0.0, True)
    rng = random.Random(6)
    for alphabet in ("абвгдежзиклмно", "αβγδεζηθικλμν", "日本語漢字文学校生先時"):
        assert model.predict(" ".join("".join(rng.choices(alphabet, k=4)) for _ in range(60)))[2]
    odd = spark.createDataFrame([(None, "abc"), (1, None), (1, None), (2, "ab " * 50000)], "doc_id long, text string")
    assert langid.identify(odd, model).count() == 4
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.train(empty).predict("abc") == ("und", 0.0, True)
    assert langid.identify(empty, model).count() == 0


def test_trigrams_are_whole_texts():
    a = langid.trigrams("Ab, c")
    assert len(a) == 4  # ' ab', 'ab ', 'b c', ' c ' with one blank for ', '
    assert np.array_equal(langid.trigrams("AB c"), a)


def test_stage_drops_what_is_rejected(spark, languages):
    extra = spark.createDataFrame([(900, "1234", "aa"), (901, None, "bb"), (902, " ".join("".join(random.Random(k).choices("абвгдежзиклмно", k=4)) for k in range(60)), "cc")], "doc_id long, text string, lang string")
    docs = languages.union(extra)
    out = langid.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == set(range(240))


def toxic_rows(n=900, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        parts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps"], k=6)) for _ in range(rng.randint(1, 12))]
        bad = rng.random() < 0.2
        if bad:
            k = rng.randrange(len(parts))
            parts[k] = rng.choice(["vile", "rotten"]) + " " + parts[k]
        rows.append((i, ". ".join(parts)))
        labels.append((i, 0, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    truth = {i: y for i, _, y in labels}
    got = toxicity.detect(docs, model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.98
    texts = dict(rows)
    for r in got:
        if truth[r.doc_id] and r.score >= 0.5:
            assert all(any(w in texts[r.doc_id][int(a) : int(b)] for w in ("vile", "rotten")) for a, b in (x.split(":") for x in r.sentences.split(",")))


def test_toxicity_odd_rows(spark):
    rows, labels = toxic_rows(200)
    docs = spark.createDataFrame([*rows, (None, "vile"), (1, None), (2, ""), (2, "")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 0, 1), (3, None, None), (4, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.detect(docs, toxicity.train(docs, marks)).collect()
    assert len(got) == 204 and all(0 <= r.score <= 1 for r in got)
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, nothing).score("vile alpha")[0] < 1e-9
    assert toxicity.detect(docs.limit(0), toxicity.Model(-1.0, {})).count() == 0


def test_noisy_or():
    model = toxicity.Model(-1.0, {"x": 2.0})
    p = lambda s: 1 / (1 + np.exp(-s))
    assert model.score("a b. x c! d")[0] == pytest.approx(1 - (1 - p(-1)) ** 2 * (1 - p(1)))
    assert model.score("a b. x c! d")[1] == "4:8"


def plain_grams(text):
    """Letter trigrams by their characters: runs of anything else are one blank, one stands at either end."""
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    low = " " + "".join(c for c, before in zip(low, "x" + low, strict=False) if c != " " or before != " ") + " "
    return ["".join(g) for g in zip(low, low[1:], low[2:], strict=False)]


def test_prediction_matches_brute_force():
    """Cosines of plain dictionaries against those of the vectors, on texts with letters of several alphabets."""
    rng = random.Random(11)
    texts = {k: [" ".join("".join(rng.choices(a, k=rng.randint(1, 7))) for _ in range(rng.randint(1, 40))) + rng.choice(["", "!", " 12"]) for _ in range(30)] for k, a in ALPHABETS.items()}
    model = langid.fit({k: [langid.sparse(langid.trigrams(t)) for t in v] for k, v in texts.items()})
    place = {}
    for t in [t for v in texts.values() for t in v]:
        own, hashed = plain_grams(t), langid.trigrams(t).tolist()
        assert len(own) == len(hashed)
        place.update(zip(own, hashed, strict=True))
    for text in [t for v in texts.values() for t in v[:10]]:
        tf = {}
        for g in plain_grams(text):
            tf[place[g]] = tf.get(place[g], 0) + 1
        own = {p: math.log1p(n) * float(model.idf[p]) for p, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in own.values()))
        cosines = [sum(x * float(w[p]) / float(model.idf[p]) for p, x in own.items()) / norm for w in model.weights]
        lang, score, _ = model.predict(text)
        assert score == pytest.approx(max(cosines), abs=1e-4)
        assert lang == model.langs[cosines.index(max(cosines))]


def test_equal_cosines_go_to_the_first_language():
    same = [langid.sparse(langid.trigrams(t)) for t in ("some words here", "other words there")]
    model = langid.fit({"zz": same, "bb": same, "mm": same})
    assert model.predict("some words")[0] == "bb"


def test_short_texts_have_bounds(spark, languages):
    """All texts of the sample are longer; pieces of them give bounds to fewer than 16 different trigrams."""
    model = langid.train(languages)
    assert (model.bounds[2:] > 0).all()
    rng = random.Random(12)
    own = ["".join(rng.choices(rng.choice(list(ALPHABETS.values())), k=rng.randint(4, 12))) for _ in range(300)]
    assert np.mean([model.predict(t)[2] for t in own]) < 0.02
    strange = ["".join(rng.choices("абвгдежзиклмно", k=rng.randint(6, 12))) for _ in range(300)]
    assert np.mean([model.predict(t)[2] for t in strange]) > 0.9


def test_toxic_gradient_leads_where_brute_force_does():
    """The likelihood that fit() climbs, by plain loops: no small step from its result gains."""
    rng = random.Random(13)
    docs = []
    for _ in range(150):
        bad = rng.random() < 0.4
        own = [tuple(sorted(rng.sample(range(1, 4), rng.randint(0, 2)))) for _ in range(rng.randint(1, 5))]
        if bad or rng.random() < 0.05:
            own[rng.randrange(len(own))] += (0,)
        docs.append((int(bad), [tuple(sorted(s)) for s in own]))
    words = ["vile", "a", "b", "c"]
    model = toxicity.fit(docs, words)

    def gain(bias, theta):
        total = -toxicity.RIDGE / 2 * sum(x * x for x in theta)
        for y, own in docs:
            clean = math.prod(1 - 1 / (1 + math.exp(-bias - sum(theta[w] for w in s))) for s in own)
            total += math.log(1 - clean if y else clean)
        return total

    theta = [model.weights.get(w, 0.0) for w in words]
    best = gain(model.bias, theta)
    for k in range(5):
        for step in (-0.2, 0.2):
            moved = [model.bias, *theta]
            moved[k] += step
            assert gain(moved[0], moved[1:]) < best
    assert theta[0] > 2 * max(theta[1:]) > 0


def plain_score(model, text):
    clean, found = 1.0, []
    for m in re.finditer(r"[^.!?\n]+", text.lower()):
        own = set(re.findall(r"[^\W\d_]+", m.group()))
        if own:
            s = model.bias + sum(model.weights.get(w, 0.0) for w in own)
            clean *= 1 - 1 / (1 + math.exp(-s))
            if s > 0:
                found.append(f"{m.start()}:{m.end()}")
    return (1 - clean if re.search(r"[^\W\d_]", text) else 1 / (1 + math.exp(-model.bias))), ",".join(found)


def test_toxic_scores_match_brute_force():
    model = toxicity.Model(-6.0, {"vile": 8.0, "rotten": 5.0, "kind": -3.0})
    rng = random.Random(14)
    pool = ["vile", "Rotten", "kind", "x1y", "élan", "word", "_", "7"]
    texts = ["", "12. 34!", *("".join(rng.choice(pool) + rng.choice([" ", ". ", "! ", "\n", "? ", ", "]) for _ in range(rng.randint(1, 30))) for _ in range(200))]
    for text in texts:
        score, found = model.score(text)
        want, spans = plain_score(model, text)
        assert score == pytest.approx(want, abs=1e-9) and found == spans, text
    # a very long text, with one offending sentence at its end
    long = "word " * 300_000 + ". " + "vile vile"
    assert model.score(long)[1] == f"{len(long) - 10}:{len(long)}" and model.score(long)[0] > 0.8
