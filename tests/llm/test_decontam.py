import random

import numpy as np
import pytest
from mailquarry.llm import decontam as D
from mailquarry.llm import wordhash


def brute_score(item, passage):
    best = 0
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, w in enumerate(item, 1):
        for j, v in enumerate(passage, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (D.MATCH if w == v else D.MISMATCH), h[i - 1][j] + D.GAP, h[i][j - 1] + D.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_matches_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (rng.choices([b"a", b"b", b"c", b"d"], k=rng.randint(1, 14)) for _ in range(2))
        score, start, end = D.align(a, b)
        assert score == brute_score(a, b)
        assert brute_score(a, b[start:end]) == score


def test_grams_are_position_independent():
    words = [f"Word{i}é" for i in range(12)]
    text = " ".join(words)
    plain = next(iter(D.grams([text])))[2]
    got = {j: g for j, _, g in D.grams(["x", None, "", "pre fix, " + text, text.replace(" ", "\n -"), "a b", text.upper()])}
    assert set(got) == {3, 4, 6}
    assert np.array_equal(got[3][2:], plain) and np.array_equal(got[4], plain) and np.array_equal(got[6], plain)
    assert len(plain) == 10 and len(set(plain.tolist())) == 10


def test_long_texts_are_hashed_whole(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000))
    want = next(iter(D.grams([text])))[2]
    monkeypatch.setattr(wordhash, "BLOCK", 500)
    assert np.array_equal(next(iter(D.grams([text])))[2], want)
    assert [(j, len(g)) for j, _, g in D.grams(["a b c", text, "d e f g"])] == [(0, 1), (1, 2998), (2, 2)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(800)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(15, 40)))) for i in range(20)]
    docs, want = [], set()
    for d in range(120):
        own = rng.choices(vocab, k=rng.randint(10, 200))
        if d < 40:
            item = d % 20
            copy = items[item][1].split()
            for k in rng.sample(range(len(copy)), int(len(copy) * (0.15 if d % 3 == 0 else 0))):
                copy[k] = rng.choice(vocab)
            at = rng.randrange(len(own))
            own[at:at] = copy
            want.add((d, item))
        docs.append((d, ", ".join(own).upper() if d % 2 else " ".join(own)))
    return items, docs, want


def test_pairs_match_brute_force(spark, corpus):
    items, docs, want = corpus
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    split = {d: D.words(t) for d, t in docs}
    for r in got:
        item = D.words(dict(items)[r.item_id])
        assert r.score == pytest.approx(brute_score(item, split[r.doc_id]) / (2 * len(item)))
    brute = {(d, i) for d, t in docs for i, x in items if brute_score(D.words(x), split[d]) >= D.LEAST * 2 * len(D.words(x))}
    assert brute == want


def test_stage_and_odd_rows(spark, corpus, tmp_path):
    items, docs, want = corpus
    rows = [(d, t, "en") for d, t in docs] + [(None, items[0][1], "x"), (500, None, "x"), (501, "", "x"), (502, "a b", "x"), (502, "a b", "x")]
    bench = spark.createDataFrame([*items, (None, "one two"), (77, None), (78, "")], "item_id long, text string")
    bench.write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.createDataFrame(rows, "doc_id long, text string, TAG string")
    out = D.stage(spark, frame, str(tmp_path))
    assert out.columns == frame.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([d for d, _ in docs if d not in {x for x, _ in want}] + [500, 501, 502, 502], key=str)
    assert D.contaminated(frame.limit(0), bench).count() == 0
    assert D.contaminated(frame, bench.limit(0)).count() == 0


def test_texts_without_blanks_are_cut_between_words(monkeypatch):
    comma = ",".join(f"w{i}" for i in range(2000))
    want = next(iter(D.grams([comma])))[2]
    giant = "a b " + "z" * 1200 + ",c d e"
    whole = next(iter(D.grams(["a b y,c d e"])))[2]
    monkeypatch.setattr(wordhash, "BLOCK", 300)
    assert np.array_equal(next(iter(D.grams([comma])))[2], want)
    got = next(iter(D.grams([giant])))[2]
    assert len(got) == len(whole) and got[-1] == whole[-1]


def test_equal_and_short_items(spark):
    items = [(5, "One two three four five six"), (3, "one, two three FOUR five six"), (9, "seven eight"), (8, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, "x one two three four five six y"), (2, "seven eight")], "doc_id long, text string")
    got = D.contaminated(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.n_items, r.score) for r in got] == [(1, 3, 2, 1.0)]
    assert {(r.item_id, r.same_id) for r in D.same_items(bench).collect()} == {(5, 3), (3, 3), (9, 9), (8, 8)}
    assert {r.item_id for r in D.too_short(bench).collect()} == {9, 8}


def test_recall_of_edited_copies(spark):
    """Shares of copies found with 10, 20 and 30 % of the words replaced; the README has the figures."""
    rng = random.Random(21)
    vocab = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(20, 60)))) for i in range(150)]
    docs, made = [], {}
    for share in (0.1, 0.2, 0.3):
        for i, text in items:
            copy = text.split()
            for k in rng.sample(range(len(copy)), round(share * len(copy))):
                copy[k] = rng.choice(vocab)
            made[len(docs)] = (share, i)
            docs.append((len(docs), " ".join(rng.choices(vocab, k=80) + copy + rng.choices(vocab, k=80))))
    docs += [(1000 + k, " ".join(rng.choices(vocab, k=200))) for k in range(150)]
    got = {(r.doc_id, r.item_id) for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    found = {share: sum((d, i) in got for d, (s, i) in made.items() if s == share) / len(items) for share in (0.1, 0.2, 0.3)}
    print("recall of edited copies", found)
    assert found[0.1] >= 0.99 and found[0.2] >= 0.95 and found[0.3] >= 0.7
    assert got == {(d, made[d][1]) for d, _ in got}  # no other pair
