"""Ranked search against scores of all documents, and on odd rows."""

import math
import random
import re

from mailquarry.llm import lexical

DOCS, ITEMS = "doc_id long, text string, DOC_ID_ string, score int", "item_id long, text string, rank int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, most):
    own = [(d, terms(t)) for d, t in docs]
    own = [(d, t) for d, t in own if t]
    count, length = len(own), sum(len(t) for _, t in own)
    out = []
    for item_id, text in items:
        scored = []
        for d, t in own:
            m = 100 - 50 + 50 * len(t) * count // length
            score = 0
            for q in set(terms(text)):
                tf = t.count(q)
                w = math.floor(1000 * math.log((2 * count + 2) / (2 * sum(q in x for _, x in own) + 1)))
                score += w * (1000000000 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item_id, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:most], 1)]
    return out


def order(rows):
    return sorted(tuple(r) for r in rows)


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "été", "x1", "日本", "the", "a", "of", "Ünder", *(f"w{i}" for i in range(60))]
    text = lambda: rng.choice([" ", "-", "\x00", "  "]).join(rng.choices(vocabulary, [20 / (i + 1) for i in range(len(vocabulary))], k=rng.randint(1, 40)))
    docs = [(rng.choice([i, i, i, 3]), rng.choice([text(), text(), text(), None, "", "..."])) for i in range(n)]
    return docs + docs[: n // 4], [(i // 2, text()) for i in range(12)] + [(90, None), (91, ""), (92, "nowhere"), (None, "alpha beta")]


def test_matches_brute_force(spark, monkeypatch):
    docs, items = corpus(150, 3)
    docs.append((None, "alpha beta the of"))
    for limits in ({}, {"ENTRIES": 90, "READ": 2}, {"DOCUMENTS": 7, "ITEMS": 5, "READ": 1}, {"TERM_BYTES": 1500}):
        for name, value in limits.items():
            monkeypatch.setattr(lexical, name, value)
        for most in (4, 50):
            got = lexical.search(spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS).repartition(3), spark.createDataFrame([(*i, 0) for i in items], ITEMS), most)
            assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(docs, items, most)))
        monkeypatch.undo()


def test_shard_stops_early_and_sees_ties():
    """A list of ties at the last rank is read to its end; what can't reach it is not looked up."""
    import numpy as np
    import pyarrow as pa

    n = 4000
    times = [[100]] * 20 + [[9]] * 500 + [[1]] * (n - 520)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n, 0, -1)), pa.array([100] * n), pa.array([[0]] * n, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "times"])
    shard = lexical.Shard([batch], np.array([7]), n, n * 100)
    looked = []
    plain = shard.scores
    shard.scores = lambda docs, terms: looked.extend(docs.tolist()) or plain(docs, terms)
    best = lexical.Best(25)
    shard.search(np.array([0]), best)
    assert best.rows[2].tolist() == [*range(n - 19, n + 1), *range(n - 519, n - 514)] and 520 < len(looked) < 2100
    best = lexical.Best(10)
    looked.clear()
    shard.search(np.array([0]), best)
    assert len(looked) < 60


def test_odd_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", "", 0)], DOCS), spark.createDataFrame([(1, "A", 0)], ITEMS)
    none_docs, none_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert lexical.search(none_docs, items).count() == lexical.search(docs, none_items).count() == lexical.search(none_docs, none_items).count() == 0
    assert [r.doc_id for r in lexical.search(docs, items).collect()] == [1]


def test_long_texts():
    long = b"needle " + b"x" * (3 << 20) + b" " + b"Hay, " * 700_000 + b"needle"
    has = lexical.counted(long)
    assert (has[b"needle"], has[b"hay"], has[b"x" * (3 << 20)], has.total()) == (2, 700_000, 1, 700_003)
