"""The living index against rebuilding, and its ranking against the scan."""

import random
import uuid

import pytest
from mailquarry.functions.text import padded
from mailquarry.operators import segments
from mailquarry.operators.manifest import Conflict
from mailquarry.operators.rank import WEIGHTS, bm25
from mailquarry.operators.segments import SearchIndex
from mailquarry.plans.indexed import found_ids, indexed_search
from mailquarry.plans.query import parse
from mailquarry.plans.search import Request, search
from mailquarry.sources.case import Case
from pyspark.sql import functions as F

MESSAGES = "id long, subject string, sender string, recipients string, body string, attachments string, date_ms long"
FILES = "message_id long, idx_path string, name string, content string"
WORDS = ["alpha", "beta", "Béta", "gamma", "the", "the", "the", "of", "delta", "alphabet"]
ALL = list(WEIGHTS)


def mail(i, rng):
    text = lambda n: " ".join(rng.choices(WORDS, k=rng.randint(0, n)))
    return (i, text(4), rng.choice(["ann", "bob the", None]), text(2), rng.choice([text(30), text(30), None]), text(2), i % 5)


def rebuilt(spark, state, files):
    return Case(spark.createDataFrame(list(state.values()), MESSAGES), spark.createDataFrame(files, FILES))


@pytest.fixture
def index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 4)
    return SearchIndex(spark, f"{tmp_path}/index-{uuid.uuid4().hex}", shards=3)


def by_scan(case, phrases):
    pads = case.messages.select("id", *(padded(F.col(f)).alias(f) for f in ALL))
    return {r.id: round(r["rank"], 9) for r in bm25(pads, WEIGHTS, phrases).collect()}


def test_living_index(spark, index):
    """After inserts, changes, deletes and merges the index finds and ranks what one that is built anew does; an old snapshot stays as it was."""
    rng = random.Random(1)
    state, files, old = {}, {}, None
    for step in range(5):
        ids = rng.sample(range(120), 30) + [200 + step]
        batch = [mail(i, rng) for i in ids]
        own = [(i, "0", f"{rng.choice(WORDS)}.txt", " ".join(rng.choices(WORDS, k=3))) for i in ids if i % 3 == 0]
        index.add(spark.createDataFrame(batch, MESSAGES), spark.createDataFrame(own, FILES))
        state |= {r[0]: r for r in batch}
        files = {k: v for k, v in files.items() if k not in ids} | {r[0]: r for r in own}
        if step in (1, 4):
            gone = rng.sample(sorted(state), 12)
            index.delete(spark.createDataFrame([(i,) for i in [*gone, 9999]], "id long"))
            state = {k: v for k, v in state.items() if k not in gone}
            files = {k: v for k, v in files.items() if k not in gone}
        if step == 2:
            old = (index.snapshot(), dict(state), dict(files))
    before = len(index.manifest().segments)
    m = index.merge()
    assert len(m.segments) < before and sum(s.rows for s in m.segments) == len(state)

    def agrees(snapshot, state, files):
        case = rebuilt(spark, state, list(files.values()))
        fresh = SearchIndex(spark, f"{index.path}-{uuid.uuid4().hex}", shards=2)
        fresh.add(case.messages, case.attachments)
        whole = fresh.snapshot()
        for q in ("the -gamma", '"alpha the"', "alph*", "pj:beta", "sujet:delta beta"):
            assert sorted(r.id for r in found_ids(snapshot.postings(), parse(q)).collect()) == sorted(r.id for r in found_ids(whole.postings(), parse(q)).collect())
        for phrases in ([(["the"], False, ALL)], [(["beta"], False, ["subject"]), (["alpha", "the"], False, ALL), (["gam"], True, ["body", "subject"])]):
            got = {r.id: round(r["rank"], 9) for r in snapshot.ranked(phrases).collect()}
            assert got == by_scan(case, phrases)

    agrees(index.snapshot(), state, files)
    agrees(*old)
    index.optimise()
    assert [s.dead for s in index.manifest().segments] == [[]]
    index.vacuum(1)
    agrees(index.snapshot(), state, files)


def test_best_rows_and_pages(spark, index):
    """The best rows are those of the whole ranking, with ties; a page from the index is the page of the scan."""
    rng = random.Random(2)
    rows = [mail(i, rng) for i in range(150)]
    case = Case(spark.createDataFrame(rows, MESSAGES), spark.createDataFrame([(i, "0", "the.txt", "omega delta") for i in range(0, 150, 9)], FILES))
    index.add(case.messages, case.attachments)
    snapshot = index.snapshot()
    phrases = [(["the"], False, ALL), (["delta"], False, ["subject", "body"])]
    whole = by_scan(case, phrases)
    for most in (1, 7, 60, 1000):
        last = sorted(whole.values())[: most][-1]
        got = {r.id: round(r["rank"], 9) for r in snapshot.ranked(phrases, most).collect()}
        assert got == {i: r for i, r in whole.items() if r <= last}
        own = {i: r for i, r in whole.items() if i % 4 == 0}
        last = sorted(own.values())[: most][-1]
        got = {r.id: round(r["rank"], 9) for r in snapshot.ranked(phrases, most, spark.range(0, 150, 4).toDF("id")).collect()}
        assert got == {i: r for i, r in own.items() if r <= last}
    for q, limit, offset in (("the", 10, 0), ("the", 10, 15), ("omega OR alpha", 200, 0), ("pj:the", 5, 0), ("delta -gamma", 8, 4)):
        for sort in ("relevance", "date"):
            r = Request(query=q, sort=sort, limit=limit, offset=offset)
            assert [x.id for x in indexed_search(case, snapshot, r).collect()] == [x.id for x in search(case, r).collect()]


def test_blocks_are_skipped():
    """A shard with one good block and many poor ones opens few of them."""
    import pandas as pd

    opened = []
    plain = segments._List.between
    lists = [{"segment": 0, "phrase": 0, "most": 9.0 if k == 3 else 1.0, "least": 10, "ids": list(range(k * 10, k * 10 + 10)), "lengths": [10] * 10, "counts": [0, 0, 0, 9 if k == 3 else 1, 0] * 10} for k in range(200)]
    try:
        segments._List.between = lambda self, a, z: opened.append(a) or plain(self, a, z)
        got = segments._best([1.0], [[5.0, 3.0, 2.0, 1.0, 2.0]], 10.0, 5, False)(pd.DataFrame(lists), pd.DataFrame({"segment": [], "id": []}))
    finally:
        segments._List.between = plain
    assert set(got["id"]) == set(range(30, 40)) and len(opened) < 20


def test_commits(spark, index):
    """Of two writers from one manifest the first wins; what the other wrote is never seen. An empty index finds nothing."""
    assert index.snapshot().ranked([(["the"], False, ALL)]).count() == 0 and index.snapshot().postings().count() == 0
    rows = spark.createDataFrame([mail(1, random.Random(3))], MESSAGES)
    index.add(rows)
    stale = index.manifest()
    index.add(rows)
    with pytest.raises(Conflict):
        index._replace(stale, rows.select("id"), None)
    assert index.manifest().version == 2 and sum(s.rows for s in index.manifest().segments) == 1
    assert not [n for n in index.manifests.versions() if n > 2]
