import random
import sqlite3

import pytest
from mailquarry.functions.excerpts import excerpt
from mailquarry.operators.postings import build_postings, lookup, write_postings
from mailquarry.plans.query import parse
from mailquarry.plans.search import Request, candidates, ranks, search, with_snippets
from mailquarry.plans.sorting import KEYS
from mailquarry.sources.case import Case

MESSAGES = [
    (1, "Budget annuel", "Anne a@x.fr", "Bob b@y.fr", "Le réunion du comité", "plan.pdf"),
    (2, "Autre", "Bob b@y.fr", "Anne a@x.fr", "accord de confidentialité signé", None),
    (3, "RE: Budget", "Carl c@z.fr", "", "le comité de budget budget", "budget.xls"),
    (4, None, None, None, None, None),
    (5, "Отчёт", "Ева", "", "годовой отчёт ё", ""),
]
ATTACHMENTS = [(1, "0", "plan.pdf", "contrat confidentiel budget"), (2, "0", "scan.png", None), (4, "0", "tahoe.txt", "seulement ici"), (4, "1", None, "comité")]


@pytest.fixture(scope="module")
def case(spark):
    m = spark.createDataFrame([(*r, 100 - r[0], 10 * r[0]) for r in MESSAGES], "id long, subject string, sender string, recipients string, body string, attachments string, date_ms long, size long")
    return Case(m.cache(), spark.createDataFrame(ATTACHMENTS, "message_id long, idx_path string, name string, content string"))


def ids(case, text, **scope):
    return sorted(r.id for r in candidates(case, parse(text), Request(query=text, **scope)).select("id").collect())


@pytest.mark.parametrize(("text", "want"), [
    ("budget", [1, 3]), ("REUNION", [1]), ("réunion", [1]), ('"accord de confidentialité"', [2]), ('"de accord"', []), ("confid*", [1, 2]), ("pj:plan", [1]), ("de:bob", [2]), ("a:anne", [2]), ("objet:budget", [1, 3]),
    ("corps:budget", [3]), ("budget -comité", []), ("budget -contrat", [3]), ("tahoe OR accord", [2, 4]), ("отчёт", [5]), ("отчет", []), ("comité ici", [4]), ("pjtexte:budget", [1]), ("pjtexte:plan", []), ("corps:ici", []),
    ('a"b (c* OR) NEAR/2 : ^x', []), ("", [1, 2, 3, 4, 5]), ('"de budget"', [3]), ("b@y.fr", [1, 2]),
])
def test_family_search(case, text, want):
    assert ids(case, text) == want


def test_negative_only_is_refused(case):
    with pytest.raises(ValueError):
        ids(case, "-budget")
    assert ids(case, "-budget apres:1970-01-01") == [2, 4, 5]


def test_ranks_match_the_engine_they_come_from(spark):
    rng = random.Random(4)
    words = ["budget", "accord", "plan", "reunion", "note", "de", "la"]
    rows = [(i, *(" ".join(rng.choices(words, k=rng.randint(0, n))) for n in (4, 2, 2, 30, 2))) for i in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(subject, sender, recipients, body, attachments, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO f(rowid, subject, sender, recipients, body, attachments) VALUES (?,?,?,?,?,?)", rows)
    m = spark.createDataFrame(rows, "id long, subject string, sender string, recipients string, body string, attachments string")
    none = spark.createDataFrame([], "message_id long, idx_path string, name string, content string")
    for text, match in (("budget", '"budget"'), ("accord OR plan", '("accord" OR "plan")'), ("objet:note", 'subject:"note"'), ('"de la"', '"de la"'), ("reu*", '"reu"*')):
        want = dict(db.execute("SELECT rowid, bm25(f, 5.0, 3.0, 2.0, 1.0, 2.0) FROM f WHERE f MATCH ?", (match,)).fetchall())
        got = {r.id: r.rank for r in ranks(Case(m, none), parse(text)).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_relevance_order_and_pages(case):
    assert [r.id for r in search(case, Request(query="budget OR tahoe", sort="relevance")).collect()] == [3, 1, 4]
    assert [r.id for r in search(case, Request(query="pjtexte:budget", sort="relevance")).collect()] == [1]
    pages = [r.id for k in range(3) for r in search(case, Request(sort="size:asc", limit=2, offset=2 * k)).collect()]
    assert pages == [1, 2, 3, 4, 5]


def test_all_sort_keys(case):
    for key in KEYS:
        assert search(case, Request(sort=key, limit=3)).count() == 3
    order = [r.subject for r in search(case, Request(sort="subject")).collect()]
    assert order == [None, "Autre", "Budget annuel", "RE: Budget", "Отчёт"]


def test_snippets(case):
    page = search(case, Request(query="comité OR ici OR autre", sort="date"))
    got = {r.id: r.snippet for r in with_snippets(case, page, "comité OR ici OR autre").collect()}
    assert got == {1: "Le réunion du «comité»", 3: "le «comité» de budget budget", 4: "📎 tahoe.txt : seulement «ici»", 2: "accord de confidentialité signé"}


def test_excerpts_match_the_engine_they_come_from():
    """Words, phrases and prefixes in random texts, against the full-text engine of the standard library."""
    rng = random.Random(8)
    words = ["budget", "accord", "accords", "plan", "de", "la", "note", "Réunion"] + [f"mot{k}" for k in range(30)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(body, tokenize='unicode61 remove_diacritics 2')")
    texts = []
    for i in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", ". ", ": ", "\n"]) for _ in range(rng.choice([5, 15, 40, 120])))
        texts.append(text)
        db.execute("INSERT INTO f(rowid, body) VALUES (?, ?)", (i, text))
    for match, terms in [('"budget"', [(["budget"], False)]), ('"plan" OR "accord"*', [(["plan"], False), (["accord"], True)]), ('"de la" OR "reunion"', [(["de", "la"], False), (["reunion"], False)]), ('"note" OR "mot1"*', [(["note"], False), (["mot1"], True)])]:
        want = dict(db.execute("SELECT rowid, snippet(f, 0, '«', '»', '…', 16) FROM f WHERE f MATCH ?", (match,)).fetchall())
        got = {i: e for i, t in enumerate(texts) if (e := excerpt(t, terms)) is not None}
        assert got.keys() == want.keys()
        assert {i: " ".join(w.split()) for i, w in want.items()} == got


def test_postings(spark, case, tmp_path):
    index = build_postings(case.messages.select("id", "subject", "body"), ["subject", "body"])
    write_postings(index, str(tmp_path / "index"), 2)
    index = spark.read.parquet(str(tmp_path / "index"))
    find = lambda *a, **k: sorted(r.id for r in lookup(index, *a, **k).collect())
    assert find(["budget"]) == [1, 3] and find(["de", "budget"]) == [3] and find(["confid"], prefix=True) == [2] and find(["budget"], fields=["body"]) == [3] and find([]) == [] and find(["comite", "de", "bud"], prefix=True) == [3]
    plan = lookup(index, ["budget"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(initial" in plan and "PushedFilters: [IsNotNull(token), EqualTo(token,budget)]" in plan


def test_index_finds_what_search_finds(spark, case, tmp_path):
    from mailquarry.plans.indexed import found_ids, read_index, write_index

    write_index(case, str(tmp_path / "whole"), 2)
    index = read_index(spark, str(tmp_path / "whole"))
    for text in ["budget", '"accord de confidentialité"', "confid*", "pj:plan", "budget -comité", "budget -contrat", "tahoe OR accord", "comité ici", "pjtexte:budget", "objet:budget", '"de budget"', "pjtexte:plan", "corps:ici"]:
        assert sorted(r.id for r in found_ids(index, parse(text)).collect()) == ids(case, text)
    with pytest.raises(ValueError):
        found_ids(index, parse("-budget"))


def test_pages_by_cursor(spark):
    """Chained pages are the whole order, for every key and both directions, with nulls and ties."""
    import random

    from mailquarry.plans.search import Request, pages, search
    from mailquarry.plans.sorting import KEYS
    from mailquarry.sources.case import Case
    from pyspark.sql import types as T

    rng = random.Random(3)
    columns = sorted({c for c, _, _ in KEYS.values()} - {"date_ms"})
    texts = {c for c, folded, _ in KEYS.values() if folded} | {"auth_spf"}
    fields = [T.StructField("id", T.LongType()), T.StructField("date_ms", T.LongType())] + [T.StructField(c, T.StringType() if c in texts else T.LongType()) for c in columns]
    value = lambda c: rng.choice([None, *("aBc" if c in texts else (0, 1, 2))])
    rows = [(i, rng.choice([None, 5, 6]), *(value(c) for c in columns)) for i in range(23)]
    case = Case(spark.createDataFrame(rows, T.StructType(fields)).coalesce(1), spark.createDataFrame([], "message_id long, idx_path string, name string, content string"))
    for k, key in enumerate(KEYS):
        r = Request(sort=f"{key}:{'asc' if k % 2 else 'desc'}", limit=9)
        whole = [x.id for x in search(case, Request(sort=r.sort, limit=None)).collect()]
        got = [[x.id for x in p.collect()] for p in pages(case, r)]
        assert [len(p) for p in got] == [9, 9, 5] and sum(got, []) == whole, r.sort
    for sort in ("date:asc", "date:desc"):
        assert sum(([x.id for x in p.collect()] for p in pages(case, Request(sort=sort, limit=7))), []) == [x.id for x in search(case, Request(sort=sort, limit=None)).collect()]


def test_pages_by_relevance(spark):
    from mailquarry.plans.search import Request, pages, search
    from mailquarry.sources.case import Case

    m = spark.createDataFrame([(i, "the " * (i % 3), "other the", i % 2) for i in range(12)], "id long, subject string, body string, date_ms long")
    case = Case(m, spark.createDataFrame([(3, "0", "the.txt", "")], "message_id long, idx_path string, name string, content string"))
    for q in ("the", "pj:the"):
        assert sum(([x.id for x in p.collect()] for p in pages(case, Request(query=q, sort="relevance", limit=5))), []) == [x.id for x in search(case, Request(query=q, sort="relevance", limit=None)).collect()]


def test_marks_of_embedded_messages(spark):
    from mailquarry.plans.search import family_marks
    from pyspark.sql import functions as F

    a = spark.createDataFrame([(1, "0", "x"), (1, "1", "y"), (1, "1/0", "z"), (1, "1/0/2", "hit"), (1, "10", "x"), (2, "1", "hit"), (2, "1/0", None), (3, "1", "x")], "message_id long, idx_path string, t string")
    got = {(r.message_id, r.idx_path): (r.hit, r.below) for r in family_marks(a, F.col("t") == "hit").collect()}
    assert {k for k, (h, _) in got.items() if h} == {(1, "1/0/2"), (2, "1")} and {k for k, (_, b) in got.items() if b} == {(1, "1"), (1, "1/0")} and len(got) == 8


def test_words_of_excerpts_share_one_fold_table(monkeypatch):
    """Words are folded one by one, so a table made for each of them took 0.4 ms a word."""
    from mailquarry.functions import text

    made = []
    plain = text.fold_table
    text.fold_map.cache_clear()
    monkeypatch.setattr(text, "fold_table", lambda: made.append(1) or plain())
    long = " ".join(["mot élan Été ELLE"] * 500)
    assert excerpt(long, [(["elle"], False), (["ete"], False)], 4) == "mot élan «Été» «ELLE»…"
    assert len(made) <= 1


def test_vocabulary_groups_by_token_alone(spark):
    """No aggregate holds pairs of token and id; rows of one id count as one message, rows without an id as none."""
    from mailquarry.plans.queries_search import vocabulary

    df = vocabulary(spark.createDataFrame([(1, "a b a"), (1, "a c"), (2, "b"), (None, "b d"), (3, None), (4, "")], "id long, body string"))
    assert {r.token: (r.n, r.docs) for r in df.collect()} == {"a": (3, 1), "b": (3, 2), "c": (1, 1), "d": (1, 0)}
    once = vocabulary(spark.createDataFrame([(1, "a b a"), (2, "b")], "id long, body string"))
    assert {r.token: (r.n, r.docs) for r in once.collect()} == {"a": (2, 1), "b": (2, 2)}
    keys = [line for line in once._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [" in line]
    assert keys and all("id#" not in line.split("]")[0] for line in keys)


def test_large_pages_have_no_task_with_all_rows(spark, monkeypatch):
    """Pages beyond TOP are those of Spark's limit, with nulls and equal keys, and are sorted by an exchange."""
    from mailquarry.plans import search as S

    rows = [(i, None if i % 4 == 0 else f"s{i % 3}", i % 5 if i % 7 else None) for i in range(60)]
    case = Case(spark.createDataFrame(rows, "id long, subject string, date_ms long"), spark.createDataFrame([], "message_id long, idx_path string, name string, content string"))
    twice = Case(case.messages.union(case.messages), case.attachments)
    asked = [(case, Request(sort=s, limit=n, offset=o)) for s, n, o in (("subject", 20, 0), ("subject:desc", 25, 17), ("date", 30, 50))]
    asked += [(twice, Request(sort="subject", limit=21, offset=0)), (case, Request(sort="date", limit=5, offset=80))]
    small = [[x.id for x in S.search(c, r).collect()] for c, r in asked]
    monkeypatch.setattr(S, "TOP", 4)
    assert [[x.id for x in S.search(c, r).collect()] for c, r in asked] == small
    plan = S.search(*asked[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Sort [" in plan
