from datetime import date

import pytest
from mailquarry.functions.text import fold_text, split_tokens
from mailquarry.plans.query import ANY, CONTENT, NAME, SUBJECT, TO, parse
from mailquarry.plans.search import Request, errors
from mailquarry.plans.sorting import KEYS, parse_sort


def shape(text):
    q = parse(text)
    return [[t.text for t in c.alternatives] for c in q.positive], [c.alternatives[0].text for c in q.negative]


@pytest.mark.parametrize(("text", "want"), [
    ("budget accord", ([["budget"], ["accord"]], [])),
    ("a OR b c", ([["a", "b"], ["c"]], [])),
    ("a OU b | c", ([["a", "b", "c"]], [])),
    ("a or b", ([["a"], ["or"], ["b"]], [])),
    ("OR x", ([["x"]], [])),
    ("a OR -b c", ([["a"], ["c"]], ["b"])),
    ("a OR spf:fail b", ([["a", "b"]], [])),
    ("-x", ([], ["x"])),
    ("- x", ([["x"]], [])),
    ('"a b', ([["a b"]], [])),
    ("!!! ...", ([], [])),
    ("de: dupont", ([["dupont"]], [])),
    ("", ([], [])),
    (None, ([], [])),
])
def test_clauses(text, want):
    assert shape(text) == want


def test_terms():
    t = [c.alternatives[0] for c in parse('objet:"plan b"* à:bob pj:x* pjtexte:y foo:bar z**').positive]
    assert [(x.text, x.field, x.phrase, x.prefix) for x in t] == [("plan b", SUBJECT, True, True), ("bob", TO, False, False), ("x", NAME, False, True), ("y", CONTENT, False, False), ("foo:bar", ANY, False, False), ("z", ANY, False, True)]
    assert parse('"accord de confid"* x').highlight == ["accord*", "de*", "confid*", "x"]


def test_dates_and_filters():
    q = parse("avant:2024 AVANT:2024-3-5 apres:01/02/2023 -after:2022-05 avant:hier indice:AUTH -spf:échec fil:12")
    assert (q.before, q.after) == (date(2024, 3, 5), date(2022, 5, 1))
    assert shape("avant:hier")[0] == [["avant:hier"]]
    assert [(f.field, f.value, f.negated) for f in q.filters] == [("indice", "auth", False), ("spf", "fail", True), ("fil", "12", False)]
    assert len(parse("indice:inconnu fil:abc spf:bizarre").errors) == 3


def test_refused():
    assert errors(parse("-x"), Request()) and not errors(parse("-x avant:2020"), Request()) and not errors(parse("-x indice:auth"), Request())
    assert not errors(parse("-x"), Request(date_to=date(2024, 1, 1)))


def test_odd_input_never_fails():
    for text in ['a"b (c* OR) NEAR/2 : ^x', ":", "::", '"', "-", "--", "a:", '""', "*", "-*", "avant:", "indice:", 'de:"', "-de:x OR y"]:
        parse(text)


def test_sort_specs():
    assert len(KEYS) == 27
    assert parse_sort("size") == ("size", True) and parse_sort("size:asc") == ("size", False) and parse_sort("nothing") == ("date", True) and parse_sort("SubjectAsc") == ("subject", False)
    assert parse_sort("subject:up") == ("date", True) and parse_sort(None) == ("date", True)


def test_tokens():
    assert split_tokens("foo_bar x1y2 a-b c.d@e.fr 12,50") == ["foo", "bar", "x1y2", "a", "b", "c", "d", "e", "fr", "12", "50"]
    assert split_tokens("O'Neil soft­hyphen 日本語 テスト") == ["o", "neil", "soft", "hyphen", "日本語", "テスト"]
    assert [fold_text(x) for x in ("Σας", "İ", "Straße", "Œuvre", "Àéroport", "ấ", "Ёй", "ά", "Øđ", "µ")] == ["σασ", "i", "straße", "œuvre", "aeroport", "a", "ёй", "ά", "øđ", "μ"]
