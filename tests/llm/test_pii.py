import random
import re
import time
from datetime import date

import pytest
from mailquarry.llm import pii

F = pii.Feistel(b"k")


@pytest.mark.parametrize(("radix", "length"), [(10, 1), (10, 2), (10, 3), (26, 2), (2, 7), (10, 4)])
def test_permutation(radix, length):
    n = radix**length
    image = [F.power(x, radix, length, "t") for x in range(n)]
    assert sorted(image) == list(range(n)) and image != list(range(n))
    assert [F.power(y, radix, length, "t", True) for y in image] == list(range(n))


def test_ranges_and_keys():
    image = [F.below(x, 777, "t") for x in range(777)]
    assert sorted(image) == list(range(777))
    assert [F.below(y, 777, "t", True) for y in image] == list(range(777))
    assert [pii.Feistel(b"other").below(x, 777, "t") for x in range(777)] != image
    assert [F.below(x, 777, "u") for x in range(777)] != image


VALUES = {
    "card": ["4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "340000000000009"],
    "iban": ["FR14 2004 1010 0505 0001 3M02 606", "DE89370400440532013000"],
    "email": ["jean.martin42@mail.example.com", "A_b+c@x.org"],
    "ssn": ["123-45-6789"],
    "ip": ["129.38.82.176", "10.0.0.1"],
    "date": ["2024-02-29", "31/12/1999", "7.10.2025", "12/31/1999"],
    "phone": ["+1 (017) 555-7713", "+33612345678", "(212) 555-0100", "212-555-0100"],
}


@pytest.mark.parametrize(("kind", "value"), [(k, v) for k, vs in VALUES.items() for v in vs])
def test_values_keep_their_format(kind, value):
    text = f"é before {value}, after."
    out, spans = pii.pseudonymise(F, text)
    assert [(k, text[s:e]) for s, e, k in spans] == [(kind, value)]
    new = out.removeprefix("é before ").removesuffix(", after.")
    assert new != value and value not in out
    assert [k for _, _, k in pii.pseudonymise(F, out)[1]] == [kind]
    if kind != "ip":
        shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))
        assert shape(new) == shape(value)
    assert pii.pseudonymise(F, out, True)[0] == text
    if kind == "date":
        nums = list(map(int, re.split(r"\D", new)))
        date(*nums) if len(new.split("-")[0]) == 4 else date(nums[2], *sorted(nums[:2]))


def test_equal_values_stay_linked():
    digits = lambda s: re.sub(r"\D", "", pii.pseudonymise(F, s)[0])
    assert digits("4111 1111 1111 1111") == digits("x 4111-1111-1111-1111 y") == digits("4111111111111111")
    assert digits("+1 (017) 555-7713") == digits("+1 017 555 7713")
    assert digits("+14155552671") == digits("+1 415 555 2671") == "1" + digits("415-555-2671") == digits("+1 (415) 555-2671")
    assert digits("+33612345678") == digits("+33 6 12 34 56 78") and digits("+33612345678")[:2] == "33"
    assert digits("+352621123456") == digits("+352 621 123 456") and digits("+352621123456")[:3] == "352"
    assert len({digits(f"+1 (017) 555-{i:04d}") for i in range(300)}) == 300
    one, two = (pii.pseudonymise(F, s)[0] for s in ("Jean.Martin@Example.org", "write jean.martin@example.ORG"))
    assert one.lower() == two.removeprefix("write ").lower() and "example" not in one.lower() and one.endswith(".org")


def _day_of(text, order):
    own = dict(zip(order, map(int, re.split(r"\D", text)), strict=True))
    return own["y"], own["m"], own["d"]


def test_dates_against_brute_force():
    """Every day of some years: one permutation, the same in every way to write it, that can be undone and is read in its order."""
    seen = set()
    for k in range(0, pii.DAYS, 7):
        d = pii.FIRST + pii.timedelta(days=k)
        ways = [(f"{d:%Y-%m-%d}", "ymd"), (f"{d.year}/{d.month}/{d.day}", "ymd"), (f"{d:%d.%m.%Y}", "dmy"), (f"{d.day}/{d.month}/{d.year}", "dmy")]
        if d.day > 12:
            ways.append((f"{d:%m/%d/%Y}", "mdy"))
        out = [pii.pseudonymise(F, w)[0] for w, _ in ways]
        assert [len(o) for o in out] == [len(w) for w, _ in ways]
        assert len({_day_of(o, order) for o, (_, order) in zip(out, ways, strict=True)}) == 1
        assert [pii.pseudonymise(F, o, True)[0] for o in out] == [w for w, _ in ways]
        seen.add(_day_of(out[0], "ymd"))
    assert len(seen) == len(range(0, pii.DAYS, 7))


def _overlapping(text):
    """The spans by the rule, looking at all found so far each time."""
    found = []
    for kind, regex, change in pii.KINDS:
        for m in regex.finditer(text):
            if not any(m.start() < e and s < m.end() for s, e, _ in found) and change(F, m.group(), False) is not None:
                found.append((m.start(), m.end(), kind))
    return sorted(found)


def test_spans_match_brute_force():
    rng = random.Random(4)
    pieces = [v for vs in VALUES.values() for v in vs] + ["129.38.82.176@mail.example.com", "4111 1111 1111 1112", "x", ",", "12", "@", "-", "2024-02-30"]
    for _ in range(300):
        text = "".join(rng.choice(pieces) + rng.choice([" ", " ", ", ", "", "\n"]) for _ in range(rng.randint(1, 12)))
        assert pii.pseudonymise(F, text)[1] == _overlapping(text)


def test_many_values_in_one_text():
    text = " ".join(f"user{k}@mail.example.org 2024-02-{k % 28 + 1:02d}" for k in range(20_000))
    at = time.perf_counter()
    assert len(pii.pseudonymise(F, text)[1]) == 40_000
    assert time.perf_counter() - at < 30


@pytest.mark.parametrize("text", [None, "", "no values", "4111 1111 1111 1112", "9807915762804490", "FR15 2004 1010 0505 0001 3M02 606", "2023-02-29", "1.2.3", "256.1.1.1", "000-12-3456",
                                  "deadbeef41111111111111111", "version 3.14", "a@b", "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"])
def test_others_stay(text):
    assert pii.pseudonymise(F, text) == (text, [])


def test_overlaps_go_to_the_first_kind():
    text = "mail 129.38.82.176@mail.example.com now"
    out, spans = pii.pseudonymise(F, text)
    assert [k for _, _, k in spans] == ["email"]


def test_mask_private(spark):
    rows = [(1, "call +1 (017) 555-7713"), (2, None), (3, ""), (None, "129.38.82.176"), (1, "call +1 (017) 555-7713"), (4, "x " * 60000 + "a.b@c.org")]
    got = pii.mask_private(spark.createDataFrame([(t, i, "q") for i, t in rows], "text string, doc_id long, Doc_Id_ string"), b"k").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text is None, r.n_values, r.n_phone) for r in got) == [
        (False, 1, False, 1, 1), (False, 1, False, 1, 1), (False, 2, True, 0, 0), (False, 3, False, 0, 0), (False, 4, False, 1, 0), (True, 0, False, 1, 0)]
    want = dict((t, pii.pseudonymise(F, t)[0]) for _, t in rows)
    assert {r.text for r in got} == set(want.values())
    assert pii.mask_private(spark.createDataFrame([], "doc_id long, text string"), b"k").count() == 0
