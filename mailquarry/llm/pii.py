"""Personal data replaced by format-preserving pseudonyms.

Candidates are found by expressions and then validated: payment cards by check digit and issuer, IBANs by
their checksum, addresses and dates by their ranges. A validated value is permuted by a keyed Feistel network
within its own format, so it stays valid, differs from other values' pseudonyms, and the same value has the same
pseudonym in every document, however it is punctuated. The permutation can be undone with the key.

What stays of a value: the issuer's class of a card, the country of an IBAN or a telephone number, the last label of a
mail domain, case and punctuation, and of a date whether day and month have one digit and whether the day is above 12, so
that every way to write it has the width it had and is read in the same order. Mail addresses count as equal whatever
their case, dates whatever their order and padding, telephone numbers of the form 415-555-0100 as those of country 1.

Nothing is shared between rows, so there is no shuffle. Defined results: a null text stays null, an empty one
empty; text outside the spans is untouched; candidates that fail validation stay as they are. Repeated rows and
null ids are treated like any other row. Overlaps go to the kind that is listed first, then to the leftmost. A very long
text takes time in proportion to its length and its values. An empty table gives no rows. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import only, parts, table

#: The key of the registered query. Real runs pass their own.
DEMO_KEY = b"demonstration key, not a secret"
ROUNDS = 10


class Feistel:
    """Keyed permutation of the numbers below radix ** length, and of any range within (by cycle walking)."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: str, i: int, half: int, modulus: int) -> int:
        h = hashlib.blake2b(f"{tweak}|{i}|{half}".encode(), key=self.key, digest_size=32).digest()
        return int.from_bytes(h, "big") % modulus

    def power(self, x: int, radix: int, length: int, tweak: str, back: bool = False) -> int:
        """Alternating halves of length // 2 and the rest, each in turn shifted by a hash of the other."""
        if length < 2:
            shift = self._round(tweak, 0, length, radix**length)
            return (x - shift if back else x + shift) % radix**length
        u = radix ** (length // 2)
        v = radix ** (length - length // 2)
        a, b = divmod(x, v)  # a below u, b below v
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if i % 2:
                f = self._round(tweak, i, a, v)
                b = (b - f if back else b + f) % v
            else:
                f = self._round(tweak, i, b, u)
                a = (a - f if back else a + f) % u
        return a * v + b

    def below(self, x: int, size: int, tweak: str, back: bool = False) -> int:
        length = max(2, (size - 1).bit_length())
        while True:
            x = self.power(x, 2, length, tweak, back)
            if x < size:
                return x

    def string(self, s: str, alphabet: str, tweak: str, back: bool = False) -> str:
        radix, x = len(alphabet), 0
        for c in s:
            x = x * radix + alphabet.index(c)
        x = self.power(x, radix, len(s), f"{tweak}|{len(s)}", back)
        out = []
        for _ in s:
            x, r = divmod(x, radix)
            out.append(alphabet[r])
        return "".join(reversed(out))


DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def refill(shape: str, new: str, of: Callable[[str], bool] = str.isdigit) -> str:
    """shape with the characters that `of` names replaced, in order, by those of new."""
    it = iter(new)
    return "".join(next(it) if of(c) else c for c in shape)


def by_class(f: Feistel, s: str, tweak: str, back: bool = False) -> str:
    """Digits, capitals and small letters permuted each among themselves."""
    for name, alphabet in (("d", DIGITS), ("u", UPPER), ("l", LOWER)):
        own = "".join(c for c in s if c in alphabet)
        if own:
            s = refill(s, f.string(own, alphabet, f"{tweak}.{name}", back), lambda c, a=alphabet: c in a)
    return s


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c)
        total += d if i % 2 else d * 2 - 9 * (d > 4)
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def card(f: Feistel, s: str, back: bool = False) -> str | None:
    n = re.sub(r"\D", "", s)
    if not 13 <= len(n) <= 19 or n[0] not in "23456" or luhn_digit(n[:-1]) != n[-1]:
        return None
    body = n[0] + f.string(n[1:-1], DIGITS, "card" + n[0], back)  # the issuer's class stays
    return refill(s, body + luhn_digit(body))


def iban(f: Feistel, s: str, back: bool = False) -> str | None:
    n = s.replace(" ", "")
    if not 15 <= len(n) <= 34 or iban_check(n[:2], n[4:]) != n[2:4]:
        return None
    rest = by_class(f, n[4:], "iban" + n[:2], back)
    return refill(s, n[:2] + iban_check(n[:2], rest) + rest, lambda c: c != " ")


def ssn(f: Feistel, s: str, back: bool = False) -> str | None:
    def valid(n: str) -> bool:
        return n[:3] not in ("000", "666") and n[0] != "9" and n[3:5] != "00" and n[5:] != "0000"

    n = s.replace("-", "")
    if not valid(n):
        return None
    while True:
        n = f.string(n, DIGITS, "ssn", back)
        if valid(n):
            return refill(s, n)


def _cased(shape: str, new: str) -> str:
    return "".join(c.upper() if o.isupper() else c for o, c in zip(shape, new, strict=True))


def email(f: Feistel, s: str, back: bool = False) -> str | None:
    local, _, domain = s.lower().rpartition("@")
    if not local:
        return None
    labels = domain.split(".")
    hosts = [by_class(f, x, "host", back) for x in labels[:-1]]
    return _cased(s, f"{by_class(f, local, 'mail', back)}@{'.'.join([*hosts, labels[-1]])}")


def ipv4(f: Feistel, s: str, back: bool = False) -> str | None:
    parts = [int(x) for x in s.split(".")]
    if max(parts) > 255:
        return None
    n = 0
    for p in parts:
        n = n << 8 | p
    n = f.below(n, 1 << 32, "ip", back)
    return ".".join(str(n >> k & 255) for k in (24, 16, 8, 0))


#: The country calling codes of one and of two digits; all others have three.
CALLING_1 = ("1", "7")
CALLING_2 = ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
             "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")


def phone(f: Feistel, s: str, back: bool = False) -> str | None:
    n = re.sub(r"\D", "", s)
    if not 8 <= len(n) <= 15:
        return None
    if s[0] == "+":
        keep = 1 if n[:1] in CALLING_1 else 2 if n[:2] in CALLING_2 else 3
        country = n[:keep]
    else:
        keep, country = 0, "1" if len(n) == 10 else ""
    return refill(s, n[:keep] + f.string(n[keep:], DIGITS, "phone" + country, back))


FIRST, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def _class_of(d: date) -> tuple[int, bool]:
    """What of a date stays: whether the day has one digit, can be a month or neither, and whether the month has one digit."""
    return (d.day > 9) + (d.day > 12), d.month > 9


@cache
def _days(kind: tuple[int, bool]) -> list[int]:
    """The days since FIRST of a class, in order."""
    return [k for k in range(DAYS) if _class_of(FIRST + timedelta(days=k)) == kind]


def day(f: Feistel, s: str, back: bool = False) -> str | None:
    a, mark, b, _, c = re.match(r"(\d+)([-/.])(\d+)([-/.])(\d+)", s).groups()
    for order in ["ymd"] if len(a) == 4 else ["dmy", "mdy"]:
        own = dict(zip(order, (a, b, c), strict=True))
        try:
            at = date(int(own["y"]), int(own["m"]), int(own["d"]))
        except ValueError:
            continue
        k = (at - FIRST).days
        if not 0 <= k < DAYS:
            continue
        domain = _days(_class_of(at))
        new = FIRST + timedelta(days=domain[f.below(bisect_left(domain, k), len(domain), f"day{_class_of(at)}", back)])
        out = {"y": f"{new.year:04d}", "m": str(new.month).zfill(len(own["m"])), "d": str(new.day).zfill(len(own["d"]))}
        return mark.join(out[x] for x in order)
    return None


#: Kind, expression and pseudonym, by precedence.
KINDS: list[tuple[str, re.Pattern, Callable]] = [
    ("iban", re.compile(r"(?<![\w])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8}(?!\w)", re.A), iban),
    ("card", re.compile(r"(?<![\w.+-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\w-]|\.[0-9])", re.A), card),
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9_.+-]*[A-Za-z0-9_+-]@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w-])", re.A), email),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", re.A), ssn),
    ("ip", re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])", re.A), ipv4),
    ("date", re.compile(r"(?<![\w./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![\w]|[./-][0-9])", re.A), day),
    ("phone", re.compile(r"(?<![\w.+-])(?:\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9](?:[\x20.-]?[0-9]){5,12}|\([0-9]{2,4}\)\x20?[0-9]{3,4}[\x20.-]?[0-9]{3,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\w-]|\.[0-9])", re.A), phone),
]

_MAY = re.compile(r"[0-9@]")


def pseudonymise(f: Feistel, text: str | None, back: bool = False) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and start, end and kind of each value in the original."""
    if not text or not _MAY.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []  # by start, none over another
    for kind, regex, change in KINDS:
        if kind == "email" and "@" not in text:
            continue
        fresh, k = [], 0
        for m in regex.finditer(text):
            while k < len(found) and found[k][1] <= m.start():
                k += 1
            if k < len(found) and found[k][0] < m.end():
                continue
            new = change(f, m.group(), back)
            if new is not None:
                fresh.append((m.start(), m.end(), kind, new))
        if fresh:
            found = sorted(found + fresh)
    pieces, at = [], 0
    for s, e, _, new in found:
        pieces += [text[at:s], new]
        at = e
    return "".join([*pieces, text[at:]]), [(s, e, k) for s, e, k, _ in found]


SCHEMA = "doc_id long, text string, n_values long, " + ", ".join(f"n_{k} long" for k, _, _ in KINDS) + ", spans string"


def _masking(key: bytes):
    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for b in parts(batches):
            out = [pseudonymise(f, t) for t in b.column(1).to_pylist()]
            kinds = [[k for _, _, k in spans] for _, spans in out]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([t for t, _ in out], pa.string()), pa.array(map(len, kinds), pa.int64()),
                 *(pa.array([ks.count(k) for ks in kinds], pa.int64()) for k, _, _ in KINDS),
                 pa.array([",".join(f"{k}:{s}:{e}" for s, e, k in spans) for _, spans in out], pa.string())],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return mask


def mask_private(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, the text with pseudonyms, the number of values in all and by kind, and their spans
    ('kind:start:end' in code points of the original) of every row of docs."""
    return only(docs, "doc_id", "text").mapInArrow(_masking(key), SCHEMA)


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_private(table(spark, sf_dir, "documents"), DEMO_KEY)
