"""The query language: lexer and parser, without Spark.

    word word        all are required, accents and case ignored
    "some phrase"    tokens in a row;  word* and "some phr"* are prefixes
    a OR b           either (also OU and |); binds to the clause before it
    -word            excluded
    field:word       de/from, a/to/cc/dest, objet/subject, corps/body, pj/attachment, pjtexte/attachmenttext
    avant:/apres:    date bounds (before:/after:)
    indice: spf: dkim: dmarc: fil:    filters on what the analysis found

A clause must be met by the message or by one of its attachments.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date

from mailquarry.functions.dates import parse_day

ANY, FROM, TO, SUBJECT, BODY, NAME, CONTENT = "any", "sender", "recipients", "subject", "body", "attachments", "content"

#: The words that name a field.
FIELDS = {
    "from": FROM, "de": FROM, "expediteur": FROM, "expéditeur": FROM,
    "to": TO, "a": TO, "à": TO, "cc": TO, "dest": TO, "destinataire": TO,
    "subject": SUBJECT, "objet": SUBJECT, "sujet": SUBJECT,
    "body": BODY, "corps": BODY, "texte": BODY,
    "attachment": NAME, "attach": NAME, "pj": NAME, "fichier": NAME,
    "attachmenttext": CONTENT, "pjtexte": CONTENT, "pjcontenu": CONTENT, "contenupj": CONTENT,
}
BEFORE, AFTER = ("avant", "before"), ("apres", "après", "after")
FILTERS = ("indice", "spf", "dkim", "dmarc", "fil")

#: Names of the flags that can be asked for, with their column and bits.
INDICES = {
    "usurpation": ("spoof_flags", 63),
    "replyto": ("spoof_flags", 1),
    "returnpath": ("spoof_flags", 2),
    "nomtrompeur": ("spoof_flags", 36),
    "domaine": ("spoof_flags", 8),
    "auth": ("spoof_flags", 16),
    "dates": ("date_flags", 127),
    "sensible": ("sens_flags", 15),
    "iban": ("sens_flags", 1),
    "carte": ("sens_flags", 2),
    "secu": ("sens_flags", 4),
    "tel": ("sens_flags", 8),
}
VERDICTS = ("pass", "fail", "softfail", "neutral", "none", "temperror", "permerror", "absent")
OR_WORDS = ("OR", "OU", "|")


@dataclass(frozen=True)
class Term:
    text: str
    field: str = ANY
    phrase: bool = False
    prefix: bool = False


@dataclass
class Clause:
    """Met if one of the alternatives is; a negated clause excludes what it matches."""

    alternatives: list[Term]
    negated: bool = False


@dataclass(frozen=True)
class Filter:
    field: str
    value: str
    negated: bool = False


@dataclass
class Query:
    positive: list[Clause] = field(default_factory=list)
    negative: list[Clause] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    highlight: list[str] = field(default_factory=list)
    after: date | None = None
    before: date | None = None


_HEAD = re.compile(r'([^\s":]+):')
_LUMP = re.compile(r"\S*")


def _term(text: str, **kind) -> Term | None:
    text = text.replace('"', " ").strip()
    return Term(text, **kind) if any(c.isalnum() for c in text) else None


def _add_filter(q: Query, name: str, raw: str, negated: bool) -> None:
    value = raw.strip().lower()
    if name == "indice" and value not in INDICES:
        q.errors.append(f"unknown flag '{raw}'; known are {', '.join(INDICES)}")
    elif name == "fil" and not re.fullmatch(r"[+-]?\d+", value, re.ASCII):
        q.errors.append(f"fil: takes the number of a thread, not '{raw}'")
    else:
        if name not in ("indice", "fil"):
            value = "fail" if value in ("echec", "échec") else value
            if value not in VERDICTS:
                q.errors.append(f"unknown result '{raw}' for {name}; known are {', '.join(VERDICTS)}")
                return
        q.filters.append(Filter(name, value, negated))


def parse(text: str | None) -> Query:
    q = Query()
    s, i, joining = text or "", 0, False
    while True:
        while i < len(s) and s[i].isspace():
            i += 1
        if i >= len(s):
            return q
        negated = s[i] == "-" and i + 1 < len(s) and not s[i + 1].isspace()
        i += negated
        where = ANY
        head = _HEAD.match(s, i)
        if head:
            name = head.group(1).lower()
            lump = _LUMP.match(s, head.end())
            if name in BEFORE + AFTER:
                day = parse_day(lump.group())
                if day:
                    if name in BEFORE:
                        q.before = day
                    else:
                        q.after = day
                    i = lump.end()
                    continue
            elif name in FILTERS:
                _add_filter(q, name, lump.group(), negated)
                i = lump.end()
                continue
            elif name in FIELDS:
                where, i = FIELDS[name], head.end()
        if i < len(s) and s[i] == '"':
            end = s.find('"', i + 1)
            end = len(s) if end < 0 else end
            body, i = s[i + 1 : end], min(len(s), end + 1)
            prefix = i < len(s) and s[i] == "*"
            i += prefix
            term = _term(body, field=where, phrase=True, prefix=prefix)
        else:
            lump = _LUMP.match(s, i)
            body, i = lump.group(), lump.end()
            if not negated and where == ANY and body in OR_WORDS:
                joining = bool(q.positive)
                continue
            term = _term(body.rstrip("*") if body.endswith("*") else body, field=where, prefix=body.endswith("*"))
        if term is None:
            continue
        if negated:
            q.negative.append(Clause([term], True))
            joining = False
            continue
        if joining:
            q.positive[-1].alternatives.append(term)
            joining = False
        else:
            q.positive.append(Clause([term]))
        q.highlight += [w + ("*" if term.prefix else "") for w in term.text.split(" ") if w]
