"""Excerpts and marks in texts as they were written, by Arrow batches: Spark's functions don't give match positions.

Excerpts are made for the rows of a page only, marks for what is shown.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from mailquarry.functions.text import fold_text

_WORD = regex.compile(r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}̀-ͯ]*")

#: What stands for a letter without its accents, and the marks after which no further piece of text gets any.
VARIANTS = {"a": "aàâäáãåæ", "c": "cç", "e": "eéèêë", "i": "iîïíì", "o": "oôöóòõœø", "u": "uùûüú", "y": "yÿý", "n": "nñ"}
MOST_MARKS = 5000
MARK, END_MARK = '<mark class="pl-hit">', "</mark>"
#: Elements in which nothing is marked.
UNMARKED = ("style", "title", "head")


def excerpt(text: str | None, terms: list[tuple[list[str], bool]], width: int = 16, always: bool = False) -> str | None:
    """`width` tokens of the text where the most different terms are, each hit between guillemets; null without a hit.

    A term is its folded tokens and whether the last may go on. The excerpt starts with a sentence if as many terms are
    found from there on, else its hits are in the middle. Of equally good places the first counts. With `always` a
    text without a hit gives its beginning.
    """
    words = list(_WORD.finditer(text or ""))
    folded = [fold_text(w.group()) for w in words]
    hits: list[tuple[int, int, int]] = []  # first token, token behind the last, term
    for k, (term, prefix) in enumerate(terms):
        n = len(term)
        for i in range(len(folded) - n + 1 if n else 0):
            if folded[i : i + n - 1] == term[:-1] and (folded[i + n - 1].startswith(term[-1]) if prefix else folded[i + n - 1] == term[-1]):
                hits.append((i, i + n, k))
    if not hits and not (always and words):
        return None
    hits.sort()
    start = _place(hits, _sentences(text, words), len(words), width)
    stop = min(len(words), start + width)
    # hits that overlap are one; what goes on behind the excerpt ends with it
    spans: list[list[int]] = []
    for first, end, _ in hits:
        if spans and first < spans[-1][1]:
            spans[-1][1] = max(end, spans[-1][1])
        else:
            spans.append([first, end])
    out, at = [], words[start].start() if start else 0
    for first, end in spans:
        if start <= first < stop:
            here, there = words[first].start(), words[min(end, stop) - 1].end()
            out += [text[at:here], "«", text[here:there], "»"]
            at = there
    out.append(text[at : words[stop - 1].end() if stop < len(words) else len(text)])
    return " ".join(("…" * (start > 0) + "".join(out) + "…" * (stop < len(words))).split())


def _sentences(text: str, words: list) -> list[int]:
    """The first token and those that follow a full stop or a colon."""
    return [i for i, w in enumerate(words) if i == 0 or (gap := text[words[i - 1].end() : w.start()]) != gap.rstrip(" \t\n\r") and gap.rstrip(" \t\n\r")[-1:] in (".", ":")]


#: What a place is worth: a term that is there, a further hit of it, the start of a sentence and that of the text.
TERM, AGAIN, SENTENCE, BEGINNING = 1000, 1, 100, 120


def _place(hits: list[tuple[int, int, int]], sentences: list[int], n: int, width: int) -> int:
    def worth(first: int) -> tuple[int, list[tuple[int, int, int]]]:
        inside = hits[bisect_left(hits, (first,)) : bisect_left(hits, (first + width,))]
        kinds = len({k for *_, k in inside})
        return TERM * kinds + AGAIN * (len(inside) - kinds), inside

    best, start = 0, 0
    for first, _, _ in hits:
        score, inside = worth(first)
        if score > best:
            best = score
            start = max(0, min(first - (width - (inside[-1][1] - first)) // 2, n - width))
        sentence = sentences[bisect_right(sentences, first) - 1]
        if n > width and sentence < first:
            score = worth(sentence)[0] + (SENTENCE if sentence else BEGINNING)
            if score > best:
                best, start = score, sentence
    return start


def snippet(c: Column, terms: list[tuple[list[str], bool]], width: int = 16, always: bool = False) -> Column:
    """excerpt() of a column."""

    @pandas_udf("string")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: excerpt(t, terms, width, always))

    return cut(c)


def _finder(terms: list[str]) -> regex.Pattern | None:
    """Tags, or words of the terms that aren't part of an entity. Longer terms come first; one that ends in * takes the whole word."""
    from unicodedata import combining, normalize

    own = []
    for term in sorted({t.casefold(): t for t in terms}.values(), key=len, reverse=True):
        plain = "".join(c for c in normalize("NFD", term.rstrip("*")) if not combining(c)).lower()
        rest = r"[\p{L}\p{N}]*" if term.endswith("*") else r"(?![\p{L}\p{N}])"
        own += ["".join(f"[{VARIANTS[c]}]" if c in VARIANTS else regex.escape(c) for c in word) + rest for word in regex.findall(r"[\p{L}\p{N}]+", normalize("NFC", plain))]
    return regex.compile(r"(?is)(?P<tag><[^>]*>)|(?<![\p{L}\p{N}&])(?:" + "|".join(own) + ")") if own else None


def marked(html: str | None, finder: regex.Pattern) -> str | None:
    """The page with its hits marked, outside tags, entities and the elements of UNMARKED."""
    if html is None:
        return None
    hits, closed, full = 0, False, False

    def shown(m: regex.Match) -> str:
        nonlocal hits, closed, full
        if m.group("tag"):
            full = hits > MOST_MARKS
            name = m.group().lower()
            if name.startswith(tuple(f"<{e}" for e in UNMARKED)):
                closed = True
            elif name.startswith(tuple(f"</{e}" for e in UNMARKED)):
                closed = False
            return m.group()
        if closed or full:
            return m.group()
        hits += 1
        return f"{MARK}{m.group()}{END_MARK}"

    return finder.sub(shown, html)


def highlight(c: Column, terms: list[str]) -> Column:
    """marked() of a column, whatever the accents and the case of text and terms."""
    if _finder(terms) is None:
        return c

    @pandas_udf("string")
    def show(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = _finder(terms)
        for s in pages:
            yield s.map(lambda t: marked(t, finder))

    return show(c)
