"""Text folding, tokens and matching as column expressions.

A token is a run of letters, numbers and private-use characters; case is folded one character to one, and Latin
letters lose their diacritics. A column is matched in padded form: its tokens, each between single blanks, so words,
phrases and prefixes all are substring tests that stay in generated code.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mailquarry.functions import htmlscan

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
NOT_TOKEN = r"[^\p{L}\p{N}\p{Co}]+"


def nocase(c: Column) -> Column:
    """A-Z to a-z only: the folding of case-insensitive comparison."""
    return F.translate(c, UPPER, LOWER)


def _folded(c: str) -> str:
    small = c.casefold()
    if len(small) != 1:
        small = c.lower()[0] if c == "İ" else c.lower() if len(c.lower()) == 1 else c
    parts = unicodedata.normalize("NFD", small)
    if len(parts) > 1 and parts[0] in LOWER and all(unicodedata.combining(p) for p in parts[1:]):
        return parts[0]
    return small


@cache
def fold_table() -> tuple[str, str]:
    """Characters and what each folds to; the combining marks come last and have no counterpart."""
    pairs = [(chr(c), _folded(chr(c))) for c in range(0x41, 0x2FFF) if unicodedata.category(chr(c)) != "Cn"]
    pairs = [(a, b) for a, b in pairs if a != b and not unicodedata.combining(a)]
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def fold(c: Column) -> Column:
    """Texts in ASCII, which need no table, only change case."""
    return F.when(is_ascii(c), F.lower(c)).otherwise(F.translate(c, *fold_table()))


@cache
def fold_map() -> dict[int, str | None]:
    """fold_table() as str.translate() takes it; made once, as excerpts fold word by word."""
    old, new = fold_table()
    return {ord(a): new[i] if i < len(new) else None for i, a in enumerate(old)}


def fold_text(s: str) -> str:
    """fold() of a Python string."""
    return s.lower() if s.isascii() else s.translate(fold_map())


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0))


def padded(c: Column) -> Column:
    """' token token ' of a text; a blank for null."""
    plain = F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
    other = F.regexp_replace(F.translate(c, *fold_table()), NOT_TOKEN, " ")
    words = F.when(c.isNull(), F.lit("")).when(is_ascii(c), plain).otherwise(other)
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def split_tokens(s: str) -> list[str]:
    """The tokens of a query term."""
    out, run = [], ""
    for c in fold_text(s):
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            run += c
        elif run:
            out.append(run)
            run = ""
    return [*out, run] if run else out


def matches(pad: Column, term: list[str], prefix: bool = False) -> Column:
    """Whether a padded text has the tokens in a row; with prefix the last may go on. No token matches nothing."""
    if not term:
        return F.lit(False)
    return F.contains(pad, F.lit(" " + " ".join(term) + ("" if prefix else " ")))


def occurrences(pad: Column, term: list[str], prefix: bool = False) -> Column:
    """How often the tokens occur in a row in a padded text, overlaps included."""
    if not term:
        return F.lit(0)
    words = F.split(F.trim(pad), " ")
    n = len(term)

    def at(k: int) -> Column:
        return F.slice(words, k + 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))

    if n == 1:
        test = (lambda t: F.startswith(t, F.lit(term[0]))) if prefix else (lambda t: t == F.lit(term[0]))
        return F.size(F.filter(words, test))
    grams = F.zip_with(at(0), at(1), lambda a, b: F.concat_ws(" ", a, b))
    for k in range(2, n):
        grams = F.zip_with(grams, at(k), lambda a, b: F.concat_ws(" ", a, b))
    want = F.lit(" ".join(term))
    return F.size(F.filter(grams, (lambda t: F.startswith(t, want)) if prefix else (lambda t: t == want)))


def token_count(pad: Column) -> Column:
    inner = F.trim(pad)
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, " ")))


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalise(c: Column) -> Column:
    """Extracted text: no control characters, single blanks, at most one empty line."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    c = F.regexp_replace(c, "[ \\t\\u00a0]+", " ")
    c = F.regexp_replace(c, " ?\n ?", "\n")
    return F.trim(F.regexp_replace(c, "\n{3,}", "\n\n"))


def _texts(pages: pd.Series) -> pd.Series:
    return pages.map(htmlscan.text_of)


def _clean(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: htmlscan.sanitised(p)[0])


def _blocked(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: htmlscan.sanitised(p)[1])


def html_to_text(c: Column) -> Column:
    """Text of an HTML page, by one pass over its tags; all entities are known."""
    return F.pandas_udf(_texts, "string")(c)


def sanitise(c: Column) -> Column:
    """HTML without what runs or loads anything; pictures of the message itself (cid:) stay."""
    return F.pandas_udf(_clean, "string")(c)


def has_remote(c: Column) -> Column:
    """Whether sanitise() takes away something that would be loaded from outside."""
    return F.pandas_udf(_blocked, "boolean")(c)


def inline_images(c: Column, shown: Column) -> Column:
    """HTML with addresses `cid:name` replaced by those of a map from lower-case names, with or without what follows an @;
    unknown ones become empty. A bare file name as `src` is looked up as well."""
    parts = F.split(c, "(?i)(?=cid:)")
    name = lambda p: F.lower(_decoded(F.regexp_extract(p, r"""(?i)^cid:([^"'\s)>]+)""", 1)))
    known = lambda n: F.coalesce(F.try_element_at(shown, n), F.try_element_at(shown, F.regexp_replace(n, "(?s)@.*$", "")), F.lit(""))
    new = lambda p: F.when(name(p) != "", F.concat(known(name(p)), F.regexp_replace(p, r"""(?i)^cid:[^"'\s)>]+""", ""))).otherwise(p)
    named = F.array_join(F.transform(parts, new), "")
    bare = r"""(?i)^src\s*=\s*["']([^"':/\\]+)["']"""
    file = lambda p: F.try_element_at(shown, F.lower(_decoded(F.regexp_extract(p, bare, 1))))
    local = lambda p: F.when(file(p).isNotNull(), F.concat(F.lit('src="'), file(p), F.lit('"'), F.regexp_replace(p, bare, ""))).otherwise(p)
    return F.array_join(F.transform(F.split(named, r"(?i)(?=\bsrc\s*=\s*[\"'])"), local), "")


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)
