"""Visual skeletons of domain labels and the one-edit test."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that look like a Latin letter (zero, one, five, Cyrillic and Greek letters), and the
#: hyphens that are ignored.
ALIKE = {
    "0": "o", "о": "o", "ο": "o",
    "1": "l", "i": "l", "l": "l", "|": "l", "і": "l", "ı": "l", "ӏ": "l",
    "5": "s", "а": "a", "е": "e", "р": "p", "с": "c", "х": "x", "у": "y", "ν": "v",
    "-": "", "_": "",
}

#: Pairs that look like one letter, in the order of replacement.
PAIRS = [("rn", "m"), ("vv", "w"), ("cl", "d")]


def unicode_label(label: str) -> str:
    if "xn--" not in label.lower():
        return label
    try:
        return ".".join(p[4:].encode("ascii").decode("punycode") if p.lower().startswith("xn--") else p for p in label.split("."))
    except (UnicodeError, ValueError):
        return label


def skeleton_of(label: str | None) -> str:
    if not label:
        return ""
    out = []
    for c in unicodedata.normalize("NFKC", unicode_label(label)).lower():
        if c in ALIKE:
            out.append(ALIKE[c])
        elif unicodedata.category(c) != "Mn":
            out.append(unicodedata.normalize("NFD", c)[0])
    s = "".join(out)
    for a, b in PAIRS:
        s = s.replace(a, b)
    return s


def _skeletons(labels: pd.Series) -> pd.Series:
    return labels.map(skeleton_of)


def skeleton(label: Column) -> Column:
    """For distinct labels only: punycode and compatibility forms have no built-in function."""
    return F.pandas_udf(_skeletons, "string")(label)


def plain_skeleton(label: Column) -> Column:
    """skeleton() for labels in ASCII, without Python."""
    c = F.lower(label)
    c = F.translate(c, "015il|-_", "olslll")
    for a, b in PAIRS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether one insertion, deletion, substitution or swap of neighbours at most leads from a to b."""
    n = F.length(a)
    at = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    swapped = lambda i: F.concat(a.substr(F.lit(1), i - 1), a.substr(i + 1, F.lit(1)), a.substr(i, F.lit(1)), a.substr(i + 2, n))
    swap = (n == F.length(b)) & (n > 1) & F.exists(at, lambda i: swapped(i) == b)
    return (F.levenshtein(a, b, 1) >= 0) | swap
