"""Secret scanning with a trigram inverted index.

From each rule's regular expression a Boolean query over the trigrams that every match must hold is derived.
Each block of documents is indexed: for every trigram of some query the list of documents that have it. The
queries are answered by intersecting and uniting those lists, and only the documents that come out are verified
by the expression. Rules without a mandatory trigram scan every document.

Blocks are cut from the batches of a partition, so the index of a block is bounded and needs no shuffle, and a
lost task builds its own blocks again.

Defined results: null and empty texts have no spans; spans are in code points; repeated rows and null ids are
scanned like any other row. A very long text is a block by itself, whose index takes some 16 times its size. An empty table gives no rows. Columns
other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import only, table

try:  # the parser's place in the standard library
    from re import _constants as C
    from re import _parser as P
except ImportError:  # pragma: no cover
    import sre_constants as C
    import sre_parse as P


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and which of the leftmost matches count."""

    kind: str
    pattern: str
    passes: Callable[[re.Match], bool]

    @property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)


def _group2_of_12(m: re.Match) -> bool:
    return len(m.group(2)) >= 12


def _long(n: int) -> Callable[[re.Match], bool]:
    return _AtLeast(n)


@dataclass(frozen=True)
class _AtLeast:
    n: int

    def __call__(self, m: re.Match) -> bool:
        return m.end() - m.start() >= self.n


BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _group2_of_12),
    Rule("access", r"AKIA[A-Z0-9]+", _long(18)),
    Rule("hex", r"[0-9a-f]+", _long(16)),
]

#: Kinds that the method adds to the base ones.
ADDED = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", _long(1)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", _long(40)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", _long(36)),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", _long(15)),
]

#: Bytes of text that are indexed at a time.
BLOCK = 4 << 20

# --- Boolean trigram queries ----------------------------------------------------------------------------

ALL = ("all",)  # no trigram is mandatory


def _and(parts: list) -> tuple:
    flat = []
    for p in parts:
        if p != ALL:
            flat += p[1] if p[0] == "and" else [p]
    flat = sorted(set(flat), key=repr)
    return ALL if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _or(parts: list) -> tuple:
    if any(p == ALL for p in parts):
        return ALL
    flat = sorted({x for p in parts for x in (p[1] if p[0] == "or" else [p])}, key=repr)
    return flat[0] if len(flat) == 1 else ("or", tuple(flat))


def _run(literal: str) -> tuple:
    data = literal.lower().encode()
    return _and([("has", data[i : i + 3]) for i in range(len(data) - 2)])


def _query(nodes) -> tuple:
    """Of a parsed sequence: literals in a row give trigrams, anything else ends the row."""
    parts, row = [], ""
    for op, arg in nodes:
        if op is C.LITERAL and arg < 128:
            row += chr(arg)
            continue
        parts.append(_run(row))
        row = ""
        if op is C.SUBPATTERN:
            parts.append(_query(arg[-1]))
        elif op is C.BRANCH:
            parts.append(_or([_query(b) for b in arg[1]]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            parts.append(_query(arg[2]))
    parts.append(_run(row))
    return _and(parts)


def trigram_query(pattern: str) -> tuple:
    """('has', trigram), ('and', parts), ('or', parts) or ALL. Trigrams are lower-case, so the query
    holds whatever the case of the match. Common beginnings that the parser pulls out of alternatives
    are literals of their own, which weakens a query but never makes it wrong."""
    return _query(P.parse(pattern, re.ASCII))


def mandatory(query: tuple) -> set[bytes]:
    """The trigrams that a query asks for."""
    return {query[1]} if query[0] == "has" else set() if query == ALL else set().union(*map(mandatory, query[1]))


class Index:
    """Postings of a block: for each asked trigram the numbers of the documents that have it."""

    LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint32)

    def __init__(self, trigrams: set[bytes]):
        self.number = {t: i + 1 for i, t in enumerate(sorted(trigrams))}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, i in self.number.items():
            self.table[t[0] << 16 | t[1] << 8 | t[2]] = i

    def postings(self, data: np.ndarray, starts: np.ndarray) -> dict[bytes, np.ndarray]:
        """data: the documents' bytes in a row; starts: where each begins."""
        none = np.zeros(0, np.int64)
        if len(data) < 3 or not self.number:
            return dict.fromkeys(self.number, none)
        low = self.LOWER[data]
        found = self.table[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(found)
        doc = np.searchsorted(starts, at, side="right") - 1
        inside = np.searchsorted(starts, at + 2, side="right") - 1 == doc  # not across two documents
        what, doc = found[at][inside], doc[inside]
        return {t: np.unique(doc[what == i]) for t, i in self.number.items()}


def candidates(query: tuple, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    if query == ALL:
        return np.arange(n)
    if query[0] == "has":
        return postings[query[1]]
    lists = [candidates(q, postings, n) for q in query[1]]
    out = lists[0]
    for x in lists[1:]:
        out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
    return out


# --- scanning -------------------------------------------------------------------------------------------


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.rules = [(r, r.regex, trigram_query(r.pattern)) for r in rules]
        self.index = Index(set().union(*(mandatory(q) for _, _, q in self.rules)))

    def block(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, kind's number, end) of every span."""
        coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        starts = np.concatenate(([0], np.cumsum([len(c) for c in coded])))[:-1]
        postings = self.index.postings(np.frombuffer(b"".join(coded), np.uint8), starts)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, regex, query) in enumerate(self.rules):
            for d in candidates(query, postings, len(texts)).tolist():
                if texts[d]:
                    out[d] += [(m.start(), k, m.end()) for m in regex.finditer(texts[d]) if rule.passes(m)]
        return out


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scanning(rules: list[Rule], base: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kinds = [r.kind for r in rules]
        for b in batches:
            texts = b.column(1).to_pylist()
            spans, at = [], 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (size < BLOCK or end == at):
                    size += len(texts[end] or "")
                    end += 1
                spans += scanner.block(texts[at:end])
                at = end
            joined, digests, counts = [], [], []
            for own in spans:
                own.sort()
                told = [(k, f"{kinds[k]}:{s}:{e}") for s, k, e in own]
                joined.append(",".join(x for _, x in told))
                digests.append(hashlib.sha256(",".join(x for k, x in told if k < base).encode()).hexdigest())
                counts.append([sum(k == j for k, _ in told) for j in range(base)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([c[j] for c in counts], pa.int64()) for j in range(base)), pa.array(digests, pa.string()), pa.array(joined, pa.string())],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return scan


def find_secrets(docs: DataFrame, added: list[Rule] | None = None) -> DataFrame:
    """doc_id, the numbers of base spans by kind, the digest of the base spans, and all spans
    ('kind:start:end', by start and then kind) of every row of docs."""
    rules = BASE + (ADDED if added is None else added)
    return only(docs, "doc_id", "text").mapInArrow(_scanning(rules, len(BASE)), SCHEMA)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def _cased(pattern: str) -> str:
    """The rule's expression for an engine whose case folding goes beyond ASCII."""

    def both(m: re.Match) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in m.group(1))

    return re.sub(r"\(\?i:([^)]*)\)", lambda m: "(?:" + both(m) + ")", pattern)


def oracle() -> str:
    """SQL that finds the same spans: positions are summed from the lengths of matches and of what lies between."""
    parts = []
    for k, r in enumerate(BASE + ADDED):
        rx = _cased(r.pattern).replace("'", "''")
        least = getattr(r.passes, "n", 12)
        if r.kind == "hex":  # runs are maximal, so those of 16 are the same matches and far fewer
            rx, least = "[0-9a-f]{16,}", 16
        size = f"length(regexp_extract_all(t, '{rx}', 2)[i])" if r.kind == "assign" else "length(m[i])"
        parts.append(
            f"SELECT row, {k} AS k, '{r.kind}' AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: "
            f"{{'a': coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'n': length(m[i]), 'ok': {size} >= {least}}}), lambda z: z.ok)) AS z "
            f"FROM (SELECT row, t, regexp_extract_all(t, '{rx}') AS m, string_split_regex(t, '{rx}') AS s FROM d) WHERE len(m) > 0"
        )
    union = "\n UNION ALL ".join(parts)
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({union}),
g AS (SELECT row, k, CAST(z.a AS BIGINT) AS a, kind || ':' || CAST(CAST(z.a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(z.a + z.n AS BIGINT) AS VARCHAR) AS said FROM f),
h AS (SELECT row, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(said, ',' ORDER BY a, k) FILTER (k < {len(BASE)}) AS base, string_agg(said, ',' ORDER BY a, k) AS spans FROM g GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN h USING (row)"""
