"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.extract.limits import pieces

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The case view in SQL, as common table expressions.
MSG = """msg AS (SELECT d.doc_id AS id, d.source AS mailbox, d.lang || '/' || d.source AS folder_path, split_part(d.text, chr(10), 1) AS subject, d.text AS body,
  d.n_chars AS size, md5(d.text) AS message_id, epoch_us(e.ts) // 1000 AS date_ms, e.user_id AS sender_id, e.event_type AS msg_class,
  CAST(l.quality + 2 * l.toxic AS INTEGER) AS flags, CAST(l.quality AS INTEGER) AS quality
  FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

_H = "html"
for _e in ("script", "style", "head", "title", "xml", "o:p"):
    _H = f"regexp_replace({_H}, '(?is)<{_e}\\b[^>]*>.*?</{_e}\\s*>', ' ', 'g')" if _e != "script" else f"regexp_replace(regexp_replace({_H}, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g')"
_H = f"regexp_replace({_H}, '(?i)<\\s*(?:br|/p|/div|/tr|/li|/h[1-6]|/table|/blockquote)\\b[^>]*>', chr(10), 'g')"
_H = f"regexp_replace({_H}, '(?i)<\\s*/t[dh]\\s*>', ' ' || chr(9), 'g')"
_H = f"regexp_replace({_H}, '(?s)<[^>]*>', ' ', 'g')"
for _e, _t in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&apos;", "chr(39)"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&amp;", "'&'")):
    _H = f"replace({_H}, '{_e}', {_t})"
_H = f"replace(regexp_replace({_H}, '[ \\t\\x{{00a0}}]+', ' ', 'g'), chr(13), '')"
HTML_TEXT = f"regexp_replace(regexp_replace({_H}, '(?:\\s*\\n){{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"

ATT = f"att AS (SELECT page_id AS message_id, url AS name, {HTML_TEXT} AS content FROM pages)"


def pad(c: str) -> str:
    """A padded text in SQL."""
    return f"(' ' || array_to_string(regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ')"


def toks(c: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}]+')"


def by_key(key: str, *forms: str) -> str:
    """SQL that both engines take: a form for each row, by its key modulo their number; {k} is the key."""
    return f"CASE {key} % {len(forms)} " + " ".join(f"WHEN {i} THEN {f.replace('{k}', key)}" for i, f in enumerate(forms)) + " END"


def customers(spark, sf_dir, **columns: str):
    """k (the customer's key) and columns of SQL."""
    from mailquarry.sources.case import table

    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), *(F.expr(c).alias(n) for n, c in columns.items()))


KEY = "c_custkey"


def by_python(df: DataFrame, column: str, make: Callable[[str | None], str | None]) -> DataFrame:
    """df with a column of texts put through a function, in Arrow batches."""
    return df.withColumn(column, F.pandas_udf(lambda s: s.map(make), "string")(F.col(column)))


def reading(column: str, make: Callable[[int, str], str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches of ids and texts doc_id and a column of what make() gives for both, a piece at a time; a null stays null."""

    def run(batches):
        for b in batches:
            for some in pieces((i.as_py(), make(i.as_py(), t.as_py()) if t.is_valid else None) for i, t in zip(b.column(0), b.column(1), strict=True)):
                ids, texts = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", column])

    return run
