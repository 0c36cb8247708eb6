"""BM25 relevance over the fields of messages, as aggregates of the padded texts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.functions.text import occurrences, token_count

K1, B = 1.2, 0.75

#: Weights of the fields.
WEIGHTS = {"subject": 5.0, "sender": 3.0, "recipients": 2.0, "body": 1.0, "attachments": 2.0}


def bm25(pads: DataFrame, fields: dict[str, float], phrases: list[tuple[list[str], bool, list[str]]]) -> DataFrame:
    """id and rank (lower is better) of the rows of pads (id and a padded text a field) that match some phrase.

    phrases: tokens, whether the last is a prefix, and the fields in which it may occur. One pass counts
    occurrences and lengths for the corpus figures, which are one row of numbers, and one more for the scores.
    """
    counts = []
    for k, (term, prefix, where) in enumerate(phrases):
        hits = {f: occurrences(F.col(f), term, prefix) for f in where if f in fields}
        weighted: Column = F.lit(0.0)
        plain: Column = F.lit(0)
        for f, h in hits.items():
            weighted = weighted + F.lit(fields[f]) * h
            plain = plain + h
        counts += [weighted.alias(f"f{k}"), (plain > 0).cast("int").alias(f"h{k}")]
    length = sum((token_count(F.col(f)) for f in fields), F.lit(0)).alias("dl")
    rows = pads.select("id", length, *counts)
    n = range(len(phrases))
    corpus = rows.agg(F.count(F.lit(1)).alias("N"), F.avg("dl").alias("avgdl"), *(F.sum(f"h{k}").alias(f"n{k}") for k in n)).first()
    score: Column = F.lit(0.0)
    for k in n:
        found = corpus[f"n{k}"] or 0
        odds = math.log((corpus["N"] - found + 0.5) / (found + 0.5))
        idf = odds if odds > 0 else 1e-6
        f = F.col(f"f{k}")
        score = score - F.lit(idf * (K1 + 1)) * f / (f + K1 * (1 - B + B * F.col("dl") / F.lit(corpus["avgdl"] or 1.0)))
    some = sum((F.col(f"h{k}") for k in n), F.lit(0)) > 0
    return rows.filter(some).select("id", score.alias("rank"))
