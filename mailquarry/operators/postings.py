"""An inverted index as a table: for each token and field of a row the places where it stands.

Written partitioned by the token's first character and sorted by token, a lookup reads a few row groups:
a word is an equality filter, a prefix a range, a phrase a join on the next place. Without it search scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.functions.text import tokens


def build_postings(rows: DataFrame, fields: list[str]) -> DataFrame:
    """token, id, unit, field, places of the texts in fields; initial is what the table is partitioned by. unit tells the
    rows of one id apart, if rows has such a column."""
    unit = F.coalesce("unit", F.lit("")) if "unit" in rows.columns else F.lit("")
    each = F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("tokens")) for f in fields))
    parts = rows.select("id", unit.alias("unit"), F.explode(each).alias("e")).select("id", "unit", "e.field", F.posexplode("e.tokens").alias("place", "token"))
    # all places of a token in one field of one row: a group is bounded by that text
    out = parts.groupBy("token", "id", "unit", "field").agg(F.array_sort(F.collect_list("place")).alias("places"))
    return out.select(F.substring("token", 1, 1).alias("initial"), "token", "id", "unit", "field", "places")


def write_postings(postings: DataFrame, path: str, files: int | None = None) -> None:
    """As many files as `files`, else as the size of the postings asks for."""
    dealt = postings.repartitionByRange(files, "initial", "token") if files else postings.repartitionByRange("initial", "token")
    (dealt.sortWithinPartitions("initial", "token", "id").write.mode("overwrite").partitionBy("initial").parquet(path))


def lookup(postings: DataFrame, term: list[str], prefix: bool = False, fields: list[str] | None = None) -> DataFrame:
    """ids of rows in which the tokens stand in a row within one field."""
    own = postings.filter(F.col("field").isin(fields)) if fields else postings

    def one(k: int) -> DataFrame:
        t = term[k]
        last = prefix and k == len(term) - 1
        some = own.filter((F.col("initial") == t[0]) & (F.startswith("token", F.lit(t)) if last else F.col("token") == t))
        return some.select("id", "unit", "field", F.transform("places", lambda p: p - k).alias(f"p{k}"))

    if not term:
        return postings.select("id").limit(0)
    found = reduce(lambda a, b: a.join(b, ["id", "unit", "field"]), (one(k) for k in range(len(term))))
    if len(term) == 1:
        return found.select("id").distinct()
    both = reduce(F.array_intersect, (F.col(f"p{k}") for k in range(len(term))))
    return found.filter(F.size(both) > 0).select("id").distinct()
