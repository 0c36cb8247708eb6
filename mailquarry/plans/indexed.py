"""Search by the inverted index: built once, asked often.

The index holds the lists of messages and of attachments (operators.lists); fields of attachments are marked. A clause is a
union of lookups, a query a chain of semi- and anti-joins of ids, so texts are never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.functions.text import split_tokens
from mailquarry.operators.lists import inverted, postings_of, read_lists, write_lists
from mailquarry.operators.postings import lookup
from mailquarry.operators.segments import BLOCK, FILE_FIELDS, MARK, Snapshot, of_files
from mailquarry.plans.query import Clause, Query, parse
from mailquarry.plans.search import MESSAGE_FIELDS, Request, attachment_fields, errors, message_fields, scope
from mailquarry.plans.sorting import RELEVANCE, order, parse_sort
from mailquarry.sources.case import Case


def write_index(case: Case, path: str, files: int | None = None) -> None:
    """The lists of messages and of attachments, each in a folder of its own."""
    none = F.lit(0).alias("shard")
    own = case.messages.select("id", F.lit(None).cast("string").alias("unit"), none, *(f for f in MESSAGE_FIELDS if f in case.messages.columns))
    write_lists(inverted(own, MESSAGE_FIELDS, [0.0] * len(MESSAGE_FIELDS), BLOCK), f"{path}/messages", files)
    write_lists(inverted(of_files(case.attachments).select("*", none), FILE_FIELDS, [0.0] * len(FILE_FIELDS), BLOCK), f"{path}/files", files)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """What found_ids() looks up."""
    return postings_of(read_lists(spark, f"{path}/messages"), MESSAGE_FIELDS).unionByName(postings_of(read_lists(spark, f"{path}/files"), FILE_FIELDS))


def clause_ids(index: DataFrame, clause: Clause) -> DataFrame:
    parts = [lookup(index, split_tokens(t.text), t.prefix, message_fields(t) + [MARK + f for f in attachment_fields(t)]) for t in clause.alternatives]
    return reduce(DataFrame.union, parts)


def found_ids(index: DataFrame, q: Query) -> DataFrame:
    """ids that the clauses of a query find. It needs a positive clause: an index knows what is there, not what isn't."""
    wrong = errors(q, Request())
    if wrong or not q.positive:
        raise ValueError("; ".join(wrong) or "nothing to look for")
    out = clause_ids(index, q.positive[0]).distinct()
    for c in q.positive[1:]:
        out = out.join(clause_ids(index, c), "id", "left_semi")
    for c in q.negative:
        out = out.join(clause_ids(index, c), "id", "left_anti")
    return out


def indexed_search(case: Case, snapshot: Snapshot, r: Request) -> DataFrame:
    """The page that plans.search.search() gives, from an index: texts aren't read, and by relevance only the rows of the page's end are ranked."""
    q = parse(r.query)
    out = scope(case.messages, q, r).join(found_ids(snapshot.postings(), q), "id", "left_semi")
    key, descending = parse_sort(r.sort)
    terms = [(split_tokens(t.text), t.prefix, message_fields(t)) for c in q.positive for t in c.alternatives if message_fields(t)]
    if key == RELEVANCE and not terms:
        key, descending = "date", True
    if key == RELEVANCE:
        # rows without a rank come last, so they are on the page only if all that have one are here
        ranked = snapshot.ranked(terms, None if r.limit is None else r.offset + r.limit, out.select("id"))
        out = out.join(ranked, "id", "left")
    out = out.orderBy(*order(key, descending, out.columns))
    return out if r.limit is None else out.offset(r.offset).limit(r.limit)
