"""From a query and a scope to a result frame.

Every text predicate of all clauses is evaluated in one pass over the messages and one over the
attachments; the attachments' answers are reduced to one row a message and joined once. Filters on other columns
reach the scan. Ranks and snippets are computed only when asked for, snippets only for the page.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailquarry.functions.dates import day_start_ms
from mailquarry.functions.excerpts import snippet
from mailquarry.functions.text import matches, padded, split_tokens
from mailquarry.operators.rank import WEIGHTS, bm25
from mailquarry.operators.store import cut
from mailquarry.plans.query import ANY, CONTENT, INDICES, NAME, Clause, Filter, Query, Term, parse
from mailquarry.plans.sorting import RELEVANCE, after, cursor, keys_of, order, parse_sort
from mailquarry.sources.case import Case

MESSAGE_FIELDS = list(WEIGHTS)
#: Rows up to which a page is kept by one task, as Spark's limit does; the ends of larger ones are looked up in the sorted keys.
TOP = 10_000


@dataclass
class Request:
    query: str = ""
    mailbox: str | None = None
    folder: str | None = None
    subtree: bool = True
    date_from: date | None = None
    date_to: date | None = None
    only_with_attachments: bool = False
    hide_duplicates: bool = False
    sort: str = "date"
    limit: int | None = 1000
    offset: int = 0
    zone: str = "UTC"
    #: The place of the last row before the page, as sorting.cursor() gives it; in place of an offset, whose rows would be sorted again for each page.
    after: tuple | None = None


def message_fields(term: Term) -> list[str]:
    """Where a term may occur in a message; none for terms on attachment contents."""
    return MESSAGE_FIELDS if term.field == ANY else [] if term.field == CONTENT else [term.field]


def attachment_fields(term: Term) -> list[str]:
    return {ANY: ["name", "content"], NAME: ["name"], CONTENT: ["content"]}.get(term.field, [])


def clause_column(clause: Clause, where, pads: dict[str, Column]) -> Column:
    """Whether some alternative matches within one of its fields; a match never spans two fields."""
    out = F.lit(False)
    for term in clause.alternatives:
        tokens = split_tokens(term.text)
        for f in where(term):
            if f in pads:
                out = out | matches(pads[f], tokens, term.prefix)
    return out


def filter_column(f: Filter) -> Column:
    """Conditions on the analysis. Negated ones keep rows without a value."""
    if f.field == "indice":
        column, mask = INDICES[f.value]
        hit = F.coalesce(F.col(column), F.lit(0)).bitwiseAND(mask) != 0
        return ~hit if f.negated else hit
    if f.field == "fil":
        hit = F.col("thread_id").eqNullSafe(F.lit(int(f.value)))
    elif f.value == "absent":
        hit = F.col(f"auth_{f.field}").isNull()
    else:
        hit = F.col(f"auth_{f.field}").eqNullSafe(F.lit(f.value))
    return ~hit if f.negated else hit


def errors(q: Query, r: Request) -> list[str]:
    out = list(q.errors)
    bounded = q.filters or q.after or q.before or r.date_from or r.date_to
    if q.negative and not q.positive and not bounded:
        out.append("a query needs something to look for beside what it excludes")
    return out


def scope(messages: DataFrame, q: Query, r: Request) -> DataFrame:
    """Filters on everything but text. A folder counts only within a mailbox; the request's dates come first."""
    out = messages
    if r.mailbox is not None:
        out = out.filter(F.col("mailbox") == r.mailbox)
        if r.folder is not None:
            own = F.col("folder_path") == r.folder
            out = out.filter(own | F.startswith("folder_path", F.lit(r.folder + "/")) if r.subtree else own)
    first, last = r.date_from or q.after, r.date_to or q.before
    if first:
        out = out.filter(F.col("date_ms") >= day_start_ms(first, r.zone))
    if last:
        out = out.filter(F.col("date_ms") < day_start_ms(last + timedelta(days=1), r.zone))
    if r.only_with_attachments:
        out = out.filter("has_att")
    if r.hide_duplicates:
        out = out.filter(F.col("dup_of").isNull())
    for f in q.filters:
        out = out.filter(filter_column(f))
    return out


def hits(case: Case, messages: DataFrame, clauses: list[Clause]) -> DataFrame:
    """messages with a boolean column m0, m1, ... for each clause: found in the message or in an attachment."""
    have = [f for f in MESSAGE_FIELDS if f in messages.columns]
    # padded texts are columns of their own, so that all clauses share one computation
    pads = {f: F.col(f"__p_{f}") for f in have}
    own = messages.select("*", *(padded(F.col(f)).alias(f"__p_{f}") for f in have))
    own = own.select(*messages.columns, *(clause_column(c, message_fields, pads).alias(f"m{k}") for k, c in enumerate(clauses)))
    if not any(attachment_fields(t) for c in clauses for t in c.alternatives):
        return own
    pads = {f: F.col(f"__p_{f}") for f in ("name", "content")}
    texts = case.attachments.select("message_id", *(padded(F.col(f)).alias(f"__p_{f}") for f in ("name", "content")))
    flags = texts.select("message_id", *(clause_column(c, attachment_fields, pads).alias(f"a{k}") for k, c in enumerate(clauses)))
    family = flags.groupBy("message_id").agg(*(F.max(f"a{k}").alias(f"a{k}") for k in range(len(clauses)))).withColumnRenamed("message_id", "__family")
    both = own.join(family, own["id"] == family["__family"], "left")
    return both.select(*messages.columns, *((F.col(f"m{k}") | F.coalesce(f"a{k}", F.lit(False))).alias(f"m{k}") for k in range(len(clauses))))


def candidates(case: Case, q: Query, r: Request) -> DataFrame:
    """All messages that the query finds, unordered."""
    wrong = errors(q, r)
    if wrong:
        raise ValueError("; ".join(wrong))
    messages = scope(case.messages, q, r)
    clauses = q.positive + q.negative
    if not clauses:
        return messages
    met = F.array(*(~F.col(f"m{k}") if c.negated else F.col(f"m{k}") for k, c in enumerate(clauses)))
    # one condition that can't be taken apart: a part pushed below the join would pad every text once more
    return hits(case, messages, clauses).filter(~F.array_contains(met, False)).select(*messages.columns)


def ranks(case: Case, q: Query) -> DataFrame | None:
    """Relevance of messages by their own texts; None if no clause concerns messages."""
    terms = [(split_tokens(t.text), t.prefix, message_fields(t)) for c in q.positive for t in c.alternatives if message_fields(t)]
    if not terms:
        return None
    have = [f for f in MESSAGE_FIELDS if f in case.messages.columns]
    pads = case.messages.select("id", *(padded(F.col(f)).alias(f) for f in have))
    return bm25(pads, {f: WEIGHTS[f] for f in have}, terms)


def search(case: Case, r: Request) -> DataFrame:
    """The page of results that the request asks for, in its order."""
    q = parse(r.query)
    out = candidates(case, q, r)
    key, descending = parse_sort(r.sort)
    scores = ranks(case, q) if key == RELEVANCE else None
    if key == RELEVANCE and scores is None:
        key, descending = "date", True
    if scores is not None:
        out = out.join(scores, "id", "left")
    if r.after is not None:
        out = out.filter(after(r.after, key, descending, out.columns))
    if r.limit is not None and r.offset + r.limit > TOP and (large := _large_page(out, r, key, descending)) is not None:
        return large
    out = out.orderBy(*order(key, descending, out.columns))
    return out if r.limit is None else out.offset(r.offset).limit(r.limit)


def _large_page(out: DataFrame, r: Request, key: str, descending: bool) -> DataFrame | None:
    """The page of a large request, sorted over all tasks: rows between two places, which come from the sorted keys alone and the number of them in each partition.
    None where rows on both sides of an end have the same keys, so that keys don't tell which of them are on the page."""
    own = keys_of(key, descending, out.columns)
    names = [f"k{i}" for i in range(len(own))]
    keys = cut(out.select(*(c.alias(n) for n, (c, _) in zip(names, own, strict=True))).orderBy(*(F.col(n).desc() if down else F.col(n).asc() for n, (_, down) in zip(names, own, strict=True))))
    keys = keys.withColumn("at", F.monotonically_increasing_id())
    sizes = sorted(keys.groupBy(F.shiftright("at", 33).alias("part")).count().collect())

    def row(place: int) -> tuple | None:
        for part, n in sizes:
            if place < n:
                return tuple(keys.filter(F.col("at") == (part << 33) + place).select(*names).first())
            place -= n
        return None

    first, beyond = row(r.offset), row(r.offset + r.limit)
    if first is None or r.limit == 0:
        return out.limit(0)
    if r.offset:
        before = row(r.offset - 1)
        if before == first:
            return None
        out = out.filter(after(before, key, descending, out.columns))
    if beyond is not None:
        last = row(r.offset + r.limit - 1)
        if last == beyond:
            return None
        out = out.filter(~F.coalesce(after(last, key, descending, out.columns), F.lit(False)))
    return out.orderBy(*order(key, descending, out.columns))


def pages(case: Case, r: Request) -> Iterator[DataFrame]:
    """All pages of a request's results, each behind the last row of the one before."""
    while True:
        page = cut(search(case, r))
        key, descending = parse_sort(r.sort)
        if key == RELEVANCE and "rank" not in page.columns:
            key, descending = "date", True
        place = cursor(page, key, descending)
        if place is None:
            return
        yield page
        r = replace(r, offset=0, after=place)


def count(case: Case, r: Request) -> int:
    """How many messages the request finds in all, without sorting or joining dimensions."""
    return candidates(case, parse(r.query), r).count()


def with_snippets(case: Case, page: DataFrame, query: str) -> DataFrame:
    """page with an excerpt of each row: of the body where it matches, else of its first attachment that matches, else the
    start of the body. Attachments of other rows are left out before their texts are padded."""
    q = parse(query)
    terms = [(split_tokens(t.text), t) for c in q.positive for t in c.alternatives if split_tokens(t.text)]
    of = lambda fields, name: [(t, k.prefix) for t, k in terms if name in fields(k)]
    none = F.lit(None).cast(T.StringType())
    body = snippet(F.col("body"), own) if (own := of(message_fields, "body")) else none
    hits = [matches(padded(F.col(f)), t, p) for f in MESSAGE_FIELDS if f in page.columns for t, p in of(message_fields, f)]
    other = F.when(reduce(lambda a, b: a | b, hits), snippet(F.col("body"), [], always=True)) if hits else none
    ids = page.select(F.col("id").alias("message_id")).distinct()
    near = case.attachments.join(ids, "message_id", "left_semi")
    text = snippet(F.col("content"), own) if (own := of(attachment_fields, "content")) else none
    said = near.select("message_id", "idx_path", F.concat(F.lit("📎 "), F.coalesce("name", F.lit("")), F.lit(" : "), text).alias("said"))
    best = said.filter(F.col("said").isNotNull()).groupBy("message_id").agg(F.min_by("said", "idx_path").alias("said"))
    out = page.join(best.withColumnRenamed("message_id", "__m"), page["id"] == F.col("__m"), "left")
    return out.select(*page.columns, F.coalesce(body, F.col("said"), other).alias("snippet"))


def family_marks(attachments: DataFrame, hit: Column) -> DataFrame:
    """attachments (message_id, idx_path) with hit, and below: whether something embedded in it, however deep, is a hit.

    Each hit is sent to the paths above it ('1/0/2' to '1/0' and '1'), of which one row goes into the shuffle from each task.
    """
    marked = attachments.withColumn("hit", F.coalesce(hit, F.lit(False)))
    steps = F.split("idx_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    found = marked.filter(F.col("hit") & F.contains("idx_path", F.lit("/"))).select("message_id", F.explode(above).alias("idx_path")).distinct()
    found = found.select(F.col("message_id").alias("__m"), F.col("idx_path").alias("__p"))
    both = marked.join(found, (F.col("message_id") == F.col("__m")) & (F.col("idx_path") == F.col("__p")), "left")
    return both.withColumn("below", F.col("__m").isNotNull()).drop("__m", "__p")
