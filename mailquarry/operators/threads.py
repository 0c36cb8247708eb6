"""Conversation threads: components of strong links, then weak links by subject, time and participants."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailquarry.functions.mail import normalise_id, normalise_subject, referenced_ids
from mailquarry.operators.graph import components
from mailquarry.operators.order import file_of, ordered
from mailquarry.operators.store import cut, written

GAP_MS = 120 * 86_400_000
LOOK_BACK = 8
LEAST_SUBJECT = 6


def strong_edges(items: DataFrame) -> DataFrame:
    """Edges between messages with the same message id or conversation key, and from each to those it refers to.

    Every group of equal ids is a star around its smallest member, so the edges grow with the messages.
    """
    ids = items.select("id", normalise_id(F.col("message_id")).alias("k")).filter(F.col("k").isNotNull())
    heads = ids.groupBy("k").agg(F.min("id").alias("head"))
    keys = items.select("id", F.col("conv_key").alias("k")).filter(F.col("k") != "")
    key_heads = keys.groupBy("k").agg(F.min("id").alias("head"))
    refers = items.select("id", F.explode(F.array_distinct(referenced_ids(F.col("in_reply_to"), F.col("refs")))).alias("k"))
    out = [f.join(h, "k").select(F.col("id").alias("a"), F.col("head").alias("b")) for f, h in ((ids, heads), (keys, key_heads), (refers, heads))]
    return out[0].union(out[1]).union(out[2])


def weak_edges(items: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between messages of one subject: each looks back over up to eight earlier ones within 120 days and links
    to the first with a participant in common, unless it meets one of its own thread before.

    A subject is followed in order of date and id, in stretches between pauses of more than 120 days, which no link crosses. Each stretch is
    a stream: a task holds the last eight messages and the threads that weak links have joined, however long it is.
    """
    own = items.filter(F.col("date_ms").isNotNull()).select("id", normalise_subject(F.col("topic")).alias("subject"), "date_ms", "parties")
    own = own.filter(F.length("subject") >= LEAST_SUBJECT)
    many = cut(own.groupBy("subject").count().filter("count > 1").select("subject"))
    own = own.join(many, "subject").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    own = own.select("subject", "id", F.coalesce("root", "id").alias("root"), "date_ms", "parties")
    return dealt(_stretches(own)).mapInArrow(_follow, "a long, b long")


def _stretches(own: DataFrame) -> DataFrame:
    """own with stretch: a number that the messages of a subject share between two pauses of more than GAP_MS."""
    rows = ordered(own, F.col("subject"), F.col("date_ms"), F.col("id"))
    file = file_of(F.col("at"))
    in_file = W.partitionBy(file).orderBy("at")
    here = F.struct("subject", "date_ms")
    # what the files before end with: one row a file
    lasts = rows.groupBy(file.alias("file")).agg(F.max_by(here, "at").alias("end"))
    lasts = lasts.select("file", F.lag("end").over(W.orderBy("file")).alias("other"))
    rows = rows.withColumn("inner", F.lag(here).over(in_file)).join(F.broadcast(lasts), file == F.col("file"))
    before = F.coalesce("inner", "other")
    starts = before.isNull() | (before["subject"] != F.col("subject")) | (F.col("date_ms") - before["date_ms"] > GAP_MS)
    rows = written(rows.withColumn("start", F.when(starts, F.col("at"))).drop("inner", "other", "file"))[0]
    opened = rows.groupBy(file.alias("file")).agg(F.max("start").alias("open"))
    opened = opened.select("file", F.last("open", True).over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)).alias("open"))
    rows = rows.withColumn("own", F.last("start", True).over(in_file)).join(F.broadcast(opened), file == F.col("file"))
    return rows.select(F.coalesce("own", "open").alias("stretch"), "id", "root", "date_ms", "parties")


def dealt(rows: DataFrame) -> DataFrame:
    """Each stretch in order in one task. Dealt by a hash of its number: by the number itself Spark might keep the partitions of a join
    before, and scatter a stretch where it splits a large one of them or reads it in parts."""
    return rows.repartition(F.xxhash64("stretch")).sortWithinPartitions("stretch", "date_ms", "id")


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stretch, recent, up = None, deque(maxlen=LOOK_BACK), {}

    def find(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    for batch in batches:
        out = []
        for number, i, root, at, people in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number != stretch:
                stretch, recent, up = number, deque(maxlen=LOOK_BACK), {}
            people = frozenset(people or ())
            for j, other, before, known in reversed(recent):
                a, b = find(root), find(other)
                if at - before > GAP_MS or a == b:
                    break
                if people & known:
                    up[max(a, b)] = min(a, b)
                    out.append((i, j))
                    break
            recent.append((i, root, at, people))
        first, second = map(list, zip(*out, strict=True)) if out else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["a", "b"])


def build(items: DataFrame, weak: bool = True) -> DataFrame:
    """id, thread_id (the smallest id of the thread) and thread_count of every item. items: id, message_id,
    in_reply_to, refs, conv_key, topic, date_ms, parties."""
    strong = cut(strong_edges(items))
    tied = cut(components(strong))
    if weak:
        tied = cut(components(strong.union(weak_edges(items, tied))))
    out = items.select("id").join(tied, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("thread_id"))
    sizes = cut(out.groupBy("thread_id").agg(F.count(F.lit(1)).alias("thread_count")))
    return out.join(sizes, "thread_id").select("id", "thread_id", F.col("thread_count").cast("int").alias("thread_count"))


@dataclass
class State:
    """Strong threads so far: labels (id, root) of all messages; heads (kind, k, head), for each id and conversation key one message that has it;
    waiting (k, id), references to ids that no message has yet."""

    labels: DataFrame
    heads: DataFrame
    waiting: DataFrame


def start(spark: SparkSession) -> State:
    return State(*(spark.createDataFrame([], schema) for schema in ("id long, root long", "kind string, k string, head long", "k string, id long")))


def extend(state: State, items: DataFrame) -> tuple[State, DataFrame]:
    """The state with new messages, and the labels (id, root) that are new or other than before. The labels are those of
    build(weak=False) over all messages.

    New edges are contracted against the labels: between classes, not messages, so the components that are looked for are as
    small as what the batch ties together. Only classes that lose their root are labelled anew.
    """
    ids = items.select(F.lit("id").alias("kind"), normalise_id(F.col("message_id")).alias("k"), "id").filter(F.col("k").isNotNull())
    keys = items.select(F.lit("conv").alias("kind"), F.col("conv_key").alias("k"), "id").filter(F.col("k") != "")
    own = cut(ids.union(keys))
    first = cut(own.groupBy("kind", "k").agg(F.min("id").alias("head")).join(state.heads, ["kind", "k"], "left_anti"))
    heads = state.heads.unionByName(first)
    met = own.join(heads, ["kind", "k"]).select(F.col("id").alias("a"), F.col("head").alias("b"))
    refers = items.select(F.explode(F.array_distinct(referenced_ids(F.col("in_reply_to"), F.col("refs")))).alias("k"), "id")
    asked = cut(refers.union(state.waiting.join(first.filter("kind = 'id'"), "k", "left_semi").select("k", "id")))
    known = heads.filter("kind = 'id'").select("k", "head")
    edges = met.union(asked.join(known, "k").select("id", "head"))
    waiting = state.waiting.join(first.filter("kind = 'id'"), "k", "left_anti").unionByName(refers.join(known, "k", "left_anti"))
    of = lambda side: state.labels.select(F.col("id").alias(side), F.col("root").alias(f"root_{side}"))
    classes = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    tied = cut(components(classes.filter("a <> b").distinct()).select("node", F.col("root").alias("into")))
    moved = state.labels.join(tied, F.col("root") == F.col("node")).select("id", F.col("into").alias("root"))
    new = items.select("id").distinct().join(tied, F.col("id") == F.col("node"), "left").select("id", F.coalesce("into", "id").alias("root"))
    changed = cut(moved.union(new))
    labels = state.labels.join(changed.select("id"), "id", "left_anti").unionByName(changed)
    return State(cut(labels), cut(heads), cut(waiting)), changed
