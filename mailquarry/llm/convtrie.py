"""Prefix trie of conversations, from the longest common prefixes of conversations in sorted order.

Equal conversations are one class. Classes are sorted by their turns, and between neighbours in this order stands the length of their
common prefix. In the Cartesian tree over these lengths a node that covers the classes [left, right) is a place where the trie
branches: left and right are the nearest places with a smaller length. They are found for all places in parallel: each block of
the order works with a stack of its own, and what reaches beyond a block finds its ends by the blocks' minima and in the lists of
prefix and suffix minima of the block that they name. Places of equal length with the same ends are one node; the depths between a node and its parent are
nodes with one child and the same members. All that is asked of a node comes from sums over its interval.

Turns are known by 128 bits of hashes of role and text. Positions in a conversation are counted over a global sort, so a conversation
with very many turns is spread over tasks. Classes are compared by their first FIRST turns, and by twice as many as long as another class has the same ones: a row
holds at most twice as many turns as it shares with another class.

Defined results: null roles and texts are empty; turns go by turn (nulls first), role and text; repeated rows are turns of their own; rows with a null conv_id
belong to no conversation and are left out; a null turn is a place in the order like others. The remainder of a negative conv_id is
negative or 0, as in SQL. An empty table has no members and so no nodes. A very long text is only hashed and measured. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import file_of, numbered, only, ordered, table, written

#: Turns by which classes are compared at first.
FIRST = 64
#: Least classes of a block, and most blocks; what the driver keeps of a block is six numbers.
BLOCK, BLOCKS = 4096, 1 << 16
#: Depths of an interval that are written out by one task, and ids that are joined before they are digested.
DEPTHS, IDS = 4096, 4096


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), k1 and k2 (hashes of the turn) and size (bytes of its text) of every row (conv_id, turn, role, text)."""
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    own = only(rows, "conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL")
    own = own.select("conv_id", "turn", empty("role"), empty("text"), F.monotonically_increasing_id().alias("row"))
    hashed = ordered(own, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row"))
    # the texts go no further
    return _positions(hashed.select("conv_id", "at", F.xxhash64("role", "text").alias("k1"), F.xxhash64("text", F.lit(1), "role").alias("k2"), F.octet_length("text").cast("long").alias("size")))


def _positions(rows: DataFrame) -> DataFrame:
    """Rows in the order of `at` with their position in their conversation: within a file by `at`, which has no gaps there, and
    behind the rows that files before it have of the conversation."""
    parts = rows.groupBy("conv_id", file_of(F.col("at")).alias("file")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("conv_id").alias("of"), "file", "first", before.alias("before"))
    met = rows.join(parts, (F.col("conv_id") == F.col("of")) & (file_of(F.col("at")) == F.col("file")))
    return met.withColumn("pos", F.col("at") - F.col("first") + F.col("before") + 1).drop("of", "file", "first", "before")


def rebuilt(turns: DataFrame, head: int = 9, family: int = 5) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations, and conv_id of all of them: the first h turns of the first conversation
    of a family, then a conversation's own after its first h; h is the checksum of its id modulo `head`."""
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("length"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % head).alias("h")
    convs = written(lengths.select("conv_id", "length", h, (F.col("conv_id") - F.col("conv_id") % family).alias("base")))[0]
    firsts = convs.filter("conv_id = base").select(F.col("base").alias("first"), F.col("length").alias("available"))
    convs = convs.join(firsts, F.col("base") == F.col("first"), "left").withColumn("taken", F.least("h", F.coalesce("available", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "taken"))[0]
    heads = turns.filter(F.col("pos") < head).join(convs.filter("taken > 0").withColumnRenamed("conv_id", "of"), (F.col("conv_id") == F.col("base")) & (F.col("pos") <= F.col("taken")))
    own = turns.join(convs.withColumnRenamed("conv_id", "of"), (F.col("conv_id") == F.col("of")) & (F.col("pos") > F.col("h")))
    keys = ["k1", "k2", "size"]
    heads = heads.select(F.col("of").alias("conv_id"), "pos", *keys)
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), *keys)
    return heads.union(own), convs.select("conv_id")


def _sum_of_places(salt: int) -> Column:
    """A hash of a conversation, as the exclusive or of hashes of its turns with their places."""
    return F.bit_xor(F.xxhash64("pos", "k1", "k2", F.lit(salt)))


def classes_of(turns: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cls (smallest conv_id), length, members and total (bytes) of each class of equal conversations; and conv_id with cls."""
    whole = turns.groupBy("conv_id").agg(F.max("pos").alias("length"), F.sum("size").alias("total"), _sum_of_places(1).alias("x1"), _sum_of_places(2).alias("x2"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    each = written(ids.join(whole, "conv_id", "left").select("conv_id", *(zero(c) for c in ("length", "total", "x1", "x2"))))[0]
    same = ["length", "total", "x1", "x2"]
    classes = written(each.groupBy(*same).agg(F.min("conv_id").alias("cls"), F.count(F.lit(1)).alias("members")))[0]
    return classes.select("cls", "length", "members", "total"), each.join(classes, same).select("conv_id", "cls", "length")


def sorted_classes(turns: DataFrame, classes: DataFrame) -> DataFrame:
    """classes by their turns, with place (from 0), lcp (turns shared with the class before, -1 for the first), next_lcp (-1 for the last)
    and shared (bytes of the lcp turns)."""
    depth = FIRST
    settled = classes.filter(F.col("length") <= depth).select("cls", F.lit(depth).cast("long").alias("depth"))
    left = written(classes.filter(F.col("length") > depth).select("cls", "length"))[0]
    while not left.isEmpty():
        firsts = turns.filter(F.col("pos") <= depth).join(left, "cls").groupBy("cls", "length").agg(_sum_of_places(1).alias("x1"), _sum_of_places(2).alias("x2"))
        firsts = written(firsts)[0]
        shared = firsts.groupBy("x1", "x2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("x1", "x2")
        again = written(firsts.join(shared, ["x1", "x2"], "left_semi").select("cls", "length"))[0]
        settled = settled.union(left.join(again, "cls", "left_anti").select("cls", F.lit(depth).cast("long").alias("depth")))
        depth *= 2
        settled = settled.union(again.filter(F.col("length") <= depth).select("cls", F.lit(depth).cast("long").alias("depth")))
        left = written(again.filter(F.col("length") > depth))[0]
    # one turn more, so that a class comes behind one that ends where it goes on
    own = turns.join(settled, "cls").filter(F.col("pos") <= F.col("depth") + 1)
    listed = own.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("pos", "k1", "k2", "size"))).alias("list"))
    keys = F.flatten(F.transform("list", lambda x: F.array(x["k1"], x["k2"])))
    none = F.array().cast("array<bigint>")
    rows = classes.join(listed, "cls", "left").select(classes["*"], F.coalesce(keys, none).alias("keys"), F.coalesce(F.transform("list", lambda x: x["size"]), none).alias("sizes"))
    rows = ordered(rows, F.col("keys"))
    # the class before: in the same file, or the last of the files before
    lasts = rows.groupBy(file_of(F.col("at")).alias("file")).agg(F.max_by("keys", "at").alias("keys"))
    lasts = lasts.select("file", F.lag("keys").over(W.orderBy("file")).alias("other"))
    inner = F.lag("keys").over(W.partitionBy(file_of(F.col("at"))).orderBy("at"))
    met = rows.withColumn("inner", inner).join(lasts, file_of(F.col("at")) == F.col("file"), "left").withColumn("before", F.coalesce("inner", "other"))
    # two numbers a turn; the first place that differs, from 1, or 0
    differs = F.array_position(F.zip_with("keys", "before", lambda a, b: a.eqNullSafe(b)), False)
    lcp = F.when(F.col("before").isNull(), -1).otherwise(F.floor(F.when(differs > 0, differs - 1).otherwise(F.size("keys")) / 2)).cast("long")
    met = met.select("cls", "length", "members", "total", "at", lcp.alias("lcp"), "sizes")
    shared = F.aggregate(F.slice("sizes", 1, F.greatest(F.col("lcp"), F.lit(0)).cast("int")), F.lit(0).cast("long"), lambda s, x: s + x)
    placed = written(numbered(met.withColumn("shared", shared).drop("sizes")).drop("at"))[0]
    following = placed.select((F.col("place") - 1).alias("of"), F.col("lcp").alias("next"))
    return placed.join(following, F.col("place") == F.col("of"), "left").select(placed["*"], F.coalesce("next", F.lit(-1).cast("long")).alias("next_lcp"))


class Least:
    """Smallest values of ranges."""

    def __init__(self, values: np.ndarray):
        self.levels = [np.asarray(values, np.int64)]
        while 1 << len(self.levels) <= len(values):
            low, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of [start, end), none of them empty."""
        level = np.frompyfunc(int.bit_length, 1, 1)((end - start).astype(object)).astype(np.int64) - 1
        out = np.empty(len(start), np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.levels[k][start[own]], self.levels[k][end[own] - (1 << k)])
        return out


def walk(lcp: list[int]) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """By a stack, for each place: the nearest one before and behind with a smaller length (-1: not here), and its group, the first
    place with its length under the same node; and the minima from the start and from the end, by place."""
    n = len(lcp)
    left, right, group, heads, stack = [-1] * n, [-1] * n, [0] * n, [], []
    for k, v in enumerate(lcp):
        while stack and lcp[stack[-1]] > v:
            right[group[stack.pop()]] = k
        if stack and lcp[stack[-1]] == v:
            group[k] = group[stack[-1]]
            stack[-1] = k
            continue
        if stack:
            left[k] = stack[-1]
        else:
            heads.append(k)
        group[k] = k
        stack.append(k)
    return left, right, group, heads, stack


SUMS = ("members", "copied", "shared", "leaves")
_LONGS = lambda names: ", ".join(f"{n} long" for n in names.split())
#: A node with both ends in its block, or a leaf: its first class, depths (above, depth], sums, places of its length, whether its first class ends at
#: depth, and its parent's conv_id, or where that isn't known here its parent's group.
NODE = "cls above depth conv n_convs n_leaves sums equal ended parent_conv parent"
#: The part that a block has of a node that reaches beyond it. left_here and right_here: whether that end is in the block.
FRAGMENT = "place depth equal left_here right_here"
#: A minimum from a block's start ('head') or end ('tail'): the end of all nodes with depths in (value, upto]. Sums are up to it; shared ones of a
#: tail include its own. low: smallest conv_id from the block's start to it, or from it to the block's end.
END = "value upto place_group members copied shared leaves low cls length"
#: Of a block: smallest length and conv_id, and sums.
TOTAL = "least low members copied shared leaves"
_ALL = "kind string, block long, " + _LONGS(" ".join(dict.fromkeys(f"{NODE} {FRAGMENT} {END} {TOTAL}".split())))
_FAR = 1 << 62


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("place", ignore_index=True)
    block, first, n = int(rows["block"][0]), int(rows["place"][0]), len(rows)
    column = lambda c: rows[c].to_numpy(np.int64)
    length, cls, total, members, following = (column(c) for c in ("length", "cls", "total", "members", "next_lcp"))
    lcp = np.concatenate((column("lcp"), [-1] if following[-1] < 0 else [])).astype(np.int64)  # behind the last class of all nothing is shared
    left, right, group, heads, tails = walk(lcp.tolist())
    left, right, group = (np.array(x, np.int64) for x in (left, right, group))
    values = dict(zip(SUMS, (members, (members - 1) * total, column("shared"), (following < length).astype(np.int64)), strict=True))
    upto = {k: np.concatenate(([0], np.cumsum(v))) for k, v in values.items()}
    least = Least(cls)
    out = []

    def put(kind: str, **columns) -> None:
        out.append(pd.DataFrame({"kind": kind, "block": block, **columns}))

    groups = np.flatnonzero((group == np.arange(len(lcp))) & (lcp >= 0))
    equal = np.bincount(group, minlength=len(lcp))
    known = (left[groups] >= 0) & (right[groups] >= 0)
    own = groups[known]
    a, z = left[own], right[own]
    conv = np.full(len(lcp), -_FAR)
    conv[own] = least.of(a, z) if len(own) else 0
    span = lambda k: upto[k][z] - upto[k][a]

    def parents(of: np.ndarray, above: np.ndarray) -> dict:
        """of: the parents' groups here; those of nodes that reach beyond the block are known by their place."""
        here = (above >= 0) & (conv[of] != -_FAR)
        return {"parent_conv": pd.arrays.IntegerArray(conv[of], ~here), "parent": pd.arrays.IntegerArray(of + first, here | (above < 0))}

    def nodes(of: np.ndarray, above: np.ndarray, **columns) -> None:
        p = parents(of, above)
        put("node", above=above, parent_conv=p["parent_conv"], parent=p["parent"], **columns)

    if len(own):
        above = np.maximum(lcp[a], lcp[z])
        nodes(group[np.where(lcp[a] >= lcp[z], a, z)], above, cls=cls[a], depth=lcp[own], conv=conv[own], n_convs=span("members"), n_leaves=span("leaves"),
              sums=span("copied") + upto["shared"][z] - upto["shared"][a + 1], equal=equal[own], ended=(length[a] == lcp[own]).astype(np.int64))
    above = np.maximum(lcp[:n], following)
    k = np.flatnonzero(length > above)
    if len(k):
        of = np.where(lcp[k] >= following[k], group[k], k + 1)
        inside = of < len(lcp)
        of[inside] = group[of[inside]]
        for some, at in ((k[inside], of[inside]), (k[~inside], None)):
            leaf = {"cls": cls[some], "depth": length[some], "conv": cls[some], "n_convs": members[some], "n_leaves": 1, "sums": values["copied"][some], "equal": 0, "ended": 1}
            if len(some) and at is not None:
                nodes(at, above[some], **leaf)
            elif len(some):  # the first place of the next block
                put("node", above=above[some], parent=some + 1 + first, **leaf)
    g = groups[~known]
    if len(g):
        put("fragment", place=g + first, depth=lcp[g], equal=equal[g], left_here=(left[g] >= 0).astype(np.int64), right_here=(right[g] >= 0).astype(np.int64))
    h, t = np.array(heads), np.array(tails)
    put("head", value=lcp[h], upto=np.concatenate(([_FAR], lcp[h[:-1]])), place_group=group[h] + first, **{k: upto[k][h] for k in SUMS}, low=[int(cls[:x].min()) if x else _FAR for x in heads])
    if len(lcp) == n:  # nothing is behind the last block
        put("tail", value=lcp[t], upto=np.concatenate((lcp[t[1:]], [_FAR])), place_group=group[t] + first, low=[int(cls[x:].min()) for x in t.tolist()], cls=cls[t], length=length[t],
            **{k: upto[k][t + 1 if k == "shared" else t] for k in SUMS})
    put("total", least=[int(lcp.min())], low=[int(cls.min())], **{k: [int(upto[k][n])] for k in SUMS})
    names = [c.split(" ")[0] for c in _ALL.split(", ")]
    return pd.concat([x.astype({c: "Int64" for c in x.columns if c != "kind"}) for x in out], ignore_index=True).reindex(columns=names)


class Blocks:
    """What the driver keeps of all blocks: at most BLOCKS times six numbers."""

    def __init__(self, totals: list):
        totals = sorted(totals, key=lambda r: r.block)
        self.least = [r.least for r in totals]
        self.low = Least(np.array([r.low for r in totals]))
        self.before = {k: np.concatenate(([0], np.cumsum([r[k] for r in totals], dtype=np.int64))) for k in SUMS}
        self.links = {-1: self._links(range(len(totals)), -1), 1: self._links(range(len(totals) - 1, -1, -1), len(totals))}

    def _links(self, order, end: int) -> list[int]:
        """For each block the next one on a side with a smaller minimum."""
        out, stack = [end] * len(self.least), []
        for b in order:
            while stack and self.least[stack[-1]] >= self.least[b]:
                stack.pop()
            out[b] = stack[-1] if stack else end
            stack.append(b)
        return out

    def beyond(self, block: int, depth: int, side: int) -> int:
        """The nearest block on a side with a length below depth."""
        b = block + side
        while self.least[b] >= depth:
            b = self.links[side][b]
        return b


def _ends_of(shared):
    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = shared.value
        for b in batches:
            sides = ((-1, "left_block", "left_here"), (1, "right_block", "right_here"))
            for side, name, here in sides:
                b[name] = [k if h else blocks.beyond(k, d, side) for k, d, h in zip(b["block"].tolist(), b["depth"].tolist(), b[here].tolist(), strict=True)]
            yield b[["place", "depth", "equal", "left_block", "right_block"]]

    return ends


def _between(shared):
    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums from one end to the other, over blocks."""
        blocks = shared.value
        for b in batches:
            a, z = b["left_block"].to_numpy(np.int64), b["right_block"].to_numpy(np.int64)
            for k in SUMS:
                b[k] = b[f"r_{k}"] + blocks.before[k][z] - b[f"l_{k}"] - blocks.before[k][a]
            low = np.minimum(b["l_low"].to_numpy(np.int64), b["r_low"].to_numpy(np.int64))
            gap = z - a > 1
            if gap.any():
                low[gap] = np.minimum(low[gap], blocks.low.of(a[gap] + 1, z[gap]))
            b["conv"] = low
            yield b[["place", "depth", "equal", "left_block", "cls", "length", "l_value", "r_value", "parent", "conv", *SUMS]]

    return between


def tree_of(classes: DataFrame) -> DataFrame:
    """The intervals of the trie: NODE with parent_conv filled in (null for the top), from sorted classes."""
    spark = classes.sparkSession
    n = classes.count()
    size = max(BLOCK, -(-n // BLOCKS))
    dealt = classes.withColumn("block", F.floor(F.col("place") / size))
    dealt = dealt.select("block", "place", "cls", "length", "members", "total", "lcp", "next_lcp", "shared")
    parts = written(dealt.groupBy("block").applyInPandas(_block, _ALL))[0]
    of = lambda kind, names: parts.filter(F.col("kind") == kind).select("block", *names.split())
    blocks = spark.sparkContext.broadcast(Blocks(of("total", TOTAL).collect()))
    named = lambda side, letter: side.select(*(F.col(c).alias(c if c in ("cls", "length") else f"{letter}_{c}") for c in side.columns))
    tails, heads = named(of("tail", END), "l"), named(of("head", END).drop("cls", "length"), "r")
    met = of("fragment", FRAGMENT).mapInPandas(_ends_of(blocks), _LONGS("place depth equal left_block right_block"))
    met = met.join(tails, (F.col("left_block") == F.col("l_block")) & (F.col("l_value") < F.col("depth")) & (F.col("depth") <= F.col("l_upto")))
    met = met.join(heads, (F.col("right_block") == F.col("r_block")) & (F.col("r_value") < F.col("depth")) & (F.col("depth") <= F.col("r_upto")))
    met = met.withColumn("parent", F.when(F.col("l_value") >= F.col("r_value"), F.col("l_place_group")).otherwise(F.col("r_place_group")))
    fragments = written(met.mapInPandas(_between(blocks), _LONGS("place depth equal left_block cls length l_value r_value parent conv " + " ".join(SUMS))))[0]
    # the parts of a node have the same first class and depth
    wide = fragments.groupBy("cls", "depth").agg(
        F.max(F.greatest("l_value", "r_value")).alias("above"),
        F.min("conv").alias("conv"),
        F.max("members").alias("n_convs"),
        F.max("leaves").alias("n_leaves"),
        F.max(F.col("copied") + F.col("shared")).alias("sums"),
        F.sum("equal").alias("equal"),
        F.max((F.col("length") == F.col("depth")).cast("long")).alias("ended"),
        F.min("parent").alias("parent"),
    )
    wide = wide.select("cls", "above", "depth", "conv", "n_convs", "n_leaves", "sums", "equal", "ended", F.lit(None).cast("long").alias("parent_conv"), "parent")
    nodes = of("node", NODE).drop("block").unionByName(wide)
    known = fragments.select(F.col("place").alias("of"), F.col("conv").alias("of_conv"))
    met = nodes.join(known, F.col("parent") == F.col("of"), "left")
    return met.withColumn("parent_conv", F.coalesce("parent_conv", "of_conv")).drop("of", "of_conv", "parent")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (cls, conv_id) as (cls, first id, ids with commas), at most IDS ids a row."""

    def given(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([x[0] for _, x in rows], pa.int64()), pa.array([",".join(map(str, x)) for _, x in rows], pa.string())], names=["cls", "first", "ids"])

    own, ids = None, []
    for b in batches:
        done = []
        for cls, conv_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if ids and (cls != own or len(ids) == IDS):
                done.append((own, ids))
                ids = []
            own = cls
            ids.append(conv_id)
        if done:
            yield given(done)
    if ids:
        yield given([(own, ids)])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each class's ids, from rows (cls, ids) in order; a class is never held whole."""
    own, digest = None, None
    for b in batches:
        done = []
        for cls, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if digest and cls == own:
                digest.update(b"," + ids.encode())
                continue
            if digest:
                done.append((own, digest.hexdigest()))
            own, digest = cls, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_pylist([{"cls": c, "digest": d} for c, d in done])
    if digest:
        yield pa.RecordBatch.from_pylist([{"cls": own, "digest": digest.hexdigest()}])


def digests_of(members: DataFrame, classes: DataFrame) -> DataFrame:
    """cls and the digest of its conv_ids, in ascending order with commas between."""
    one = classes.filter("members = 1").select("cls", F.sha2(F.col("cls").cast("string").cast("binary"), 256).alias("digest"))
    many = members.join(classes.filter("members > 1").select("cls"), "cls", "left_semi").select("cls", "conv_id")
    joined = ordered(many, F.col("cls"), F.col("conv_id")).select("cls", "conv_id").mapInArrow(_joined, "cls long, first long, ids string")
    return one.union(joined.repartition("cls").sortWithinPartitions("cls", "first").select("cls", "ids").mapInArrow(_digested, "cls long, digest string"))


def _before(turns: DataFrame) -> DataFrame:
    """cls, pos and the bytes of the turns before, of every row (cls, pos, size)."""
    rows = ordered(turns.select("cls", "pos", "size"), F.col("cls"), F.col("pos"))
    file = file_of(F.col("at"))
    sums = rows.groupBy("cls", file.alias("file")).agg(F.sum("size").alias("all"))
    earlier = F.coalesce(F.sum("all").over(W.partitionBy("cls").orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("cls").alias("of"), "file", earlier.alias("earlier"))
    inner = F.coalesce(F.sum("size").over(W.partitionBy("cls", file).orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    met = rows.withColumn("inner", inner).join(sums, (F.col("cls") == F.col("of")) & (file == F.col("file")))
    return met.select("cls", "pos", (F.col("inner") + F.col("earlier")).alias("before"))


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node of the trie of the rebuilt conversations."""
    own = written(turns_of(conversations))[0]
    turns, ids = rebuilt(own)
    turns = written(turns)[0]
    classes, members = classes_of(turns, ids)
    members = written(members)[0]
    turns = turns.withColumnRenamed("conv_id", "cls").join(classes.select("cls"), "cls", "left_semi")
    order = sorted_classes(turns, classes)
    tree = written(tree_of(order))[0]
    # depths in pieces first, so that one long stretch is many tasks' work
    low = F.explode(F.sequence(F.col("above") + 1, F.col("depth"), F.lit(DEPTHS).cast("long")))
    pieces = tree.withColumn("low", low).withColumn("high", F.least(F.col("low") + DEPTHS - 1, F.col("depth")))
    nodes = pieces.repartition(F.xxhash64("cls", "low")).withColumn("d", F.explode(F.sequence("low", "high"))).drop("low", "high")
    # bytes above count only where conversations share a node
    need = tree.filter("n_convs > 1").groupBy("cls").agg(F.max("depth").alias("deepest"))
    before = _before(turns.join(need, "cls").filter(F.col("pos") <= F.col("deepest")))
    shared = nodes.filter("n_convs > 1").join(before.select(F.col("cls").alias("of"), "pos", "before"), (F.col("cls") == F.col("of")) & (F.col("d") == F.col("pos")), "left")
    shared = shared.withColumn("saved_tokens", F.col("sums") - (F.col("n_convs") - 1) * F.coalesce("before", F.lit(0))).drop("of", "pos", "before")
    nodes = shared.unionByName(nodes.filter("n_convs = 1").withColumn("saved_tokens", F.lit(0).cast("long")))
    digests = digests_of(members, classes).withColumnRenamed("cls", "of")
    ends = (F.col("d") == F.col("depth")) & (F.col("ended") == 1)
    last = nodes.filter(ends).join(digests, F.col("cls") == F.col("of"), "left").drop("of")
    nodes = last.unionByName(nodes.filter(~ends).withColumn("digest", F.lit(hashlib.sha256(b"").hexdigest())))
    return nodes.select(
        F.col("conv").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(F.col("d") > F.col("above") + 1, F.col("conv")).otherwise(F.col("parent_conv")).alias("parent_conv_id"),
        "n_convs",
        F.when(F.col("d") < F.col("depth"), 1).when(F.col("equal") > 0, F.col("equal") + 1 - F.col("ended")).otherwise(0).cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.col("digest").alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM o),
c AS (SELECT DISTINCT conv_id AS c, conv_id - conv_id % 5 AS b, 0 AS h FROM o),
x AS (SELECT c, b, c::VARCHAR AS s, 4294967295::BIGINT AS r, 0 AS k FROM c
      UNION ALL
      SELECT c, b, s, xor(r >> 8, (list_reduce([xor(r, ascii(s[k + 1])) & 255] || range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))), k + 1 FROM x WHERE k < length(s)),
h AS MATERIALIZED (SELECT c, b, xor(r, 4294967295) % 9 AS h FROM x WHERE k = length(s)),
p AS (SELECT c, pos, role, text FROM h JOIN t ON t.conv_id = b AND pos <= h
      UNION ALL SELECT c, pos + 100, role, text FROM h JOIN t ON t.conv_id = c AND pos > h),
q AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, sha256(role || chr(0) || sha256(text)) AS k, strlen(text) AS size FROM p),
w AS MATERIALIZED (SELECT c, d, size, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS path, max(d) OVER (PARTITION BY c) AS len FROM q
      UNION ALL SELECT c, 0, 0, '', coalesce(len, 0) FROM h LEFT JOIN (SELECT c, max(d) AS len FROM q GROUP BY c) USING (c)),
n AS MATERIALIZED (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len), '')) AS ends FROM w GROUP BY path, d),
k AS (SELECT left(path, (64 * (d - 1))::INT) AS up, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.path),
u AS (SELECT left(path, (64 * a)::INT) AS up, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved
      FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN u ON u.up = f.path LEFT JOIN n g ON f.d > 0 AND g.path = left(f.path, (64 * (f.d - 1))::INT)
"""
