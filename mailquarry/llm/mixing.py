"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a weight. The mix is `share` times all words; each source gets its part by weight, but at most `most` times its
own words, and what it can't take goes to the others by weight again. A document of a source with the target t and s words is
wanted t / s times: its whole copies are taken, and of the fraction that is left a copy is taken or not.

These fractions are rounded dependently. Of two documents one hands words to the other, in a random direction that
keeps each one's expectation, until one of them is taken whole or not at all; the other goes on. So the words of a source stay what they were, but for
the one document that is left at the end, which is taken or not as is nearer. Documents are dealt to nodes of about FAN by a hash, a node's leftover meets those of FAN
neighbouring nodes one level up, and so on: a tree with few levels, in which no task holds more than a node. Masses are whole numbers of 1 / 65536 of a
word, so meetings lose nothing; coins are hashes, so a run that is repeated gives the same rows.
All of it is DataFrame work inside the JVM.

Defined results: a null text has no words; documents without words have nothing taken; a null source is a source and comes
last; null doc_ids are rows like others; rows that repeat in full are rows of their own, and which of them is taken makes no difference; equal
hashes are told apart by id and text. A source without words has the target 0. An empty table gives no rows. A very long text is only counted. Other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mark, numbered, only, ordered, positional, table, written

#: Weights of the registered query, repeated over the sources in their order; the mix in parts of all words; the most times a document is taken.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Documents or leftovers of a node.
FAN = 64
#: Bits behind the point of a mass.
POINT = 16

_BLANKS = "\x20\x09-\x0d"


def words(text: Column) -> Column:
    """Number of words. Each is cut to one letter first, so that no array of them is built."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{_BLANKS}]+", "x"), f"[{_BLANKS}]+", "")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes (source, source_size) with each source's target. The driver sees three sums a round."""
    place = numbered(ordered(sizes, F.col("source").asc_nulls_last())).drop("at")
    weighed = written(place.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))))[0]
    cap = F.col("source_size") * F.lit(float(most))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = cap <= F.col("weight") * F.lit(level)
        row = weighed.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count(F.when(over, 1))).first()
        if row[2] == full or not row[1]:
            break
        full, level = row[2], (share * total - row[0]) / row[1]
    return weighed.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def _let(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _coin(a: Column, b: Column, seed: int) -> Column:
    """At random in [0, 1)."""
    return F.xxhash64(a, b, F.lit(seed)).bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))


def _whole(x: Column) -> Column:
    return F.shiftleft(x["size"], POINT)


def _settled(x: Column, mass: Column) -> Column:
    return F.struct(*(x[c].alias(c) for c in ("doc_id", "mark", "copy", "size")), (mass > 0).alias("won"))


def _with(x: Column, mass: Column) -> Column:
    return F.struct(*(mass.alias(c) if c == "mass" else x[c].alias(c) for c in ("key", "doc_id", "mark", "copy", "size", "mass")))


def _meet(s: Column, x: Column, seed: int) -> Column:
    """The state after the document that is left and the next have met: one of them, or both, are settled."""
    held = s["held"]

    def moved(m: Column) -> Column:
        first, second = held["mass"] + m, x["mass"] - m
        one, two = (first == 0) | (first == _whole(held)), (second == 0) | (second == _whole(x))
        done = F.concat(s["out"], F.when(one & two, F.array(_settled(held, first), _settled(x, second))).when(one, F.array(_settled(held, first))).otherwise(F.array(_settled(x, second))))
        return F.struct(F.when(one & two, F.lit(None)).when(one, _with(x, second)).otherwise(_with(held, first)).alias("held"), done.alias("out"))

    ways = F.struct(F.least(_whole(held) - held["mass"], x["mass"]).alias("up"), F.least(held["mass"], _whole(x) - x["mass"]).alias("down"))
    mass = _let(ways, lambda w: F.when(_coin(held["key"], x["key"], seed) * (w["up"] + w["down"]) < w["down"], w["up"]).otherwise(-w["down"]))
    return F.when(held.isNull(), F.struct(x.alias("held"), s["out"].alias("out"))).otherwise(_let(mass, moved))


ITEM = "struct<key:bigint,doc_id:bigint,mark:bigint,copy:bigint,size:bigint,mass:bigint>"
DONE = "array<struct<doc_id:bigint,mark:bigint,copy:bigint,size:bigint,won:boolean>>"


def _level(items: DataFrame, seed: int) -> DataFrame:
    """source, node, nodes, held (the leftover or null) and out (what is settled) of every node."""
    nodes = items.groupBy("source", "node", "nodes").agg(F.sort_array(F.collect_list("item")).alias("list"))
    start = F.struct(F.lit(None).cast(ITEM).alias("held"), F.array().cast(DONE).alias("out"))
    return nodes.select("source", "node", "nodes", F.aggregate("list", start, lambda s, x: _meet(s, x, seed)).alias("s")).select("source", "node", "nodes", "s.held", "s.out")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0) -> DataFrame:
    """doc_id, mark, source, size, source_size, target, copies and taken (copies times size) for every row of docs."""
    rows = written(only(docs, "doc_id", "text", "source").select("doc_id", mark(F.col("text")).alias("mark"), "source", words(F.col("text")).alias("size")))[0]
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    filled = rows.filter("size > 0").groupBy("source").agg(F.count(F.lit(1)).alias("filled"))
    goals = written(goals.join(filled, goals["source"].eqNullSafe(filled["source"]), "left").select(goals["*"], F.coalesce("filled", F.lit(0)).alias("filled")))[0]
    # rows that repeat in full get numbers, so that no node has more than its part of them
    each = rows.groupBy("doc_id", "mark", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
    own = goals.withColumnRenamed("source", "of")
    rate = F.col("target") / F.greatest("source_size", F.lit(1))
    met = each.join(own, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("mass", F.floor((rate - F.floor(rate)) * F.shiftleft("size", POINT)))
    key = F.xxhash64("doc_id", "mark", "copy", F.lit(seed))
    nodes = F.ceil(F.col("filled") / FAN)
    items = met.filter("mass > 0").select("source", F.pmod(key, nodes).alias("node"), nodes.alias("nodes"), F.struct(key.alias("key"), "doc_id", "mark", "copy", "size", "mass").alias("item"))
    decided = met.filter("mass = 0").select("source", "doc_id", "mark", "copy", "size", F.lit(False).alias("won"))
    width = goals.agg(F.max(F.ceil(F.col("filled") / FAN))).first()[0] or 0
    depth = 0
    while width:
        level = written(_level(items, seed + depth))[0]
        decided = decided.union(level.select("source", F.inline("out")))
        items = level.filter("held IS NOT NULL").select("source", F.floor(F.col("node") / FAN).alias("node"), F.ceil(F.col("nodes") / FAN).alias("nodes"), F.col("held").alias("item"))
        depth += 1
        if width == 1:
            break
        width = -(-width // FAN)
    if depth:  # one document of each source at most, to the nearer side
        decided = decided.union(items.select("source", "item.doc_id", "item.mark", "item.copy", "item.size", (F.col("item.mass") * 2 >= _whole(F.col("item"))).alias("won")))
    out = decided.join(own, F.col("source").eqNullSafe(F.col("of")))
    copies = F.when(F.col("size") > 0, F.floor(rate) + F.col("won").cast("long")).otherwise(0)
    return out.select("doc_id", "mark", "source", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of docs, each as often as plan (what mix() gave for docs) takes it. Of rows with the same id, text and source one stands for all."""
    rows, doc_id, text, named = positional(docs)
    source = f"c{docs.columns.index('source')}"
    wanted = plan.filter("copies > 0").groupBy(F.col("doc_id").alias("p_id"), F.col("mark").alias("p_mark"), F.col("source").alias("p_source")).agg(F.sum("copies").alias("p_n"))
    rows = rows.withColumn("p_own", mark(F.col(text)))
    same = F.col(doc_id).eqNullSafe(F.col("p_id")) & (F.col("p_own") == F.col("p_mark")) & F.col(source).eqNullSafe(F.col("p_source"))
    met = rows.dropDuplicates([doc_id, "p_own", source]).join(wanted, same)
    return named(met.withColumn("p_copy", F.explode(F.sequence(F.lit(1), F.col("p_n")))))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
