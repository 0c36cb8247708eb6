"""A search index that takes new, changed and deleted messages, and ranks from its own lists.

The index is a folder of segments, each written once. A commit adds a segment and names, for the older ones, the messages that are dead in them: those that the
batch brings anew or that were deleted. What counts is said by a manifest of its own number; a manifest is put in its place whole or not at all, so
a commit that fails is never seen, and a reader keeps the snapshot that it opened. Segments of like size are merged when there
are FAN of them, without what is dead, so there are few and each message is written again a number of times that grows with the logarithm of all.

A segment has lists, as operators.lists has them:
* blocks: for each token, in each shard of messages, its messages by id with their length and the token's count and places a field, at most BLOCK a row, with
  bounds of every score in the row; the empty token lists all messages. Texts are dealt by shard and id before tokens are made of them, so blocks of a list don't overlap;
* files: the lists of attachments, for words, prefixes and phrases.

Ranking follows operators.rank over message fields, without reading a text. Each shard is one task: the stretches between block ends are visited by
the sum of their blocks' bounds, and none is opened once that sum is below the score of the last place that counts. The best of all shards meet in one sort.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailquarry.operators.lists import SCHEMA, entries, inverted, merged, postings_of, read_lists, write_lists
from mailquarry.operators.manifest import Manifests, delete_others
from mailquarry.operators.rank import K1, WEIGHTS, B
from mailquarry.operators.store import cut, exists

FIELDS = list(WEIGHTS)
#: Marks the fields of attachments, which have postings but no part in the ranking.
MARK = "att:"
FILE_FIELDS = [MARK + "name", MARK + "content"]
#: Messages of a block; segments of like size that are merged; shards of a new index; manifests that vacuum() keeps.
BLOCK, FAN, SHARDS, KEEP = 128, 4, 32, 2


def of_files(attachments: DataFrame) -> DataFrame:
    """Attachments as rows of their message's id."""
    return attachments.selectExpr("message_id AS id", "idx_path AS unit", f"name AS `{FILE_FIELDS[0]}`", f"content AS `{FILE_FIELDS[1]}`")


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")


@dataclass
class Segment:
    """Figures are of what is alive."""

    name: str
    rows: int
    tokens: int
    dead: list[str] = field(default_factory=list)
    dead_rows: int = 0


@dataclass
class Manifest:
    version: int
    shards: int
    segments: list[Segment] = field(default_factory=list)


class SearchIndex:
    """Writes an index at a shared path. Several writers may try; of those that start from the same manifest one succeeds."""

    def __init__(self, spark: SparkSession, path: str, shards: int = SHARDS):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, path)
        if self.manifests.newest() is None:
            self._commit(Manifest(0, shards))

    def manifest(self, version: int | None = None) -> Manifest:
        raw = self.manifests.read(version)
        return Manifest(raw["version"], raw["shards"], [Segment(**s) for s in raw["segments"]])

    def _commit(self, m: Manifest) -> None:
        self.manifests.commit(m.version, asdict(m))

    # --- writing ------------------------------------------------------------------------------------------

    def add(self, messages: DataFrame, attachments: DataFrame | None = None) -> Manifest:
        """Messages (id and fields) and their attachments (message_id, idx_path, name, content), in place of what the index has of the same ids."""
        m = self.manifest()
        own = messages.filter("id IS NOT NULL").select("id", F.lit(None).cast("string").alias("unit"), shard_of(m.shards), *(f for f in FIELDS if f in messages.columns))
        dealt = own.repartitionById(m.shards, "shard").sortWithinPartitions("shard", "id")
        files = None if attachments is None else inverted(of_files(attachments).withColumn("shard", F.lit(0)), FILE_FIELDS, [0.0] * len(FILE_FIELDS), BLOCK)
        segment = self._write(inverted(dealt, FIELDS, list(WEIGHTS.values()), BLOCK), files)
        return self._replace(m, messages.select("id"), segment)

    def delete(self, ids: DataFrame) -> Manifest:
        return self._replace(self.manifest(), ids.select("id"), None)

    def _replace(self, m: Manifest, ids: DataFrame, segment: Segment | None) -> Manifest:
        name = uuid.uuid4().hex
        ids.distinct().write.parquet(f"{self.path}/dead/{name}")
        gone = self.spark.read.parquet(f"{self.path}/dead/{name}")
        kept = []
        for s in m.segments:
            hit = self.lengths(s).join(gone, "id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
            if hit.n:
                s = Segment(s.name, s.rows - hit.n, s.tokens - hit.t, [*s.dead, name], s.dead_rows + hit.n)
            if s.rows:
                kept.append(s)
        out = Manifest(m.version + 1, m.shards, kept + ([segment] if segment and segment.rows else []))
        self._commit(out)
        return out

    def _write(self, blocks: DataFrame, files: DataFrame | None, dealt: bool = False) -> Segment:
        """A new segment; nobody knows of it yet."""
        s = Segment(uuid.uuid4().hex, 0, 0)
        write_lists(blocks, self._folder(s, "blocks"), dealt=dealt)
        if files is not None:
            write_lists(files, self._folder(s, "files"))
        size = self.lengths(s).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
        return Segment(s.name, size.n, size.t)

    def _folder(self, s: Segment, kind: str) -> str:
        return f"{self.path}/segments/{s.name}/{kind}"

    def lists(self, s: Segment, kind: str) -> DataFrame:
        """With what is dead."""
        return read_lists(self.spark, self._folder(s, kind)) if exists(self.spark, self._folder(s, kind)) else self.spark.createDataFrame([], SCHEMA)

    def lengths(self, s: Segment) -> DataFrame:
        all_ = self.lists(s, "blocks").filter("initial IS NULL OR initial = ''").filter("token = ''")
        return self._alive(all_.select(F.explode(F.arrays_zip("ids", "lengths")).alias("e")).select(F.col("e.ids").alias("id"), F.col("e.lengths").alias("tokens")), s)

    def _alive(self, rows: DataFrame, s: Segment) -> DataFrame:
        return rows.join(self.dead(s), "id", "left_anti") if s.dead else rows

    def dead(self, s: Segment) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/dead/{d}" for d in s.dead)).distinct()

    def postings(self, s: Segment) -> DataFrame:
        own = postings_of(self.lists(s, "blocks"), FIELDS).unionByName(postings_of(self.lists(s, "files"), FILE_FIELDS))
        return self._alive(own, s)

    def merge(self) -> Manifest:
        """Merges the segments of each size that has FAN of them, and those of which half is dead, as long as there are some."""
        while True:
            m = self.manifest()
            tiers: dict[int, list[Segment]] = {}
            for s in m.segments:
                tiers.setdefault(int(math.log(max(s.rows, 1), FAN)), []).append(s)
            some = next((own for _, own in sorted(tiers.items()) if len(own) >= FAN), None) or [s for s in m.segments if s.dead_rows > s.rows]
            if not some:
                return m
            self._merged(m, some)

    def optimise(self) -> Manifest:
        """One segment of all."""
        m = self.manifest()
        return self._merged(m, m.segments) if len(m.segments) > 1 or any(s.dead for s in m.segments) else m

    def _merged(self, m: Manifest, some: list[Segment]) -> Manifest:
        whole = self._write(self._woven(some), reduce(DataFrame.unionByName, (self._clean(s, "files", FILE_FIELDS) for s in some)), dealt=True)
        names = {s.name for s in some}
        out = Manifest(m.version + 1, m.shards, [s for s in m.segments if s.name not in names] + [whole])
        self._commit(out)
        return out

    def _clean(self, s: Segment, kind: str, fields: list[str]) -> DataFrame:
        """Lists of what is alive. Of a segment with dead messages each entry becomes a list."""
        own = self.lists(s, kind)
        if not s.dead:
            return own
        e = self._alive(entries(own, len(fields)), s)
        weighted = sum((F.lit(w) * F.get("n", F.lit(k)) for k, w in enumerate(WEIGHTS.get(f, 0.0) for f in fields)), F.lit(0.0))
        total = F.size("places")
        return e.select("initial", "token", "shard", weighted.alias("most"), F.col("tokens").alias("least"), F.array("id").alias("ids"), F.array("unit").alias("units"), F.array("tokens").alias("lengths"), F.col("n").alias("counts"), F.array(total).alias("ends"), "places")

    def _woven(self, some: list[Segment]) -> DataFrame:
        """One list by id of each token in each shard."""
        lists = reduce(DataFrame.unionByName, (self._clean(s, "blocks", FIELDS) for s in some))
        # the only exchange of a merge: rows with the same key are in one range
        dealt = lists.repartitionByRange("initial", "token", "shard").sortWithinPartitions("initial", "token", "shard", F.get("ids", F.lit(0)))
        return merged(dealt, list(WEIGHTS.values()), BLOCK)

    def vacuum(self, keep: int = KEEP) -> None:
        """Deletes manifests but the newest, and the segments and lists of dead messages that none of those names. Only for times without writers."""
        kept = [s for m in self.manifests.forget(keep) for s in m["segments"]]
        delete_others(self.spark, f"{self.path}/segments", {s["name"] for s in kept})
        delete_others(self.spark, f"{self.path}/dead", {d for s in kept for d in s["dead"]})

    def snapshot(self, version: int | None = None) -> Snapshot:
        return Snapshot(self, self.manifest(version))


def blocks_of(counts: DataFrame, keys: list[str], shards: int) -> DataFrame:
    """Rows (keys, id, tokens, n0, n1, ...) as blocks of a shard. A list's part in a shard is numbered by a window, so no task holds a whole list."""
    weighted = sum((F.lit(w) * F.col(f"n{k}") for k, w in enumerate(WEIGHTS.values())), F.lit(0.0))
    dealt = counts.withColumn("shard", shard_of(shards)).withColumn("weighted", weighted)
    place = F.row_number().over(W.partitionBy(*keys, "shard").orderBy("id"))
    dealt = dealt.withColumn("block", F.floor((place - 1) / BLOCK).cast("int"))
    listed = dealt.groupBy(*keys, "shard", "block").agg(
        F.max("weighted").alias("most"), F.min("tokens").alias("least"), F.sort_array(F.collect_list(F.struct("id", "tokens", F.array(*(f"n{k}" for k in range(len(FIELDS)))).alias("n")))).alias("rows")
    )
    return listed.select(*keys, "shard", "block", "most", "least", F.col("rows.id").alias("ids"), F.col("rows.tokens").alias("lengths"), F.flatten("rows.n").alias("counts"))


class Snapshot:
    """An index as one manifest has it."""

    def __init__(self, index: SearchIndex, manifest: Manifest):
        self.index, self.manifest, self.spark = index, manifest, index.spark

    def postings(self) -> DataFrame:
        """What plans.indexed.found_ids() looks up."""
        own = [self.index.postings(s) for s in self.manifest.segments]
        return reduce(DataFrame.unionByName, own) if own else self.spark.createDataFrame([], "initial string, token string, id long, unit string, field string, places array<int>")

    def _lists(self, term: list[str], prefix: bool, fields: list[str]) -> tuple[DataFrame, int]:
        """Blocks of a phrase (segment -1 where its blocks are made now, of what is alive) and how many messages have it in the fields."""
        columns = ("segment", "shard", "most", "least", "ids", "lengths", "counts")
        if len(term) == 1 and not prefix:
            own = lambda df: df.filter((F.col("initial") == term[0][0]) & (F.col("token") == term[0]))
            blocks = [(k, s, own(self.index.lists(s, "blocks"))) for k, s in enumerate(self.manifest.segments)]
            n = 0
            for _, s, df in blocks:
                has = lambda i: reduce(lambda a, b: a | b, (F.get("counts", i * len(FIELDS) + FIELDS.index(f)) > 0 for f in fields))
                ids = F.transform(F.filter(F.sequence(F.lit(0), F.size("ids") - 1), has), lambda i: F.get("ids", i))
                if s.dead:
                    n += df.select(F.explode(ids).alias("id")).join(self.index.dead(s), "id", "left_anti").count()
                else:
                    n += df.agg(F.coalesce(F.sum(F.size(ids)), F.lit(0))).first()[0]
            return reduce(DataFrame.union, (df.withColumn("segment", F.lit(k)).select(*columns) for k, _, df in blocks)), n
        found = self._places(term, prefix).filter(F.col("field").isin(fields))
        counts = found.groupBy("id").agg(*(F.coalesce(F.sum(F.when(F.col("field") == f, F.col("n"))), F.lit(0)).cast("int").alias(f"n{k}") for k, f in enumerate(FIELDS)))
        lengths = reduce(DataFrame.union, (self.index.lengths(s) for s in self.manifest.segments))
        counts = cut(counts.join(lengths, "id"))
        blocks = blocks_of(counts.withColumn("of", F.lit(0)), ["of"], self.manifest.shards)
        return blocks.withColumn("segment", F.lit(-1)).select(*columns), counts.count()

    def _places(self, term: list[str], prefix: bool) -> DataFrame:
        """id, field and n, how often the tokens stand in a row there. A place has one token, so tokens with the same start never share one."""
        postings = self.postings().filter(~F.startswith("field", F.lit(MARK)))

        def one(k: int) -> DataFrame:
            t = term[k]
            last = prefix and k == len(term) - 1
            some = postings.filter((F.col("initial") == t[0]) & (F.startswith("token", F.lit(t)) if last else F.col("token") == t))
            return some.select("id", "field", F.transform("places", lambda p: p - k).alias(f"p{k}"))

        found = reduce(lambda a, b: a.join(b, ["id", "field"]), (one(k) for k in range(len(term))))
        both = reduce(F.array_intersect, (F.col(f"p{k}") for k in range(len(term))))
        return found.select("id", "field", F.size(both).alias("n")).filter("n > 0")

    def ranked(self, phrases: list[tuple[list[str], bool, list[str]]], most: int | None = None, within: DataFrame | None = None) -> DataFrame:
        """id and rank as operators.rank.bm25() gives them for the whole index, of the `most` best messages and those that rank as the last of them; of all by default.
        within: the ids that may come up; corpus figures are of all."""
        rows, tokens = (sum(getattr(s, c) for s in self.manifest.segments) for c in ("rows", "tokens"))
        asked = [(t, p, [f for f in where if f in FIELDS]) for t, p, where in phrases]
        asked = [x for x in asked if x[0] and x[2]]
        nothing = self.spark.createDataFrame([], "id long, rank double")
        if not rows or not asked:
            return nothing
        lists = [self._lists(*x) for x in asked]
        odds = [math.log((rows - n + 0.5) / (n + 0.5)) for _, n in lists]
        factors = [(x if x > 0 else 1e-6) * (K1 + 1) for x in odds]
        weights = [[WEIGHTS[f] if f in where else 0.0 for f in FIELDS] for _, _, where in asked]
        blocks = reduce(DataFrame.union, (df.withColumn("phrase", F.lit(k)) for k, (df, _) in enumerate(lists)))
        shard = shard_of(self.manifest.shards)
        marks = [self.index.dead(s).select(shard, F.lit(k).alias("segment"), "id") for k, s in enumerate(self.manifest.segments) if s.dead]
        if within is not None:
            marks.append(within.select(shard, F.lit(-2).alias("segment"), "id"))
        marked = reduce(DataFrame.union, marks) if marks else self.spark.createDataFrame([], "shard int, segment int, id long")
        best = _best(factors, weights, tokens / rows or 1.0, most, within is not None)
        out = blocks.groupBy("shard").cogroup(marked.groupBy("shard")).applyInPandas(best, "id long, rank double")
        if most is None:
            return out
        out = cut(out)
        last = out.orderBy("rank").limit(most).agg(F.max("rank")).first()[0]
        return out.filter(F.col("rank") <= last) if last is not None else nothing


class _List:
    """A phrase's blocks in one segment of a shard, by id, without the messages that don't count."""

    def __init__(self, rows: pd.DataFrame, weights: list[float], factor: float, average: float):
        rows = rows.assign(first=[x[0] for x in rows["ids"]]).sort_values("first")
        self.ids = [np.asarray(x) for x in rows["ids"]]
        self.lengths, self.counts = list(rows["lengths"]), list(rows["counts"])
        self.first, self.last = np.array([x[0] for x in self.ids]), np.array([x[-1] for x in self.ids])
        self.weights, self.factor, self.average = np.array(weights), factor, average
        # of the greatest count and the smallest length; a hair more, as sums of scores round
        self.bounds = self.scored(rows["most"].to_numpy(float), rows["least"].to_numpy(float)) * (1 + 1e-9)

    def scored(self, hits: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.factor * hits / (hits + K1 * (1 - B + B * lengths / self.average))

    def bound(self, places: np.ndarray) -> np.ndarray:
        """Of the block that covers each place, or 0."""
        at = np.searchsorted(self.first, places, "right") - 1
        return np.where((at >= 0) & (places <= self.last[np.maximum(at, 0)]), self.bounds[np.maximum(at, 0)], 0.0)

    def between(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids from start to below end, which one block covers, and their scores."""
        k = int(np.searchsorted(self.first, start, "right")) - 1
        if k < 0 or self.last[k] < start:
            return np.empty(0, np.int64), np.empty(0)
        a, z = np.searchsorted(self.ids[k], [start, end])
        hits = np.asarray(self.counts[k]).reshape(-1, len(self.weights))[a:z] @ self.weights
        some = hits > 0
        return self.ids[k][a:z][some], self.scored(hits[some], np.asarray(self.lengths[k], float)[a:z][some])


def _best(factors: list[float], weights: list[list[float]], average: float, most: int | None, within: bool):
    def best(blocks: pd.DataFrame, marked: pd.DataFrame) -> pd.DataFrame:
        found = top(blocks, marked)
        return pd.DataFrame({"id": pd.Series([i for i, _ in found], dtype="int64"), "rank": pd.Series([-s for _, s in found], dtype="float64")})

    def top(blocks: pd.DataFrame, marked: pd.DataFrame) -> list[tuple[int, float]]:
        lists = [(seg, _List(own, weights[k], factors[k], average)) for (k, seg), own in blocks.groupby(["phrase", "segment"])]
        if not lists:
            return []
        marks = {seg: np.sort(own.to_numpy()) for seg, own in marked.groupby("segment")["id"]}
        has = lambda ids, own: np.isin(ids, own, assume_unique=True) if own is not None else np.zeros(len(ids), bool)
        cuts = np.unique(np.concatenate([np.concatenate((x.first, x.last + 1)) for _, x in lists]))
        bounds = sum(x.bound(cuts[:-1]) for _, x in lists)
        out: list[tuple[int, float]] = []
        least = 0.0
        for k in np.argsort(-bounds, kind="stable"):
            if bounds[k] <= 0 or bounds[k] < least:
                break
            scores: dict[int, float] = {}
            for seg, x in lists:
                ids, own = x.between(cuts[k], cuts[k + 1])
                keep = ~has(ids, marks.get(seg)) & (has(ids, marks.get(-2)) if within else True)
                for i, s in zip(ids[keep].tolist(), own[keep].tolist(), strict=True):
                    scores[i] = scores.get(i, 0.0) + s
            out += [x for x in scores.items() if x[1] >= least]
            if most is not None and len(out) > 2 * most + 100:
                out, least = cut_to(out)
        return cut_to(out)[0] if most is not None else out

    def cut_to(out: list[tuple[int, float]]) -> tuple[list[tuple[int, float]], float]:
        """The best ones and those that score as the last of them, and that score."""
        if len(out) <= most:
            return out, 0.0
        least = sorted((s for _, s in out), reverse=True)[most - 1]
        return [x for x in out if x[1] >= least], least

    return best
