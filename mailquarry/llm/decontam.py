"""Benchmark decontamination by rare n-gram seeds and local alignment.

Test items are cut into word n-grams, whose document counts are taken over the whole corpus. In every run of
WINDOW n-grams of an item the rarest is a seed, so a copy with that many n-grams unedited in a row shares one,
however common the item is in the corpus. Passages around seeds meet their items in an equi-join on the seed,
and Smith-Waterman alignment of the words scores each pair.

The executors test n-grams against a bitmap of fixed size, whatever the size of the benchmark; only n-grams
that pass reach the shuffle. Counts are summed in each batch first. Seeds are broadcast within BROADCAST_ROWS rows, items
within 64 MB; beyond that they are shuffled.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, lower-cased. Defined results:
null and empty texts and items match nothing; items with fewer words than an n-gram are never matched, as a word or two
prove nothing (too_short() lists them); items with the same words are one, which has the smallest item_id of them and
their number (same_items() lists them all); repeated rows and null doc_ids are searched like any other row; an empty
benchmark or corpus gives no pairs. A very long text is hashed in parts that are cut between words, a word longer than
such a part by itself. Columns other than doc_id, text and item_id are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, bounded_bytes, cut, mark, only, table, without
from .common import parts as batched
from .wordhash import Words, runs

NGRAM, WINDOW = 3, 2
#: Alignment scores, and the share of an item's own score from which a passage is a copy of it.
MATCH, MISMATCH, GAP = 2, -1, -2
LEAST = 0.4
#: Bits of the bitmap, as a power of two.
BITMAP = 26
BROADCAST_ROWS = 1_000_000
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_IS_WORD = np.array([chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" or c >= 128 for c in range(256)])
_HASHED = Words(_IS_WORD)


def grams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Number of the text, place of its first word (0) and hashes of all its n-grams, for texts that have some."""
    for j, hashes in _HASHED.of([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]):
        if len(hashes) >= NGRAM:
            yield j, 0, runs(hashes, NGRAM)


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").lower().encode("utf-8", "surrogatepass"))


class Bitmap:
    """Two bits a hash in a bitmap of fixed size; may say yes wrongly, never no."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, g: np.ndarray) -> np.ndarray:
        low = np.uint64((1 << BITMAP) - 1)
        out = np.ones(len(g), bool)
        for shift in (0, 32):
            at = (g >> np.uint64(shift)) & low
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def bitmap_of(frame: DataFrame) -> Bitmap:
    """Of the column gram. Built by the executors; at most 2 ** BITMAP bits go to the driver."""
    low = (1 << BITMAP) - 1
    place = F.explode(F.array(F.col("gram").bitwiseAND(low) + 1, F.shiftrightunsigned("gram", 32).bitwiseAND(low) + 1)).alias("p")
    parts = frame.select(place).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros(1 << (BITMAP - 3), np.uint8)
    for r in parts.collect():
        # bit p of bucket k stands for the number (k - 1) * 32768 + p + 1
        at = (r.k - 1) * 4096
        part = np.frombuffer(bytes(r.bits), np.uint8)[: max(0, len(bits) - at)]
        bits[at : at + len(part)] |= part
    return Bitmap(bits)


def _item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        rows = [(ids[j], k, g) for j, _, gs in grams(texts) for k, g in enumerate(gs.view(np.int64).tolist())]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item", "pos", "gram"])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = list(map(words, b.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b" ".join(w) for w in own], pa.binary()), pa.array(map(len, own), pa.int64())], names=["item_id", "text", "n"])


def same_items(benchmark: DataFrame) -> DataFrame:
    """item_id, text (the words, with a blank between), n (their number) and same_id, the smallest item_id with these words, of every item."""
    own = only(benchmark, "item_id", "text").mapInArrow(_item_words, "item_id long, text binary, n long")
    least = own.groupBy("text").agg(F.min("item_id").alias("same_id"))
    return own.join(least, "text").select("item_id", "text", "n", "same_id")


def too_short(benchmark: DataFrame) -> DataFrame:
    """The item_id of the items that are never matched, as they have fewer words than an n-gram."""
    return same_items(benchmark).filter(F.col("n") < NGRAM).select("item_id")


def _counting(bitmap):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batched(batches, 0):
            df: Counter = Counter()
            for _, _, g in grams(b.column(0).to_pylist()):
                hit = g[bitmap.value.has(g)]
                if len(hit):
                    df.update(np.unique(hit).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.int64()), pa.array(list(df.values()), pa.int64())], names=["gram", "df"])

    return count


def _passages(bitmap, longest: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batched(batches):
            rows = []
            ids, texts, marks = (b.column(k).to_pylist() for k in range(3))
            for j, _, g in grams(texts):
                at = np.flatnonzero(bitmap.value.has(g))
                if not len(at):
                    continue
                own = words(texts[j])
                cuts = np.flatnonzero(np.diff(at) > longest) + 1
                for part in np.split(at, cuts):
                    a, z = max(0, int(part[0]) - longest), int(part[-1]) + NGRAM + longest
                    rows.append((ids[j], marks[j], a, np.unique(g[part]).view(np.int64).tolist(), b" ".join(own[a:z])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "mark", "first", "seeds", "passage"])

    return find


def align(item: list[bytes], passage: list[bytes]) -> tuple[int, int, int]:
    """Best local alignment score of two word sequences, and the words [start, end) of the passage in it.

    A row of the matrix at a time; gaps along the row come from a running maximum.
    """
    code = {w: k for k, w in enumerate(set(item))}
    p = np.array([code.get(w, -1) for w in passage])
    n = len(p)
    step = -GAP * np.arange(n + 1)
    h, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, start, end = 0, 0, 0
    for w in item:
        diagonal = h[:-1] + np.where(p == code[w], MATCH, MISMATCH)
        t = np.concatenate(([0], np.maximum(np.maximum(diagonal, h[1:] + GAP), 0)))
        o = np.arange(n + 1)
        o[1:] = np.where(t[1:] == 0, o[1:], np.where(t[1:] == diagonal, origin[:-1], origin[1:]))
        lifted = t + step
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        h, origin = top - step, o[source]
        k = int(np.argmax(h))
        if h[k] > best:
            best, start, end = int(h[k]), int(origin[k]), k
    return best, start, end


def _scoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batched(batches, 4):
        doc, own, item, first, passage, text = (b.column(k).to_pylist() for k in range(6))
        score, start, end = [], [], []
        for f, p, t in zip(first, passage, text, strict=True):
            mine = t.split(b" ")
            s, a, z = align(mine, p.split(b" "))
            score.append(s / (MATCH * len(mine)))
            start.append(f + a)
            end.append(f + z)
        arrays = [pa.array(x, pa.int64()) for x in (doc, own, item)] + [pa.array(score, pa.float64())] + [pa.array(x, pa.int64()) for x in (start, end)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "mark", "item", "score", "start_word", "end_word"])


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, mark, item_id, n_items (items with the same words), score (1: the whole item, word for word), start_word and
    end_word of the best passage, for every pair of a document and a test item that scores at least `least`. Of items with the same
    words the smallest item_id stands for all."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    given = same_items(benchmark).filter(F.col("n") >= NGRAM).groupBy("text").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items"))
    items = cut(given.withColumn("item", F.monotonically_increasing_id()))
    pieces = cut(items.select("item", F.col("text").cast("string").alias("text")).mapInArrow(_item_grams, "item long, pos long, gram long"))
    rows = only(docs, "doc_id", "text")
    counts = rows.select("text").mapInArrow(_counting(sc.broadcast(bitmap_of(pieces))), "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))
    run = W.partitionBy("item").orderBy("pos").rowsBetween(0, WINDOW - 1)
    rated = pieces.join(counts, "gram", "left").select("item", "pos", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram").alias("rate"))
    seeds = cut(rated.select("item", F.min("rate").over(run)["gram"].alias("gram")).distinct())
    # an item's gram count, and two more words, bounds its length
    longest = (pieces.agg(F.max("pos")).first()[0] or 0) + NGRAM
    own_seeds, own_items = bounded(seeds, BROADCAST_ROWS), bounded_bytes(items, "text")
    marked = rows.select("doc_id", "text", mark(F.col("text")).alias("mark"))
    found = marked.mapInArrow(_passages(sc.broadcast(bitmap_of(seeds)), longest), "doc_id long, mark long, first long, seeds array<long>, passage binary")
    found = cut(found.withColumn("at", F.monotonically_increasing_id()))
    met = found.select("at", F.explode("seeds").alias("gram")).join(own_seeds, "gram").select("at", "item").distinct()
    pairs = met.join(found, "at").join(own_items, "item").select("doc_id", "mark", "item", "first", "passage", "text")
    scored = pairs.mapInArrow(_scoring, "doc_id long, mark long, item long, score double, start_word long, end_word long").filter(F.col("score") >= least)
    best = scored.groupBy("doc_id", "mark", "item").agg(F.max(F.struct("score", -F.col("start_word"), "end_word")).alias("b"))
    best = best.join(own_items.select("item", "item_id", "n_items"), "item")
    return best.select("doc_id", "mark", "item_id", "n_items", F.col("b.score").alias("score"), (-F.col("b.col2")).alias("start_word"), F.col("b.end_word").alias("end_word"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "n_items", F.round("score", 6).alias("score"), "start_word", "end_word")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a copy of a test item, with all their columns."""
    return without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "mark").distinct())
