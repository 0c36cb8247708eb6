"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.operators.order import file_of, numbered, ordered  # noqa: F401  operators take them from here
from mailquarry.operators.store import cut, shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table over all cores. Only a scan with fewer splits than cores, such as one small file, is dealt out anew."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def bounded(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows, which is counted; larger ones are left to be shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bounded_bytes(df: DataFrame, column: str, most: int = 64 << 20) -> DataFrame:
    """df marked for broadcast if all texts of a column, and 64 bytes a row, come to at most `most` bytes, which is summed."""
    size = df.agg(F.sum(F.octet_length(column).cast("long") + 64)).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def parts(batches: Iterator[pa.RecordBatch], column: int = 1, rows: int = 1024, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and about `size` bytes of a text column, so that what a worker
    holds as objects at a time doesn't grow with the length of texts. A longer text is a slice by itself."""
    for b in batches:
        if b.num_rows < 2:
            yield b
            continue
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.maximum.accumulate(np.cumsum(lengths) // size * (b.num_rows // rows + 1) + np.arange(b.num_rows) // rows)
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            yield b.slice(a, z - a)
        pa.default_memory_pool().release_unused()


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, by exact name; tables may have others whose names differ only in case."""
    return df.select(*(df[f"`{n}`"] for n in names)) if not _clash(df, names) else df.toDF(*_unique(df, names)).select(*names)


def _clash(df: DataFrame, names: tuple[str, ...]) -> bool:
    low = [c.lower() for c in df.columns]
    return any(low.count(n.lower()) > 1 for n in names)


def _unique(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    """Column names with all but the exact match of each wanted name set aside."""
    seen: set[str] = set()
    out = []
    for i, c in enumerate(df.columns):
        exact = c in names and c not in seen
        seen.add(c)
        out.append(c if exact or c.lower() not in {n.lower() for n in names} else f"__other_{i}")
    return out


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % folds).cast("int")


def mark(text: Column) -> Column:
    """A 64-bit hash of the text, which with doc_id tells rows apart."""
    return F.xxhash64(text)


def keep_rows(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns. verdicts has doc_id, mark and kept for every
    row of docs. Where rows that repeat in full (same id, same text) are kept and dropped, one stays."""
    verdicts = verdicts.select("doc_id", "mark", "kept")
    tally = verdicts.groupBy("doc_id", "mark").agg(F.max(F.col("kept").cast("int")).alias("any"), F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("int")).alias("k"))
    odd = cut(tally.filter(F.col("k") < F.col("n")))
    left = without(docs, odd.filter(F.col("any") == 0).select("doc_id", "mark"))
    if odd.filter(F.col("any") > 0).isEmpty():
        return left
    rows, doc_id, text, named = positional(left)
    return named(rows.withColumn("mark", mark(F.col(text))).dropDuplicates([doc_id, "mark"]))


#: Rows of a list of dropped rows that are broadcast; longer lists go through a bitmap of 2 ** BITS bits first.
DROPPED, BITS = 500_000, 26


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs that gone (doc_id and mark, each pair once) doesn't name, with all their columns.

    A short list is broadcast. Of a longer one a bitmap of fixed size is broadcast, and only rows whose hash is in it are
    shuffled with their texts to meet the list; all others stay where they are.
    """
    rows, doc_id, text, named = positional(docs)
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"))
    marked = rows.withColumn("mark", mark(F.col(text)))
    same = F.col(doc_id).eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark"))
    if gone.limit(DROPPED + 1).count() <= DROPPED:
        return named(marked.join(F.broadcast(gone), same, "left_anti"))
    place = lambda a, b: F.xxhash64(a, b).bitwiseAND((1 << BITS) - 1) + 1
    bits = gone.select(place("gone_id", "gone_mark").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket"))
    bits = F.broadcast(bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")))
    marked = marked.withColumn("p", place(doc_id, "mark")).join(bits, F.bitmap_bucket_number("p") == F.col("bucket"), "left")
    byte = F.conv(F.hex(F.expr("substring(bits, CAST(bitmap_bit_position(p) DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    held = F.coalesce(F.floor(byte / F.pow(F.lit(2), F.bitmap_bit_position("p") % 8)) % 2 == 1, F.lit(False))
    marked = marked.withColumn("held", held).drop("bits")
    return named(marked.filter(~F.col("held"))).union(named(marked.filter("held").join(gone, same, "left_anti")))


def positional(docs: DataFrame) -> tuple[DataFrame, str, str, Callable[[DataFrame], DataFrame]]:
    """docs with its columns numbered, so that no name of an extra column gets in the way: the frame, its names for doc_id and
    text, and what gives a frame that has all these columns their own names back."""
    names = docs.columns
    low = [c.lower() for c in names]
    at = lambda n: names.index(n) if n in names else low.index(n)
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return rows, f"c{at('doc_id')}", f"c{at('text')}", lambda df: df.select(*rows.columns).toDF(*names)
