"""Exact deduplication against a persistent digest index.

The index is a table of text digests, bucketed and sorted by digest. A batch is reduced to one row per
digest (aggregated before the shuffle), compared with the index by a sort-merge anti-join, and what is new
is appended. All of it is DataFrame work inside the JVM. A batch has a name, by default a hash of its rows; digests that
the index has from a batch of the same name are the batch's own, so a run that is repeated gives the same rows and
adds nothing. Appends add a file a bucket; beyond MERGE files a bucket the index is merged into one again, and one file a
bucket is read in its order, without a sort.

Defined results: a null text counts as empty; empty texts form one group like any other; rows that repeat
with the same doc_id are told apart by position, so exactly one row of a group stays; null doc_ids come
after all others in the choice of that row. A text of any length is one row; only its digest is shuffled. An empty table gives
no rows and leaves the index as it is. Other columns of the input are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.operators.store import delete, exists, file_system

from .common import cut, keep_rows, mark, new_path, only, table

#: The characters that equality of texts ignores.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without blanks; null as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_points (code points of the original text), digest (SHA-256 of the normalised text),
    row_id and mark."""
    text = F.col("text")
    return only(docs, "doc_id", "text").select(
        "doc_id",
        F.length(F.coalesce(text, F.lit(""))).alias("n_points"),
        F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row_id"),
        mark(text).alias("mark"),
    )


#: Files a bucket beyond which an index is merged.
MERGE = 8
#: Lets the planner trust the order of bucketed files, which it does where a bucket is one file.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def _ordered(spark: SparkSession) -> Iterator[None]:
    """Plans that are run within it read the index in its order."""
    before = spark.conf.get(ORDERED, "false")
    spark.conf.set(ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(ORDERED, before)


class DigestIndex:
    """Digests seen so far with the document that stands for each, in a bucketed table at a shared path.

    Opening a path that already has an index continues it, so the index outlives a session. The number
    of buckets belongs to the path and must be the same each time; by default a new index has as many as the
    session has shuffle partitions, so neither side of the anti-join is shuffled twice. The files are in a folder for
    each generation; the newest that was finished counts, so a merge that fails leaves the one before.
    """

    COLUMNS = ("digest", "keep_id", "n_points", "batch")

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        self.generation = max([k for k in self._generations() if k == 0 or exists(spark, f"{self._place(k)}/_SUCCESS")], default=0)
        self._open()

    def _place(self, generation: int) -> str:
        return f"{self.path}/generation-{generation:06d}"

    def _generations(self) -> list[int]:
        place, system = file_system(self.spark, self.path)
        return [int(f.getPath().getName().rsplit("-", 1)[1]) for f in system.listStatus(place)] if system.exists(place) else []

    def _create(self, name: str, generation: int) -> None:
        place = self._place(generation).replace("'", "\\'")
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.spark.sql(
            f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, n_points INT, batch STRING) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )

    def _open(self) -> None:
        self._create(self.name, self.generation)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, winners: DataFrame) -> DataFrame:
        return winners.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, winners: DataFrame) -> None:
        """One file a bucket: rows are dealt by the hash that also numbers the buckets."""
        self._insert(winners, self.name)
        self.spark.catalog.refreshTable(self.name)

    def _insert(self, rows: DataFrame, name: str) -> None:
        rows.select(*self.COLUMNS).repartition(self.buckets, "digest").write.insertInto(name)

    def files(self) -> int:
        """Files of the fullest bucket, as far as the number of all tells."""
        return -(-len(self.read().inputFiles()) // self.buckets)

    def merge(self) -> None:
        """The index in a new generation with one file a bucket; the one before is deleted once that is finished."""
        old, new = self.generation, max([self.generation, *self._generations()]) + 1
        other = f"{self.name}_{new}"
        self._create(other, new)
        # as plain files: read as buckets they would not be dealt anew, and a bucket could come out in several files
        self._insert(self.spark.read.schema(self.read().schema).parquet(self._place(old)), other)
        self.spark.sql(f"DROP TABLE {other}")  # its files stay, as its location was given
        self.generation = new
        self._open()
        delete(self.spark, self._place(old))

    def drop(self) -> None:
        """Removes the index and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def _name_of(groups: DataFrame) -> str:
    """A name that a batch has by what is in it, whatever the order of its rows."""
    part = F.xxhash64("digest", "group_size", F.col("best.n"), F.col("best.doc_id")).cast("decimal(38,0)")
    row = groups.agg(F.count(F.lit(1)), F.sum(part)).first()
    return f"{row[0]}:{row[1] or 0}"


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size (rows of this batch with the text), kept,
    text_sha256. A text that the index already knows from another batch keeps the index's document. The batch's new
    digests are in the index when this returns, and nothing of the result is read from the index later."""
    rows = cut(digests(docs))
    id_null = F.col("doc_id").isNull()
    best = F.min(F.struct((-F.col("n_points")).alias("n"), id_null.alias("z"), F.col("doc_id"), F.col("row_id")))
    groups = cut(rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")))
    batch = batch or _name_of(groups)
    winners = groups.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.n")).alias("n_points"), F.lit(batch).alias("batch"))
    with _ordered(index.spark):
        index.append(index.unseen(winners))
        if index.files() > MERGE:
            index.merge()
        known = index.read().select("digest", "keep_id", "batch")
        stands = groups.join(known.hint("merge"), "digest")
        stands = cut(stands.select("digest", "group_size", "keep_id", F.when(F.col("batch") == batch, F.col("best.row_id")).alias("keep_row")))
    out = rows.join(stands, "digest")
    return out.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "mark",
    )


def alone(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """deduplicate() with an index for this once."""
    index = DigestIndex(spark, new_path(spark, "digest-index"))
    out = deduplicate(docs, index)
    index.drop()
    return out


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alone(spark, table(spark, sf_dir, "documents")).drop("mark")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without repeated texts: of equal texts the row that deduplicate() keeps, with all its columns."""
    return keep_rows(docs, alone(spark, docs))


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id,
             count(*) OVER (PARTITION BY sha) AS group_size FROM d
      WINDOW w AS (PARTITION BY sha ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM r
"""
