"""Reading, merging and rewriting the case's tables.

Tables are Parquet folders below one base path. What the engine would update in place is a join of old and new rows,
written to a new folder that then takes the old one's place, so a failed run leaves the old table whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all machines share; where it is unset, a folder in the warehouse, which they share as well."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


_recorded: list[list[str]] = []


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that lost executors cost nothing already done."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    if _recorded:
        file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            _recorded[-1].append(file.get())
    return out


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df written to a new folder of the shared one and read again, and that folder.

    For loops: unlike a checkpoint, what is read again has the size of its files, not the product of the estimates of all joins before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _recorded:
        _recorded[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Within it, what cut() keeps is needed only until its end and then deleted: the result must be written by then."""
    _recorded.append([])
    try:
        yield
    finally:
        for path in _recorded.pop():
            delete(spark, path)


def file_system(spark: SparkSession, path: str):
    """The path as the JVM knows it, and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    place, system = file_system(spark, path)
    system.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place, system = file_system(spark, path)
    return system.exists(place)


#: Columns of a message that a new reading replaces only if it has a value.
KEEP_OLD = ("subject", "sender_name", "to_text", "cc_text", "date", "msg_class")
#: Bits of spoof_flags that the whole case decides and a single message keeps.
CASE_BITS = 40


def merge_messages(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the rows of new (same id) merged in: some columns keep their value where the new one is null, the size
    must be positive to count, case-wide bits of spoof_flags stay, rows that failed only get their error."""
    fresh = new.select(F.col("id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in new.columns if c != "id"))
    both = old.join(fresh, F.col("id") == F.col("__id"), "left")
    failed = F.col("__error").isNotNull() if "error" in new.columns else F.lit(False)

    def value(c: str) -> Column:
        o, n = F.col(c), F.col(f"__{c}")
        if c in KEEP_OLD:
            n = F.coalesce(n, o)
        elif c == "size":
            n = F.when(n > 0, n).otherwise(o)
        elif c == "spoof_flags":
            n = F.coalesce(o, F.lit(0)).bitwiseAND(CASE_BITS).bitwiseOR(n)
        return F.when(F.col("__id").isNull() | (failed if c != "error" else F.lit(False)), o).otherwise(n).alias(c)

    return both.select(*(value(c) if c in new.columns and c != "id" else F.col(c) for c in old.columns))


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of old whose key new doesn't have, and all of new: repeating it changes nothing."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows of new that differ from old in some column, nulls counting as values."""
    o = old.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in columns))
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return new.join(o, new[key] == o["__k"], "left").filter(differs | F.col("__k").isNull()).select(*new.columns)


def duplicates(messages: DataFrame) -> DataFrame:
    """messages with dup_of: the first id of its mailbox with the same message id, null for that one itself."""
    # aggregated before the shuffle and reduced to ids that repeat; messages without an id never meet
    known = messages.filter(F.col("message_id") != "").groupBy("mailbox", "message_id").agg(F.min("id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    heads = cut(known.filter("__n > 1").select(F.col("mailbox").alias("__box"), F.col("message_id").alias("__key"), "__first"))
    both = messages.join(heads, (F.col("mailbox") == F.col("__box")) & (F.col("message_id") == F.col("__key")), "left")
    return both.select(*(messages[c] for c in messages.columns), F.when(F.col("__first") < F.col("id"), F.col("__first")).alias("dup_of"))


def remove_source(tables: dict[str, DataFrame], source_id: int) -> dict[str, DataFrame]:
    """The tables without a source and all that depends on it."""
    gone = tables["messages"].filter(F.col("source_id") == source_id).select(F.col("id").alias("message_id"))
    out = dict(tables)
    for child in ("sensitive", "attachment_text", "attachments"):
        if child in out:
            out[child] = out[child].join(gone, "message_id", "left_anti")
    for own in ("messages", "folders"):
        if own in out:
            out[own] = out[own].filter(F.col("source_id") != source_id)
    out["sources"] = out["sources"].filter(F.col("id") != source_id)
    return out


def reset_attachments(messages: DataFrame) -> DataFrame:
    """messages queued anew for attachment extraction."""
    return messages.withColumn("att_indexed", F.lit(False)).withColumn("sens_state", F.least(F.col("sens_state"), F.lit(1)))


def move_source(sources: DataFrame, messages: DataFrame, source_id: int, mailbox_id: int) -> tuple[DataFrame, DataFrame]:
    """A source and its messages in another mailbox."""
    to = lambda c, k: F.when(F.col(k) == source_id, F.lit(mailbox_id).cast("long")).otherwise(F.col(c))
    return sources.withColumn("mailbox_id", to("mailbox_id", "id")), messages.withColumn("mailbox_id", to("mailbox_id", "source_id"))


def merge_mailboxes(mailboxes: DataFrame) -> DataFrame:
    """id and the id that stands for it: mailboxes whose names differ only in case are one, the smallest id stays."""
    from mailquarry.functions.text import nocase

    return mailboxes.select("id", F.min("id").over(W.partitionBy(nocase(F.col("name")))).alias("into"))


def prune_mailboxes(mailboxes: DataFrame, sources: DataFrame) -> DataFrame:
    return mailboxes.join(sources.select(F.col("mailbox_id").alias("id")).distinct(), "id", "left_semi")


def compact(spark: SparkSession, path: str, target: str, partitions: int, *sort: str) -> None:
    """A table rewritten as few large files, sorted so that statistics prune scans."""
    df = spark.read.parquet(path)
    (df.repartitionByRange(partitions, *sort).sortWithinPartitions(*sort) if sort else df.repartition(partitions)).write.mode("overwrite").parquet(target)


def migrate(messages: DataFrame, version: int) -> DataFrame:
    """messages of an older schema version in the current one, queued for what that version lacked."""
    from mailquarry.sources.case import MESSAGES, SCHEMA_VERSION

    if version > SCHEMA_VERSION:
        raise ValueError(f"the case was written by a later version ({version})")
    for f in MESSAGES.fields:
        if f.name not in messages.columns:
            default = {"att_indexed": False, "hdr_done": False, "sens_state": 0, "spoof_flags": 0, "date_flags": 0, "sens_flags": 0, "sens_count": 0}.get(f.name)
            messages = messages.withColumn(f.name, F.lit(default).cast(f.dataType))
    return messages.select(*(f.name for f in MESSAGES.fields))
