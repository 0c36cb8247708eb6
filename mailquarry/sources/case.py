"""The case: messages and attachments as the engine sees them, and a view of generic tables as a case."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailquarry.functions.text import html_to_text

SCHEMA_VERSION = 3


def _fields(spec: str) -> T.StructType:
    kinds = {"l": T.LongType(), "s": T.StringType(), "i": T.IntegerType(), "b": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


#: Identity and place, people and content, times in milliseconds, size, class and state, threads, analysis, progress.
MESSAGES = _fields(
    "id:l source_id:l folder_id:l mailbox_id:l nid:l file_path:s subject:s sender_name:s sender_email:s to_text:s cc_text:s bcc_text:s conversation_topic:s "
    "date:l sent_date:l created_date:l modified_date:l size:l has_att:b att_count:i att_names:s msg_class:s importance:i is_read:b flag_status:i "
    "message_id:s in_reply_to:s refs:s conv_key:s dup_of:l thread_id:l thread_count:i reply_to:s return_path:s auth_spf:s auth_dkim:s auth_dmarc:s spoof_flags:i date_flags:i "
    "sens_flags:i sens_count:i sens_state:i indexed:b error:s att_indexed:b hdr_done:b"
)
ATTACHMENTS = _fields("id:l message_id:l idx_path:s name:s size:l sha256:s status:s error:s chars:i embedded:b")
FOLDERS = _fields("id:l source_id:l nid:l path:s name:s depth:i item_count:l msg_count:l")
SOURCES = _fields("id:l mailbox_id:l kind:i path:s display_name:s size:l sha256:s status:s msg_count:l error:s added:l finished:l mtime:l")
MAILBOXES = _fields("id:l name:s")
SENSITIVE = _fields("message_id:l att_path:s kind:i masked:s pos:i len:i")
LOOKALIKES = _fields("domain:s resembles:s kind:s messages:l")
META = _fields("key:s value:s")
TABLES = {"messages": MESSAGES, "attachments": ATTACHMENTS, "folders": FOLDERS, "sources": SOURCES, "mailboxes": MAILBOXES, "sensitive": SENSITIVE, "lookalikes": LOOKALIKES, "meta": META}


@dataclass
class Case:
    """messages: id, mailbox, folder_path, subject, sender, recipients, body, attachments (names), size, date_ms, message_id, msg_class and
    the analysis columns. attachments: message_id, idx_path, name, content."""

    messages: DataFrame
    attachments: DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df over all cores. Only a scan with fewer splits than cores, such as one small file, is dealt out anew."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fixture_messages(spark: SparkSession, folder: str) -> DataFrame:
    """documents with the event and the labels of the same id, as messages."""
    d, e, k = (table(spark, folder, n) for n in ("documents", "events", "labels"))
    d = spread(d)
    e = e.select(F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("date_ms"), F.col("user_id").alias("sender_id"), F.col("event_type").alias("msg_class"))
    k = k.select(F.col("doc_id").alias("id"), (F.col("quality") + 2 * F.col("toxic")).cast("int").alias("flags"), F.col("quality").cast("int").alias("quality"))
    own = d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("mailbox"),
        F.concat_ws("/", "lang", "source").alias("folder_path"),
        F.substring_index("text", "\n", 1).alias("subject"),
        F.col("text").alias("body"),
        F.col("n_chars").alias("size"),
        F.md5(F.col("text").cast("binary")).alias("message_id"),
    )
    return own.join(e, "id", "left").join(k, "id", "left")


def fixture_attachments(spark: SparkSession, folder: str) -> DataFrame:
    """pages as attachments of the message with the same number."""
    p = spread(table(spark, folder, "pages"))
    return p.select(F.col("page_id").alias("message_id"), F.lit("0").alias("idx_path"), F.col("url").alias("name"), html_to_text(F.col("html")).alias("content"))


def fixture_case(spark: SparkSession, folder: str) -> Case:
    return Case(fixture_messages(spark, folder), fixture_attachments(spark, folder))


def fixture_threads(spark: SparkSession, folder: str) -> DataFrame:
    """conversations as messages that answer the turn before."""
    c = table(spark, folder, "conversations")
    key = lambda t: F.concat(F.lit("c"), "conv_id", F.lit("t"), t)
    return c.select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"),
        key(F.col("turn")).alias("message_id"),
        F.when(F.col("turn") > 0, key(F.col("turn") - 1)).alias("in_reply_to"),
        F.lit(None).cast("string").alias("refs"),
        F.lit(None).cast("string").alias("conv_key"),
        F.lit(None).cast("string").alias("topic"),
        F.lit(None).cast("long").alias("date_ms"),
        F.lit(None).cast("array<string>").alias("parties"),
    )


def fixture_subjects(spark: SparkSession, folder: str) -> DataFrame:
    """conversations as messages of 40 subjects over some years; the first two turns of every other conversation, which differ in subject, share a key."""
    c = table(spark, folder, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    return c.select(
        (conv * 1_000_000 + turn).alias("id"),
        *(F.lit(None).cast("string").alias(n) for n in ("message_id", "in_reply_to", "refs")),
        F.when((conv % 2 == 0) & (turn < 2), F.concat(F.lit("key "), conv)).alias("conv_key"),
        F.concat(F.when(turn > 0, F.lit("RE: ")).otherwise(""), F.lit("Matter  "), (conv * 3 + turn) % 40).alias("topic"),
        ((conv * 37 + turn * 11) % 2000 * 86_400_000).alias("date_ms"),
        F.array(F.concat(F.lit("a"), conv % 7), F.concat(F.col("role"), turn % 3)).alias("parties"),
    )


def fixture_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Sender domains and their messages, from the hosts of pages: 'X.Y.example.TLD' stands for 'Y.TLD'."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    parts = F.split(F.regexp_replace(host, r"\.example\.", "."), r"\.")
    two = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".")
    return table(spark, folder, "pages").select(two.alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
