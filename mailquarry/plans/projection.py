"""The columns of a result row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the message itself.
OWN = [
    "id", "subject", "sender_name", "sender_email", "to_text", "date", "size", "has_att", "att_count", "att_names", "msg_class", "importance", "dup_of", "indexed", "error", "mailbox_id", "cc_text", "bcc_text", "sent_date",
    "conversation_topic", "is_read", "flag_status", "message_id", "hdr_done", "thread_id", "thread_count", "auth_spf", "auth_dkim", "auth_dmarc", "reply_to", "return_path", "spoof_flags", "date_flags", "sens_flags", "sens_count",
]


def projected(messages: DataFrame, folders: DataFrame, sources: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """Result rows of messages: their own columns, and mailbox, folder_path, source_name and source_path of the tables of the case. Of those
    only id and what is shown goes into the joins; a message without one of them isn't shown."""
    f = folders.select(F.col("id").alias("__folder"), F.col("path").alias("folder_path"))
    s = sources.select(F.col("id").alias("__source"), F.col("display_name").alias("source_name"), F.col("path").alias("source_path"))
    b = mailboxes.select(F.col("id").alias("__box"), F.col("name").alias("mailbox"))
    out = messages.join(f, F.col("folder_id") == F.col("__folder")).join(s, F.col("source_id") == F.col("__source")).join(b, F.col("mailbox_id") == F.col("__box"))
    return out.select(*OWN, "mailbox", "folder_path", "source_name", "source_path")
