"""Sort keys of results and their specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.functions.text import nocase

#: Key: column, whether it sorts case-insensitively, whether it is descending by nature.
KEYS: dict[str, tuple[str, bool, bool]] = {
    "date": ("date_ms", False, True),
    "sent": ("sent_ms", False, True),
    "sender": ("sender_name", True, False),
    "senderemail": ("sender_email", True, False),
    "to": ("to_text", True, False),
    "cc": ("cc_text", True, False),
    "bcc": ("bcc_text", True, False),
    "subject": ("subject", True, False),
    "mailbox": ("mailbox", True, False),
    "folder": ("folder_path", True, False),
    "source": ("source_name", True, False),
    "size": ("size", False, True),
    "attcount": ("att_count", False, True),
    "attnames": ("att_names", True, False),
    "hasatt": ("has_att", False, True),
    "kind": ("msg_class", True, False),
    "importance": ("importance", False, True),
    "dup": ("dup_of", False, True),
    "msgid": ("message_id", True, False),
    "conversation": ("conversation_topic", True, False),
    "read": ("is_read", False, False),
    "flag": ("flag_status", False, True),
    "thread": ("thread_id", False, True),
    "spoof": ("spoof_flags", False, True),
    "dateflags": ("date_flags", False, True),
    "sensitive": ("sens_flags", False, True),
    "spf": ("auth_spf", False, False),
}
RELEVANCE = "relevance"

#: Names that saved layouts of earlier versions use.
LEGACY = {"datedesc": ("date", True), "dateasc": ("date", False), "sizedesc": ("size", True), "senderasc": ("sender", False), "subjectasc": ("subject", False)}


def parse_sort(text: str | None) -> tuple[str, bool]:
    """Key and whether it is descending, of 'key', 'key:asc' or 'key:desc'; anything unknown means by date."""
    name = (text or "").strip().lower()
    if name in LEGACY:
        return LEGACY[name]
    key, _, way = name.partition(":")
    if key != RELEVANCE and key not in KEYS or way not in ("", "asc", "desc"):
        return "date", True
    natural = False if key == RELEVANCE else KEYS[key][2]
    return key, {"": natural, "asc": False, "desc": True}[way]


def keys_of(key: str, descending: bool, have: list[str]) -> list[tuple[Column, bool]]:
    """What a total order compares, and whether descending: the key, then the newest, then the largest id."""
    newest = [(F.col("date_ms"), True), (F.col("id"), True)]
    if key == RELEVANCE:
        return [(F.col("rank").isNull(), False), (F.col("rank"), False), *newest]
    column, folded, _ = KEYS[key]
    if column not in have:
        column, folded = "date_ms", False
    if column == "date_ms":
        return [(F.col("date_ms"), descending), (F.col("id"), descending)]
    return [(nocase(F.col(column)) if folded else F.col(column), descending), *newest]


def order(key: str, descending: bool, have: list[str]) -> list[Column]:
    """The columns to sort by. Nulls come first when ascending."""
    return [c.desc() if down else c.asc() for c, down in keys_of(key, descending, have)]


def cursor(page: DataFrame, key: str, descending: bool) -> tuple | None:
    """The place of a sorted page's last row in the order; None of an empty page."""
    last = page.select(*(c.alias(f"k{i}") for i, (c, _) in enumerate(keys_of(key, descending, page.columns)))).tail(1)
    return tuple(last[0]) if last else None


def after(place: tuple, key: str, descending: bool, have: list[str]) -> Column:
    """Whether a row comes behind a place. The condition on the first key stands by itself too, so that it reaches the scan."""

    def behind(c: Column, down: bool, value) -> Column:
        if value is None:
            return F.lit(False) if down else c.isNotNull()
        return (c < F.lit(value)) | c.isNull() if down else c > F.lit(value)

    keys = keys_of(key, descending, have)
    out, same = F.lit(False), F.lit(True)
    for (c, down), value in zip(keys, place, strict=True):
        out = out | (same & behind(c, down, value))
        same = same & c.eqNullSafe(F.lit(value))
    (first, down), value = keys[0], place[0]
    return (behind(first, down, value) | first.eqNullSafe(F.lit(value))) & out
