"""Messages in Internet format, one file a row."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime
from email.message import EmailMessage
from email.utils import format_datetime

import pyarrow as pa
from pyspark.sql import DataFrame


def eml_bytes(m: dict) -> bytes:
    """subject, sender_name, sender_email, to, date_ms, message_id, body, html, attachments (name, data) as a message."""
    out = EmailMessage()
    line = lambda s: " ".join(str(s).split())
    if m.get("subject"):
        out["Subject"] = line(m["subject"])
    if m.get("sender_email") or m.get("sender_name"):
        name, mail = line(m.get("sender_name") or ""), m.get("sender_email") or ""
        out["From"] = f'"{name.replace(chr(34), "")}" <{mail}>' if name and mail else mail or name
    if m.get("to"):
        out["To"] = line(m["to"])
    if m.get("date_ms") is not None:
        out["Date"] = format_datetime(datetime.fromtimestamp(m["date_ms"] / 1000, UTC))
    if m.get("message_id"):
        out["Message-ID"] = line(m["message_id"])
    out.set_content(m.get("body") or "")
    if m.get("html"):
        out.add_alternative(m["html"], subtype="html")
    for a in m.get("attachments") or []:
        if (a["name"] or "").lower().endswith(".eml"):
            from email import message_from_bytes, policy

            out.add_attachment(message_from_bytes(a["data"] or b"", policy=policy.default), filename=a["name"])
        else:
            out.add_attachment(a["data"] or b"", maintype="application", subtype="octet-stream", filename=a["name"])
    return out.as_bytes()


def write_eml(messages: DataFrame, folder: str) -> DataFrame:
    """Writes `id`.eml of every row below folder, which all machines must share; returns id, path and bytes. Files appear
    under their name only when whole, so a repeated task does no harm."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            rows = []
            for m in b.to_pylist():
                data, path = eml_bytes(m), os.path.join(folder, f"{m['id']}.eml")
                part = f"{path}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, path)
                rows.append((m["id"], path, len(data)))
            ids, paths, sizes = map(list, zip(*rows, strict=True)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["id", "path", "bytes"])

    return messages.mapInArrow(write, "id long, path string, bytes long")
