"""Message files as rows.

Files are read by Spark's binary source and parsed in Arrow batches. A file that can't be parsed gives a row
with its error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.extract.limits import PIECE_BYTES
from mailquarry.extract.message import Message, read_message

SCHEMA = """file_path string, subject string, sender_name string, sender_email string, recipients array<struct<kind:int,name:string,email:string>>,
 date_ms long, sent_ms long, created_ms long, modified_ms long, msg_class string, importance int, is_read boolean, flag_status int,
 message_id string, in_reply_to string, refs string, conv_key string, topic string, headers string, body string,
 attachments array<struct<idx_path:string,name:string,size:bigint,visible:boolean,embedded:boolean,data:binary>>, error string"""

#: Most messages in an Arrow batch.
ROWS = 250


def _ms(t) -> int | None:
    return None if t is None else round(t.timestamp() * 1000)


def flat_attachments(m: Message, prefix: str = "", depth: int = 5) -> list[dict]:
    """Attachments of a message and of those embedded in it, by path: '2/0' is the first one of the third."""
    out = []
    for k, a in enumerate(m.attachments):
        path = f"{prefix}{k}"
        out.append({"idx_path": path, "name": a.name, "size": a.size, "visible": a.visible, "embedded": a.message is not None, "data": a.data})
        if a.message is not None and depth > 0:
            out += flat_attachments(a.message, path + "/", depth - 1)
    return out


def message_row(path: str, data: bytes | None) -> dict:
    return row_of(path, lambda: read_message(data or b""))


def row_of(path: str, read: Callable[[], Message]) -> dict:
    """A message as a row, or its error."""
    names = ["subject", "sender_name", "sender_email", "importance", "is_read", "flag_status", "message_id", "in_reply_to", "conv_key", "topic", "headers"]
    try:
        m = read()
    except Exception as e:  # noqa: BLE001  the file's fault, and only its row's
        return {"file_path": path, "error": f"{type(e).__name__}: {e}"[:300]}
    embedded = [a.message for a in m.attachments if a.message is not None]
    body = "\n".join(x for x in [m.best_body(), *(f"{e.subject or ''}\n{e.best_body()}" for e in embedded)] if x)
    return {
        "file_path": path,
        **{n: getattr(m, n) for n in names},
        "recipients": [{"kind": r.kind, "name": r.name, "email": r.email} for r in m.recipients],
        "date_ms": _ms(m.date),
        "sent_ms": _ms(m.submit),
        "created_ms": _ms(m.created),
        "modified_ms": _ms(m.modified),
        "msg_class": m.message_class,
        "refs": m.references,
        "body": body,
        "attachments": flat_attachments(m),
        "error": None,
    }


def arrow_batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches. Bodies and attachments have any size, so a batch ends at about PIECE_BYTES of them."""
    held: list[dict] = []
    size = 0
    for row in rows:
        own = len(row.get("body") or "") + sum(len(a["data"] or b"") for a in row.get("attachments") or ())
        if held and (len(held) == ROWS or size + own > PIECE_BYTES):
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
        held.append({n: row.get(n) for n in schema.names})
        size += own
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _parse(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # one file at a time bounds memory
                row = message_row(b.column(0)[k].as_py(), b.column(1)[k].as_py())
                yield pa.RecordBatch.from_pylist([{n: row.get(n) for n in schema.names}], schema=schema)

    return run


def parse_files(files: DataFrame, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """Messages of files (path, content). With `made`, files has other rows, whose Arrow batches it turns into batches of those two columns in the same task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(SCHEMA)
    run = _parse(to_arrow_schema(schema))
    if made:
        return files.mapInArrow(lambda batches: run(made(batches)), schema)
    return files.select("path", "content").mapInArrow(run, schema)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All message files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][sS][gG]").load(folder)
    return parse_files(files)


def attachment_rows(messages: DataFrame) -> DataFrame:
    """file_path and each attachment's columns."""
    return messages.select("file_path", F.explode("attachments").alias("a")).select("file_path", "a.*")
