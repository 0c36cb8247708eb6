"""Mail stores in a column as rows: folders, the cheap listing of their messages, and whole messages.

For stores that are values of a table, as attachments or archive members are; each is parsed by one task. Files are read in place, by
many tasks, by sources.storefile. A store that can't be read gives one row with its error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from mailquarry.extract.pst import Row, Store
from mailquarry.sources import msg

FOLDERS = "file_path string, nid long, path string, name string, depth int, error string"
LISTING = "file_path string, nid long, folder string, subject string, sender_name string, to_text string, date_ms long, size int, msg_class string, importance int, has_att boolean, is_read boolean, error string"


def folder_rows(path: str, s: Store) -> Iterator[dict]:
    for f in s.folders():
        yield {"file_path": path, "nid": f.nid, "path": f.path, "name": f.name, "depth": f.depth}


def listing_row(path: str, folder: str, nid: int, row: Row) -> dict:
    flags = row.number(0x0E07)
    return {
        "file_path": path, "nid": nid, "folder": folder, "subject": row.clean(0x0037), "sender_name": row.clean(0x0042), "to_text": row.clean(0x0E04),
        "date_ms": msg._ms(row.time(0x0E06) or row.time(0x0039)), "size": row.number(0x0E08), "msg_class": row.clean(0x001A), "importance": row.number(0x0017),
        "has_att": None if flags is None else bool(flags & 0x10), "is_read": None if flags is None else bool(flags & 1),
    }


def _listing(path: str, s: Store) -> Iterator[dict]:
    for f in s.folders():
        for nid, row in s.listing(f.nid):
            yield listing_row(path, f.path, nid, row)


def _messages(path: str, s: Store) -> Iterator[dict]:
    for f in s.folders():
        for nid, _ in s.listing(f.nid):
            yield {**msg.row_of(f"{path}#{nid}", lambda n=nid: s.message(n)), "folder": f.path}


def _rows(stores: DataFrame, ddl: str, make: Callable[[str, Store], Iterator[dict]], table: bytes | None) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def safe(path: str, data: bytes) -> Iterator[dict]:
            try:
                yield from make(path, Store(data, table))
            except Exception as e:  # noqa: BLE001  the file's fault, and only its row's
                yield {"file_path": path, "error": f"{type(e).__name__}: {e}"[:300]}

        for b in batches:
            for k in range(b.num_rows):
                yield from msg.arrow_batches(safe(b.column(0)[k].as_py(), b.column(1)[k].as_py() or b""), arrow)

    return stores.select("path", "content").mapInArrow(run, schema)


def read_folders(stores: DataFrame, table: bytes | None = None) -> DataFrame:
    """Folders of stores (path, content), depth first; table: the substitution of encoded stores."""
    return _rows(stores, FOLDERS, folder_rows, table)


def list_messages(stores: DataFrame, table: bytes | None = None) -> DataFrame:
    """What the contents tables say of messages, without opening them."""
    return _rows(stores, LISTING, _listing, table)


def read_messages(stores: DataFrame, table: bytes | None = None) -> DataFrame:
    """Whole messages, as sources.msg gives them, with their folder."""
    return _rows(stores, msg.SCHEMA + ", folder string", _messages, table)
