"""Mail stores read in place, as a data source: `spark.read.format("mailstore")`.

Option `rows` says what the rows are: 'folders', 'listing' (what the contents tables say of messages, without opening them) or
'messages'. A store is read by many tasks: messages by ranges of the tree of nodes, listings by blocks of the contents tables, small
stores several to a task. A task reads pages and blocks by their place, so a store may have any size. Of messages only what the
schema names is read: without `body`, `recipients` or `attachments` their blocks stay where they are.

The planner reads the upper pages of each tree, and for listings the folders. Files are opened through pyarrow, so a path may be local (on a folder
that all machines share), HDFS or an object store. Stores that can't be read, and messages that can't, give a row with the error.

Options: path (a store or a folder of stores), rows, nodes (about how many nodes or listed messages a task gets), table (the substitution of encoded stores, as
512 hexadecimal digits).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from mailquarry.extract.pst import MESSAGE, Store
from mailquarry.sources import msg, pst

SCHEMAS = {"folders": pst.FOLDERS, "listing": pst.LISTING, "messages": msg.SCHEMA + ", folder string"}
NODES = 20_000
SUFFIXES = (".pst", ".ost")


def opened(path: str):
    """The file system of a path and its path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Placed:
    """A file that is read by place."""

    def __init__(self, path: str):
        system, place = opened(path)
        self.file = system.open_input_file(place)

    def read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def close(self) -> None:
        self.file.close()


def stores_below(path: str) -> list[str]:
    """Stores below a folder, or the one that path is; with the scheme of path."""
    from pyarrow import fs

    system, place = opened(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.File:
        return [path]
    found = sorted(f.path for f in system.get_file_info(fs.FileSelector(place, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(SUFFIXES))
    head = path.rstrip("/")
    return [head + f[len(place.rstrip("/")) :] for f in found]


@dataclass
class Piece:
    """A part of a store: nodes from low to below high, or blocks of the contents table of the folder `nid`."""

    path: str
    low: int = 0
    high: int = 1 << 64
    nid: int = 0
    folder: str = ""
    error: str = ""


@dataclass
class Task(InputPartition):
    pieces: list[Piece] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(0)


def _said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:300]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.rows = options["path"], options.get("rows", "messages")
        if self.rows not in SCHEMAS:
            raise ValueError(f"rows must be one of {', '.join(SCHEMAS)}")
        self.nodes = int(options.get("nodes", NODES))
        self.table = bytes.fromhex(options["table"]) if options.get("table") else None
        self.schema = schema

    def _pieces(self, path: str) -> Iterator[tuple[Piece, int]]:
        """Parts of a store, each with about how many rows it has."""
        if self.rows == "folders":
            yield Piece(path), 100
            return
        try:
            source = Placed(path)
            store = Store(source, self.table)
            if self.rows == "messages":
                yield from ((Piece(path, low, high), n) for low, high, n in store.spans(self.nodes))
            else:
                for f in store.folders():
                    yield from self._blocks(path, store, f)
            source.close()
        except Exception as e:  # noqa: BLE001  the file's fault, and only its row's
            yield Piece(path, error=_said(e)), 1

    def _blocks(self, path: str, store: Store, folder) -> Iterator[tuple[Piece, int]]:
        try:
            per = store.contents(folder.nid)
        except Exception:  # noqa: BLE001  a damaged table lists nothing
            return
        first, n = 0, 0
        for k, rows in enumerate(per):
            n += rows
            if n >= self.nodes or k + 1 == len(per):
                yield Piece(path, first, k + 1, folder.nid, folder.path), n
                first, n = k + 1, 0

    def partitions(self) -> list[Task]:
        out, room = [], 0
        for path in stores_below(self.path):
            for piece, n in self._pieces(path):
                if not out or room < n:
                    out.append(Task())
                    room = self.nodes
                out[-1].pieces.append(piece)
                room -= n
        return out or [Task()]

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        rows = (row for piece in partition.pieces for row in self._safe(piece))
        return msg.arrow_batches(rows, to_arrow_schema(self.schema))

    def _safe(self, piece: Piece) -> Iterator[dict]:
        if piece.error:
            yield {"file_path": piece.path, "error": piece.error}
            return
        try:
            source = Placed(piece.path)
            yield from getattr(self, f"_{self.rows}")(piece, Store(source, self.table))
            source.close()
        except Exception as e:  # noqa: BLE001
            yield {"file_path": piece.path, "error": _said(e)}

    def _folders(self, piece: Piece, store: Store) -> Iterator[dict]:
        return pst.folder_rows(piece.path, store)

    def _listing(self, piece: Piece, store: Store) -> Iterator[dict]:
        for nid, row in store.rows(piece.nid, piece.low, piece.high):
            yield pst.listing_row(piece.path, piece.folder, nid, row)

    def _messages(self, piece: Piece, store: Store) -> Iterator[dict]:
        want = frozenset(self.schema.names) & {"body", "recipients", "attachments"}
        paths: dict[int, str | None] = {}
        for nid, parent in store.scan(piece.low, piece.high):
            if nid & 0x1F == MESSAGE and (folder := store.path_of(parent, paths)):
                yield {**msg.row_of(f"{piece.path}#{nid}", lambda n=nid: store.message(n, want=want)), "folder": folder}


class MailStores(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailstore"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("rows", "messages")]

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)


def read_stores(spark: SparkSession, path: str, rows: str = "messages", columns: str | None = None, table: bytes | None = None, nodes: int = NODES) -> DataFrame:
    """Rows of the stores below a path. columns: the schema of those that are wanted, in SQL; by default all."""
    spark.dataSource.register(MailStores)
    reader = spark.read.format("mailstore").option("rows", rows).option("nodes", nodes)
    if table:
        reader = reader.option("table", table.hex())
    return (reader.schema(columns) if columns else reader).load(path)
