"""Attachments saved as files."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.operators.labels import file_name

SCHEMA = "message_id long, idx_path string, path string, bytes long, sha256 string, error string"


def save_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes the data of files (message_id, idx_path, name, data) below a folder that all machines share, one folder a message, and gives where
    each is, how long and its digest. Nothing is written before the result is computed. A file is put in its place whole; a task
    that is repeated puts the same there. What can't be written gives a row with the error. Names are made safe, and begin with the place in the
    message, so that two of one name don't meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from mailquarry.sources.storefile import opened

        system, base = opened(folder.rstrip("/"))
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                mid, place, name, data = (b.column(i)[k].as_py() for i in range(4))
                path = f"{base}/{mid}/{(place or '0').replace('/', '-')} {name}"
                try:
                    system.create_dir(f"{base}/{mid}", recursive=True)
                    own = f"{base}/{mid}/.{uuid.uuid4().hex}"
                    with system.open_output_stream(own) as f:
                        f.write(data or b"")
                    system.move(own, path)
                    rows.append((mid, place, path, len(data or b""), hashlib.sha256(data or b"").hexdigest(), None))
                except OSError as e:
                    rows.append((mid, place, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=names)

    return files.select("message_id", "idx_path", file_name(F.col("name")).alias("name"), "data").mapInArrow(run, SCHEMA)
