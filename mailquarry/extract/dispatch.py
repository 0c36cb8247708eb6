"""Which extractor a file gets, and what comes of it.

A bad file is a row with its status and error, never a failed task. A file that takes too long is stopped by an alarm where the system has
one; what no alarm reaches, extract.supervised stops.
"""

from __future__ import annotations

import hashlib
import re
import signal
import threading
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import archives, mime, ole, plain, rtf
from .limits import Budget, Encrypted, Limits, TooMuch, pieces

OK, EMPTY, UNSUPPORTED, ENCRYPTED, TOO_LARGE, ERROR = "ok", "empty", "unsupported", "encrypted", "toolarge", "error"

#: The first bytes of formats, and the extensions of each kind.
MAGIC = [(b"%PDF-", "pdf"), (b"PK\x03\x04", "zip"), (b"PK\x05\x06", "zip"), (ole.MAGIC, "ole")]
EXTENSIONS = {
    "pdf": ["pdf"],
    "rtf": ["rtf"],
    "mime": ["eml"],
    "html": ["html", "htm", "xhtml", "mht", "mhtml"],
    "xml": ["xml", "xsd", "xsl", "xslt", "config", "svg", "rels", "kml"],
    "text": [
        "txt", "csv", "tsv", "ics", "vcf", "url", "log", "json", "md", "ini", "cfg", "conf", "yaml", "yml", "sql", "bat", "cmd", "ps1", "vbs", "js", "css",
        "properties", "reg", "lst", "asc", "nfo",
    ],
}
_KIND = {e: k for k, own in EXTENSIONS.items() for e in own}
#: Before it up to eight blanks or bytes from EF on may stand.
_RTF = re.compile(rb"[\x00-\x20\xef-\xff]{0,8}\{\\rtf")


def sniff(name: str | None, data: bytes) -> str | None:
    """The kind of a file: by its first bytes, else by its extension. A name that promises a package or a compound
    file without its first bytes is not supported."""
    for magic, kind in MAGIC:
        if data.startswith(magic):
            return kind
    if _RTF.match(data):
        return "rtf"
    m = re.search(r"\.([^./\\]+)$", name or "")
    return _KIND.get(m.group(1).lower()) if m else None


def text_of(name: str | None, data: bytes, budget: Budget, depth: int = 0) -> str | None:
    """The text of a file; None if its kind isn't supported."""
    kind = sniff(name, data)
    if kind == "zip":
        return archives.zip_text(data, budget, depth)
    if kind == "ole":
        return ole.ole_text(data, budget, depth)
    if kind == "mime":
        return mime.mime_text(data, budget, depth)
    if kind == "rtf":
        return rtf.rtf_text(data)
    if kind == "html":
        return plain.html_text(plain.decode(data))
    if kind == "xml":
        return plain.xml_text(data)
    return plain.decode(data) if kind == "text" else None  # PDF needs a library that isn't here


def tidy(text: str, most: int) -> str:
    text = re.sub(r"\r\n?", "\n", text)
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", text)
    text = re.sub(" ?\n ?", "\n", re.sub("[ \t\u00a0]+", " ", text))
    return re.sub("\n{3,}", "\n\n", text).strip()[:most]


@contextmanager
def at_most(seconds: float):
    """Stops what runs inside after so many seconds; without effect outside a main thread."""
    if threading.current_thread() is not threading.main_thread() or not hasattr(signal, "SIGALRM"):
        yield
        return

    def late(*_):
        raise TimeoutError(f"took more than {seconds:g} s")

    old = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, old)


def extract(name: str | None, data: bytes | None, limits: Limits | None = None, seconds: float = 60.0) -> tuple[str, str | None, str | None]:
    """Status, text and error of a file."""
    limits = limits or Limits()
    if data is None:
        return ERROR, None, "no content"
    if len(data) > limits.file_bytes:
        return TOO_LARGE, None, None
    if not data:
        return EMPTY, None, None
    try:
        with at_most(seconds):
            text = text_of(name, data, Budget(limits))
    except Encrypted:
        return ENCRYPTED, None, None
    except (TooMuch, TimeoutError, ValueError, KeyError, IndexError, OSError, RuntimeError, EOFError, NotImplementedError, zipfile.BadZipFile, ElementTree.ParseError, RecursionError, ArithmeticError, MemoryError) as e:
        return (ENCRYPTED, None, None) if "password required" in str(e) else (ERROR, None, f"{type(e).__name__}: {e}"[:300])
    except Exception as e:  # noqa: BLE001  struct.error and the like: the file's fault, and only its row's
        return ERROR, None, f"{type(e).__name__}: {e}"[:300]
    if text is None:
        return UNSUPPORTED, None, None
    text = tidy(text, limits.text_chars)
    return (OK, text, None) if text else (EMPTY, None, None)


def first_status(name: Column, data: Column, most: int = 50 << 20) -> Column:
    """What can be said of a file without opening it: too large, empty, not supported; else null."""
    known = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^./\\]+)$", 1)).isin(*_KIND)
    head = F.hex(F.substring(data, 1, 16))
    magic = F.rlike(head, F.lit("^(?:255044462D|504B0304|504B0506|D0CF11E0A1B11AE1|(?:[01][0-9A-F]|20|EF|F[0-9A-F]){0,8}7B5C727466)"))
    return F.when(F.length(data) > most, TOO_LARGE).when(F.length(data) == 0, EMPTY).when(~known & ~magic, UNSUPPORTED)


SCHEMA = "message_id long, idx_path string, name string, size long, sha256 string, status string, error string, chars int, content string"


def _extracting(limits: Limits, seconds: float, memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .supervised import Supervisor

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
        with Supervisor(limits, seconds, memory) as child:

            def results(b: pa.RecordBatch) -> Iterator[tuple]:
                for at in range(b.num_rows):
                    mid, path, name, data = (b.column(k)[at].as_py() for k in range(4))
                    # what is known without opening the file needs no child
                    plain = data is None or not data or len(data) > limits.file_bytes
                    status, text, error = extract(name, data, limits, seconds) if plain else child.extract(name, data)
                    digest = hashlib.sha256(data).hexdigest() if data is not None else None
                    yield mid, path, name, len(data or b""), digest, status, error, len(text or ""), text

            for b in batches:
                for rows in pieces(results(b)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def extract_frame(files: DataFrame, limits: Limits | None = None, seconds: float = 60.0, memory: int = 4 << 30, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """Status, digest and text of every file in files (message_id, idx_path, name, data). Each task has a child process with `memory` bytes of address
    space, which is killed and started anew where a file takes more than `seconds` or brings it down.

    With `made`, files has other rows, whose Arrow batches it turns into batches of those four columns: in the same task, so that no second Python process
    gets the files in batches of its own."""
    run = _extracting(limits or Limits(), seconds, memory)
    if made:
        return files.mapInArrow(lambda batches: run(made(batches)), SCHEMA)
    return files.select("message_id", "idx_path", "name", "data").mapInArrow(run, SCHEMA)
