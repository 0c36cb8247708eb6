"""Queries on file formats: every document is written as a file of some format and read back.

The files are made in Arrow batches on the executors and never leave the job, so the readers are held against SQL over
whole tables.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.extract.dispatch import extract_frame
from mailquarry.extract.limits import Limits, pieces
from mailquarry.extract.ole import CompoundFile
from mailquarry.plans.registry import query
from mailquarry.sinks.eml import eml_bytes
from mailquarry.sinks.msgfile import compound, message_tree
from mailquarry.sources.case import spread, table
from mailquarry.sources.msg import attachment_rows, parse_files
from mailquarry.sources.storefile import read_stores

#: A text as the extractors tidy it.
TIDY = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'),
  '[ \\t\\x{{00a0}}]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"""
EXTRACTED = f"SELECT message_id, CASE WHEN content = '' THEN 'empty' ELSE 'ok' END AS status, CASE WHEN content <> '' THEN content END AS content FROM (SELECT doc_id AS message_id, {TIDY.format('text')} AS content FROM documents)"


def documents(spark, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", "text")


def making(suffix: str, make: Callable[[int, str], bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches of documents message_id, idx_path, name, data: each document as a file that make() writes."""

    def run(batches):
        for b in batches:
            for some in pieces((i.as_py(), make(i.as_py(), t.as_py() or "")) for i, t in zip(b.column(0), b.column(1), strict=True)):
                ids, data = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(["0"] * len(ids)), pa.array([f"{i}{suffix}" for i in ids]), pa.array(data, pa.binary())], names=["message_id", "idx_path", "name", "data"])

    return run


def extracted(spark, sf_dir: str, suffix: str, make: Callable[[int, str], bytes], limits: Limits | None = None) -> DataFrame:
    """Each document as a file that make() writes, and in the same task what is extracted of it."""
    return extract_frame(documents(spark, sf_dir), limits, made=making(suffix, make))


def _content(df: DataFrame) -> DataFrame:
    return df.select("message_id", "status", "content")


def docx(_, text: str) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://w"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def odt(_, text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/vnd.oasis.opendocument.text")
        z.writestr("content.xml", "<o>" + "".join(f"<p>{escape(line)}</p>" for line in text.split("\n")) + "</o>")
    return out.getvalue()


def ppt(_, text: str) -> bytes:
    data = text.encode("utf-16-le")
    return compound({"PowerPoint Document": struct.pack("<HHI", 0, 0x0FA0, len(data)) + data})


def rtf(_, text: str) -> bytes:
    plain = text.replace("\\", "\\\\").replace("{", "\\{").replace("}", "\\}").replace("\n", "\\par ")
    units = plain.encode("utf-16-le")
    out = "".join(chr(u) if u < 128 else f"\\u{u - 65536 if u > 32767 else u}?" for (u,) in struct.iter_unpack("<H", units))
    return ("{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}" + out + "}").encode("ascii")


def eml(i: int, text: str) -> bytes:
    return eml_bytes({"subject": None, "sender_email": None, "body": text})


def msg(i: int, text: str) -> bytes:
    inner = message_tree({0x0037: f"inner {i}"}, [], [("deep.txt", b"deep")], header=24)
    values = {0x0037: f"subject {i}", 0x0042: "Ann", 0x0C1F: f"ann{i % 7}@x.fr", 0x1035: f"<{i}@x>", 0x0E06: datetime.fromtimestamp(1_700_000_000 + i, UTC), 0x0E07: i % 2, 0x1000: text}
    return compound(message_tree(values, [(1, "Bob", "bob@y.fr"), (2, "Eve", f"eve{i}@z.fr")], [("first.txt", text.encode()), ("in.msg", inner)]))


@query(EXTRACTED)
def ext4_packages(spark, sf_dir):
    return _content(extracted(spark, sf_dir, ".docx", docx))


def xlsx(i: int, text: str) -> bytes:
    """A row a line; every other cell is a shared string."""
    lines = text.split("\n")
    cell = lambda k, line: f'<c t="s"><v>{k}</v></c>' if k % 2 else f'<c t="inlineStr"><is><t>{escape(line)}</t></is></c>'
    rows = "".join(f"<row>{cell(k, line)}</row>" for k, line in enumerate(lines))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://s"><sheets><sheet name="Sheet {i}"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://s">' + "".join(f"<si><r><t>{escape(x[: len(x) // 2])}</t></r><r><t>{escape(x[len(x) // 2 :])}</t></r></si>" for x in lines) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://s"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def pptx(_, text: str) -> bytes:
    """A slide a line, written in an order that isn't theirs."""
    slides = dict(enumerate(text.split("\n"), 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/presentation.xml", "<p/>")
        for k in sorted(slides, key=str, reverse=True):
            z.writestr(f"ppt/slides/slide{k}.xml", '<p:sld xmlns:p="http://p" xmlns:a="http://a">' + f"<a:p><a:r><a:t>{escape(slides[k])}</a:t></a:r></a:p></p:sld>")
    return out.getvalue()


@query(f"SELECT doc_id AS message_id, 'ok' AS status, trim('Sheet ' || doc_id || chr(10) || {TIDY.format('text')}, chr(10)) AS content FROM documents")
def ext4_workbooks(spark, sf_dir):
    return _content(extracted(spark, sf_dir, ".xlsx", xlsx))


@query(f"SELECT message_id, status, regexp_replace(content, '\\n+', chr(10) || chr(10), 'g') AS content FROM ({EXTRACTED})")
def ext4_presentations(spark, sf_dir):
    return _content(extracted(spark, sf_dir, ".pptx", pptx))


@query(EXTRACTED)
def ext4_opendocument(spark, sf_dir):
    return _content(extracted(spark, sf_dir, ".odt", odt))


@query(EXTRACTED)
def ext5_binary_office(spark, sf_dir):
    return _content(extracted(spark, sf_dir, ".ppt", ppt))


@query(EXTRACTED)
def ext9_rtf(spark, sf_dir):
    return _content(extracted(spark, sf_dir, ".rtf", rtf))


@query(EXTRACTED)
def ext7_internet_messages(spark, sf_dir):
    return _content(extracted(spark, sf_dir, ".eml", eml))


@query(EXTRACTED)
def ext9_plain_text(spark, sf_dir):
    return _content(extracted(spark, sf_dir, ".txt", lambda i, t: t.encode()))


@query("SELECT doc_id AS message_id, 'unsupported' AS status FROM documents")
def ext6_pdf_status(spark, sf_dir):
    return extracted(spark, sf_dir, ".pdf", lambda i, t: b"%PDF-1.7 " + t.encode()).select("message_id", "status")


@query("SELECT doc_id AS message_id, CASE WHEN octet_length(encode(text)) > 2000 THEN 'toolarge' WHEN text = '' THEN 'empty' ELSE 'ok' END AS status FROM documents")
def ext3_size_limit(spark, sf_dir):
    return extracted(spark, sf_dir, ".txt", lambda i, t: t.encode(), Limits(file_bytes=2000)).select("message_id", "status")


@query("SELECT doc_id AS message_id, 'error' AS status, false AS has_text FROM documents")
def ext10_broken_files(spark, sf_dir):
    bad = extracted(spark, sf_dir, ".zip", lambda i, t: b"PK\x03\x04" + t.encode())
    return bad.select("message_id", "status", F.col("content").isNotNull().alias("has_text"))


def message_files(spark, sf_dir: str, make: Callable[[int, str], bytes]) -> DataFrame:
    """Each document as a message file that make() writes, and in the same task the message that is read of it."""
    made = making(".msg", make)
    return parse_files(documents(spark, sf_dir), lambda batches: (b.select(["name", "data"]) for b in made(batches)))


def _messages(spark, sf_dir):
    return message_files(spark, sf_dir, msg)


@query("""SELECT doc_id || '.msg' AS file_path, 'subject ' || doc_id AS subject, 'ann' || (doc_id % 7) || '@x.fr' AS sender_email, '<' || doc_id || '@x>' AS message_id, (1700000000 + doc_id) * 1000 AS date_ms, doc_id % 2 = 1 AS is_read,
  CASE WHEN regexp_matches(text, '[^\\s]') THEN text || chr(10) ELSE '' END || 'inner ' || doc_id || chr(10) AS body FROM documents""")
def src6_message_files(spark, sf_dir):
    return _messages(spark, sf_dir).select("file_path", "subject", "sender_email", "message_id", "date_ms", "is_read", "body")


@query("SELECT doc_id AS message_id, sha256(text) AS hash FROM documents")
def src7_compound_streams(spark, sf_dir):
    made = making(".bin", lambda i, t: compound({"Other": b"x" * (i % 9000), "Dir": {"Text": t.encode()}}))

    def run(batches):
        for b in made(batches):
            hashes = [hashlib.sha256(CompoundFile(d.as_py()).stream("Dir", "Text")).hexdigest() for d in b.column("data")]
            yield pa.RecordBatch.from_arrays([b.column("message_id"), pa.array(hashes)], names=["message_id", "hash"])

    return documents(spark, sf_dir).mapInArrow(run, "message_id long, hash string")


@query("SELECT doc_id || '.msg' AS file_path, k AS idx_path, n AS name, e AS embedded FROM documents, (VALUES ('0', 'first.txt', false), ('1', 'in.msg', true), ('1/0', 'deep.txt', false)) v(k, n, e)")
def ext11_attachment_paths(spark, sf_dir):
    return attachment_rows(_messages(spark, sf_dir)).select("file_path", "idx_path", "name", "embedded")


@query("SELECT doc_id || '.msg' AS file_path, 'in.msg' AS name FROM documents")
def src8_embedded_messages(spark, sf_dir):
    return attachment_rows(_messages(spark, sf_dir)).filter("embedded").select("file_path", "name")


@query("SELECT doc_id || '.msg' AS file_path, k AS kind, CASE k WHEN 1 THEN 'bob@y.fr' ELSE 'eve' || doc_id || '@z.fr' END AS email FROM documents, (VALUES (1), (2)) v(k)")
def src9_recipients(spark, sf_dir):
    return _messages(spark, sf_dir).select("file_path", F.explode("recipients").alias("r")).select("file_path", "r.kind", "r.email")


@query("SELECT doc_id || '.msg' AS file_path, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents")
def src10_attachments(spark, sf_dir):
    return attachment_rows(_messages(spark, sf_dir)).filter("idx_path = '0'").select("file_path", "size")


@query("""SELECT doc_id || '.msg' AS file_path, k AS idx_path, k = '1/0/0' AND (text ILIKE '%the%') AS hit, k IN ('1', '1/0') AND (text ILIKE '%the%') AS below
  FROM documents, (VALUES ('0'), ('1'), ('1/0'), ('1/0/0'), ('1/1')) v(k)""")
def txt9_embedded_hits(spark, sf_dir):
    """Message files with a message in a message, whose innermost file is the text that is looked through."""
    from mailquarry.plans.search import family_marks

    def nested(i: int, text: str) -> bytes:
        inner = message_tree({0x0037: "deepest"}, [], [("text.txt", text.encode())], 24)
        return compound(message_tree({0x0037: f"m{i}"}, [], [("first.txt", b"x"), ("in.msg", message_tree({0x0037: "inner"}, [], [("deep.msg", inner), ("other.txt", b"y")], 24))]))

    rows = attachment_rows(message_files(spark, sf_dir, nested)).withColumnRenamed("file_path", "message_id")
    marks = family_marks(rows, F.col("data").cast("string").ilike("%the%"))
    return marks.select(F.col("message_id").alias("file_path"), "idx_path", "hit", "below")


@query(f"SELECT message_id, instr(content, 'subject ' || message_id) > 0 AND instr(content, 'deep') > 0 AS whole FROM (SELECT doc_id AS message_id, 'subject ' || doc_id || ' deep' AS content FROM documents)")
def ext8_message_recursion(spark, sf_dir):
    c = extracted(spark, sf_dir, ".msg", lambda i, t: compound(message_tree({0x0037: f"subject {i}", 0x1000: t}, [], [("deep.txt", b"deep")])))
    return c.select("message_id", (F.contains("content", F.concat(F.lit("subject "), "message_id")) & F.contains("content", F.lit("deep"))).alias("whole"))


@query(f"SELECT message_id, trim('s ' || lang || chr(10) || content, chr(10)) AS content FROM (SELECT doc_id AS message_id, lang, {TIDY.format('text')} AS content FROM documents)")
def snk9_eml_export(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", "text")

    def run(batches):
        for b in batches:
            for some in pieces((i.as_py(), eml_bytes({"subject": f"s {g.as_py()}", "body": t.as_py()})) for i, g, t in zip(*b.columns, strict=True)):
                ids, data = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(["0"] * len(ids)), pa.array(["m.eml"] * len(ids)), pa.array(data, pa.binary())], names=["message_id", "idx_path", "name", "data"])

    return extract_frame(docs, made=run).select("message_id", "content")


@query("SELECT page_id, sha256(html) AS hash, CAST(octet_length(encode(html)) AS BIGINT) AS bytes, page_id || '/0-1 a_b' || page_id || '.html' AS place FROM pages")
def snk10_saved_attachments(spark, sf_dir):
    """Each page saved as a file under a name that isn't safe, and read again from there."""
    from mailquarry.operators.store import cut, shared_dir
    from mailquarry.sinks.savefile import save_files

    folder = f"{shared_dir(spark).rstrip('/')}/saved-{uuid.uuid4().hex}"
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("message_id"), F.lit("0/1").alias("idx_path"), F.concat(F.lit("a?b"), "page_id", F.lit(".html")).alias("name"), F.col("html").cast("binary").alias("data"))
    saved = cut(save_files(p, folder)).select("message_id", F.col("sha256").alias("said"))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    place = F.url_decode(F.regexp_extract("path", "/saved-[0-9a-f]+/(.*)$", 1))
    found = read.select(F.regexp_extract("path", "/saved-[0-9a-f]+/([0-9]+)/", 1).cast("long").alias("page_id"), F.sha2("content", 256).alias("hash"), F.col("length").alias("bytes"), place.alias("place"))
    return found.join(saved, F.col("page_id") == F.col("message_id")).filter("hash = said").select("page_id", "hash", "bytes", "place")


#: A substitution of our own for encoded stores; 5 is odd, so each byte comes up once.
SUBSTITUTION = bytes((5 * i + 77) % 256 for i in range(256))


def store_files(spark, sf_dir: str, encoded: bytes | None = None) -> str:
    """A folder with the documents in mail stores of up to 2000 messages, in a folder a language below one a source."""
    from mailquarry.operators.store import shared_dir
    from mailquarry.sinks.pstfile import Box, Mail, store
    from mailquarry.sources.storefile import opened

    where = f"{shared_dir(spark).rstrip('/')}/stores-{uuid.uuid4().hex}"

    def mail(r: dict) -> Mail:
        values = {0x0037: f"subject {r['doc_id']}", 0x0042: r["source"], 0x1000: r["text"] or "", 0x0E06: datetime.fromtimestamp(1_700_000_000 + r["doc_id"], UTC), 0x0E07: r["doc_id"] % 2, 0x0E08: r["n_chars"]}
        return Mail(values, [{0x0C15: 1, 0x3001: "Bob", 0x39FE: "bob@y.fr"}], [({0x3707: "a.txt", 0x3701: b"x" * (r["doc_id"] % 5000)}, None)] if r["doc_id"] % 3 == 0 else [])

    def run(batches):
        system, place = opened(where)
        system.create_dir(place, recursive=True)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                rows = b.slice(at, 2000).to_pylist()
                tree: dict = {}
                for r in rows:
                    tree.setdefault(r["source"], {}).setdefault(r["lang"], []).append(mail(r))
                name = f"{place}/{rows[0]['doc_id']}"
                own = f"{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(own) as f:
                    f.write(store([Box(s, [], [Box(g, ms) for g, ms in sorted(langs.items())]) for s, langs in sorted(tree.items())], encoded))
                system.move(own, f"{name}.pst")  # a task that is repeated puts the same in its place
                yield pa.RecordBatch.from_arrays([pa.array([len(rows)])], names=["n"])

    spread(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(run, "n long").agg(F.sum("n")).first()
    return where


@query("SELECT source AS path, source AS name, CAST(0 AS INTEGER) AS depth FROM documents GROUP BY source UNION ALL SELECT source || '/' || lang, lang, 1 FROM documents GROUP BY source, lang")
def src3_store_folders(spark, sf_dir):
    return read_stores(spark, store_files(spark, sf_dir), "folders").select("path", "name", "depth").distinct()


_LISTED = "SELECT source || '/' || lang AS folder, 'subject ' || doc_id AS subject, source AS sender_name, (1700000000 + doc_id) * 1000 AS date_ms, CAST(n_chars AS INTEGER) AS size, doc_id % 2 = 1 AS is_read FROM documents"
_STORED = """SELECT source || '/' || lang AS folder, 'subject ' || doc_id AS subject, CASE WHEN regexp_matches(text, '[^\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]') THEN text ELSE '' END AS body,
  CASE WHEN doc_id % 3 = 0 THEN doc_id % 5000 END AS attached FROM documents"""


@query(_LISTED)
def src4_store_listing(spark, sf_dir):
    columns = "folder string, subject string, sender_name string, date_ms long, size int, is_read boolean"
    return read_stores(spark, store_files(spark, sf_dir), "listing", columns, nodes=500)


def _stored(df: DataFrame) -> DataFrame:
    return df.select("folder", "subject", F.coalesce("body", F.lit("")).alias("body"), F.get("attachments", F.lit(0))["size"].alias("attached"))


@query(_STORED)
def src5_store_messages(spark, sf_dir):
    return _stored(read_stores(spark, store_files(spark, sf_dir), nodes=500))


@query(_STORED)
def src5_encoded_store(spark, sf_dir):
    return _stored(read_stores(spark, store_files(spark, sf_dir, SUBSTITUTION), table=SUBSTITUTION, nodes=500))


@query("SELECT source || '/' || lang AS folder, count(*) AS n, CAST(sum(1700000000 + doc_id) * 1000 AS BIGINT) AS dates FROM documents GROUP BY ALL")
def src5_pruned_messages(spark, sf_dir):
    """Only short properties are asked for, so bodies and attachments aren't read."""
    rows = read_stores(spark, store_files(spark, sf_dir), columns="folder string, date_ms long", nodes=500)
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.sum("date_ms").alias("dates"))


