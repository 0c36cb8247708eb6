import io
import zipfile
from datetime import UTC, datetime

import pytest
from mailquarry.extract import dispatch
from mailquarry.extract.archives import natural_key
from mailquarry.extract.limits import Limits
from mailquarry.extract.message import read_message
from mailquarry.extract.mime import decode_words
from mailquarry.extract.ole import CompoundFile
from mailquarry.extract.plain import decode
from mailquarry.extract.rtf import decompress, rtf_html, rtf_text
from mailquarry.sinks.msgfile import compound, message_tree


def zipped(files: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, d in files.items():
            z.writestr(n, d)
    return out.getvalue()


W = 'xmlns:w="http://w"'
DOCX = zipped({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Bonjour</w:t><w:instrText>PAGE</w:instrText><w:t> monde</w:t></w:r></w:p><w:p><w:r><w:t>fin</w:t></w:r></w:p></w:body></w:document>"})
XLSX = zipped({
    "xl/workbook.xml": '<workbook><sheets><sheet name="Budget"/></sheets></workbook>',
    "xl/sharedStrings.xml": "<sst><si><t>alpha</t></si><si><r><t>be</t></r><r><t>ta</t></r></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c t="s"><v>1</v></c><c><v>42.5</v></c></row><row><c t="inlineStr"><is><t>inline</t></is></c></row></sheetData></worksheet>',
})
PPTX = zipped({"ppt/presentation.xml": "<p/>", "ppt/slides/slide10.xml": "<s><t>ten</t></s>", "ppt/slides/slide2.xml": "<s><t>two</t></s>"})
ODT = zipped({"mimetype": "application/vnd.oasis", "content.xml": "<o><p>texte <span>libre</span></p></o>"})


@pytest.mark.parametrize(("name", "data", "want"), [
    ("a.docx", DOCX, ("ok", "Bonjour monde\nfin")),
    ("a.xlsx", XLSX, ("ok", "Budget\nbeta\t42.5".replace("\t", " ") + "\ninline")),
    ("a.pptx", PPTX, ("ok", "two\nten")),
    ("a.odt", ODT, ("ok", "texte libre")),
    ("a.csv", "clé;valeur".encode("cp1252"), ("ok", "clé;valeur")),
    ("a.ics", b"SUMMARY:Point", ("ok", "SUMMARY:Point")),
    ("a.json", b'{"k": 1}', ("ok", '{"k": 1}')),
    ("a.html", b"<p>Bonjour <b>monde</b></p><script>x()</script>", ("ok", "Bonjour monde")),
    ("a.xml", b"<a><b>un</b><c>deux</c></a>", ("ok", "un deux")),
    ("a.rtf", rb"{\rtf1\ansi Bonjour \b monde\b0\par fin}", ("ok", "Bonjour monde\nfin")),
    ("a.bin", b"\x00\x01", ("unsupported", None)),
    ("a.pdf", b"%PDF-1.4", ("unsupported", None)),
    ("a.docx", b"not a zip", ("unsupported", None)),
    ("a.txt", b"", ("empty", None)),
    ("a.txt", b" \n ", ("empty", None)),
    ("a.xml", b'<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>', ("error", None)),
    ("a.zip", b"PK\x03\x04broken", ("error", None)),
])
def test_formats(name, data, want):
    status, text, error = dispatch.extract(name, data)
    assert (status, text) == want
    assert (error is not None) == (status == "error")


def test_limits():
    assert dispatch.extract("a.txt", b"x" * 11, Limits(file_bytes=10))[0] == "toolarge"
    assert dispatch.extract("a.txt", b"x" * 50, Limits(text_chars=7))[1] == "x" * 7
    many = zipped({f"{i}.txt": "x" for i in range(60)})
    assert dispatch.extract("a.zip", many, Limits(entries=50))[0] == "error"
    bomb = zipped({"zero.txt": b"0" * (2 << 20), "ok.txt": "lisible"})
    status, text, _ = dispatch.extract("a.zip", bomb, Limits(entry_bytes=1 << 20))
    assert status == "ok" and "lisible" in text and "00000" not in text


def test_nested_archives():
    data = b"profond"
    name = "deep.txt"
    for k in range(5):
        data = zipped({name: data, f"niveau{k}.txt": f"texte{k}"})
        name = f"z{k}.zip"
    text = dispatch.extract("a.zip", data)[1]
    assert all(f"texte{k}" in text for k in (4, 3, 2)) and "texte1" not in text and "profond" not in text


def test_encrypted():
    assert dispatch.extract("a.docx", compound({"EncryptedPackage": b"x", "EncryptionInfo": b"y"}))[0] == "encrypted"
    doc = bytearray(2000)
    doc[10:12] = (0x0100).to_bytes(2, "little")
    assert dispatch.extract("a.doc", compound({"WordDocument": bytes(doc)}))[0] == "encrypted"
    assert dispatch.extract("a.xls", compound({"Workbook": b"\x2f\x00\x04\x00abcd"}))[0] == "encrypted"


def test_binary_office():
    import struct

    text = "Bonjour\rmonde\x13 PAGE \x14un\x15"
    main = bytearray(1024) + text.encode("cp1252")
    clx = b"\x02" + struct.pack("<I", 16) + struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, 0x40000000 | 2048, 0)
    struct.pack_into("<HI", main, 10, 0, 0)
    struct.pack_into("<II", main, 0x01A2, 0, len(clx))
    assert dispatch.extract("a.doc", compound({"WordDocument": bytes(main), "0Table": clx}))[:2] == ("ok", "Bonjour\nmondeun")
    rec = lambda k, b: struct.pack("<HH", k, len(b)) + b
    sst = struct.pack("<II", 1, 1) + struct.pack("<HB", 5, 0) + b"alpha"
    book = rec(0x85, bytes(6) + b"\x06\x00Budget") + rec(0xFC, sst) + rec(0xFD, bytes(6) + struct.pack("<I", 0)) + rec(0x203, bytes(6) + struct.pack("<d", 2.5))
    assert dispatch.extract("a.xls", compound({"Workbook": book}))[:2] == ("ok", "Budget\nalpha\n2.5")
    atom = lambda k, b: struct.pack("<HHI", 0, k, len(b)) + b
    show = struct.pack("<HHI", 15, 1000, 8 + 10) + atom(0x0FA0, "diapo".encode("utf-16-le"))
    assert dispatch.extract("a.ppt", compound({"PowerPoint Document": show + atom(0x0FA8, b"deux")}))[:2] == ("ok", "diapo\ndeux")


def test_mime():
    data = (b"Subject: =?utf-8?Q?caf=C3=A9?=\nFrom: a@b.fr\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=x\n\n--x\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n"
            b"d=C3=A9but\n--x\nContent-Type: text/plain\nContent-Disposition: attachment; filename=n.txt\nContent-Transfer-Encoding: base64\n\nam9pbnQ=\n--x--\n")  # fmt: skip
    status, text, _ = dispatch.extract("m.eml", data)
    assert status == "ok" and all(w in text for w in ("café", "début", "n.txt", "joint"))
    assert decode_words("=?iso-8859-1?B?6XTp?=") == "été" and decode_words(None) == ""


def test_time_limit(monkeypatch):
    import time

    monkeypatch.setattr(dispatch, "text_of", lambda *a: time.sleep(5))
    assert dispatch.extract("a.txt", b"x", seconds=0.2) == ("error", None, "TimeoutError: took more than 0.2 s")


def test_charsets_and_order():
    assert decode(b"\xff\xfeh\x00i\x00") == "hi" and decode("é".encode()) == "é" and decode(b"caf\xe9") == "café"
    assert decode("héhé".encode("utf-16-le")) == "héhé"
    assert decode(b'<meta charset="iso-8859-2">\xb1') == '<meta charset="iso-8859-2">ą'
    assert sorted(["slide10", "Slide2", "slide1"], key=natural_key) == ["slide1", "Slide2", "slide10"]


def test_rtf():
    euro = b"\\" + b"u8364?" + b"\\" + b"u233 ?"
    assert rtf_text(rb"{\rtf1{\fonttbl{\f0 Arial;}}{\*\generator x}caf\'e9 " + euro + rb"{\pict 00ff}b\tab c}") == "café €éb\tc"
    html = rb"{\rtf1\ansi\fromhtml1 {\*\htmltag64 <p>}\htmlrtf {\b \htmlrtf0 Bonjour {\*\htmltag84 <b>}monde\htmlrtf }\htmlrtf0 {\*\htmltag92 </b>}{\*\htmltag72 </p>}}"
    assert rtf_html(html) == "<p>Bonjour <b>monde</b></p>"
    assert rtf_text(html) == "Bonjour monde"
    assert decompress((20).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"MELA" + bytes(4) + b"hello") == b"hello"


def test_compound_file():
    tree = {"small": b"abc", "big": bytes(range(256)) * 40, "dir": {"inner": b"x" * 5000, "deep": {"leaf": b"y" * 70}}}
    cf = CompoundFile(compound(tree))
    assert cf.stream("small") == b"abc" and cf.stream("BIG") == tree["big"] and cf.stream("dir", "inner") == b"x" * 5000 and cf.stream("dir", "deep", "leaf") == b"y" * 70
    assert cf.stream("none") is None
    with pytest.raises(ValueError):
        CompoundFile(b"short")


def test_message_file():
    t = datetime(2025, 10, 7, 8, tzinfo=UTC)
    inner = message_tree({0x0037: "Inner", 0x1000: "inner body"}, header=24)
    data = compound(message_tree(
        {0x0037: "Objet\x01 ", 0x0042: "Ann", 0x0065: "/o=x/cn=a", 0x0C1F: "ann@x.fr", 0x001A: "IPM.Note", 0x1035: "<id@x>", 0x0E06: t, 0x0E07: 1, 0x0071: bytes(range(30)), 0x1000: "corps " * 1000, 0x0017: 2},
        [(1, "Bob", "bob@y.fr"), (2, "Eve", "/o=z"), (0, "skip", "s@k.ip")], [("a.txt", b"joint"), ("in.msg", inner)]))
    m = read_message(data)
    assert (m.subject, m.sender_name, m.sender_email, m.message_id, m.date, m.is_read, m.importance) == ("Objet", "Ann", "ann@x.fr", "<id@x>", t, True, 2)
    assert m.conv_key == bytes(range(22)).hex().upper()
    assert [(r.kind, r.name, r.email) for r in m.recipients] == [(1, "Bob", "bob@y.fr"), (2, "Eve", None)]
    assert [(a.name, a.data) for a in m.attachments] == [("a.txt", b"joint"), ("in.msg", None)]
    assert m.attachments[1].message.subject == "Inner" and m.attachments[1].message.best_body() == "inner body"
    status, text, _ = dispatch.extract("m.msg", data)
    assert status == "ok" and all(w in text for w in ("Objet", "corps", "joint", "inner body"))


def test_extract_frame(spark):
    files = [(1, "0", "a.html", b"<p>x</p>"), (1, "1", "b.bin", b"\0"), (2, "0", None, None), (3, "0", "c.txt", b"")]
    rows = dispatch.extract_frame(spark.createDataFrame([(a, b, c, bytearray(d) if d is not None else None) for a, b, c, d in files], "message_id long, idx_path string, name string, data binary")).collect()
    assert [(r.message_id, r.status, r.content) for r in rows] == [(1, "ok", "x"), (1, "unsupported", None), (2, "error", None), (3, "empty", None)]
    assert rows[3].sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_rtf_code_pages_of_two_bytes():
    """Bytes of one character come as codes, as a code and a plain letter, or broken off."""
    from mailquarry.extract.rtf import rtf_text

    def coded(text, page):
        return "".join(f"\\'{b:02x}" for b in text.encode(page))

    assert rtf_text(rf"{{\rtf1\ansi\ansicpg932 {coded('日本', 'cp932')} x}}".encode()) == "日本 x"
    assert rtf_text(rf"{{\rtf1\ansi\ansicpg949 {coded('한국', 'cp949')}}}".encode()) == "한국"
    assert rtf_text(rb"{\rtf1\ansi\ansicpg932 \'83A\'83B}") == b"\x83A\x83B".decode("cp932")
    assert rtf_text(rb"{\rtf1\ansi\ansicpg932 a\'83\par b}") == "a\ufffd\nb"
    assert rtf_text(rb"{\rtf1\ansi\ansicpg1252 caf\'e9}") == "café"


PARSERS = """
import os, re

def parse(name, data, limits, seconds):
    if name == "loop.c":
        re.match(r"(a+)+$", "a" * 60 + "b")  # in C code, where no alarm and no other thread of Python comes in
    if name == "loop.py":
        while True:
            pass
    if name == "fat":
        return "ok", str(len(bytearray(4 << 30))), None
    if name == "crash":
        os.abort()
    print("noise")
    return "ok", data.decode(), None
"""


def test_supervised_extraction(tmp_path, monkeypatch):
    """A parser that loops, in C code or not, takes too much memory or dies costs its own file only."""
    from mailquarry.extract.supervised import Supervisor

    (tmp_path / "bad_parsers.py").write_text(PARSERS)
    monkeypatch.syspath_prepend(str(tmp_path))
    with Supervisor(seconds=1.0, memory=3 << 30, parser="bad_parsers:parse") as child:
        got = {name: child.extract(name, b"text of " + name.encode()) for name in ("a", "loop.c", "b", "loop.py", "c", "fat", "d", "crash", "e")}
        assert all(got[k] == ("ok", f"text of {k}", None) for k in "abcde")
        assert [got[k][:2] for k in ("loop.c", "loop.py", "fat", "crash")] == [("error", None)] * 4
        assert "no longer answered" in got["loop.c"][2] and got["loop.py"][2] == "TimeoutError: stopped after 1 s" and "MemoryError" in got["fat"][2] and "ended with" in got["crash"][2]
        assert child.restarts == 3
        assert child.extract("long", b"x" * 30_000_000)[1] == "x" * 30_000_000
    assert child.child is None


def test_frame_goes_on_after_a_lost_child(spark, monkeypatch):
    files = spark.createDataFrame([(1, "0", "a.txt", b"one"), (2, "0", "b.txt", b"two"), (3, "0", "c.zip", b"PK\x03\x04"), (4, "0", "d.html", b"<p>x")], "message_id long, idx_path string, name string, data binary")
    rows = {r.message_id: (r.status, r.content) for r in dispatch.extract_frame(files.coalesce(1), memory=3 << 30).collect()}
    assert rows == {1: ("ok", "one"), 2: ("ok", "two"), 3: ("error", None), 4: ("ok", "x")}


def test_saved_files(spark, tmp_path):
    """Names that aren't safe or missing, two of one name, no data; a second run puts the same in the same places."""
    from mailquarry.sinks.savefile import save_files

    files = spark.createDataFrame([(1, "0", "a/b.txt", b"one"), (1, "1", "a/b.txt", b"two"), (1, "1/0", None, None), (2, None, "x" * 300, b"")], "message_id long, idx_path string, name string, data binary")
    for folder in (f"{tmp_path}/saved", f"file://{tmp_path}/saved"):
        rows = save_files(files, folder).collect()
        assert {(r.message_id, r.path.rsplit("/", 1)[1][:9], r.bytes) for r in rows} == {(1, "0 a_b.txt", 3), (1, "1 a_b.txt", 3), (1, "1-0 messa", 0), (2, "0 xxxxxxx", 0)} and not any(r.error for r in rows)
    assert sorted(p.name for p in (tmp_path / "saved" / "1").iterdir() if not p.name.endswith(".crc")) == ["0 a_b.txt", "1 a_b.txt", "1-0 message"]
    assert (tmp_path / "saved" / "1" / "1 a_b.txt").read_bytes() == b"two"
    (tmp_path / "taken").write_bytes(b"")
    assert all("Error" in r.error for r in save_files(files, f"{tmp_path}/taken").collect())


def test_results_leave_in_pieces():
    """A batch with many files gives several batches of results, each of few bytes, and no result is lost."""
    import pyarrow as pa
    from mailquarry.extract import limits
    from mailquarry.extract.dispatch import _extracting

    n, text = 1200, b"word " * 2000
    b = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["0"] * n), pa.array(["a.txt"] * n), pa.array([text] * n, pa.binary())], names=["message_id", "idx_path", "name", "data"])
    out = list(_extracting(limits.Limits(), 60.0, 4 << 30)(iter([b])))
    assert len(out) > 2 and max(x.nbytes for x in out) < 2 * limits.PIECE_BYTES
    assert [i for x in out for i in x.column(0).to_pylist()] == list(range(n)) and set(x for o in out for x in o.column(5).to_pylist()) == {"ok"}
    big = [(k, "x" * (limits.PIECE_BYTES + k)) for k in range(3)]
    assert list(limits.pieces(big)) == [[x] for x in big] and list(limits.pieces([])) == []


def test_files_are_made_and_read_in_one_step(spark):
    """Files that are made for extraction pass through no second Python process, and only a piece of them is made before their texts leave."""
    import pyarrow as pa
    from mailquarry.extract import limits
    from mailquarry.plans.queries_formats import making

    count = []

    def make(i: int, t: str) -> bytes:
        count.append(i)
        return t.encode()

    n = 3000
    docs = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([None if i % 9 == 0 else f"text {i}" for i in range(n)])], names=["doc_id", "text"])
    out = dispatch._extracting(Limits(), 60.0, 4 << 30)(making(".txt", make)(iter([docs])))
    first = next(out)
    assert len(count) <= 2 * limits.PIECE_ROWS and first.num_rows == limits.PIECE_ROWS
    rest = [x for b in [first, *out] for x in b.to_pylist()]
    assert [(r["message_id"], r["content"]) for r in rest] == [(i, None if i % 9 == 0 else f"text {i}") for i in range(n)]

    own = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    df = dispatch.extract_frame(own, made=making(".txt", lambda i, t: t.encode()))
    assert sorted((r.message_id, r.name, r.status, r.content) for r in df.collect()) == sorted((i, f"{i}.txt", "ok", f"text {i}") for i in range(50))
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_texts_of_functions_leave_in_pieces():
    """Of a batch of texts only a piece is read before the first results leave; no row is lost, and a null stays null."""
    import pyarrow as pa
    from mailquarry.extract import limits
    from mailquarry.plans.registry import reading

    count = []

    def make(i: int, t: str) -> str:
        count.append(i)
        return f"{t} {i}"

    n = 3000
    b = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([None if i % 9 == 0 else "é" for i in range(n)])], names=["doc_id", "text"])
    out = reading("content", make)(iter([b]))
    first = next(out)
    assert first.num_rows == limits.PIECE_ROWS >= len(count)
    rest = [x for p in [first, *out] for x in p.to_pylist()]
    assert rest == [{"doc_id": i, "content": None if i % 9 == 0 else f"é {i}"} for i in range(n)]
