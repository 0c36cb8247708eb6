"""Word, Excel and PowerPoint packages, OpenDocument files and other ZIP archives."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from .limits import Budget, Encrypted
from .plain import xml_root

#: Kinds of elements by the end of their names: text, line ends, tabs, and what is left out.
TEXT, LINE, TAB, SKIP = {"t"}, {"p", "br", "cr", "tr", "h"}, {"tab", "tc", "table-cell"}, {"instrText", "delText", "fallback", "Fallback"}


def natural_key(name: str) -> list[tuple]:
    """Sorts slide2 before slide10."""
    return [(0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in re.split(r"(\d+)", name) if p]


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def markup_text(data: bytes, everything: bool = False) -> str:
    """Text of a part. Packages mark text runs; OpenDocument has text anywhere."""
    out: list[str] = []

    def walk(e: ElementTree.Element) -> None:
        name = _local(e)
        if name in SKIP:
            return
        if e.text and (everything or name in TEXT):
            out.append(e.text)
        if name == "s" and everything:
            out.append(" ")
        for c in e:
            walk(c)
            if everything and c.tail:
                out.append(c.tail)
        if name in LINE:
            out.append("\n")
        elif name in TAB:
            out.append("\t")

    walk(xml_root(data))
    return "".join(out)


class Archive:
    def __init__(self, data: bytes, budget: Budget):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.budget = budget
        self.infos = {i.filename: i for i in self.zip.infolist() if not i.is_dir()}

    def read(self, name: str) -> bytes | None:
        """An entry, or None if it is larger than the limits let it be; its real size counts, not the stated one."""
        info = self.infos[name]
        if info.flag_bits & 1:
            raise Encrypted
        limit = self.budget.limits.entry_bytes
        if info.file_size > limit:
            return None
        with self.zip.open(info) as f:
            data = f.read(limit + 1)
        if len(data) > limit:
            return None
        self.budget.spend(len(data))
        return data

    def parts(self, pattern: str) -> list[str]:
        return sorted((n for n in self.infos if re.fullmatch(pattern, n)), key=natural_key)

    def markup(self, pattern: str, everything: bool = False) -> list[str]:
        out = []
        for n in self.parts(pattern):
            self.budget.entry()
            data = self.read(n)
            if data:
                out.append(markup_text(data, everything))
        return out


def sheets_text(a: Archive) -> str:
    """Sheet names, then the cells of each sheet: shared and inline strings, and numbers."""
    out: list[str] = []
    shared: list[str] = []
    if "xl/sharedStrings.xml" in a.infos:
        data = a.read("xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in xml_root(data)] if data else []
    if "xl/workbook.xml" in a.infos and (data := a.read("xl/workbook.xml")):
        out += [e.get("name") or "" for e in xml_root(data).iter() if _local(e) == "sheet"]
    for n in a.parts(r"xl/worksheets/[^/]+\.xml"):
        a.budget.entry()
        data = a.read(n)
        if not data:
            continue
        for row in (e for e in xml_root(data).iter() if _local(e) == "row"):
            cells = []
            for c in (e for e in row if _local(e) == "c"):
                value = next((e.text or "" for e in c if _local(e) == "v"), "")
                if c.get("t") == "s":
                    k = int(value) if value.isdigit() else -1
                    value = shared[k] if 0 <= k < len(shared) else ""
                elif c.get("t") == "inlineStr":
                    value = "".join(e.text or "" for e in c.iter() if _local(e) == "t")
                cells.append(value)
            out.append("\t".join(cells))
    return "\n".join(out + a.markup(r"xl/comments\d*\.xml"))


def zip_text(data: bytes, budget: Budget, depth: int) -> str:
    from .dispatch import text_of

    a = Archive(data, budget)
    if "word/document.xml" in a.infos:
        return "\n".join(a.markup(r"word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml"))
    if "xl/workbook.xml" in a.infos:
        return sheets_text(a)
    if "ppt/presentation.xml" in a.infos:
        return "\n".join(a.markup(r"ppt/slides/slide\d+\.xml") + a.markup(r"ppt/notesSlides/notesSlide\d+\.xml"))
    if "content.xml" in a.infos and "mimetype" in a.infos:
        manifest = a.read("META-INF/manifest.xml") if "META-INF/manifest.xml" in a.infos else b""
        if b"encryption-data" in (manifest or b""):
            raise Encrypted
        return "\n".join(a.markup(r"content\.xml", True))
    out = []
    for n in sorted(a.infos, key=natural_key):
        budget.entry()
        out.append(n)
        if depth < budget.limits.depth:
            inner = a.read(n)
            if inner:
                out.append(text_of(n, inner, budget, depth + 1) or "")
    return "\n".join(x for x in out if x)
