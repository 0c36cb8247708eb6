"""Plain text, HTML and XML."""

from __future__ import annotations

import codecs
import re
from xml.etree import ElementTree

from mailquarry.functions import htmlscan

_META = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_\-:.]+)""", re.I)


def known_codec(name: str | None) -> str | None:
    try:
        return codecs.lookup(name).name if name else None
    except LookupError:
        return None


def decode(data: bytes, charset: str | None = None) -> str:
    """By byte order mark, declared charset, charset in the page, UTF-16 zeros, UTF-8 validity, else Windows-1252."""
    for bom, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(bom):
            return data[len(bom) :].decode(name, "replace")
    found = known_codec(charset)
    if not found:
        m = _META.search(data[:4096])
        found = known_codec(m.group(1).decode("ascii")) if m else None
    if found:
        return data.decode(found, "replace")
    head = data[:2000]
    if len(head) > 3:
        for offset, name in ((1, "utf-16-le"), (0, "utf-16-be")):
            if head[offset::2].count(0) > 0.7 * len(head[offset::2]) and head[1 - offset :: 2].count(0) == 0:
                return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def html_text(page: str) -> str:
    return htmlscan.text_of(page)


def xml_root(data: bytes) -> ElementTree.Element:
    """The document, unless it declares a document type, with which entities could grow without bound."""
    if b"<!DOCTYPE" in data[:4096].upper() or b"<!ENTITY" in data:
        raise ValueError("document types are refused")
    return ElementTree.fromstring(data)


def xml_text(data: bytes) -> str:
    return " ".join(t.strip() for t in xml_root(data).itertext() if t.strip())
