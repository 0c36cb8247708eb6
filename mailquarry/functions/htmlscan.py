"""One pass over HTML: tags and their attributes by place.

Text and sanitiser both go from tag to tag and never search twice for the same thing, so their time grows with the page. The sanitiser reads
attributes as a viewer does (values in either quotes or bare, separated by blanks or slashes, entities and control characters inside) and
cuts or replaces them where they stand; what is harmless stays byte for byte.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

#: Elements whose content is not shown, and tags that end a line or a cell.
UNSEEN = {"script", "style", "head", "title", "xml", "o:p"}
LINE_ENDS = {"br", "/p", "/div", "/tr", "/li", "/h1", "/h2", "/h3", "/h4", "/h5", "/h6", "/table", "/blockquote"}
CELL_ENDS = {"/td", "/th"}
#: Elements that go with their content, and tags that go alone.
ACTIVE = {"script", "iframe", "object", "embed", "applet", "frameset", "noscript"}
ACTIVE_TAGS = {"script", "iframe", "object", "embed", "applet", "frame", "base", "link", "meta"}
#: Attributes that load something, attributes that lead somewhere, schemes that run, and what stands for a blocked one.
LOADING = {"src", "background", "poster", "lowsrc", "dynsrc", "data"}
LEADING = {"href", "src", "action", "formaction", "xlink:href"}
RUNNING = ("javascript:", "vbscript:", "data:text/html")
OUTSIDE = ("http:", "https:", "//", "\\\\", "file:", "ftp:")
BLOCKED = 'data-pl-blocked="1"'

_OPENING = re.compile(r"<(\s*)(/?[A-Za-z][A-Za-z0-9]*(?::[A-Za-z]+)?)")
_ENTITY = re.compile(r"&#?[A-Za-z0-9]+;")
_BLANK = " \t\n\r\f"


@lru_cache(64)
def _close_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE | re.ASCII)


def decoded(text: str) -> str:
    """Entities with their semicolon as characters."""
    return _ENTITY.sub(lambda m: html.unescape(m.group()), text) if "&" in text else text


# --- text -----------------------------------------------------------------------------------------------------


def _shown(page: str) -> Iterator[str]:
    at = 0
    while (start := page.find("<", at)) >= 0:
        yield page[at:start]
        if page.startswith("<!--", start) and (end := page.find("-->", start + 4)) >= 0:
            yield " "
            at = end + 3
            continue
        end = page.find(">", start)
        if end < 0:
            at = start
            break
        at, between = end + 1, " "
        if m := _OPENING.match(page, start):
            name = m.group(2).lower()
            if name in LINE_ENDS:
                between = "\n"
            elif name in CELL_ENDS:
                between = " \t"
            elif name in UNSEEN and not m.group(1) and (close := _close_of(name).search(page, at)):
                at = close.end()
        yield between
    yield page[at:]


def text_of(page: str | None) -> str | None:
    """What a page shows: unseen elements and comments go, block ends become line feeds, other tags blanks, entities characters."""
    if page is None:
        return None
    text = re.sub("[ \t\u00a0]+", " ", decoded("".join(_shown(page)))).replace("\r", "")
    # blanks up to the last line feed of a run; three of them and more are one empty line
    return re.sub(r"\s*\n", lambda m: "\n\n" if m.group().count("\n") > 2 else m.group(), text).strip()


# --- attributes ------------------------------------------------------------------------------------------------


class Attribute(NamedTuple):
    """before: where what separates it from the last one starts; [start, end) is the whole, [value, value_end) its value without quotes."""

    name: str
    before: int
    start: int
    value: int
    value_end: int
    end: int


def attributes(page: str, at: int) -> tuple[list[Attribute], int]:
    """Attributes from behind a tag's name on, and where the tag ends (behind its '>', or at the page's end)."""
    out, n = [], len(page)
    while True:
        before = at
        while at < n and (page[at] in _BLANK or page[at] == "/"):
            at += 1
        if at >= n or page[at] == ">":
            return out, min(at + 1, n)
        start = at
        at += 1  # an equals sign may begin a name
        while at < n and page[at] not in _BLANK and page[at] not in "/>=":
            at += 1
        name, mark = page[start:at].lower(), at
        while at < n and page[at] in _BLANK:
            at += 1
        if at >= n or page[at] != "=":
            at = mark
            out.append(Attribute(name, before, start, mark, mark, mark))
            continue
        at += 1
        while at < n and page[at] in _BLANK:
            at += 1
        if at < n and page[at] in "\"'":
            value = at + 1
            found = page.find(page[at], value)
            value_end = n if found < 0 else found
            at = min(value_end + 1, n)
        else:
            value = at
            while at < n and page[at] not in _BLANK and page[at] != ">":
                at += 1
            value_end = at
        out.append(Attribute(name, before, start, value, value_end, at))


# --- sanitiser -------------------------------------------------------------------------------------------------

_URL = re.compile(r"url\(\s*[\"']?\s*(?:https?:|//|\\\\|file:)[^)]*\)", re.IGNORECASE)
_IMPORT = re.compile(r"@import\s+(\"[^\"']*\"|'[^\"']*')", re.IGNORECASE)
_IMAGE_SET = re.compile(r"(?:-webkit-)?image-set\([^)]*(?:https?:|//)[^)]*\)", re.IGNORECASE)
_CALLS = re.compile(r"url\(|image-set\(|@import", re.IGNORECASE)


def _address(value: str) -> str:
    """As a viewer takes an address: entities decoded, without control characters, blanks before it and case."""
    return "".join(c for c in decoded(value) if c > " " or c == " ").lstrip(" \u00a0").lower()


def _somewhere_outside(value: str) -> bool:
    return any(x in decoded(value).lower() for x in OUTSIDE if x != "ftp:")


def styled(css: str, quoted: bool = False) -> str | None:
    """A style without what it would load; null if what loads is written so that it can't be cut out."""
    out = _URL.sub("url()", css)
    out = _IMPORT.sub(lambda m: "" if _somewhere_outside(m.group(1)) else m.group(), out)
    out = _IMAGE_SET.sub("none", out)
    plain = re.sub(r"\\([0-9a-fA-F]{1,6})\s?|\\(.)|/\*.*?\*/", lambda m: chr(min(int(m.group(1), 16), 0x10FFFF)) if m.group(1) else m.group(2) or "", decoded(out) if quoted else out, flags=re.DOTALL)
    return None if plain != out and _CALLS.search(plain) and _somewhere_outside(plain) else out


def sanitised(page: str | None) -> tuple[str | None, bool]:
    """The page without what runs or loads anything, and whether something of it would have been loaded. Pictures of the message itself
    (cid:) and links stay."""
    if page is None:
        return None, False
    out, at, blocked = [], 0, False
    while (start := page.find("<", at)) >= 0:
        out.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            out.append(page[start:at])
            continue
        m = _OPENING.match(page, start)
        if not m or m.group(1):
            out.append("<")
            at = start + 1
            continue
        name = m.group(2).lower()
        # a name goes on to a blank, a slash or the end
        stop = m.end()
        while stop < len(page) and page[stop] not in _BLANK and page[stop] not in "/>":
            stop += 1
        whole = page[start + 1 : stop].lower()
        own, end = attributes(page, stop)
        at = end
        if name in ACTIVE and (close := _close_of(name).search(page, m.end())):
            at = close.end()
            continue
        if name in ACTIVE_TAGS:
            continue
        tag, hit = _harmless(page, start, stop, end, whole, own)
        out.append(tag)
        blocked |= hit
        if whole == "style" and (close := _close_of("style").search(page, end)):
            inside = page[end : close.start()]
            kept = styled(inside)
            blocked |= kept != inside
            out.append(kept or "")
            at = close.start()
    return "".join([*out, page[at:]]), blocked


def _harmless(page: str, start: int, stop: int, end: int, name: str, own: list[Attribute]) -> tuple[str, bool]:
    out, at, blocked = [], start, False

    def put(a: Attribute, text: str, since: int | None = None) -> None:
        nonlocal at
        out.extend((page[at : a.start if since is None else since], text))
        at = a.end

    for a in own:
        value = page[a.value : a.value_end]
        if a.end > a.start + len(a.name) and (a.name.startswith("on") and a.name[2:].isalpha() or a.name == "ping"):
            put(a, " ", a.before)
        elif a.name in LEADING and _address(value).replace(" ", "").startswith(RUNNING):
            put(a, f'{page[a.start : a.start + len(a.name)]}="#"')
        elif a.name in LOADING and _address(value).startswith(OUTSIDE):
            put(a, f'{page[a.start : a.start + len(a.name)]}="" {BLOCKED}')
            blocked = True
        elif a.name in ("srcset", "imgsrcset", "imagesrcset") and _somewhere_outside(value):
            put(a, f" {BLOCKED}")
            blocked = True
        elif a.name in ("href", "xlink:href") and name not in ("a", "area") and _address(value).startswith(OUTSIDE):
            put(a, f'{page[a.start : a.start + len(a.name)]}=""')
            blocked = True
        elif a.name == "style" and (kept := styled(value, True)) != value:
            if kept is None:
                put(a, " ", a.before)
            else:
                out.extend((page[at : a.value], kept))
                at = a.value_end
            blocked = True
    return "".join([*out, page[at:end]]), blocked
