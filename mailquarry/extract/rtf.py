"""RTF to text, and the HTML that a mail program wrapped in RTF."""

from __future__ import annotations

import codecs
import re

_TOKEN = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")

#: Groups whose content is not text.
SKIPPED = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "generator", "themedata", "xmlnstbl", "listtable", "listoverridetable", "rsidtbl", "datastore", "fldinst"}
SPECIAL = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}


def _decoder(name: str) -> codecs.IncrementalDecoder:
    try:
        return codecs.getincrementaldecoder(name)("replace")
    except LookupError:
        return codecs.getincrementaldecoder("cp1252")("replace")


def _walk(data: bytes, html: bool) -> str:
    """Text outside of skipped groups. For wrapped HTML the tags come from its destinations and what is only for RTF
    readers is left out."""
    out: list[str] = []
    charset = "cp1252"
    stack: list[tuple] = []
    skip, tag, hidden, fallback, left = False, False, False, 1, 0
    first = False

    def put(s: str) -> None:
        if not skip and not (html and hidden and not tag):
            out.append(s)

    # a character of a code page may be two bytes, of which the second can stand as a plain one
    coded = _decoder(charset)

    for m in _TOKEN.finditer(data):
        word, number, hexa, symbol, brace, text = m.groups()
        if not hexa and coded.getstate()[0]:
            lead = text[:1] if text else b""
            put(coded.decode(lead, not lead))
            if lead:
                text = text[1:]
                if not text:
                    continue
        if brace == b"{":
            stack.append((skip, tag, hidden, fallback))
            first, left = True, 0
            continue
        if brace == b"}":
            if stack:
                skip, tag, hidden, fallback = stack.pop()
            first, left = False, 0
            continue
        if word:
            name, n = word.decode(), int(number) if number else None
            if name == "u" and n is not None:
                put(chr(n % 65536))
                left = fallback
            elif name == "uc":
                fallback = n or 0
            elif name == "ansicpg" and n:
                coded = _decoder(f"cp{n}" if n != 65001 else "utf-8")
            elif name == "htmltag":
                tag, skip = html, not html
            elif name == "htmlrtf":
                hidden = n != 0
            elif name == "mhtmltag" or name in SKIPPED:
                skip = True
            elif name == "bin" and n:
                skip = True
            elif name in SPECIAL and not (html and not tag):
                put(SPECIAL[name])
            elif html and name in ("par", "tab", "line"):
                put(SPECIAL[name])
            first = False
        elif hexa:
            if left:
                left -= 1
            else:
                put(coded.decode(bytes([int(hexa, 16)])))
        elif symbol:
            if symbol == b"*" and first:
                skip = True
                if html and data[m.end() : m.end() + 8] == b"\\htmltag":
                    skip = False
            elif symbol in b"\\{}":
                put(symbol.decode())
            elif symbol == b"~":
                put("\u00a0")
            first = False
        elif text:
            part = text.decode("cp1252", "replace")
            if left:
                part, left = part[left:], max(0, left - len(part))
            put(part)
            first = False
    return re.sub("[\ud800-\udbff][\udc00-\udfff]", lambda p: p.group().encode("utf-16", "surrogatepass").decode("utf-16"), "".join(out))


def has_html(data: bytes) -> bool:
    return b"\\fromhtml" in data[:2000]


def rtf_html(data: bytes) -> str | None:
    return _walk(data, True) if has_html(data) else None


def rtf_text(data: bytes) -> str:
    if has_html(data):
        from .plain import html_text

        return html_text(_walk(data, True))
    return re.sub(r"\n{3,}", "\n\n", _walk(data, False)).strip()


def decompress(data: bytes) -> bytes:
    """Compressed RTF of message properties (LZ77 with the fixed dictionary of the public format description)."""
    size, kind = int.from_bytes(data[4:8], "little"), data[8:12]
    if kind == b"MELA":
        return data[16 : 16 + size]
    if kind != b"LZFu":
        return data
    start = (
        rb"{\rtf1\ansi\mac\deff0\deftab720{\fonttbl;}{\f0\fnil \froman \fswiss \fmodern \fscript \fdecor MS Sans SerifSymbolArialTimes New RomanCourier{\colortbl\red0\green0\blue0"
        b"\r\n" + rb"\par \pard\plain\f0\fs20\b\i\u\tab\tx"
    )
    ring = bytearray(start.ljust(4096, b"\0"))
    at, out, i = len(start), bytearray(), 16
    while i < len(data):
        control = data[i]
        i += 1
        for bit in range(8):
            if i >= len(data):
                return bytes(out[:size])
            if control >> bit & 1:
                ref = int.from_bytes(data[i : i + 2], "big")
                i += 2
                offset, length = ref >> 4, (ref & 15) + 2
                if offset == at % 4096:
                    return bytes(out[:size])
                for k in range(length):
                    c = ring[(offset + k) % 4096]
                    out.append(c)
                    ring[at % 4096] = c
                    at += 1
            else:
                out.append(data[i])
                ring[at % 4096] = data[i]
                at += 1
                i += 1
    return bytes(out[:size])
