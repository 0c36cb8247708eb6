"""Compound files, and the text of binary Word, Excel and PowerPoint documents in them."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from .limits import Budget, Encrypted

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
END = 0xFFFFFFFA  # from here on sector numbers are marks


@dataclass
class Entry:
    name: str
    kind: int
    start: int
    size: int
    left: int
    right: int
    child: int
    children: dict[str, Entry] = field(default_factory=dict)


class CompoundFile:
    """Storages and streams of a compound file. Broken chains end early; loops in chains or the tree are cut."""

    def __init__(self, data: bytes):
        if not data.startswith(MAGIC) or len(data) < 512:
            raise ValueError("not a compound file")
        self.data = data
        shift, small = struct.unpack_from("<HH", data, 30)
        self.sector, self.small = 1 << shift, 1 << small
        directory, _, self.cutoff, mini, _, difat, _ = struct.unpack_from("<7I", data, 48)
        table = list(struct.unpack_from("<109I", data, 76))
        per, seen = self.sector // 4, set()
        while difat < END and difat not in seen:
            seen.add(difat)
            part = self._numbers(difat)
            table += part[: per - 1]
            difat = part[per - 1] if len(part) == per else END
        self.fat = [x for s in table if s < END for x in self._numbers(s)]
        self.minifat = [x for s in self._chain(mini, self.fat) for x in self._numbers(s)]
        raw = self._join(directory)
        entries = [self._entry(raw[i : i + 128]) for i in range(0, len(raw) - 127, 128)]
        self.root = entries[0] if entries else Entry("", 5, END, 0, END, END, END)
        self.mini = self._join(self.root.start)
        self._tree(self.root, entries, {0})

    def _numbers(self, s: int) -> list[int]:
        at = (s + 1) * self.sector
        part = self.data[at : at + self.sector]
        return list(struct.unpack(f"<{len(part) // 4}I", part[: len(part) // 4 * 4]))

    @staticmethod
    def _chain(s: int, fat: list[int]) -> list[int]:
        out, seen = [], set()
        while s < len(fat) and s < END and s not in seen:
            seen.add(s)
            out.append(s)
            s = fat[s]
        return out

    def _join(self, s: int) -> bytes:
        return b"".join(self.data[(k + 1) * self.sector : (k + 2) * self.sector] for k in self._chain(s, self.fat))

    @staticmethod
    def _entry(raw: bytes) -> Entry:
        n = struct.unpack_from("<H", raw, 64)[0]
        left, right, child = struct.unpack_from("<3I", raw, 68)
        start, size = struct.unpack_from("<IQ", raw, 116)
        return Entry(raw[: max(0, n - 2)].decode("utf-16-le", "replace"), raw[66], start, size & 0xFFFFFFFF, left, right, child)

    def _tree(self, top: Entry, entries: list[Entry], seen: set[int]) -> None:
        todo = [(top, top.child)]
        while todo:
            parent, i = todo.pop()
            if i >= len(entries) or i in seen:
                continue
            seen.add(i)
            e = entries[i]
            parent.children[e.name] = e
            todo += [(parent, e.left), (parent, e.right)]
            if e.kind in (1, 5):
                todo.append((e, e.child))

    def read(self, e: Entry) -> bytes:
        if e.size < self.cutoff:
            parts = (self.mini[k * self.small : (k + 1) * self.small] for k in self._chain(e.start, self.minifat))
            return b"".join(parts)[: e.size]
        return self._join(e.start)[: e.size]

    def stream(self, *path: str) -> bytes | None:
        e = self.root
        for p in path:
            e = next((c for n, c in e.children.items() if n.lower() == p.lower()), None)
            if e is None:
                return None
        return self.read(e)


def word_text(cf: CompoundFile) -> str:
    """The main text by the piece table, field codes left out."""
    main = cf.stream("WordDocument") or b""
    flags = struct.unpack_from("<H", main, 10)[0]
    if flags & 0x0100:
        raise Encrypted
    table = cf.stream("1Table" if flags & 0x0200 else "0Table") or b""
    at, size = struct.unpack_from("<II", main, 0x01A2)
    clx, i, pieces = table[at : at + size], 0, b""
    while i < len(clx):
        if clx[i] == 1:
            i += 3 + struct.unpack_from("<H", clx, i + 1)[0]
        elif clx[i] == 2:
            n = struct.unpack_from("<I", clx, i + 1)[0]
            pieces = clx[i + 5 : i + 5 + n]
            break
        else:
            break
    n = (len(pieces) - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", pieces) if n > 0 else ()
    out = []
    for k in range(n):
        where = struct.unpack_from("<I", pieces, 4 * (n + 1) + 8 * k + 2)[0]
        chars = ends[k + 1] - ends[k]
        if where & 0x40000000:
            where = (where & 0x3FFFFFFF) // 2
            out.append(main[where : where + chars].decode("cp1252", "replace"))
        else:
            out.append(main[where : where + 2 * chars].decode("utf-16-le", "replace"))
    shown, depth = [], []
    for c in "".join(out):
        if c == "\x13":
            depth.append(False)
        elif c == "\x14" and depth:
            depth[-1] = True
        elif c == "\x15" and depth:
            depth.pop()
        elif all(depth):
            shown.append({"\r": "\n", "\x0b": "\n", "\x0c": "\n", "\x07": "\t"}.get(c, c))
    return "".join(shown)


def records(data: bytes, head: str):
    """Type and content of each record."""
    size, i = struct.calcsize(head), 0
    while i + size <= len(data):
        *_, kind, n = struct.unpack_from(head, data, i)
        yield kind, data[i + size : i + size + n]
        i += size + n


def _sheet_string(b: bytes, at: int, chars: int, wide: bool) -> tuple[str, int]:
    n = chars * (2 if wide else 1)
    return b[at : at + n].decode("utf-16-le" if wide else "latin-1", "replace"), at + n


def excel_text(cf: CompoundFile) -> str:
    """Sheet names, shared strings and numbers, in the order of their records."""
    book = cf.stream("Workbook") or cf.stream("Book") or b""
    out: list[str] = []
    shared: list[str] = []
    parts: list[bytes] = []
    in_table = False
    rows = list(records(book, "<HH"))
    for kind, b in rows:
        if kind == 0x2F:
            raise Encrypted
        if kind == 0xFC:
            parts, in_table = [b], True
        elif kind == 0x3C and in_table:
            parts.append(b)
        else:
            in_table = False
    if parts:
        shared = _shared_strings(parts)
    for kind, b in rows:
        if kind == 0x85 and len(b) > 8:
            out.append(_sheet_string(b, 8, b[6], bool(b[7] & 1))[0])
        elif kind == 0xFD and len(b) >= 10:
            k = struct.unpack_from("<I", b, 6)[0]
            if k < len(shared):
                out.append(shared[k])
        elif kind == 0x204 and len(b) > 9:
            out.append(_sheet_string(b, 9, struct.unpack_from("<H", b, 6)[0], bool(b[8] & 1))[0])
        elif kind == 0x203 and len(b) >= 14:
            out.append(f"{struct.unpack_from('<d', b, 6)[0]:g}")
        elif kind == 0x27E and len(b) >= 10:
            out.append(f"{_rk(struct.unpack_from('<I', b, 6)[0]):g}")
        elif kind == 0xBD and len(b) >= 6:
            out += [f"{_rk(struct.unpack_from('<I', b, i + 2)[0]):g}" for i in range(4, len(b) - 7, 6)]
    return "\n".join(out)


def _rk(v: int) -> float:
    x = float((v >> 2) - (1 << 30 if v >> 31 else 0)) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0]
    return x / 100 if v & 1 else x


def _shared_strings(parts: list[bytes]) -> list[str]:
    """The shared string table; a string that goes on in the next record states its width anew."""
    out, p, i = [], 0, 8
    count = struct.unpack_from("<I", parts[0], 4)[0]
    for _ in range(count):
        if p >= len(parts):
            break
        if i >= len(parts[p]):
            p, i = p + 1, 0
            if p >= len(parts):
                break
        b = parts[p]
        if i + 3 > len(b):
            break
        left, flags = struct.unpack_from("<HB", b, i)
        i += 3
        runs = extra = 0
        if flags & 8:
            runs = struct.unpack_from("<H", b, i)[0]
            i += 2
        if flags & 4:
            extra = struct.unpack_from("<I", b, i)[0]
            i += 4
        wide, text = bool(flags & 1), ""
        while left:
            room = (len(parts[p]) - i) // (2 if wide else 1)
            take = min(left, room)
            s, i = _sheet_string(parts[p], i, take, wide)
            text, left = text + s, left - take
            if left:
                p += 1
                if p >= len(parts):
                    break
                wide, i = bool(parts[p][0] & 1), 1
        skip = 4 * runs + extra
        while p < len(parts) and i + skip > len(parts[p]):
            skip -= len(parts[p]) - i
            p, i = p + 1, 0
        i += skip
        out.append(text)
    return out


def slides_text(cf: CompoundFile) -> str:
    """Text atoms of a presentation."""
    user = cf.stream("Current User") or b""
    if len(user) >= 16 and struct.unpack_from("<I", user, 12)[0] == 0xF3D1C4DF:
        raise Encrypted
    out: list[str] = []

    def walk(data: bytes, depth: int) -> None:
        i = 0
        while i + 8 <= len(data) and depth < 32:
            head, kind, n = struct.unpack_from("<HHI", data, i)
            body = data[i + 8 : i + 8 + n]
            if head & 15 == 15:
                walk(body, depth + 1)
            elif kind == 0x0FA0:
                out.append(body.decode("utf-16-le", "replace"))
            elif kind == 0x0FA8:
                out.append(body.decode("latin-1"))
            i += 8 + n

    walk(cf.stream("PowerPoint Document") or b"", 0)
    return "\n".join(s.replace("\r", "\n").replace("\x0b", "\n") for s in out)


def ole_text(data: bytes, budget: Budget, depth: int) -> str:
    cf = CompoundFile(data)
    names = {n.lower() for n in cf.root.children}
    if "encryptedpackage" in names:
        raise Encrypted
    if "worddocument" in names:
        return word_text(cf)
    if "workbook" in names or "book" in names:
        return excel_text(cf)
    if "powerpoint document" in names:
        return slides_text(cf)
    if "__properties_version1.0" in names:
        from .dispatch import text_of
        from .message import parse_message

        m = parse_message(cf, cf.root, budget.limits.depth - depth)
        parts = [m.subject or "", m.best_body()]
        for a in m.attachments:
            if a.data and depth < budget.limits.depth:
                budget.entry()
                budget.spend(len(a.data))
                parts += [a.name, text_of(a.name, a.data, budget, depth + 1) or ""]
            elif a.message:
                parts += [a.message.subject or "", a.message.best_body()]
        return "\n".join(p for p in parts if p)
    raise ValueError("no known document in the compound file")
