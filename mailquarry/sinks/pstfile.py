"""Writes mail stores of the Unicode format: folders with messages, recipients, attachments and embedded messages.

For exchange with extract.pst and for tests of it; checksums and allocation maps are left empty.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from datetime import UTC, datetime

BLOCK, ITEM = 8176, 3580
SIZES = {0x0003: 4, 0x000B: 1, 0x0040: 8, 0x001F: 4, 0x001E: 4, 0x0102: 4, 0x000D: 4}


@dataclass
class Mail:
    """values, and those of recipients and attachments: property tags to text, bytes, numbers, booleans or times."""

    values: dict
    recipients: list[dict] = field(default_factory=list)
    attachments: list[tuple[dict, Mail | None]] = field(default_factory=list)


@dataclass
class Box:
    name: str
    mails: list[Mail] = field(default_factory=list)
    boxes: list[Box] = field(default_factory=list)


def coded(v) -> tuple[int, bytes]:
    if isinstance(v, bool):
        return 0x000B, struct.pack("<B", v)
    if isinstance(v, int):
        return 0x0003, struct.pack("<i", v)
    if isinstance(v, datetime):
        return 0x0040, struct.pack("<Q", round((v - datetime(1601, 1, 1, tzinfo=UTC)).total_seconds()) * 10_000_000)
    return (0x001F, v.encode("utf-16-le")) if isinstance(v, str) else (0x0102, bytes(v))


class Writer:
    def __init__(self, table: bytes | None = None, gap: int = 0):
        """table: the reader's substitution, if blocks are to be encoded. gap: bytes that are left free behind the header, a multiple of 64."""
        self.gap = gap
        self.table = bytes(table.index(i) for i in range(256)) if table else None
        self.out = bytearray(1024)
        self.blocks: list[tuple[int, int, int]] = []
        self.nodes: list[tuple[int, int, int, int]] = []
        self.last, self.serial = 0, 0

    def block(self, data: bytes, internal: bool = False) -> int:
        self.last += 4
        bid = self.last | (2 if internal else 0)
        at = len(self.out) + self.gap
        self.out += data.translate(self.table) if self.table and not internal else data
        self.out += bytes(-(len(data) + 16) % 64 + 16)
        self.blocks.append((bid, at, len(data)))
        return bid

    def tree_of(self, parts: list[bytes]) -> int:
        """The block of a node's data, above several parts an array of theirs."""
        bids = [self.block(p) for p in parts]
        if len(bids) == 1:
            return bids[0]
        if len(bids) > 1000:
            bids = [self._array(1, bids[i : i + 1000]) for i in range(0, len(bids), 1000)]
            return self._array(2, bids)
        return self._array(1, bids)

    def _array(self, level: int, bids: list[int]) -> int:
        return self.block(struct.pack("<BBHI", 1, level, len(bids), 0) + b"".join(struct.pack("<Q", b) for b in bids), True)

    def subnodes(self, below: dict[int, tuple[int, int]]) -> int:
        if not below:
            return 0
        rows = [struct.pack("<QQQ", n, *below[n]) for n in sorted(below)]
        leaves = [(sorted(below)[i], self.block(struct.pack("<BBHI", 2, 0, len(rows[i : i + 300]), 0) + b"".join(rows[i : i + 300]), True)) for i in range(0, len(rows), 300)]
        if len(leaves) == 1:
            return leaves[0][1]
        return self.block(struct.pack("<BBHI", 2, 1, len(leaves), 0) + b"".join(struct.pack("<QQ", *x) for x in leaves), True)

    def properties(self, values: dict, below: dict | None = None, extra: dict | None = None) -> tuple[int, int]:
        """A property context; extra: tags to ready-made (kind, content)."""
        heap, below = HeapWriter(self), dict(below or {})
        records = b""
        for tag, (kind, raw) in sorted({**{t: coded(v) for t, v in values.items()}, **(extra or {})}.items()):
            small = raw.ljust(4, b"\0") if kind in (0x0003, 0x000B) else struct.pack("<I", heap.put(raw, below))
            records += struct.pack("<HH", tag, kind) + small
        top = heap.tree(2, 6, records)
        return heap.finish(0xBC, top), self.subnodes(below)

    def rows(self, rows: list[tuple[int, dict]]) -> tuple[int, int]:
        """A table context of rows (id, values)."""
        heap, below = HeapWriter(self), {}
        cells = [(rid, {t: coded(v) for t, v in values.items()}) for rid, values in rows]
        kinds = {t: k for _, c in cells for t, (k, _) in c.items()}
        order = sorted(kinds, key=lambda t: (-SIZES[kinds[t]], t))
        at, columns, bit = 8, {}, 2
        for t in order:
            columns[t] = at, SIZES[kinds[t]], bit
            at, bit = at + SIZES[kinds[t]], bit + 1
        wide = 8 + sum(SIZES[kinds[t]] for t in order if SIZES[kinds[t]] > 1)
        width = at + -(-bit // 8)
        packed = []
        for rid, c in cells:
            row = bytearray(width)
            row[:8] = struct.pack("<II", rid, 0)
            row[at] |= 0xC0
            for t, (_, raw) in c.items():
                where, size, b = columns[t]
                row[where : where + size] = raw if kinds[t] in (0x0003, 0x000B, 0x0040) else struct.pack("<I", heap.put(raw, below))
                row[at + b // 8] |= 1 << (7 - b % 8)
            packed.append(bytes(row))
        per = BLOCK // width
        index = heap.tree(4, 4, b"".join(struct.pack("<II", rid, k) for k, rid in sorted(((k, r) for k, (r, _) in enumerate(rows)), key=lambda x: x[1])))
        where = 0
        if packed:
            below[0x3F] = self.tree_of([b"".join(packed[i : i + per]) for i in range(0, len(packed), per)]), 0
            where = 0x3F
        described = [(0x0003, 0x67F2, 0, 4, 0), (0x0003, 0x67F3, 4, 4, 1)] + [(kinds[t], t, *columns[t]) for t in order]
        info = struct.pack("<BB4HIII", 0x7C, len(described), wide, wide, at, width, index, where, 0) + b"".join(struct.pack("<HHHBB", *d) for d in sorted(described, key=lambda d: d[1]))
        return heap.finish(0x7C, heap.item(info)), self.subnodes(below)

    def mail(self, m: Mail) -> tuple[int, int]:
        below: dict[int, tuple[int, int]] = {}
        if m.recipients:
            below[0x692] = self.rows(list(enumerate(m.recipients)))
        if m.attachments:
            ids = [(k + 1) << 5 | 0x05 for k in range(len(m.attachments))]
            below[0x671] = self.rows([(n, {0x0E20: 0}) for n in ids])
            for n, (values, inner) in zip(ids, m.attachments, strict=True):
                if inner is None:
                    below[n] = self.properties(values)
                else:
                    below[n] = self.properties({**values, 0x3705: 5}, {0x24: self.mail(inner)}, {0x3701: (0x000D, struct.pack("<II", 0x24, 0))})
        return self.properties(m.values, below)

    def box(self, nid: int, box: Box, parent: int) -> None:
        self.nodes.append((nid, *self.properties({0x3001: box.name}), parent))
        inner = []
        for b in box.boxes:
            self.serial += 1
            inner.append((0x8000 + self.serial * 32 | 0x02, b))
        self.nodes.append((nid & ~0x1F | 0x0D, *self.rows([(n, {0x3001: b.name}) for n, b in inner]), 0))
        listed = []
        for m in box.mails:
            self.serial += 1
            n = 0x200000 + self.serial * 32 | 0x04
            self.nodes.append((n, *self.mail(m), nid))
            listed.append((n, {t: v for t, v in m.values.items() if t in (0x0037, 0x0042, 0x0E04, 0x0E06, 0x0E07, 0x0E08, 0x001A, 0x0017)}))
        self.nodes.append((nid & ~0x1F | 0x0E, *self.rows(listed), 0))
        for n, b in inner:
            self.box(n, b, nid)

    def pages(self, entries: list[bytes]) -> int:
        """Place of the top page of a tree of entries."""
        level = 0
        while True:
            size = len(entries[0])
            per, above = 488 // size, []
            for i in range(0, len(entries), per):
                part = entries[i : i + per]
                above.append(struct.pack("<QQQ", struct.unpack_from("<Q", part[0])[0], 0, len(self.out) + self.gap))
                self.out += b"".join(part).ljust(488, b"\0") + struct.pack("<4B", len(part), per, size, level) + bytes(20)
            if len(above) == 1:
                return struct.unpack_from("<Q", above[0], 16)[0]
            entries, level = above, level + 1

    def finish(self) -> bytes:
        """The store without the gap, which goes behind the first 1024 bytes."""
        nodes = self.pages([struct.pack("<QQQII", n, d, s, up, 0) for n, d, s, up in sorted(self.nodes)])
        blocks = self.pages([struct.pack("<QQHHI", b, at, size, 1, 0) for b, at, size in sorted(self.blocks, key=lambda x: x[0] & ~1)])
        self.out[:4] = b"!BDN"
        struct.pack_into("<H", self.out, 10, 23)
        struct.pack_into("<Q", self.out, 224, nodes)
        struct.pack_into("<Q", self.out, 240, blocks)
        self.out[513] = 1 if self.table else 0
        return bytes(self.out)


class HeapWriter:
    def __init__(self, writer: Writer):
        self.writer, self.blocks, self.fill = writer, [[]], 12
        self.subs = 0

    def item(self, raw: bytes) -> int:
        if self.fill + len(raw) + 2 * (len(self.blocks[-1]) + 3) + 4 > BLOCK:
            self.blocks.append([])
            self.fill = 66
        self.blocks[-1].append(raw)
        self.fill += len(raw)
        return len(self.blocks) - 1 << 16 | len(self.blocks[-1]) << 5

    def put(self, raw: bytes, below: dict) -> int:
        """An item; above its largest size a subnode; nothing for no content."""
        if not raw:
            return 0
        if len(raw) <= ITEM:
            return self.item(raw)
        self.subs += 1
        nid = 0x1000 + self.subs * 32 | 0x1F
        below[nid] = self.writer.tree_of([raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]), 0
        return nid

    def tree(self, key: int, size: int, records: bytes) -> int:
        step, level = key + size, 0
        while True:
            per = ITEM // step * step
            parts = [records[i : i + per] for i in range(0, len(records), per)]
            hids = [(p[:key], self.item(p)) for p in parts]
            if len(hids) <= 1:
                top = hids[0][1] if hids else 0
                return self.item(struct.pack("<BBBBI", 0xB5, key, size, level, top))
            records, step, level = b"".join(k + struct.pack("<I", h) for k, h in hids), key + 4, level + 1

    def finish(self, kind: int, root: int) -> int:
        out = []
        for k, items in enumerate(self.blocks):
            head = 12 if k == 0 else 66
            places = [head]
            for i in items:
                places.append(places[-1] + len(i))
            body = b"".join(items)
            pad = (head + len(body)) % 2
            at = head + len(body) + pad
            start = struct.pack("<HBBI4x", at, 0xEC, kind, root) if k == 0 else struct.pack("<H", at).ljust(66, b"\0")
            out.append(start + body + bytes(pad) + struct.pack("<HH", len(items), 0) + struct.pack(f"<{len(places)}H", *places))
        return self.writer.tree_of(out)


def store(boxes: list[Box], table: bytes | None = None) -> bytes:
    w = Writer(table)
    w.box(0x122, Box("root", [], boxes), 0x122)
    return w.finish()


def write_store(path: str, boxes: list[Box], table: bytes | None = None, gap: int = 0) -> None:
    """A store as a local file, with a hole of `gap` bytes in it."""
    w = Writer(table, gap)
    w.box(0x122, Box("root", [], boxes), 0x122)
    data = w.finish()
    with open(path, "wb") as f:
        f.write(data[:1024])
        f.seek(1024 + gap)
        f.write(data[1024:])
