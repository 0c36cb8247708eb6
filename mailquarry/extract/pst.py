"""Mail stores (Unicode format of the public description): B-trees, heaps, property and table contexts, folders.

Blocks that are encoded by substitution need its table of 256 bytes, which is a parameter. Pages and blocks are read by their place
when they are asked for and found by search in their trees, so a store of any size is read with little memory, and a part of it without the rest.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

from .limits import Encrypted
from .message import EPOCH, Message, attachment_of, from_properties, recipient_of
from .plain import decode

ROOT_FOLDER = 0x122
HIERARCHY, CONTENTS = 0x0D, 0x0E
RECIPIENTS, ATTACHMENTS = 0x692, 0x671
VARIABLE = (0x001E, 0x001F, 0x0102, 0x000D)


@dataclass(frozen=True)
class Folder:
    nid: int
    path: str
    name: str
    depth: int


#: What of a message may be asked for beside its short properties.
ALL = frozenset({"body", "recipients", "attachments"})
#: Type of a node, in the low five bits of its number.
MESSAGE = 0x04
#: Entries of a page of the tree of nodes, in leaves and above them.
LEAF, ABOVE = 15, 20
#: Pages of 512 bytes and blocks of at most 8 KB that a store keeps.
PAGES, BLOCKS = 4096, 256


class Source(Protocol):
    """What a store is read from."""

    def read(self, at: int, size: int) -> bytes: ...


class Held:
    """A store in memory."""

    def __init__(self, data: bytes):
        self.data = data

    def read(self, at: int, size: int) -> bytes:
        return self.data[at : at + size]


class Parts(Sequence):
    """The blocks of a node's data, read one by one."""

    def __init__(self, store: Store, bids: list[int]):
        self.store, self.bids = store, bids

    def __len__(self) -> int:
        return len(self.bids)

    def __getitem__(self, k: int) -> bytes:
        return self.store.block(self.bids[k])

    def size(self, k: int) -> int:
        """Without reading the block."""
        return self.store.place(self.bids[k])[1]


class Store:
    def __init__(self, source: bytes | Source, table: bytes | None = None):
        self.source = Held(source) if isinstance(source, (bytes, bytearray, memoryview)) else source
        head = self.source.read(0, 564)
        if head[:4] != b"!BDN":
            raise ValueError("not a mail store")
        if struct.unpack_from("<H", head, 10)[0] < 23:
            raise ValueError("the older format with 32-bit places isn't read")
        if table is not None and sorted(table) != list(range(256)):
            raise ValueError("the substitution must have each of 256 bytes once")
        self.table, self.encoded = table, head[513]
        self.nodes, self.blocks = struct.unpack_from("<Q", head, 224)[0], struct.unpack_from("<Q", head, 240)[0]
        self.page = lru_cache(PAGES)(lambda at: self.source.read(at, 512))
        self.block = lru_cache(BLOCKS)(self._block)

    def entries(self, page_at: int) -> tuple[int, list[bytes]]:
        """Level and entries of a page."""
        page = self.page(page_at)
        n, size, level = page[488], page[490], page[491]
        return level, [page[k * size : (k + 1) * size] for k in range(n)]

    def _find(self, page_at: int, key: int) -> bytes | None:
        """The leaf entry of a key. Entries are sorted, so each page is searched by halves."""
        for _ in range(16):
            page = self.page(page_at)
            n, size, level = page[488], page[490], page[491]
            low, high = 0, n
            while low < high:
                mid = (low + high) // 2
                if struct.unpack_from("<Q", page, mid * size)[0] <= key:
                    low = mid + 1
                else:
                    high = mid
            if not low:
                return None
            entry = page[(low - 1) * size : low * size]
            if level == 0:
                return entry if struct.unpack_from("<Q", entry)[0] == key else None
            page_at = struct.unpack_from("<Q", entry, 16)[0]
        return None

    def node(self, nid: int) -> tuple[int, int] | None:
        """Data block and subnode block of a node."""
        e = self._find(self.nodes, nid)
        return struct.unpack_from("<QQ", e, 8) if e else None

    def parent(self, nid: int) -> int | None:
        e = self._find(self.nodes, nid)
        return struct.unpack_from("<I", e, 24)[0] if e else None

    def scan(self, low: int = 0, high: int = 1 << 64, page_at: int | None = None, depth: int = 0) -> Iterator[tuple[int, int]]:
        """Number and parent of the nodes from low to below high; pages outside aren't read."""
        level, entries = self.entries(self.nodes if page_at is None else page_at)
        keys = [struct.unpack_from("<Q", e)[0] for e in entries]
        for k, (key, e) in enumerate(zip(keys, entries, strict=True)):
            if key >= high:
                return
            if level == 0 and key >= low:
                yield key, struct.unpack_from("<I", e, 24)[0]
            elif level and depth < 16 and (k + 1 == len(keys) or keys[k + 1] > low):
                yield from self.scan(low, high, struct.unpack_from("<Q", e, 16)[0], depth + 1)

    def spans(self, nodes: int) -> list[tuple[int, int, int]]:
        """Ranges (low, high) of node numbers that cover all, and about how many nodes each has: `nodes`, as far as the upper pages of the tree tell."""
        level, entries = self.entries(self.nodes)
        while level and LEAF * ABOVE ** (level - 1) > nodes:
            pages = [self.entries(struct.unpack_from("<Q", e, 16)[0]) for e in entries]
            level, entries = level - 1, [e for _, own in pages for e in own]
        each = LEAF * ABOVE ** (level - 1) if level else 1
        per = max(1, nodes // each)
        cuts = [struct.unpack_from("<Q", entries[k])[0] for k in range(0, len(entries), per)]
        counts = [each * min(per, len(entries) - k) for k in range(0, len(entries), per)]
        return list(zip([0, *cuts[1:]], [*cuts[1:], 1 << 64], counts, strict=True)) if cuts else []

    def place(self, bid: int) -> tuple[int, int]:
        """Where a block is and how long."""
        e = self._find(self.blocks, bid & ~1)
        if e is None:
            raise ValueError(f"block {bid:x} is missing")
        return struct.unpack_from("<Q", e, 8)[0], struct.unpack_from("<H", e, 16)[0]

    def _block(self, bid: int) -> bytes:
        raw = self.source.read(*self.place(bid))
        if bid & 2 or self.encoded == 0:
            return raw
        if self.encoded != 1 or self.table is None:
            raise Encrypted("the store is encoded")
        return raw.translate(self.table)

    def leaves(self, bid: int, level: int = 0) -> list[int]:
        """The blocks of a node's data; only arrays of blocks are read."""
        if not bid:
            return []
        if not bid & 2 or level > 3:
            return [bid]
        raw = self.block(bid)
        n = struct.unpack_from("<H", raw, 2)[0]
        return [p for (b,) in struct.iter_unpack("<Q", raw[8 : 8 + 8 * n]) for p in self.leaves(b, level + 1)]

    def parts(self, bid: int) -> Parts:
        """The data of a node, block by block."""
        return Parts(self, self.leaves(bid))

    def subnodes(self, bid: int, level: int = 0) -> dict[int, tuple[int, int]]:
        out: dict[int, tuple[int, int]] = {}
        if not bid or level > 3:
            return out
        raw = self.block(bid)
        n = struct.unpack_from("<H", raw, 2)[0]
        if raw[1] == 0:
            for nid, data, sub in struct.iter_unpack("<QQQ", raw[8 : 8 + 24 * n]):
                out[nid & 0xFFFFFFFF] = data, sub
        else:
            for _, b in struct.iter_unpack("<QQ", raw[8 : 8 + 16 * n]):
                out |= self.subnodes(b, level + 1)
        return out

    # --- folders and messages ---------------------------------------------------------------------------

    def folders(self) -> Iterator[Folder]:
        """Depth first from the root's children. A slash in a name becomes a division slash."""
        todo, seen = [(nid, "", 0) for nid in reversed(self._children(ROOT_FOLDER))], set()
        while todo:
            nid, above, depth = todo.pop()
            if nid in seen or self.node(nid) is None:
                continue
            seen.add(nid)
            name = self._name(nid)
            path = f"{above}/{name}" if above else name
            yield Folder(nid, path, name, depth)
            todo += [(c, path, depth + 1) for c in reversed(self._children(nid))]

    def _name(self, folder: int) -> str:
        return (PropertyBag(self, *self.node(folder)).clean(0x3001) or "(sans nom)").replace("/", "∕")

    def path_of(self, folder: int, known: dict[int, str | None]) -> str | None:
        """Path of a folder by its parents, null if they don't lead to the root; `known` keeps what was found."""
        if folder not in known:
            known[folder] = None  # a ring of parents leads nowhere
            above = self.parent(folder)
            if above == ROOT_FOLDER and folder != ROOT_FOLDER:
                known[folder] = self._name(folder)
            elif above and (up := self.path_of(above, known)):
                known[folder] = f"{up}/{self._name(folder)}"
        return known[folder]

    def _table(self, folder: int, kind: int) -> list[tuple[int, PropertyBag]]:
        own = self.node(folder & ~0x1F | kind)
        return table_rows(self, *own) if own else []

    def _children(self, folder: int) -> list[int]:
        return [nid for nid, _ in self._table(folder, HIERARCHY)]

    def listing(self, folder: int) -> list[tuple[int, PropertyBag]]:
        """Messages of a folder with the columns of its contents table; stops at damage."""
        try:
            return self._table(folder, CONTENTS)
        except (ValueError, IndexError, struct.error):
            return []

    def contents(self, folder: int) -> list[int]:
        """Rows of each block of a folder's contents table; none of them is read."""
        own = self.node(folder & ~0x1F | CONTENTS)
        return Table(self, *own).per if own else []

    def rows(self, folder: int, first: int, last: int) -> Iterator[tuple[int, Row]]:
        """Messages of a folder in some blocks of its contents table."""
        own = self.node(folder & ~0x1F | CONTENTS)
        return Table(self, *own).slice(first, last) if own else iter(())

    def message(self, nid: int, depth: int = 5, want: frozenset[str] = ALL) -> Message:
        own = self.node(nid)
        if own is None:
            raise ValueError(f"message {nid:x} is missing")
        return self._message(*own, depth, want)

    def _message(self, data: int, sub: int, depth: int, want: frozenset[str] = ALL) -> Message:
        m = from_properties(PropertyBag(self, data, sub), "body" in want)
        below = self.subnodes(sub) if want & {"recipients", "attachments", "body"} else {}
        if RECIPIENTS in below and "recipients" in want:
            m.recipients = [r for _, row in table_rows(self, *below[RECIPIENTS]) if (r := recipient_of(row))]
        if ATTACHMENTS in below and want & {"attachments", "body"}:
            for k, (nid, _) in enumerate(table_rows(self, *below[ATTACHMENTS])):
                if nid not in below:
                    continue
                bag = PropertyBag(self, *below[nid])
                inner = bag.value(0x3701, 0x000D)
                target = self.subnodes(below[nid][1]).get(struct.unpack_from("<I", inner)[0]) if inner and len(inner) >= 4 else None
                embedded = bag.number(0x3705) == 5 and target is not None
                own = attachment_of(bag, k, embedded or "attachments" not in want)
                if embedded and depth > 0:
                    own.message = self._message(*target, depth - 1, want)
                m.attachments.append(own)
        return m


class Heap:
    """Small items in the blocks of a node, and what its subnodes hold."""

    def __init__(self, store: Store, data: int, sub: int):
        self.store, self.blocks, self.sub = store, store.parts(data), sub
        if not self.blocks or self.blocks[0][2] != 0xEC:
            raise ValueError("no heap in the node")
        self._below: dict | None = None

    @property
    def root(self) -> int:
        return struct.unpack_from("<I", self.blocks[0], 4)[0]

    def item(self, hid: int) -> bytes:
        if not hid:
            return b""
        b, k = self.blocks[hid >> 16], hid >> 5 & 0x7FF
        at = struct.unpack_from("<H", b)[0]
        start, end = struct.unpack_from("<HH", b, at + 4 + 2 * (k - 1))
        return b[start:end]

    def spread(self, hnid: int) -> Sequence[bytes]:
        """An item, or a subnode's blocks."""
        if hnid & 0x1F == 0:
            return [self.item(hnid)]
        if self._below is None:
            self._below = self.store.subnodes(self.sub)
        return self.store.parts(self._below[hnid][0]) if hnid in self._below else []

    def find(self, hid: int, wanted: int) -> bytes | None:
        """Content of a record of a tree on the heap; of each level one item is read."""
        head = self.item(hid)
        if len(head) < 8:
            return None
        key, size, level, at = head[1], head[2], min(head[3], 8), struct.unpack_from("<I", head, 4)[0]
        while True:
            raw, step = self.item(at), key + (4 if level else size)
            low, high = 0, len(raw) // step
            while low < high:
                mid = (low + high) // 2
                if int.from_bytes(raw[mid * step : mid * step + key], "little") <= wanted:
                    low = mid + 1
                else:
                    high = mid
            if not low:
                return None
            record = raw[(low - 1) * step : low * step]
            if not level:
                return record[key:] if int.from_bytes(record[:key], "little") == wanted else None
            at, level = struct.unpack_from("<I", record, key)[0], level - 1

    def tree(self, hid: int) -> Iterator[tuple[int, bytes]]:
        """Key and content of each record of a tree on the heap."""
        head = self.item(hid)
        if len(head) < 8:
            return
        key, size, levels, top = head[1], head[2], head[3], struct.unpack_from("<I", head, 4)[0]

        def walk(h: int, level: int) -> Iterator[tuple[int, bytes]]:
            raw, step = self.item(h), key + (4 if level else size)
            for i in range(0, len(raw) - step + 1, step):
                if level:
                    yield from walk(struct.unpack_from("<I", raw, i + key)[0], level - 1)
                else:
                    yield int.from_bytes(raw[i : i + key], "little"), raw[i + key : i + step]

        yield from walk(top, min(levels, 8))


class Values:
    """Typed reading of property values, as extract.message asks for them."""

    def value(self, tag: int, kind: int) -> bytes | None:
        raise NotImplementedError

    def binary(self, tag: int, kind: int = 0x0102) -> bytes | None:
        return self.value(tag, kind)

    def text(self, tag: int) -> str | None:
        wide = self.value(tag, 0x001F)
        if wide is not None:
            s = wide.decode("utf-16-le", "replace")
        else:
            narrow = self.value(tag, 0x001E)
            if narrow is None:
                return None
            s = decode(narrow, f"cp{self.number(0x3FFD) or 1252}")
        s = s.rstrip("\0")
        return s[2:] if tag == 0x0037 and s[:1] == "\x01" else s  # a subject may start with the length of its prefix

    def clean(self, tag: int) -> str | None:
        s = self.text(tag)
        s = "".join(c for c in s if c >= " ").strip() if s else None
        return s or None

    def number(self, tag: int) -> int | None:
        raw = self.value(tag, 0x0003)
        if raw is not None:
            return struct.unpack_from("<i", raw)[0]
        raw = self.value(tag, 0x000B)
        return None if raw is None else int(raw[0] != 0)

    def time(self, tag: int):
        from datetime import timedelta

        raw = self.value(tag, 0x0040)
        ticks = struct.unpack_from("<Q", raw)[0] if raw and len(raw) >= 8 else 0
        try:
            return EPOCH + timedelta(microseconds=ticks // 10) if ticks else None
        except OverflowError:
            return None


class PropertyBag(Values):
    """A property context."""

    def __init__(self, store: Store, data: int, sub: int):
        self.heap = Heap(store, data, sub)
        self.props = {tag: struct.unpack("<HI", rest) for tag, rest in self.heap.tree(self.heap.root)}

    def value(self, tag: int, kind: int) -> bytes | None:
        have, raw = self.props.get(tag, (0, 0))
        if have != kind:
            return None
        if kind in (0x0003, 0x000B, 0x0002):
            return struct.pack("<I", raw)
        return b"".join(self.heap.spread(raw))


class Row(Values):
    """A row of a table context."""

    def __init__(self, heap: Heap, columns: dict[int, tuple[int, int, int, int]], raw: bytes, bits: bytes):
        self.heap, self.columns, self.raw, self.bits = heap, columns, raw, bits

    def value(self, tag: int, kind: int) -> bytes | None:
        have, at, size, bit = self.columns.get(tag, (0, 0, 0, 0))
        if have != kind or not self.bits[bit // 8] >> (7 - bit % 8) & 1:
            return None
        raw = self.raw[at : at + size]
        return b"".join(self.heap.spread(struct.unpack("<I", raw)[0])) if kind in VARIABLE else raw


class Table:
    """A table context. Its rows stand in blocks, which a row never crosses; an index tells which of them count."""

    def __init__(self, store: Store, data: int, sub: int):
        self.heap = heap = Heap(store, data, sub)
        info = heap.item(heap.root)
        if not info or info[0] != 0x7C:
            raise ValueError("no table in the node")
        _, _, self.bits_at, self.width = struct.unpack_from("<4H", info, 2)
        self.index, rows = struct.unpack_from("<II", info, 10)
        self.columns = {}
        for i in range(info[1]):
            kind, tag, at, size, bit = struct.unpack_from("<HHHBB", info, 22 + 8 * i)
            self.columns[tag] = kind, at, size, bit
        self.blocks = heap.spread(rows) if rows else []
        sizes = [self.blocks.size(k) for k in range(len(self.blocks))] if isinstance(self.blocks, Parts) else map(len, self.blocks)
        self.per = [n // self.width for n in sizes]

    def row(self, block: bytes, k: int) -> Row:
        raw = block[k * self.width : (k + 1) * self.width]
        return Row(self.heap, self.columns, raw, raw[self.bits_at :])

    def slice(self, first: int, last: int) -> Iterator[tuple[int, Row]]:
        """Rows of the blocks from first to below last, as far as the index names them."""
        before = sum(self.per[:first])
        for b in range(first, min(last, len(self.per))):
            block = self.blocks[b]
            for k in range(self.per[b]):
                rid = struct.unpack_from("<I", block, k * self.width)[0]
                entry = self.heap.find(self.index, rid)
                if entry is not None and int.from_bytes(entry[:4], "little") == before + k:
                    yield rid, self.row(block, k)
            before += self.per[b]


def table_rows(store: Store, data: int, sub: int) -> list[tuple[int, Row]]:
    """Id and cells of each row, in the order of the rows."""
    t = Table(store, data, sub)
    starts = [0]
    for n in t.per:
        starts.append(starts[-1] + n)
    out = []
    for rid, raw in sorted(t.heap.tree(t.index), key=lambda x: x[1][::-1]):
        k = int.from_bytes(raw[:4], "little")
        b = bisect.bisect_right(starts, k) - 1
        if b < len(t.per):
            out.append((rid, t.row(t.blocks[b], k - starts[b])))
    return out
