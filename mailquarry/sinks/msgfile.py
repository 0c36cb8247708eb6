"""Writes compound files and Outlook message files, for exchange and for tests of their readers."""

from __future__ import annotations

import struct
from datetime import UTC, datetime

FREE, END, FATSECT, DIFSECT = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC


def compound(tree: dict) -> bytes:
    """tree: names to bytes (streams) or dicts (storages). Short streams go to the mini stream."""
    entries = [["Root Entry", 5, END, 0, FREE, FREE, FREE]]
    mini, minifat, big = bytearray(), [], []

    def add(children: dict) -> int:
        first = FREE
        for name, value in reversed(list(children.items())):
            i = len(entries)
            e = [name, 1 if isinstance(value, dict) else 2, END, 0, FREE, first, FREE]
            entries.append(e)
            first = i
            if isinstance(value, dict):
                e[6] = add(value)
            elif value:
                e[3] = len(value)
                if len(value) < 4096:
                    n = -(-len(value) // 64)
                    e[2] = len(minifat)
                    minifat.extend([*range(len(minifat) + 1, len(minifat) + n), END])
                    mini.extend(value.ljust(64 * n, b"\0"))
                else:
                    big.append((e, value))
        return first

    entries[0][6] = add(tree)
    sectors, fat = [], []

    def put(data: bytes) -> int:
        if not data:
            return END
        start, n = len(sectors), -(-len(data) // 512)
        for k in range(n):
            sectors.append(data[512 * k : 512 * k + 512].ljust(512, b"\0"))
            fat.append(len(fat) + 1)
        fat[-1] = END
        return start

    for e, value in big:
        e[2] = put(value)
    entries[0][2], entries[0][3] = put(bytes(mini)), len(mini)
    mf = put(struct.pack(f"<{len(minifat)}I", *minifat).ljust(-(-len(minifat) // 128) * 512, b"\xff")) if minifat else END
    raw = b""
    for name, kind, start, size, left, right, child in entries:
        n = (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0")
        raw += n + struct.pack("<HBB3I", 2 * len(name) + 2, kind, 1, left, right, child) + bytes(36) + struct.pack("<IQ", start, size)
    directory = put(raw)
    count, more = 1, 0
    while (len(sectors) + count + more) > 128 * count:
        count += 1
        more = -(-max(0, count - 109) // 127)  # places of table sectors beyond the header's 109 are in sectors of their own
    where = list(range(len(sectors), len(sectors) + count))
    chain = list(range(len(sectors) + count, len(sectors) + count + more))
    full = fat + [FATSECT] * count + [DIFSECT] * more
    data = struct.pack(f"<{len(full)}I", *full).ljust(512 * count, b"\xff")
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<IIIIIIIII", 0, count, directory, 0, 4096, mf, -(-len(minifat) // 128), chain[0] if chain else END, more)
    head += struct.pack("<109I", *(where[:109] + [FREE] * (109 - len(where))))
    for k in range(more):
        part = where[109 + 127 * k : 236 + 127 * k]
        data += struct.pack("<128I", *part, *[FREE] * (127 - len(part)), chain[k + 1] if k + 1 < more else END)
    return b"".join([head, *sectors, data])


def properties(fixed: dict, header: int) -> bytes:
    out = bytes(header)
    for tag, value in fixed.items():
        if isinstance(value, datetime):
            raw, kind = struct.pack("<Q", round((value - datetime(1601, 1, 1, tzinfo=UTC)).total_seconds()) * 10_000_000), 0x40
        elif isinstance(value, bool):
            raw, kind = struct.pack("<Q", int(value)), 0x0B
        else:
            raw, kind = struct.pack("<iI", value, 0), 0x03
        out += struct.pack("<II", tag << 16 | kind, 6) + raw
    return out


def storage(values: dict, header: int) -> dict:
    """values: property tags to text, bytes, numbers, booleans or times."""
    fixed = {t: v for t, v in values.items() if not isinstance(v, (str, bytes))}
    out = {"__properties_version1.0": properties(fixed, header)}
    for t, v in values.items():
        if isinstance(v, str):
            out[f"__substg1.0_{t:04X}001F"] = v.encode("utf-16-le")
        elif isinstance(v, bytes):
            out[f"__substg1.0_{t:04X}0102"] = v
    return out


def message_tree(values: dict, recipients=(), attachments=(), header: int = 32) -> dict:
    """recipients: (kind, name, address); attachments: (name, bytes) or (name, tree of a message)."""
    out = storage(values, header)
    for k, (kind, name, mail) in enumerate(recipients):
        out[f"__recip_version1.0_#{k:08X}"] = storage({0x0C15: kind, 0x3001: name, 0x39FE: mail}, 8)
    for k, (name, data) in enumerate(attachments):
        if isinstance(data, dict):
            own = storage({0x3707: name, 0x3705: 5}, 8)
            own["__substg1.0_3701000D"] = data
        else:
            own = storage({0x3707: name, 0x3705: 1, 0x3701: data}, 8)
        out[f"__attach_version1.0_#{k:08X}"] = own
    return out
