"""Outlook message files: properties, recipients, attachments and embedded messages of a compound file."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from .ole import CompoundFile, Entry
from .plain import decode, html_text
from .rtf import decompress, rtf_html, rtf_text

EPOCH = datetime(1601, 1, 1, tzinfo=UTC)


@dataclass
class Recipient:
    kind: int  # 1 To, 2 Cc, 3 Bcc
    name: str | None
    email: str | None


@dataclass
class Attachment:
    name: str
    size: int
    content_id: str | None
    hidden: bool
    data: bytes | None
    message: Message | None = None

    @property
    def visible(self) -> bool:
        return not self.hidden and not self.content_id


@dataclass
class Message:
    subject: str | None = None
    sender_name: str | None = None
    sender_email: str | None = None
    message_class: str | None = None
    message_id: str | None = None
    in_reply_to: str | None = None
    references: str | None = None
    headers: str | None = None
    topic: str | None = None
    conv_key: str | None = None
    importance: int = 1
    flag_status: int = 0
    is_read: bool | None = None
    delivery: datetime | None = None
    submit: datetime | None = None
    created: datetime | None = None
    modified: datetime | None = None
    body: str | None = None
    html: str | None = None
    rtf: bytes | None = None
    recipients: list[Recipient] = field(default_factory=list)
    attachments: list[Attachment] = field(default_factory=list)

    @property
    def date(self) -> datetime | None:
        return self.delivery or self.submit or self.created

    def best_body(self) -> str:
        """Plain text, else the HTML's, else the RTF's."""
        if self.body and self.body.strip():
            return self.body
        if self.html and html_text(self.html):
            return html_text(self.html)
        return rtf_text(self.rtf) if self.rtf else ""


class Bag:
    """The properties of one storage: fixed ones in one stream, others a stream each."""

    def __init__(self, cf: CompoundFile, storage: Entry, header: int):
        self.cf, self.storage = cf, storage
        self.streams = {n.upper(): e for n, e in storage.children.items()}
        e = self.streams.get("__PROPERTIES_VERSION1.0")
        raw = cf.read(e)[header:] if e else b""
        self.fixed: dict[int, tuple[int, bytes]] = {}
        for i in range(0, len(raw) - 15, 16):
            tag = struct.unpack_from("<I", raw, i)[0]
            self.fixed[tag >> 16] = (tag & 0xFFFF, raw[i + 8 : i + 16])

    def binary(self, tag: int, kind: int = 0x0102) -> bytes | None:
        e = self.streams.get(f"__SUBSTG1.0_{tag:04X}{kind:04X}")
        return self.cf.read(e) if e and e.kind == 2 else None

    def text(self, tag: int) -> str | None:
        wide = self.binary(tag, 0x001F)
        if wide is not None:
            s = wide.decode("utf-16-le", "replace")
        else:
            narrow = self.binary(tag, 0x001E)
            if narrow is None:
                return None
            s = decode(narrow, f"cp{self.number(0x3FFD) or 1252}")
        return s.rstrip("\0")

    def clean(self, tag: int) -> str | None:
        s = self.text(tag)
        s = "".join(c for c in s if c >= " ").strip() if s else None
        return s or None

    def number(self, tag: int) -> int | None:
        kind, raw = self.fixed.get(tag, (0, b""))
        return struct.unpack("<i", raw[:4])[0] if kind == 0x0003 else int(raw[0] != 0) if kind == 0x000B else None

    def time(self, tag: int) -> datetime | None:
        kind, raw = self.fixed.get(tag, (0, b""))
        ticks = struct.unpack("<Q", raw)[0] if kind == 0x0040 else 0
        try:
            return EPOCH + timedelta(microseconds=ticks // 10) if ticks else None
        except OverflowError:
            return None

    def below(self, prefix: str) -> list[Entry]:
        return [e for n, e in sorted(self.streams.items()) if n.startswith(prefix) and e.kind == 1]


def _address(*candidates: str | None) -> str | None:
    return next((c for c in candidates if c and "@" in c and not c.lower().startswith("/o=")), None)


def from_properties(p, bodies: bool = True) -> Message:
    """A message without recipients and attachments, of any bag of properties; its bodies are read only if asked for."""
    index = p.binary(0x0071)
    flags = p.number(0x0E07)
    page = p.binary(0x1013) if bodies else None
    subject = p.clean(0x0037)
    m = Message(
        subject=subject,
        sender_name=p.clean(0x0042) or p.clean(0x0C1A),
        sender_email=_address(p.clean(0x5D02), p.clean(0x5D01), p.clean(0x0065), p.clean(0x0C1F)),
        message_class=p.clean(0x001A),
        message_id=p.clean(0x1035),
        in_reply_to=p.clean(0x1042),
        references=p.clean(0x1039),
        headers=p.text(0x007D),
        topic=p.clean(0x0070),
        conv_key=index[:22].hex().upper() if index and len(index) >= 22 else None,
        importance=1 if p.number(0x0017) is None else p.number(0x0017),
        flag_status=p.number(0x1090) or 0,
        is_read=None if flags is None else bool(flags & 1),
        delivery=p.time(0x0E06),
        submit=p.time(0x0039),
        created=p.time(0x3007),
        modified=p.time(0x3008),
    )
    if not bodies:
        return m
    m.body = p.text(0x1000)
    m.html = decode(page, f"cp{p.number(0x3FDE)}" if p.number(0x3FDE) else None) if page else p.text(0x1013)
    packed = p.binary(0x1009)
    if packed:
        m.rtf = decompress(packed)
        m.html = m.html or rtf_html(m.rtf)
    return m


def recipient_of(r) -> Recipient | None:
    kind = r.number(0x0C15)
    return Recipient(kind, r.clean(0x3001), _address(r.clean(0x39FE), r.clean(0x3003))) if kind in (1, 2, 3) else None


def attachment_of(a, place: int, embedded: bool) -> Attachment:
    name = a.clean(0x3707) or a.clean(0x3704) or a.clean(0x3001) or ("message.msg" if embedded else f"piece-jointe-{place + 1}")
    data = None if embedded else a.binary(0x3701)
    return Attachment(name, len(data or b"") or a.number(0x0E20) or 0, a.clean(0x3712), bool(a.number(0x7FFE)), data)


def parse_message(cf: CompoundFile, storage: Entry, depth: int, header: int = 32) -> Message:
    """A message and, as far as depth allows, the messages embedded in it."""
    p = Bag(cf, storage, header)
    m = from_properties(p)
    m.recipients = [r for e in p.below("__RECIP_VERSION1.0_") if (r := recipient_of(Bag(cf, e, 8)))]
    for k, e in enumerate(p.below("__ATTACH_VERSION1.0_")):
        a = Bag(cf, e, 8)
        inner = next((c for n, c in a.streams.items() if n.startswith("__SUBSTG1.0_3701000D")), None)
        embedded = a.number(0x3705) == 5 and inner is not None
        own = attachment_of(a, k, embedded)
        if embedded and depth > 0:
            own.message = parse_message(cf, inner, depth - 1, 24)
        m.attachments.append(own)
    return m


def read_message(data: bytes, depth: int = 5) -> Message:
    cf = CompoundFile(data)
    return parse_message(cf, cf.root, depth)
