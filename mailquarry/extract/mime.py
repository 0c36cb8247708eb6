"""Messages in Internet format."""

from __future__ import annotations

import email
import email.header
import email.policy

from .limits import Budget
from .plain import decode, html_text


def decode_words(s: str | None) -> str:
    """A header with its encoded words decoded."""
    if not s:
        return ""
    try:
        return str(email.header.make_header(email.header.decode_header(s)))
    except (LookupError, ValueError, UnicodeError):
        return s


def mime_text(data: bytes, budget: Budget, depth: int) -> str:
    from .dispatch import text_of

    out: list[str] = []

    def walk(part: email.message.Message, level: int) -> None:
        budget.entry()
        if part.get_content_maintype() == "multipart" or part.get_content_type() == "message/rfc822":
            inner = part.get_payload()
            if part.get_content_type() == "message/rfc822" and inner:
                out.append(decode_words(inner[0].get("Subject")))
            if level < 16 and isinstance(inner, list):
                for p in inner:
                    walk(p, level + 1)
            return
        body = part.get_payload(decode=True) or b""
        budget.spend(len(body))
        name = decode_words(part.get_filename())
        if name:
            out.append(name)
            if depth < budget.limits.depth:
                out.append(text_of(name, body, budget, depth + 1) or "")
        elif part.get_content_type() == "text/html":
            out.append(html_text(decode(body, part.get_content_charset())))
        elif part.get_content_maintype() == "text":
            out.append(decode(body, part.get_content_charset()))

    m = email.message_from_bytes(data)
    out += [decode_words(m.get(h)) for h in ("Subject", "From", "To", "Cc")]
    walk(m, 0)
    return "\n".join(x for x in out if x)
