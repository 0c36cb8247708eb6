"""What one attachment may cost."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

#: What a batch of results of files or texts may hold: bytes (beyond them with one row only) and rows.
PIECE_BYTES, PIECE_ROWS = 4 << 20, 500


def pieces(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """rows in lists of about PIECE_BYTES, so that a task holds few results at once, however many rows a batch of its input has."""
    out: list[tuple] = []
    held = 0
    for row in rows:
        own = sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if out and (held + own > PIECE_BYTES or len(out) == PIECE_ROWS):
            yield out
            out, held = [], 0
        out.append(row)
        held += own
    if out:
        yield out


@dataclass(frozen=True)
class Limits:
    file_bytes: int = 50 << 20
    text_chars: int = 4_000_000
    depth: int = 3
    entries: int = 5000
    entry_bytes: int = 50 << 20
    total_bytes: int = 200 << 20


class Encrypted(Exception):
    """The file needs a password."""


class TooMuch(Exception):
    """The file goes beyond the limits."""


@dataclass
class Budget:
    """Counts over one attachment and all that it contains."""

    limits: Limits = field(default_factory=Limits)
    entries: int = 0
    total: int = 0

    def entry(self) -> None:
        self.entries += 1
        if self.entries > self.limits.entries:
            raise TooMuch(f"more than {self.limits.entries} entries")

    def spend(self, n: int) -> None:
        self.total += n
        if self.total > self.limits.total_bytes:
            raise TooMuch(f"more than {self.limits.total_bytes} bytes unpacked")
