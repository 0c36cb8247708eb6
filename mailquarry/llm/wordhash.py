"""64-bit hashes of the words of many texts at once, and of runs of words.

All words of a block of text are hashed together: differences of one running polynomial, shifted back to the word's
start. A longer text is cut between words; a word longer than a block is hashed by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of text that are hashed at a time.
BLOCK = 1 << 17

_BASE = 0x9E3779B97F4A7C15 | 1
_power_cache: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    if not _power_cache or len(_power_cache[0]) < n:
        with np.errstate(over="ignore"):
            _power_cache[:] = [np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64).cumprod(dtype=np.uint64))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _power_cache


def mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class Words:
    """Words are the longest runs of the bytes that `inside` (a table of 256 truth values) names."""

    def __init__(self, inside: np.ndarray):
        self.inside = inside
        own = b"".join(re.escape(bytes([c])) for c in np.flatnonzero(inside).tolist())
        self.run = re.compile(b"[" + own + b"]+")

    def hashed(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each word of data (at most BLOCK bytes, or one longer word) and where it starts."""
        if len(data) > BLOCK:
            return np.array([xxhash.xxh64_intdigest(data)], np.uint64), np.zeros(1, np.int64)
        up, down = _powers(BLOCK + 1)
        b = np.frombuffer(data, np.uint8)
        inside = self.inside[b]
        edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        with np.errstate(over="ignore"):
            run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)))
            return mix((run[ends] - run[starts]) * down[starts]), starts

    def _parts(self, text: bytes) -> Iterator[bytes]:
        at = 0
        while at < len(text):
            end = min(len(text), at + BLOCK)
            if end < len(text):
                gaps = np.flatnonzero(~self.inside[np.frombuffer(text, np.uint8, end - at, at)])
                end = at + int(gaps[-1]) + 1 if len(gaps) else self.run.match(text, at).end()
            yield text[at:end]
            at = end

    def of(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """The number of each text and the hashes of its words, in order. Short texts share a block; a line feed, which
        mustn't be part of words, keeps them apart."""
        own, size = [], 0

        def block() -> Iterator[tuple[int, np.ndarray]]:
            hashes, starts = self.hashed(b"\n".join(texts[j] for j in own))
            begin = np.concatenate(([0], np.cumsum([len(texts[j]) + 1 for j in own])))
            first = np.searchsorted(starts, begin).tolist()
            yield from ((j, hashes[a:z]) for j, a, z in zip(own, first[:-1], first[1:], strict=True))

        for j, text in enumerate(texts):
            if own and size + len(text) + 1 > BLOCK:
                yield from block()
                own, size = [], 0
            if len(text) >= BLOCK:
                yield j, np.concatenate([self.hashed(p)[0] for p in self._parts(text)])
            else:
                own.append(j)
                size += len(text) + 1
        if own:
            yield from block()


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width words; none if there are fewer."""
    n = max(0, len(hashes) - width + 1)
    with np.errstate(over="ignore"):
        g = hashes[:n].copy()
        for k in range(1, width):
            g = g * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[k : n + k]
    return mix(g)
