"""Bit-sliced Hamming search: one Python integer holds one bit of many fingerprints, a lane each."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np


def planes_of(rows: np.ndarray) -> list[int]:
    """Bit planes of an (n, words) array of unsigned 64-bit fingerprints; lane i of each plane is row i."""
    bits = np.unpackbits(np.ascontiguousarray(rows, dtype="<u8").view(np.uint8), axis=1, bitorder="little")
    packed = np.packbits(bits, axis=0, bitorder="little")
    return [int.from_bytes(packed[:, k].tobytes(), "little") for k in range(packed.shape[1])]


def within(differ: Iterable[int], lanes: int, radius: int) -> int:
    """The lanes with at most radius set bits over all planes of differ.

    Distances are counted in vertical counters that start so that the first count above the radius
    overflows. Planes go in two at a time through a carry-save adder; an overflow takes its lane out, and
    the block is abandoned once no lane is left.
    """
    size = max(1, radius.bit_length())
    start = (1 << size) - 1 - radius
    count = [lanes if start >> j & 1 else 0 for j in range(size)]
    planes = iter(differ)
    for a in planes:
        b = next(planes, 0)
        either = a ^ b
        ones = count[0]
        carry = (a & b) | (ones & either)
        count[0] = ones ^ either
        for j in range(1, size):
            if not carry:
                break
            held = count[j]
            count[j] = held ^ carry
            carry &= held
        if carry:
            lanes &= ~carry
            if not lanes:
                return 0
    return lanes


def lanes_set(lanes: int) -> Iterator[int]:
    while lanes:
        low = lanes & -lanes
        yield low.bit_length() - 1
        lanes ^= low


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


#: Buckets above this size are searched from a few rows first, so that dense groups leave; smaller ones are compared at once.
SMALL = 48

#: Rows that start a search in vain, in a row, after which the rest of a bucket is compared at once.
VAIN = 8


def link_buckets(bucket: np.ndarray, rows: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs (i, root) that span, within each bucket, the same components as all pairs within the radius.

    bucket: the bucket of each row, equal ones together. At shift s every row meets the row s places on, one lane
    a row, for all buckets at once. Out of large buckets dense groups are taken first, breadth first, where a row that
    has been reached leaves the lanes, so such a group costs little more than its size; what is left of the bucket
    then goes by shifts: about 12 microseconds a row in buckets of 200, growing in proportion to the bucket.
    """
    n = len(bucket)
    if n < 2:
        return []
    edges = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    starts = np.concatenate(([0], edges))
    sizes = np.diff(np.concatenate((starts, [n])))
    forest = Forest(n)
    left = np.repeat(sizes > 1, sizes)
    for at, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        left[at : at + size] = _searched(rows[at : at + size], radius, at, forest)
    # buckets of like size go together, so a large one doesn't lengthen the shifts of all
    kept = np.add.reduceat(left, starts)
    order = np.repeat(kept.astype(float).clip(1), sizes)
    for low, high in ((2, 8), (9, 64), (65, 512), (513, n)):
        keep = np.flatnonzero(left & (order >= low) & (order <= high))
        if len(keep):
            _shifted(bucket[keep], rows[keep], radius, keep, forest, int(order[keep].max()))
    return [(i, r) for i in range(n) if (r := forest.root(i)) != i]


def _shifted(bucket: np.ndarray, rows: np.ndarray, radius: int, names: np.ndarray, forest: Forest, most: int) -> None:
    planes = planes_of(rows)
    for s in range(1, most):
        same = bucket[s:] == bucket[:-s]
        if not same.any():
            break
        lanes = int.from_bytes(np.packbits(same, bitorder="little").tobytes(), "little")
        for i in lanes_set(within(((p ^ (p >> s)) & lanes for p in planes), lanes, radius)):
            forest.join(int(names[i]), int(names[i + s]))


def _searched(rows: np.ndarray, radius: int, base: int, forest: Forest) -> np.ndarray:
    """Takes whole components out, one after the other; after VAIN single rows in a row, says which rows are left to compare."""
    left = np.arange(len(rows))  # lane k is row left[k]
    planes, alive, built, vain = planes_of(rows), (1 << len(rows)) - 1, len(rows), 0
    while alive and vain < VAIN:
        low = (alive & -alive).bit_length() - 1
        alive &= alive - 1
        queue, alone = [int(left[low])], True
        while queue and alive:
            count = alive.bit_count()
            if 2 * count < built:  # half are gone: pack the lanes anew
                left = left[_lanes(alive, len(left))]
                planes, alive, built = planes_of(rows[left]), (1 << count) - 1, count
            q = queue.pop()
            bits = int.from_bytes(np.ascontiguousarray(rows[q], dtype="<u8").tobytes(), "little")
            found = within(((alive & ~p) if bits >> k & 1 else (p & alive) for k, p in enumerate(planes)), alive, radius)
            if found:
                alone = False
                alive &= ~found
                for i in np.flatnonzero(_lanes(found, len(left))).tolist():
                    forest.join(base + q, base + int(left[i]))
                    queue.append(int(left[i]))
        vain = vain + 1 if alone else 0
    out = np.zeros(len(rows), bool)
    out[left[_lanes(alive, len(left))]] = True
    return out


def _lanes(lanes: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(lanes.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n].astype(bool)
