"""The trie against one built turn by turn, and its parts on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from mailquarry.llm import convtrie

FIELDS = "conv_id long, turn long, role string, text string, TURN_ string, size int"


def brute(rows):
    convs: dict = {}
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            convs.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (*x[:2], x[2].encode(), x[3].encode()))] for c, v in convs.items()}
    whole = {}
    for c, turns in own.items():
        base = c - int(np.fmod(c, 5))
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members: dict = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children: dict = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[x] for x in below) or 1
        saved[path] = sum(saved[x] for x in below) + (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
    ends = {p: ",".join(map(str, sorted(c for c in m if whole[c] == p))) for p, m in members.items()}
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()]


def corpus(n, seed, length=9):
    """Conversations over few texts, some equal, some starting with another, some very long."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-n // 3, 3 * n), n):
        k = rng.choice([0, 1, 2, 3, length, length])
        texts = rng.choices(["a", "b", "ä", "", None], [6, 2, 1, 1, 1], k=k)
        rows += [(c, rng.choice([t, t, t, None, 0]), rng.choice(["user", "user", None, "x"]), x, "y", 1) for t, x in enumerate(texts)]
    for c in (5, 6, 7, 10**12):
        rows += [(c, t, "user", f"long {t % 7}", "y", 1) for t in range(300 if c != 6 else 180)]
    rows += [(None, 1, "user", "a", "y", 1)] * 3
    return rows


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize(("n", "block", "blocks", "depths"), [(60, 4096, 1 << 16, 4096), (400, 7, 1 << 16, 50), (90, 1, 1 << 16, 3), (150, 3, 9, 4096)])
def test_matches_brute_force(spark, monkeypatch, n, block, blocks, depths):
    for name, value in {"BLOCK": block, "BLOCKS": blocks, "DEPTHS": depths, "IDS": 3, "FIRST": 4}.items():
        monkeypatch.setattr(convtrie, name, value)
    rows = corpus(n, n)
    got = convtrie.trie(spark.createDataFrame(rows, FIELDS).repartition(3))
    assert order(got.collect()) == order(brute(rows))


@pytest.mark.parametrize("rows", [[], [(3, 1, "user", "a", "", 0)], [(0, None, None, None, "", 0)] * 5, [(None, 1, "u", "t", "", 0)], [(c, t, "u", "same", "", 0) for c in range(40) for t in range(5)]])
def test_odd_tables(spark, rows):
    assert order(convtrie.trie(spark.createDataFrame(rows, FIELDS)).collect()) == order(brute(rows))


def test_turnless(spark):
    """A conversation whose own turns are all replaced by those of a base that isn't there has none."""
    c = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    got = convtrie.trie(spark.createDataFrame([(c, t, "u", "x", "", 0) for t in range(2)], FIELDS)).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_walk_finds_nearest_smaller():
    rng = random.Random(4)
    for _ in range(300):
        v = [rng.randint(-1, 4) for _ in range(rng.randint(1, 30))]
        left, right, group, heads, tails = convtrie.walk(v)
        for k, x in enumerate(v):
            below = [j for j in range(k) if v[j] < x]
            above = [j for j in range(k + 1, len(v)) if v[j] < x]
            g = group[k]
            assert (left[g], right[g]) == (below[-1] if below else -1, above[0] if above else -1)
            assert g == next(j for j in range(left[g] + 1, len(v)) if v[j] == x)
        assert heads == [k for k, x in enumerate(v) if all(y > x for y in v[:k])]
        assert tails == [k for k, x in enumerate(v) if all(y > x for y in v[k + 1 :])]


def test_least():
    values = np.random.default_rng(1).integers(0, 99, 77)
    least = convtrie.Least(values)
    a, z = map(np.array, zip(*((i, j) for i in range(77) for j in range(i + 1, 78)), strict=True))
    assert least.of(a, z).tolist() == [values[i:j].min() for i, j in zip(a, z, strict=True)]


def test_conversation_with_most_rows_is_spread(spark):
    """Positions of one conversation's turns are counted over several files."""
    rows = [(1, t, "u", str(t), "", 0) for t in range(5000)] + [(2, 0, "u", "x", "", 0)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one file
    try:
        turns = convtrie.turns_of(spark.createDataFrame(rows, FIELDS).repartition(4)).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(turns) == 5001 and sorted(turns[turns.conv_id == 1].pos) == list(range(1, 5001))
    assert (turns["at"] // 2**33).nunique() > 1
