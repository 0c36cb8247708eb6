import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from mailquarry.llm import packing


@pytest.fixture(scope="module")
def encode():
    return packing.CachedTokenizer(packing.default_vocabulary())


TEXTS = ["", None, "Hello World", "it's we'll THEY'RE x'dre 'S", "é É ß œ ª µ º × ÷ ² 12½", "tab\tnew\nline\r\x0b\x0cend", "a\x1cb\x1db", "\x85nb\xa0sp", "İstanbul ΣΑΣ й ё", "日本語 テスト",
         "é combining", "<|endoftext|> and <|startoftext|>", "a<|b", "don''t... !!?? --- 3.14", "x" * 3000, "\x00\x01\x7f", "_under_score_", "😀 emoji"]


def test_ids_are_the_librarys(encode):
    rng = random.Random(1)
    pool = [c for c in map(chr, range(0x250))] + list("  etaoin'srl.,") * 20
    texts = TEXTS + ["".join(rng.choices(pool, k=200)) for _ in range(300)]
    for text, got in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == encode.library.encode(text or "", add_special_tokens=False).ids, text


def verify(rows, tokens, window):
    """rows hold each document's ids once, in windows without gaps."""
    docs, windows = defaultdict(list), defaultdict(list)
    for doc_id, start, length, crc, total, seq, offset in rows:
        docs[doc_id].append((start, length, crc, total))
        windows[seq].append((offset, length))
    assert set(docs) == set(tokens)
    for d, pieces in docs.items():
        at = 0
        for start, length, crc, total in sorted(pieces):
            assert start == at and total == len(tokens[d]) and length > 0
            assert crc == zlib.crc32(np.array(tokens[d][start : start + length], "<u4").tobytes())
            at += length
        assert at == len(tokens[d])
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window and (at == window or at & (at - 1) == 0)


@pytest.mark.parametrize("limit", [2, 5, 1024])
def test_packer(limit):
    rng = random.Random(limit)
    p = packing.Packer(64, limit, 7)
    tokens = {}
    for d in range(500):
        tokens[d] = [rng.randrange(49000) for _ in range(rng.choice([1, 3, 20, 40, 63, 64, 65, 300]))]
        p.add(d, np.array(tokens[d], "<u4").tobytes())
        assert p.open <= limit and p.open == p.count.sum()
    p.finish()
    verify(p.rows, tokens, 64)


def test_pack(spark, encode):
    texts = [*TEXTS, "word " * 9000]
    df = spark.createDataFrame([(t, i, "x") for i, t in enumerate(texts)], "text string, doc_id long, Text_ string").repartition(3)
    tokens = {i: [*encode.library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    verify([tuple(r) for r in packing.pack(df).collect()], tokens, 4096)


def test_empty_null_and_repeated(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, "a b"), (1, None), (1, None)], "doc_id long, text string")).collect()
    assert sum(r.length for r in rows) == 5


def test_placement_matches_brute_force():
    """Each tail goes to the fill level with the smallest sum of squares, found by trying them all; the fullest of equals."""
    rng = random.Random(5)
    window, p, levels = 32, packing.Packer(32, 10**9), {}

    def squares(counts):
        return sum(n * n for n in counts.values())

    for d in range(800):
        size = rng.choice([1, 2, 3, 5, 8, 13, 21, 31])
        best = None
        for level in sorted([0, *(k for k, n in levels.items() if n and k + size <= window)], reverse=True):
            after = dict(levels)
            if level:
                after[level] -= 1
            if level + size < window:
                after[level + size] = after.get(level + size, 0) + 1
            if best is None or squares(after) < squares(best):
                best = after
        levels = best
        p.add(d, np.zeros(size, "<u4").tobytes())
        assert {k: n for k, n in levels.items() if n} == {int(k): int(p.count[k]) for k in np.flatnonzero(p.count)}
