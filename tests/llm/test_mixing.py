"""The mix against a version that follows the rule document by document, and its properties on odd rows."""

import random
import re
import struct

import pytest
import xxhash
from mailquarry.llm import mixing

FIELDS = "doc_id long, text string, source string, TEXT_ string, taken int"


def spark_hash(*values):
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<i" if isinstance(v, Int) else "<q", v), h)
    return h - (1 << 64) if h >> 63 else h


class Int(int):
    """A number that Spark hashes as an integer of four bytes."""


def coin(a, b, seed):
    return (spark_hash(a, b, Int(seed)) & ((1 << 53) - 1)) / float(1 << 53)


def water(sizes, weights, share, most):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= most * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: most * sizes[s] for s in over}
        free -= over
    return out


def meet(held, x, seed, won):
    whole = lambda d: d[4] << mixing.POINT
    up, down = min(whole(held) - held[5], x[5]), min(held[5], whole(x) - x[5])
    m = up if coin(held[0], x[0], seed) * (up + down) < down else -down
    rest = []
    for d, mass in ((held, held[5] + m), (x, x[5] - m)):
        if mass in (0, whole(d)):
            won[d[1:5]] = mass > 0
        else:
            rest.append((*d[:5], mass))
    return rest[0] if rest else None


def brute(rows, weights=mixing.WEIGHTS, share=mixing.SHARE, most=mixing.MOST, seed=0):
    """doc_id, size, source_size, target and taken of each row."""
    docs = [(d, xxhash.xxh64_intdigest((t or "").encode(), 42) if t is not None else 42, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s, *_ in rows]
    docs = [(d, m - (1 << 64) if m >> 63 else m, s, n) for d, m, s, n in docs]
    sizes = {}
    for _, _, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    goal = water(sizes, weights, share, most)
    out = []
    for source in sizes:
        seen, items, won, own = {}, [], {}, []
        filled = sum(1 for d in docs if d[2] == source and d[3])
        rate = goal[source] / max(1, sizes[source])
        for d, m, s, n in docs:
            if s == source:
                k = seen[d, m] = seen.get((d, m), 0) + 1
                own.append((d, m, k, n))
                mass = int((rate - int(rate)) * (n << mixing.POINT))
                if mass:
                    items.append((spark_hash(d, m, k, Int(seed)), d, m, k, n, mass))
        nodes, depth = -(-filled // mixing.FAN), 0
        placed = [(x[0] % nodes, x) for x in items]
        while nodes:
            left = []
            for node in {p for p, _ in placed}:
                held = None
                for x in sorted((x for p, x in placed if p == node), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2:])):
                    held = meet(held, x, seed + depth, won) if held else x
                if held:
                    left.append((node // mixing.FAN, held))
            placed, depth = left, depth + 1
            if nodes == 1:
                break
            nodes = -(-nodes // mixing.FAN)
        for _, x in placed:
            won[x[1:5]] = x[5] * 2 >= x[4] << mixing.POINT
        out += [(d, n, sizes[source], goal[source], n * (int(rate) + won.get((d, m, k, n), False)) if n else 0) for d, m, k, n in own]
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["big"] * 6 + ["a", "b", "é", None])
        text = rng.choice(["x  y\tz", " ".join(["w"] * rng.randint(1, 60)), None, "", " \n ", "one\x0btwo three"]) if i % 3 else " ".join(["w"] * int(rng.paretovariate(0.8) * 5 % 3000 + 1))
        rows.append((rng.choice([i, i, i, None, 7]), text, source, "x", 1))
    return rows


@pytest.mark.parametrize("n", [1, 40, 1500])
def test_matches_brute_force(spark, n):
    rows = corpus(n, n)
    plan = mixing.mix(spark.createDataFrame(rows, FIELDS).repartition(3))
    got = order((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in plan.collect())
    want = order(brute(rows))
    assert [(g[:3], g[4]) for g in got] == [(w[:3], w[4]) for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_sources_come_near_their_targets(spark):
    rows = corpus(1500, 5)
    got = mixing.mix(spark.createDataFrame(rows, FIELDS)).collect()
    assert len(got) == len(rows)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own) / 2 + 1
        assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in own)
        rate = own[0].target / own[0].source_size
        assert all(abs(r.copies - rate) < 1 for r in own if r["size"])
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))


def test_expectation_is_the_rate():
    """Over many seeds a document is taken as often as its source's rate says, whatever its length; brute() is the same rule."""
    rows = [(i, "w " * (1 + i % 7 * 5), s, "", 0) for i in range(60) for s in ("a", "b")]
    copies: dict = {}
    for seed in range(200):
        for _, size, total, target, taken in brute(rows, (5, 1), 1.0, 2, seed):
            copies.setdefault((target / total, size), []).append(taken / size)
    for (rate, _), own in copies.items():
        assert sum(own) / len(own) == pytest.approx(rate, abs=0.05)


def test_odd_tables(spark):
    empty = mixing.mix(spark.createDataFrame([], FIELDS))
    assert empty.count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, None, "a", "", 0), (None, " ", None, "", 0)], FIELDS)).collect()
    assert sorted((r["size"], r.target, r.taken) for r in blank) == [(0, 0.0, 0)] * 2
    long = mixing.mix(spark.createDataFrame([(1, "word " * 2_000_000, "a", "", 0), (2, "a b", "a", "", 0)], FIELDS)).collect()
    assert sorted(r["size"] for r in long) == [2, 2_000_000]
    hot = mixing.mix(spark.createDataFrame([(1, "a b c", "a", "", 0)] * 3000 + [(2, "a b c", "b", "", 0)] * 3000, FIELDS), (2, 1), 1.0).collect()
    assert len(hot) == 6000 and {s: sum(r.taken for r in hot if r.source == s) for s in "ab"} == {"a": 12000, "b": 6000}


def test_mixed_rows(spark):
    docs = spark.createDataFrame(corpus(300, 2), FIELDS)
    plan = mixing.mix(docs)
    out = mixing.mixed(docs, plan)
    assert out.columns == docs.columns
    count = lambda df, *c: {tuple(r[:-1]): r[-1] for r in df.collect()}
    assert count(out.groupBy("doc_id", "source").count()) == {k: v for k, v in count(plan.groupBy("doc_id", "source").agg({"copies": "sum"})).items() if v}


def test_reruns_agree(spark, tmp_path):
    spark.createDataFrame(corpus(400, 9), FIELDS).select("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    once, again = (order(tuple(r) for r in mixing.op12_source_mixing(spark, str(tmp_path)).collect()) for _ in range(2))
    assert once == again
