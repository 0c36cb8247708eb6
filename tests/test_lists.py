"""Lists of postings against counting, for stretches, shards and messages of several rows."""

import random
import uuid

import pyarrow as pa
import pytest
from mailquarry.operators import lists
from mailquarry.operators.lists import NAMES, SCHEMA, entries, postings_of
from mailquarry.operators.segments import SearchIndex

WEIGHTS = [5.0, 1.0]
WORDS = ["alpha", "beta", "béta", "the", "the", "of"]


def batches(rows, size):
    names = ["shard", "id", "unit", "t0", "t1"]
    types = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for k in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + size], strict=True), types, strict=True)], names=names)


def counted(rows):
    """(token, shard, id) to tokens of the message, counts a field and places field by field."""
    tokens, out = {}, {}
    for s, i, _, *texts in rows:
        tokens[s, i] = tokens.get((s, i), 0) + sum(len(t.split()) for t in texts)
        out.setdefault(("", s, i), ([0, 0], [[], []]))
        for k, t in enumerate(texts):
            for place, w in enumerate(t.split()):
                n, at = out.setdefault((w, s, i), ([0, 0], [[], []]))
                n[k] += 1
                at[k].append(place)
    return {key: (tokens[key[1:]], n, at[0] + at[1]) for key, (n, at) in out.items()}


def unpacked(found):
    """The same of lists; rows of a list must come by id, within their bounds and without overlap."""
    out, last = {}, {}
    for b in found:
        assert b.schema.names == NAMES
        for r in b.to_pylist():
            assert 1 <= len(r["ids"]) <= 3 and r["initial"] == r["token"][:1] and r["least"] == min(r["lengths"])
            key = r["token"], r["shard"]
            assert r["ids"] == sorted(r["ids"]) and r["ids"][0] > last.get(key, -1)
            last[key] = r["ids"][-1]
            counts = [r["counts"][k : k + 2] for k in range(0, len(r["counts"]), 2)]
            assert r["most"] == max(5 * a + b for a, b in counts)
            for i, n, c, a, z in zip(r["ids"], r["lengths"], counts, [0, *r["ends"]], r["ends"], strict=False):
                assert (*key, i) not in out
                out[*key, i] = (n, c, r["places"][a:z])
    return out


@pytest.mark.parametrize("size, text", [(1, 1 << 20), (7, 60), (1000, 1 << 20), (1000, 1)])
def test_lists_of_stretches(monkeypatch, size, text):
    """Wherever batches and stretches end, each token of each message is listed once; a message may have several rows, or no token."""
    monkeypatch.setattr(lists, "TEXT", text)
    rng = random.Random(size)
    words = lambda n: " ".join(rng.choices(WORDS, k=rng.randint(0, n)))
    rows = [(s, i, None, words(2), words(9)) for s in range(3) for i in range(s, 60, 3) for _ in range(1 + (i % 11 == 0))]
    assert unpacked(lists._inverting(WEIGHTS, 3)(batches(rows, size))) == counted(rows)
    # two indices of messages by turns, woven into one
    halves = [[r for r in rows if r[1] % 2 == k] for k in range(2)]
    parts = [pa.Table.from_batches(list(lists._inverting(WEIGHTS, 3)(batches(h, size)))) for h in halves]
    both = sorted(pa.concat_tables(parts).to_pylist(), key=lambda r: (r["token"], r["shard"], r["ids"][0]))
    table = pa.Table.from_pylist(both, schema=parts[0].schema)
    assert unpacked(lists._weaving(WEIGHTS, 3)(table.to_batches(size))) == counted(rows)
    assert list(lists._inverting(WEIGHTS, 3)(iter([]))) == [] and list(lists._weaving(WEIGHTS, 3)(iter([]))) == []


def test_entries_of_lists(spark):
    rows = [("t", "the", 0, 1.0, 3, [1, 2], None, [3, 4], [1, 0, 1, 2], [1, 4], [0, 1, 5, 7]), ("", "", 0, 0.0, 3, [1, 2], ["x", None], [3, 4], [0, 0, 0, 0], [0, 0], [])]
    own = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.token, r.id, r.unit, r.tokens, r.n, r.places) for r in entries(own, 2).collect()) == [("", 1, "x", 3, [0, 0], []), ("", 2, "", 4, [0, 0], []), ("the", 1, "", 3, [1, 0], [0]), ("the", 2, "", 4, [1, 2], [1, 5, 7])]
    assert sorted((r.id, r.field, r.places) for r in postings_of(own, ["a", "b"]).collect()) == [(1, "a", [0]), (2, "a", [1]), (2, "b", [5, 7])]


def test_an_index_holds_lists(spark, tmp_path):
    """What is shuffled and written is lists: far fewer rows than there are pairs of a token and a message."""
    rows = spark.range(2000).selectExpr("id", "'the end' AS subject", "concat('the of ', id % 5) AS body")
    index = SearchIndex(spark, f"{tmp_path}/index-{uuid.uuid4().hex}", shards=2)
    segment = index.add(rows).segments[0]
    kept = spark.read.parquet(*(str(p) for p in (tmp_path / index.path.split("/")[-1] / "segments" / segment.name).iterdir()))
    assert segment.rows == 2000 and segment.tokens == 10_000 and kept.count() < 200
    assert index.snapshot().postings().count() == 10_000
