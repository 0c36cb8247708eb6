"""Postings in lists: a row for a token and up to so many of its messages, made where the texts are.

A task turns a stretch of texts into lists of their tokens, so that what is shuffled and written are some lists a stretch, not a row for each place.
A row has the ids of its messages, by id; the tokens of each; how often the token stands in each field; and the places, field by field, where ends says
how many there are up to the end of each message. most and least are the greatest weighted count and the smallest length, which bound every score in the row.
The empty token, which no text has, lists all messages with their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.functions.text import padded

SCHEMA = "initial string, token string, shard int, most double, least int, ids array<long>, units array<string>, lengths array<int>, counts array<int>, ends array<int>, places array<int>"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: Characters of text that are turned into lists at once, and values in a batch of results.
TEXT, VALUES = 8 << 20, 1 << 20


def inverted(rows: DataFrame, fields: list[str], weights: list[float], block: int) -> DataFrame:
    """Lists of rows (id, unit, shard and texts). Rows of one shard must come together and by id where lists of a shard may not overlap; neighbours of one id and unit are one message."""
    texts = [F.trim(padded(F.col(f))).alias(f"t{k}") if f in rows.columns else F.lit("").alias(f"t{k}") for k, f in enumerate(fields)]
    return rows.select(F.col("shard").cast("int"), F.col("id").cast("long"), F.col("unit").cast("string"), *texts).mapInArrow(_inverting(weights, block), SCHEMA)


def _inverting(weights: list[float], block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            *whole, rest = _stretches(t)
            for some in whole:
                yield from _lists(some, weights, block)
        if rest is not None:
            yield from _lists(rest, weights, block)

    return run


def _changes(t: pa.Table) -> np.ndarray:
    """Whether a row begins another message or shard than the row before."""
    out = np.zeros(t.num_rows, bool)
    out[:1] = True
    for name, none in (("shard", -1), ("id", np.iinfo(np.int64).min), ("unit", "")):
        own = pc.fill_null(t[name].combine_chunks(), none)
        if len(own) > 1:
            out[1:] |= pc.not_equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False)
    return out


def _stretches(t: pa.Table) -> list[pa.Table]:
    """t cut between messages: a new stretch for each shard and about each TEXT characters. The last may go on in the next batch."""
    if not t.num_rows:
        return [t]
    size = sum(pc.binary_length(t[n].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64) for n in t.column_names[3:])
    part = (np.cumsum(size) - size) // TEXT
    # of a message the first row says where it belongs
    new = np.flatnonzero(_changes(t))
    part = np.repeat(part[new], np.diff(np.append(new, t.num_rows)))
    shard = t["shard"].combine_chunks().to_numpy(zero_copy_only=False)
    at = np.flatnonzero((np.diff(part) != 0) | (np.diff(shard) != 0)) + 1
    edges = [0, *at.tolist()]
    if new[-1] > edges[-1]:
        edges.append(int(new[-1]))  # the last message waits
    edges.append(t.num_rows)
    return [t.slice(a, z - a) for a, z in zip(edges, edges[1:], strict=False)]


def _lists(t: pa.Table, weights: list[float], block: int) -> Iterator[pa.RecordBatch]:
    """The lists of one stretch, by token."""
    if not t.num_rows:
        return
    new = _changes(t)
    message = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    n, wide = len(first), len(weights)
    values, owners, fields, places = [], [], [], []
    for k, name in enumerate(t.column_names[3:]):
        texts = t[name].combine_chunks()
        if not pc.any(pc.not_equal(texts, "")).as_py():
            continue
        split = pc.split_pattern(texts, " ")
        starts = split.offsets.to_numpy()
        sizes = np.diff(starts)
        row = np.repeat(np.arange(t.num_rows, dtype=np.int32), sizes)
        place = (np.arange(starts[0], starts[-1]) - starts[:-1][row]).astype(np.int32)
        words = split.flatten()
        full = pc.not_equal(words, "")
        if not pc.all(full).as_py():
            keep = full.to_numpy(zero_copy_only=False)
            words, row, place = words.filter(full), row[keep], place[keep]
        values.append(words)
        owners.append(message[row])
        places.append(place)
        fields.append(np.full(len(row), k, np.int8))
    # the empty token, which every message has nowhere
    words = pa.concat_arrays(values) if values else pa.array([], pa.string())
    coded = words.dictionary_encode()
    owner, place, field = (np.concatenate([np.empty(0, d), *x]) for x, d in ((owners, np.int64), (places, np.int32), (fields, np.int8)))
    lengths = np.bincount(owner, minlength=n)
    order = np.argsort(coded.indices.to_numpy().astype(np.int64) * n + owner, kind="stable")
    code, owner, place, field = coded.indices.to_numpy()[order], owner[order], place[order], field[order]
    pair = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(owner) != 0))) if len(code) else np.empty(0, np.int64)
    of = np.cumsum(np.bincount(pair, minlength=len(code))) - 1
    counts = np.bincount(of * wide + field, minlength=len(pair) * wide).reshape(-1, wide)
    code = np.concatenate([np.zeros(n, np.int64), code[pair] + 1])
    who = np.concatenate([np.arange(n), owner[pair]])
    counts = np.concatenate([np.zeros((n, wide), np.int64), counts])
    tokens = pa.concat_arrays([pa.array([""], pa.string()), coded.dictionary])
    at = pa.array(first[who])
    yield from packed(tokens, code, np.full(len(code), t["shard"][0].as_py()), t["id"].combine_chunks().take(at), t["unit"].combine_chunks().take(at), lengths[who], counts, place, weights, block)


def packed(tokens: pa.Array, code, shard, ids: pa.Array, units: pa.Array, lengths, counts, places, weights: list[float], block: int) -> Iterator[pa.RecordBatch]:
    """Entries (a token of tokens, a message, its figures), which come by token, shard and id, as rows of up to `block` entries. places are those of all entries in a row."""
    m = len(code)
    if not m:
        return
    groups = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(shard) != 0)))
    within = np.arange(m) - np.repeat(groups, np.diff(np.append(groups, m)))
    rows = np.flatnonzero(within % block == 0)
    edges = np.append(rows, m)
    sizes = counts.sum(axis=1)
    upto = np.append(0, np.cumsum(sizes))
    ends = upto[1:] - np.repeat(upto[rows], np.diff(edges))
    token = tokens.take(pa.array(code[rows]))
    listed = lambda values, offsets: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    whole = [
        pc.utf8_slice_codeunits(token, 0, 1),
        token,
        pa.array(shard[rows], pa.int32()),
        pa.array(np.maximum.reduceat(counts @ np.array(weights), rows)),
        pa.array(np.minimum.reduceat(lengths, rows), pa.int32()),
        listed(ids, edges),
        listed(units, edges) if units.null_count < m else pa.nulls(len(rows), pa.list_(pa.string())),
        listed(pa.array(lengths, pa.int32()), edges),
        listed(pa.array(counts.reshape(-1), pa.int32()), edges * counts.shape[1]),
        listed(pa.array(ends, pa.int32()), edges),
        listed(pa.array(places, pa.int32()), upto[edges]),
    ]
    out = pa.RecordBatch.from_arrays(whole, names=NAMES)
    # in batches of about VALUES values
    held = (np.diff(upto[edges]) + np.diff(edges) * (4 + counts.shape[1]) + 8).cumsum()
    cuts = np.unique(np.append(np.searchsorted(held, np.arange(0, held[-1], VALUES)), len(rows)))
    for a, z in zip(cuts, cuts[1:], strict=False):
        yield out.slice(a, z - a)


def merged(lists: DataFrame, weights: list[float], block: int) -> DataFrame:
    """Lists, which come by token, shard and first id, with those of a token in a shard woven into rows by id."""
    return lists.select(*NAMES).mapInArrow(_weaving(weights, block), SCHEMA)


def _weaving(weights: list[float], block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = (t if rest is None else pa.concat_tables([rest, t])).combine_chunks()
            token, shard = t["token"].combine_chunks(), t["shard"].combine_chunks()
            same = pc.and_(pc.equal(token, token[-1]), pc.equal(shard, shard[-1])).to_numpy(zero_copy_only=False) if t.num_rows else np.empty(0, bool)
            rest = t.filter(pa.array(same))
            yield from _woven(t.filter(pa.array(~same)), weights, block)
        if rest is not None:
            yield from _woven(rest, weights, block)

    return run


def _woven(t: pa.Table, weights: list[float], block: int) -> Iterator[pa.RecordBatch]:
    if not t.num_rows:
        return
    t = t.combine_chunks()
    flat = lambda name: t[name].combine_chunks().flatten()
    held = pc.list_value_length(t["ids"].combine_chunks()).to_numpy()
    row = np.repeat(np.arange(t.num_rows), held)
    coded = t["token"].combine_chunks().dictionary_encode()
    code, shard = coded.indices.to_numpy()[row], t["shard"].combine_chunks().to_numpy()[row]
    ids, lengths, places = flat("ids"), flat("lengths").to_numpy(), flat("places").to_numpy()
    counts = flat("counts").to_numpy().reshape(len(row), -1)
    sizes = counts.sum(axis=1)
    starts = np.cumsum(sizes) - sizes
    order = np.lexsort((pc.fill_null(ids, np.iinfo(np.int64).min).to_numpy(), shard, code))
    own = sizes[order]
    at = np.repeat(starts[order] - (np.cumsum(own) - own), own) + np.arange(own.sum())
    yield from packed(coded.dictionary, code[order], shard[order], ids.take(pa.array(order)), pa.nulls(len(order), pa.string()), lengths[order], counts[order], places[at], weights, block)


def write_lists(lists: DataFrame, path: str, files: int | None = None, dealt: bool = False) -> None:
    """Lists in files by first character and token. Without `files`, a character with many lists is dealt over several files, so no task has all of it. dealt: they come so that few tasks have a character."""
    own = lists if dealt else lists.repartition(files, "initial") if files else lists.hint("rebalance", F.col("initial"))
    own.sortWithinPartitions("initial", "token", "shard", F.get("ids", F.lit(0))).write.mode("overwrite").partitionBy("initial").parquet(path)


def read_lists(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def entries(lists: DataFrame, wide: int) -> DataFrame:
    """Lists as rows: initial, token, shard, id, unit, tokens (of the message), n (the token's count a field) and places."""
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("ends", i - 1))

    def one(i: Column) -> Column:
        return F.struct(
            F.get("ids", i).alias("id"),
            F.coalesce(F.get("units", i), F.lit("")).alias("unit"),
            F.get("lengths", i).alias("tokens"),
            F.slice("counts", i * wide + 1, F.lit(wide)).alias("n"),
            F.slice("places", start(i) + 1, F.get("ends", i) - start(i)).alias("places"),
        )

    each = F.transform(F.sequence(F.lit(0), F.size("ids") - 1), one)
    return lists.select("initial", "token", "shard", F.explode(each).alias("e")).select("initial", "token", "shard", "e.*")


def postings_of(lists: DataFrame, fields: list[str]) -> DataFrame:
    """Lists as operators.postings has them: initial, token, id, unit, field, places."""
    upto: Column = F.lit(0)
    each = []
    for k, f in enumerate(fields):
        n = F.get("n", F.lit(k))
        each.append(F.struct(F.lit(f).alias("field"), F.slice("places", upto + 1, n).alias("places")))
        upto = upto + n
    some = F.filter(F.array(*each), lambda x: F.size(x["places"]) > 0)
    return entries(lists.filter("token <> ''"), len(fields)).select("initial", "token", "id", "unit", F.inline(some)).select("initial", "token", "id", "unit", "field", "places")
