"""Near-duplicate detection by SimHash, with bit-sliced comparison of fingerprints.

link_fingerprints() finds every pair of 64-bit fingerprints within the radius. The bits are cut into blocks;
two fingerprints within the radius agree in all but radius of them, so those that agree in some choice of
blocks meet in a bucket. A bucket with more than LIMIT fingerprints is cut again by the bits that are left,
up to twice, after which it can hold 256 at most: no cap, no lost link, no quadratic bucket.

near_groups() serves the corpus pipeline, where documents are near-duplicates if the Jaccard similarity of their
five-word shingles is 0.8 or more. Bits of a SimHash at that similarity agree in too few blocks to make keys that hold up
on large tables, so the keys of its buckets are bands of minima; in a bucket, sketches of BITS bits are compared by the
same bit-sliced kernel, and what lies within NEAR bits is held against 0.8 on the shingles themselves.

Defined results: a null text counts as empty; a text without words has the fingerprint zero, which links
like any other; a shorter text than a shingle is one shingle. Repeated rows have equal fingerprints and stay
in the result. Null doc_ids are ignored when the smallest is sought; a component of only null ids has the id null.
A very long text is counted in chunks, so beyond the text only its hashes are held. An empty table gives no rows.
Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.operators.graph import components

from . import bitslice
from .common import bounded, cut, keep_rows, mark, only, parts, table
from .wordhash import Words, mix, runs

SEED = 42

#: Fingerprints in a bucket beyond which it is cut again.
LIMIT = 4096

#: Shingles whose bits are counted at a time, to bound memory on long texts.
CHUNK = 1 << 15


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of width words, A-Z lower-cased; blanks are \\x20 and \\x09-\\x0D."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in own), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned 64-bit number."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        count += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None) -> int:
    hashes = shingle_hashes(text, 3)
    return majority(hashes) if len(hashes) else 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts(batches):
        prints = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    return only(docs, "doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def block_masks(free: int, blocks: int, radius: int) -> list[int]:
    """Masks of the choices of blocks - radius blocks from the bits of free."""
    bits = [k for k in range(64) if free >> k & 1]
    step = len(bits) / blocks
    parts = [sum(1 << k for k in bits[round(i * step) : round((i + 1) * step)]) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linker(radius: int, least: int = 8192):
    """Links rows (two columns that name the bucket and sort the input, node, fingerprint) within their buckets, which are
    small: as many whole buckets at a time as make `least` rows."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def edges(bucket: np.ndarray, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            node, prints = cols[2], cols[3]
            found = bitslice.link_buckets(bucket, prints.view(np.uint64).reshape(len(node), -1), radius)
            if found:
                i, r = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[r])], names=["a", "b"])

        def joined() -> tuple[list[np.ndarray], np.ndarray]:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            return cols, np.concatenate(([0], np.cumsum((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))))

        for b in batches:
            if not b.num_rows:
                continue
            held.append([_plain(c) for c in b.columns])
            if sum(len(h[0]) for h in held) < least:
                continue
            cols, bucket = joined()
            at = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
            if at:
                yield from edges(bucket[:at], [c[:at] for c in cols])
            held = [[c[at:] for c in cols]]
        if held:
            cols, bucket = joined()
            yield from edges(bucket, cols)

    return link


def _plain(c: pa.Array) -> np.ndarray:
    if pa.types.is_fixed_size_binary(c.type) or pa.types.is_binary(c.type):
        width = len(c[0].as_py())
        return np.frombuffer(b"".join(c.to_pylist()), "<u8").reshape(len(c), width // 8)
    return c.to_numpy(zero_copy_only=False)


def link_fingerprints(prints: DataFrame, radius: int = 2, blocks: int = 4, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` that span the components of all pairs within radius.

    A component inside a bucket comes out as a star, so what is sent grows with the number of fingerprints.
    """
    spark = prints.sparkSession
    masks = block_masks((1 << 64) - 1, blocks, radius)
    tree = [masks]
    for _ in range(2):
        tree.append([m | c for m in tree[-1] for c in block_masks(~m & ((1 << 64) - 1), blocks, radius)])
    rows = prints.select("fp", F.lit(0).alias("parent"))
    edges = spark.createDataFrame([], "a long, b long")
    for depth, level in enumerate(tree):
        fan = len(masks)
        own = F.array(*(F.lit(_signed(m)) for m in level))
        child = F.explode(F.sequence(F.col("parent") * fan, F.col("parent") * fan + fan - 1)).alias("m")
        keys = rows.select("fp", child).select("m", F.element_at(own, F.col("m") + 1).bitwiseAND(F.col("fp")).alias("key"), "fp")
        sizes = cut(keys.groupBy("m", "key").count().filter("count > 1"))
        last = depth == len(tree) - 1
        near = keys.join(sizes if last else sizes.filter(F.col("count") <= limit), ["m", "key"]).select("m", "key", F.col("fp").alias("node"), "fp")
        # Dealt by a hash of m and key: by m and key themselves Spark would keep the join's exchange instead, and scatter a bucket
        # over tasks wherever it reads that exchange locally, as the join became a broadcast, or splits a skewed part of it.
        near = near.repartition(F.xxhash64("m", "key")).sortWithinPartitions("m", "key", "fp")
        edges = edges.union(near.mapInArrow(_linker(radius), "a long, b long"))
        hot = sizes.filter(F.col("count") > limit)
        if last or hot.isEmpty():
            break
        rows = keys.join(hot, ["m", "key"]).select("fp", F.col("m").alias("parent"))
    return edges


def group(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id that links lead
    to) of every row of docs."""
    prints = cut(fingerprints(docs))
    kinds = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    tied = cut(components(link_fingerprints(kinds, radius)))
    rooted = kinds.join(tied, kinds["fp"] == tied["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = cut(rooted.groupBy("root").agg(F.min("low").alias("component_id")))
    named = cut(rooted.join(lows, "root").select("fp", "component_id"))
    out = prints.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))


# --- the corpus pipeline's near-duplicates --------------------------------------------------------------

#: Words of a shingle; bands of a document and the minima of each. A pair at 0.8 shares no band once in 1,500 times.
WORDS, BANDS, ROWS = 5, 40, 8

#: Bits of a sketch and the radius of its comparison. Pairs at 0.8 differ in 77 +- 8 bits (simulated), at 0.6 in 117 +- 10.
BITS, NEAR = 512, 104

#: Shingles below which a set is too small for a sketch: such a set goes from its buckets to the exact comparison at once.
FEW = 32

#: Documents and shingles of a group's block; larger groups are compared block by block.
BLOCK, BLOCK_SHINGLES = 1 << 12, 1 << 19

#: Multipliers (odd) and offsets of the families of hashes whose minima are taken.
_TIMES, _PLUS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64) | np.array([1, 0], np.uint64).reshape(2, 1, 1)

#: What is added to a hash before it is mixed, for each 64 bits of a sketch.
_STEPS = np.array([k * 0x9E3779B97F4A7C15 & (2**64 - 1) for k in range(1, BITS // 64 + 1)], np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of 64-bit hashes of a hash."""
    with np.errstate(over="ignore"):
        return mix(h + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1)))


_HASHED = Words(np.array([c not in b" \t\n\x0b\x0c\r" for c in range(256)]))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the hashes of the distinct five-word shingles, in order; of fewer words the whole sequence is one."""
    out = []
    for _, h in _HASHED.of([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]):
        out.append(np.unique(runs(h, min(WORDS, max(1, len(h))))))
    return out


def shingles(text: str | None) -> np.ndarray:
    return shingle_sets([text])[0]


def minima(h: np.ndarray) -> np.ndarray:
    """The smallest value of every family over the hashes."""
    out = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 128):  # what a core's cache holds
        np.minimum(out, (h[at : at + 128] * _TIMES + _PLUS).min(axis=1), out=out)
    return out


def sketch(h: np.ndarray) -> bytes:
    """SimHash of BITS bits of a set of shingle hashes: a bit is 1 if set in over half of them."""
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 2048):
        with np.errstate(over="ignore"):
            many = mix(h[at : at + 2048, None] + _STEPS)
        count += np.unpackbits(many.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(2 * count > len(h), bitorder="little").tobytes()


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys of (n, BANDS * ROWS) minima; documents share a band's key if they share all its minima."""
    parts = signatures.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for j in range(ROWS):
        key = _mixed(key ^ parts[:, :, j], j + 1)
    return key


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts(batches, rows=256):
        if not b.num_rows:
            continue
        sets = shingle_sets(b.column(1).to_pylist())
        keys = band_keys(np.array([minima(h) for h in sets])).view(np.int64)
        digests = [xxhash.xxh3_128_digest(h.astype("<u8").tobytes(), SEED) for h in sets]
        # a document without words has no band: it equals others of its kind and resembles none
        listed = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
        arrays = [b.column(0), b.column(2), pa.array(digests, pa.binary()), pa.array([len(h) for h in sets], pa.int64()), listed, pa.array(map(sketch, sets), pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "mark", "digest", "n", "keys", "sketch"])


def link_sets(sets: list[np.ndarray], labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs that span, together with equal labels, the same components as all pairs of sets with a Jaccard similarity of 0.8 or more.

    Sets that similar share one of their rarest shingles: in one order of all shingles by frequency, a fifth of each set and one
    more hold a common one. Those that do are counted in full. The search is breadth first; a set that has been reached isn't met
    again, and sets of one label are reached together.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    start = np.concatenate(([0], np.cumsum(size)))
    _, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    ids = ids[np.lexsort((ids, often[ids], row))]
    rare = size - (4 * size + 4) // 5 + 1
    of = np.arange(len(ids)) - start[row] < rare[row]
    by = np.argsort(ids[of], kind="stable")
    key, holder = ids[of][by], row[of][by]
    kin: dict[int, list[int]] = {}
    for i, name in enumerate(range(n) if labels is None else labels):
        kin.setdefault(name, []).append(i)
    own_kin = [kin[name] for name in (range(n) if labels is None else labels)]

    def places(at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The positions of all runs, one after the other."""
        return np.repeat(at - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())

    alive, flag, found = np.ones(n, bool), np.zeros(len(often), bool), []
    left = built = n
    first = np.searchsorted(key, np.arange(len(often) + 1))
    for seed in range(n):
        if not alive[seed]:
            continue
        queue = list(own_kin[seed])
        alive[queue] = False
        left -= len(queue)
        while queue and left:
            if 2 * left < built:
                held = alive[holder]
                key, holder, built = key[held], holder[held], left
                first = np.searchsorted(key, np.arange(len(often) + 1))
            q = queue.pop()
            probe = ids[start[q] : start[q] + rare[q]]
            hit = np.zeros(n, bool)
            hit[holder[places(first[probe], first[probe + 1] - first[probe])]] = True
            near = np.flatnonzero(hit & alive & (5 * size >= 4 * size[q]) & (5 * size[q] >= 4 * size))
            if not len(near):
                continue
            own = ids[start[q] : start[q + 1]]
            flag[own] = True
            common = np.add.reduceat(flag[ids[places(start[near], size[near])]], np.concatenate(([0], np.cumsum(size[near])[:-1])), dtype=np.int64)
            flag[own] = False
            for i in near[9 * common >= 4 * (size[near] + size[q])].tolist():
                found.append((i, q))
                if alive[i]:
                    alive[own_kin[i]] = False
                    left -= len(own_kin[i])
                    queue += own_kin[i]
    return found


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts(batches, 4):
        sets = [h.astype("<u8").tobytes() for h in shingle_sets(b.column(4).to_pylist())]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sets, pa.binary())], names=["root", "node", "blocks", "block", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links documents (root, i, j that name what is compared and sort the input, node, label, shingles)."""
    at, nodes, labels, sets = None, [], [], []

    def edges() -> pa.RecordBatch:
        pairs = link_sets(sets, labels) if len(set(labels)) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in pairs], pa.int64()), pa.array([nodes[j] for _, j in pairs], pa.int64())], names=["a", "b"])

    for b in parts(batches, 5):
        for root, i, j, node, label, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at != (root, i, j):
                if len(sets) > 1:
                    yield edges()
                at, nodes, labels, sets = (root, i, j), [], [], []
            nodes.append(node)
            labels.append(label)
            sets.append(np.frombuffer(data, "<u8"))
    if len(sets) > 1:
        yield edges()


def _compared(dealt: DataFrame) -> DataFrame:
    """Edges among rows (root, i, j, node, label, shingles), within each root, i and j."""
    return cut(dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_similar, "a long, b long"))


def _candidates(kinds: DataFrame, limit: int = LIMIT) -> DataFrame:
    """node and root of the groups of sets that may be similar: chains of sets in a bucket whose sketches are within the radius.

    Of buckets with the same members one is looked at. A bucket with more than `limit` sets, and sets too small for a
    sketch, go into one group each bucket without a comparison of sketches; what is compared exactly later only grows.
    """
    banded = kinds.filter("n > 0").select("node", "n", F.explode("keys").alias("key"))
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("low"), F.bit_xor(F.xxhash64("node")).alias("members")).filter("size > 1")
    sizes = cut(sizes.groupBy("size", "low", "members").agg(F.min("key").alias("key")))
    rows = cut(banded.join(sizes.select("key", "size", "low"), "key"))
    chained = rows.filter((F.col("size") > limit) | (F.col("n") < FEW * 5 // 4)).select(F.col("node").alias("a"), F.col("low").alias("b"))
    small = rows.filter((F.col("size") <= limit) & (F.col("n") >= FEW)).select("node", F.lit(0).alias("m"), "key")
    near = small.join(kinds.select("node", "sketch"), "node").select("m", "key", "node", "sketch").repartition("m", "key").sortWithinPartitions("m", "key")
    edges = chained.union(near.mapInArrow(_linker(NEAR), "a long, b long")).filter("a <> b")
    tied = cut(components(edges))
    return tied.union(tied.select(F.col("root").alias("node"), "root").distinct())


def _labelled(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members with the component that edges put each node in, as `label`."""
    own = edges.join(members.select(F.col("node").alias("a")), "a", "left_semi").select("a", "b")
    tied = components(own).select(F.col("node").alias("tied"), F.col("root").alias("own"))
    return members.join(tied, members["node"] == F.col("tied"), "left").withColumn("label", F.coalesce("own", "node")).drop("tied", "own")


def _blocks(block: int, block_shingles: int) -> Column:
    """The number of blocks of an aggregated group with the columns n (shingles of a set)."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / block_shingles)).cast("int")


def _verified(docs: DataFrame, kinds: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """Edges (a, b) that span the components of all pairs with a similarity of 0.8 or more within the groups of candidates.

    A group is dealt over blocks of bounded size by a hash. Blocks are linked by themselves, then one set of each component found
    so far meets those of the other blocks. Only groups that still have several components go on: the sets of a group's largest
    component meet all others of the group, and these each other, block by block, so no pair is left out. That remainder grows with
    the square of the blocks of sets outside the largest component.
    """
    grouped = cut(_candidates(kinds).join(kinds.select("node", "n", "first"), "node"))
    sizes = grouped.groupBy("root").agg(_blocks(block, block_shingles).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    members = cut(grouped.join(sizes, "root").select("root", "node", "blocks", own, F.col("first.doc_id").alias("own_id"), F.col("first.mark").alias("own_mark")))
    read = docs.join(bounded(members, 200_000), docs["doc_id"].eqNullSafe(F.col("own_id")) & (docs["mark"].eqNullSafe(F.col("own_mark"))))
    sets = read.select("root", "node", "blocks", "block", "text").mapInArrow(_sets, "root long, node long, blocks int, block int, shingles binary")
    sets = sets.withColumn("i", F.col("block")).withColumn("j", F.col("block")).withColumn("label", F.col("node"))
    order = ("root", "i", "j", "node", "label", "shingles")
    if members.filter("blocks > 1").isEmpty():
        return _compared(sets.select(*order))
    sets = cut(sets)
    edges = _compared(sets.select(*order))
    large = cut(sets.filter("blocks > 1").withColumn("n", F.length("shingles") / 8))
    # one set of each component of each block
    heads = cut(_labelled(large, edges)).filter("label = node")
    sizes = heads.groupBy("root").agg(_blocks(block, block_shingles).alias("parts"))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    edges = edges.union(_compared(heads.join(sizes, "root").withColumn("i", own).withColumn("j", own).select(*order)))
    # groups in several components: blocks of the largest come first, then those of all others
    named = cut(_labelled(large.drop("label"), edges))
    counts = cut(named.groupBy("root", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")))
    best = counts.groupBy("root").agg(F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    inside = F.col("label") == F.col("top.label")
    open_ = cut(counts.join(best, "root").groupBy("root").agg(
        F.first("top.label").alias("main"),
        *(F.greatest(F.ceil(F.sum(F.when(side, F.col("c"))) / block), F.ceil(F.sum(F.when(side, F.col("s"))) / block_shingles)).cast("int").alias(name) for side, name in ((inside, "p"), (~inside, "q")))))
    if open_.isEmpty():
        return edges
    rest = named.drop("block", "i", "j").join(open_, "root")
    place = F.when(F.col("label") == F.col("main"), F.pmod(F.xxhash64("node", F.lit(2)), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("node", F.lit(2)), F.col("q"))).cast("int")
    rest = rest.withColumn("block", place)
    span = F.sequence(F.lit(0), F.col("p") + F.col("q") - 1)
    other = F.explode(F.filter(span, lambda o: (o != F.col("block")) & ((o >= F.col("p")) | (F.col("block") >= F.col("p"))))).alias("other")
    rest = rest.select("root", "block", other, "node", "label", "shingles")
    return edges.union(_compared(rest.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).select(*order)))


def near_groups(docs: DataFrame, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, mark and kept of every row of docs: of each group of near-duplicates the row with the smallest
    doc_id stays. Two documents link if they share a band, or are chained by such links, and the Jaccard similarity of
    their five-word shingles is 0.8 or more."""
    marked = only(docs, "doc_id", "text").select("doc_id", "text", mark(F.col("text")).alias("mark"))
    schema = "doc_id long, mark long, digest binary, n long, keys array<long>, sketch binary"
    rows = cut(marked.mapInArrow(_signatures, schema).withColumn("row_id", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("row_id"), F.col("mark")))
    kinds = rows.groupBy("digest").agg(first.alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    kinds = cut(kinds.withColumn("node", F.col("first.row_id")))
    tied = cut(components(_verified(marked, kinds, block, block_shingles)))
    rooted = kinds.join(tied, kinds["node"] == tied["node"], "left").select("digest", "first", F.coalesce("root", kinds["node"]).alias("root"))
    chosen = cut(rooted.groupBy("root").agg(F.min("first").alias("best")))
    named = cut(rooted.join(chosen, "root").select("digest", F.col("best.row_id").alias("keep_row")))
    return rows.select("doc_id", "mark", "row_id", "digest").join(named, "digest").select("doc_id", "mark", (F.col("row_id") == F.col("keep_row")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group of near-duplicates, with all its columns."""
    return keep_rows(docs, near_groups(docs))
