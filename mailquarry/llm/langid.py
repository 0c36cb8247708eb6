"""Language identification by the nearest of several centroids per language.

A text is a vector of letter trigrams, hashed to DIMENSIONS places, weighted by TF-IDF and normalised. For each
language spherical k-means makes up to CENTROIDS centroids of a sample of at most about SAMPLE labelled
texts. A text gets the language of the centroid with the largest cosine. It is rejected if the cosine is low for
its size: below a fraction of what nearly all sample texts with about as many different trigrams reach. Each sample
text also gives one piece of a smaller size, so that short texts have bounds of their own. Sizes of which the sample has
few even so take the bound of the next smaller one.

The sample is drawn by a hash of the id over all rows that may be learnt from; vectors, not texts, go to the
driver (a few kilobytes each). Scoring reads whole texts and needs no shuffle.

Defined results: null texts and texts without letters are `und` with score 0 and rejected, and so is every text
if nothing could be learnt. Equal cosines go to the language that sorts first. Repeated rows and null ids are
scored like any other; a null id counts as held out from nothing and is never learnt from. A very long text is read whole. An empty table
gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, fold_of, only, parts, positional, table
from .sampling import drawn_ids

DIMENSIONS = 1 << 13
SAMPLE = 600
CENTROIDS = 4
ROUNDS = 12
#: Texts are learnt from unless crc32(doc_id) modulo FOLDS is HELD_OUT.
FOLDS, HELD_OUT = 3, 1
#: A text is rejected below this fraction of the cosine that all but one in a hundred of the sample of its size reach.
REJECT = 0.4
#: Sample texts or pieces that a size (a power of two of different trigrams) needs for a bound of its own.
SIZED = 20
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Which code points are letters (categories L*)."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(text: str | None) -> np.ndarray | None:
    """Places of the text's letter trigrams, runs of other characters as one blank; None without letters."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    known = letter_table()[code]
    if not known.any():
        return None
    code = np.where(known, code, 32)
    code = np.concatenate(([32], code[known | np.concatenate(([True], known[:-1]))], [32])).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:] * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - 13)).astype(np.int64)


def frequencies(text: str | None) -> np.ndarray | None:
    places = trigrams(text)
    return None if places is None else np.log1p(np.bincount(places, minlength=DIMENSIONS)).astype(np.float32)


class Model:
    """Centroids (rows, times the IDF weights), the language of each, the IDF weights and the bounds by size."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str], bounds: np.ndarray):
        self.idf, self.langs, self.bounds = idf, langs, bounds
        self.weights = (centroids * idf).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine and whether the text is rejected."""
        tf = frequencies(text)
        if tf is None or not self.langs:
            return UNKNOWN, 0.0, True
        norm = float(np.linalg.norm(tf * self.idf))
        cosines = self.weights @ tf / max(norm, 1e-12)
        best = int(np.argmax(cosines))
        score = min(1.0, max(0.0, float(cosines[best])))
        return self.langs[best], score, score <= float(self.bounds[size_of(np.flatnonzero(tf))])


def size_of(places: np.ndarray) -> int:
    """The power of two of the number of different trigrams."""
    return max(len(places).bit_length() - 1, 0)


def size_bounds(sizes: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """REJECT times the hundredth part of the cosines of each size, or the bound of the next smaller size."""
    out = np.zeros(DIMENSIONS.bit_length() + 1)
    for k in range(len(out)):
        own = reach[sizes == k]
        out[k] = REJECT * float(np.quantile(own, 0.01)) if len(own) >= SIZED else out[k - 1] if k else 0.0
    return out


#: Places and the log of 1 plus their counts.
Sparse = tuple[np.ndarray, np.ndarray]


def sparse(where: np.ndarray) -> Sparse:
    at, n = np.unique(where, return_counts=True)
    return at, np.log1p(n).astype(np.float32)


def fit(texts: dict[str, list[Sparse]], pieces: dict[str, list[Sparse]] | None = None) -> Model:
    """From the vectors of the texts of each language, and those of pieces of them for the bounds. One language at a time is dense."""
    langs = sorted(texts)
    if not langs:
        return Model(np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), [], np.zeros(DIMENSIONS.bit_length() + 1))
    n = sum(map(len, texts.values()))
    df = np.bincount(np.concatenate([at for own in texts.values() for at, _ in own]), minlength=DIMENSIONS)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    centroids, names, sizes, reached = [], [], [], []
    for lang in langs:
        x = np.zeros((len(texts[lang]), DIMENSIONS), np.float32)
        for row, (at, tf) in zip(x, texts[lang], strict=True):
            row[at] = tf * idf[at]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c, reach = spherical_kmeans(x, CENTROIDS, ROUNDS)
        centroids.append(c)
        names += [lang] * len(c)
        sizes += [size_of(at) for at, _ in texts[lang]]
        reached += reach.tolist()
        for at, tf in (pieces or {}).get(lang, ()):
            own = tf * idf[at]
            sizes.append(size_of(at))
            reached.append(float((c[:, at] @ own).max() / max(float(np.linalg.norm(own)), 1e-12)))
    return Model(idf, np.concatenate(centroids), names, size_bounds(np.array(sizes), np.array(reached)))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """At most k unit centroids of the unit rows of x, and each row's cosine to its own. Starts from the row
    nearest the mean and then, each time, the row farthest from those chosen."""
    chosen = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(0)
                c[j] = m / max(float(np.linalg.norm(m)), 1e-12)
    return c, (x @ c.T).max(axis=1)


def piece_of(where: np.ndarray) -> np.ndarray:
    """A run of a text's trigrams, of a size below its own; size and place are drawn by a hash of them all."""
    draw = zlib.crc32(where.tobytes())
    length = min(len(where), 3 << (draw % max(1, len(where).bit_length() - 1)) >> 1)
    start = draw // 32 % (len(where) - length + 1)
    return where[start : start + length]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts(batches, 0):
        langs, pieces, places, counts = [], [], [], []
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            where = trigrams(text)
            for piece, run in () if where is None else ((False, where), (True, piece_of(where))):
                at, n = np.unique(run, return_counts=True)
                langs.append(lang)
                pieces.append(piece)
                places.append(at.astype("<u2").tobytes())
                counts.append(n.astype("<u4").tobytes())
        arrays = [pa.array(langs, pa.string()), pa.array(pieces, pa.bool_()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["lang", "piece", "places", "counts"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from text and lang of at most about `sample` texts a language that aren't held out."""
    rows = only(docs, "doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    )
    drawn = rows.join(bounded(cut(drawn_ids(rows, "lang", sample).distinct())), ["doc_id", "lang"], "left_semi").select("text", "lang")
    found: tuple[dict[str, list[Sparse]], dict[str, list[Sparse]]] = {}, {}
    for r in sorted(drawn.mapInArrow(_vectors, "lang string, piece boolean, places binary, counts binary").collect(), key=lambda r: (r.lang, bytes(r.places), bytes(r.counts))):
        at, n = np.frombuffer(r.places, "<u2"), np.frombuffer(r.counts, "<u4")
        found[r.piece].setdefault(r.lang, []).append((at, np.log1p(n).astype(np.float32)))
    return fit(*found)


def _scoring(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            out = list(map(model.predict, b.column(1).to_pylist()))
            langs, scores, rejected = map(list, zip(*out, strict=True)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "mark", "lang_pred", "score", "rejected"],
            )

    return score


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, mark, lang_pred, score and rejected of every row of docs."""
    rows = only(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return rows.mapInArrow(_scoring(model), "doc_id long, mark long, lang_pred string, score double, rejected boolean")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs))
    held_out = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "lang_pred", "score", "rejected")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs whose language is known well enough, with all their columns as they were."""
    model = train(docs)
    rows, _, text, named = positional(docs)
    at = rows.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, at):
            yield b.filter(pa.array([not model.predict(t)[2] for t in b.column(at).to_pylist()], pa.bool_()))

    return named(rows.mapInArrow(kept, rows.schema))
