"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is logistic in the distinct words that it has; a document's is the noisy-or of its
sentences'. Weights are fitted by gradient ascent on the document labels' likelihood, over a sample of
at most about SAMPLE labelled documents a class, drawn by a hash of the id. Executors choose the
words that go with the label, and send the driver the sample's sentences as places in that vocabulary. Scoring reads whole texts, needs no shuffle and locates the sentences that
offend.

Only the text is an input of a score. Defined results: null texts, empty ones and those without words have
the score of a document with one sentence without known words; without any labels of both kinds to learn
from, every score is 0. Repeated labels of a document count as toxic if one of them is. Repeated rows and
null ids are scored like any other row. A very long text is split into all its sentences, whose scores are combined. An empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, fold_of, only, parts, table
from .sampling import drawn_ids

#: Documents are learnt from unless crc32(doc_id) modulo FOLDS is HELD_OUT.
FOLDS, HELD_OUT = 5, 0
SAMPLE = 4000
#: A word needs so many sample documents to have a weight.
LEAST_DOCS = 4
#: ... and so large a chi-squared statistic of its presence against the label (a chance of one in 1,000).
LEAST_CHI2 = 10.8
ROUNDS, RATE, RIDGE = 250, 0.2, 0.02

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and the distinct lower-case words of each sentence that has words."""
    low = (text or "").lower()
    if text is not None and len(low) != len(text):  # a few capitals grow when lower-cased
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for m in SENTENCE.finditer(low):
        words = set(WORD.findall(m.group()))
        if words:
            yield m.start(), m.end(), words


class Model:
    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights

    def score(self, text: str | None) -> tuple[float, str]:
        """Probability of the document, and 'start:end' of the sentences that are likelier toxic than not."""
        get, bias = self.weights.get, self.bias
        clean, none, found = 0.0, True, []
        counts: Counter = Counter()
        for start, end, words in sentences(text):
            none = False
            s = bias
            for w in words:
                v = get(w)
                if v is not None:
                    s += v
            counts[s] += 1
            if s > 0:
                found.append(f"{start}:{end}")
        if none:
            counts[bias] += 1
        for s, n in counts.items():
            clean += n * _log_clean(s)
        return float(min(1.0, max(0.0, -np.expm1(clean)))), ",".join(found)


def _log_clean(s: float) -> float:
    """log of 1 - logistic(s)."""
    return -(max(s, 0.0) + float(np.log1p(np.exp(-abs(s)))))


def fit(docs: list[tuple[int, list[tuple[int, ...]]]], vocabulary: list[str]) -> Model:
    """docs: label and, for each sentence with words, the places of its words in the vocabulary."""
    docs = sorted(docs)
    labels = np.array([y for y, _ in docs], float)
    if len(set(labels.tolist())) < 2:
        return Model(-50.0, {})
    # sentences with the same known words in one document are one instance with a weight
    tokens, sizes, weight, owner = [], [], [], []
    for d, (_, ss) in enumerate(docs):
        kinds = Counter(ss) or {(): 1}
        for words, n in kinds.items():
            tokens.extend(words)
            sizes.append(len(words))
            weight.append(n)
            owner.append(d)
    tokens, sizes, weight, owner = np.array(tokens, int), np.array(sizes), np.array(weight, float), np.array(owner)
    of = np.repeat(np.arange(len(sizes)), sizes)
    rate = labels.mean()
    theta, bias = np.zeros(len(vocabulary)), float(np.log(max(rate, 1e-6) / (np.bincount(owner, weight).mean())))
    m, v = np.zeros(len(theta) + 1), np.zeros(len(theta) + 1)
    for t in range(1, ROUNDS + 1):
        s = bias + np.bincount(of, theta[tokens], len(sizes))
        p = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
        clean = np.bincount(owner, weight * np.log1p(-np.minimum(p, 1 - 1e-12)), len(docs))
        toxic = np.maximum(-np.expm1(clean), 1e-9)
        # d log-likelihood / d s of each instance
        pull = np.where(labels == 1, (1 - toxic) / toxic, -1.0)
        g = pull[owner] * weight * p
        grad = np.concatenate((np.bincount(tokens, g[of], len(theta)) - RIDGE * theta, [g.sum()]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        theta, bias = theta + step[:-1], bias + float(step[-1])
    return Model(bias, {w: float(v) for w, v in zip(vocabulary, theta, strict=True) if abs(v) > 1e-3})


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a batch the documents and the toxic documents that have it."""
    for b in batches:
        df: Counter = Counter()
        toxic_df: Counter = Counter()
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own = set().union(*(s for _, _, s in sentences(text)))
            df.update(own)
            if y:
                toxic_df.update(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64()), pa.array([toxic_df[w] for w in df], pa.int64())], names=["word", "df", "toxic_df"]
        )


def _instances(vocabulary: list[str]):
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: k for k, w in enumerate(vocabulary)}
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                parts = [sorted(at[w] for w in s if w in at) for _, _, s in sentences(text)]
                out.append(np.array([x for p in parts for x in (len(p), *p)], "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.binary())], names=["toxic", "sentences"])

    return bags


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from at most about `sample` documents of each label, held-out ones excepted. Common classes are
    drawn thinner than rare ones only beyond that bound, and the bias is then set right for the true shares."""
    known = only(labels, "doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    shares = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    drawn = bounded(drawn_ids(known, "toxic", sample))
    rows = cut(only(docs, "doc_id", "text").join(drawn, "doc_id").select("text", "toxic"))
    taken = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(taken) < 2:
        return Model(-50.0, {})
    n, pos = sum(taken.values()), taken[1]
    # only words that pass both tests go to the driver, at most a few thousand
    words = rows.mapInArrow(_words, "word string, df long, toxic_df long").groupBy("word").agg(F.sum("df").alias("df"), F.sum("toxic_df").alias("toxic_df"))
    a, d = F.col("toxic_df").cast("double"), F.col("df").cast("double")
    value = n * (a * n - d * pos) ** 2 / F.greatest(F.lit(1.0), d * (n - d) * pos * (n - pos))
    vocabulary = sorted(r.word for r in words.filter((F.col("df") >= LEAST_DOCS) & (value >= LEAST_CHI2)).select("word").collect())
    bags = []
    for r in rows.mapInArrow(_instances(vocabulary), "toxic int, sentences binary").collect():
        flat, i, parts = np.frombuffer(r.sentences, "<u4").tolist(), 0, []
        while i < len(flat):
            parts.append(tuple(flat[i + 1 : i + 1 + flat[i]]))
            i += 1 + flat[i]
        bags.append((r.toxic, parts))
    model = fit(bags, vocabulary)
    # rarer positives among all rows than in the sample lower every sentence's odds alike
    model.bias += float(np.log(min(1.0, (shares[1] / shares[0]) / (taken[1] / taken[0]))))
    return model


def _scoring(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            out = [model.score(t) for t in b.column(1).to_pylist()]
            scores, spans = map(list, zip(*out, strict=True)) if out else ([], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.string())], names=["doc_id", "score", "sentences"])

    return score


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the offending sentences as start:end pairs, of every row of docs."""
    return only(docs, "doc_id", "text").mapInArrow(_scoring(model), "doc_id long, score double, sentences string")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = detect(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")
