"""Packing of documents into training windows by the online sum-of-squares rule.

A document's tokens are its ids by the tokenizer and one closing id. Whole windows are cut off first; the
tail goes where the sum of squared counts of partly filled windows, by fill level, grows least. The counts lie
in an array with an entry a level. Each task packs the documents of its partition in their order, so there is
no shuffle and a lost task is repeated with the same result; the window number starts with the partition's.

At most `open_limit` windows are open at a time. Beyond that, and at the end, the fullest are topped up by
cutting from the emptiest, so that every task leaves one partly filled window, which is split into windows of
powers of two that need no padding.

Defined results: a null or empty text has only the closing id; very long texts fill many windows; repeated
rows and null doc_ids are packed like any other row; an empty table gives no row. Columns other than doc_id
and text are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import only, parts, table

WINDOW = 4096
END_ID = 2
OPEN_LIMIT = 1024
#: Words and blank-separated chunks whose ids are kept, after which the cache starts anew.
CACHE = 900_000
#: The same in the pipeline, where workers share their executor with what earlier stages hold.
STAGE_CACHE = 400_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class CachedTokenizer:
    """Token ids as little-endian 32-bit bytes, the same ids that the library gives for the whole text.

    The vocabulary's pre-tokenizer never joins characters across blanks and never joins letters with other
    characters, so a text's ids are those of its chunks, and a chunk's those of its words. Both are kept.
    Texts with characters beyond Latin, control characters that count as blanks only in Python, or
    something like a special token go to the library as a whole.
    """

    ODD = re.compile("[^\\x00-\\x1b\\x20-į\\u0131-ſ]|<\\|")
    WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºÀ-ÖØ-öø-ſ]+|[0-9²³¹¼½¾]|[^\\s0-9²³¹¼½¾a-zªµºÀ-ÖØ-öø-ſ]+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.library = Tokenizer.from_file(path)
        # the same model for words that are normalised and cut already
        self.bare = Tokenizer(self.library.model)
        self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.library.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.limit = CACHE
        self.words: dict[str, bytes] = {}
        self.chunks = self.words  # a chunk without punctuation is its word

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def single(self, words: list[str]) -> list[bytes]:
        """Ids of words that are one pre-token each: encoded together, and cut behind the ids that end a word."""
        ids = np.array(self.bare.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = (np.flatnonzero(self.closing[ids]) + 1) * 4
        if len(ends) != len(words):
            return self.whole(words)
        raw, ends = ids.tobytes(), ends.tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def is_odd(self, text: str) -> bool:
        if text.isascii():
            return "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        return self.ODD.search(text) is not None

    def parts(self, chunk: str) -> list[str]:
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in ".," and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.WORD.findall(chunk)

    def learn(self, chunks: set[str]) -> None:
        fresh = {c: self.parts(c) for c in chunks}
        new = list({w for parts in fresh.values() for w in parts}.difference(self.words))
        for at in range(0, len(new), 4096):
            self.words.update(zip(new[at : at + 4096], self.single(new[at : at + 4096]), strict=True))
        word = self.words.__getitem__
        self.chunks.update([(c, b"".join(map(word, p))) for c, p in fresh.items() if len(p) != 1])

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.words) > self.limit:
            self.words.clear()
        out: list = [b""] * len(texts)
        odd, held, unknown = [], [], set()
        known = self.chunks.get
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.is_odd(text):
                odd.append(i)
                continue
            parts = text.lower().split()
            ids = list(map(known, parts))
            gaps, k = [], -1
            for _ in range(ids.count(None)):
                k = ids.index(None, k + 1)
                gaps.append(k)
            if gaps:
                unknown.update([parts[k] for k in gaps])
                held.append((i, ids, parts, gaps))
            else:
                out[i] = b"".join(ids)
        for i, b in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
            out[i] = b
        self.learn(unknown)
        for i, ids, parts, gaps in held:
            for k in gaps:
                ids[k] = known(parts[k])
            out[i] = b"".join(ids)
        return out


class Packer:
    """Windows of one task. Pieces are [doc_id, doc_tokens, start, bytes of ids]."""

    def __init__(self, window: int = WINDOW, open_limit: int = OPEN_LIMIT, first_id: int = 0):
        self.window, self.open_limit, self.next_id = window, open_limit, first_id
        self.count = np.zeros(window + 1, np.int64)  # partly filled windows by level; 0 and window stay 0
        self.at: dict[int, list[list]] = {}
        self.open = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        total = len(ids) // 4
        full = total - total % self.window
        for s in range(0, full, self.window):
            self._emit([[doc_id, total, s, ids[4 * s : 4 * (s + self.window)]]])
        if total > full:
            self._place([doc_id, total, full, ids[4 * full :]], total - full)
            if self.open > self.open_limit:
                self._settle(self.open_limit // 2)

    def _place(self, piece: list, size: int) -> None:
        room = self.window - size
        # the change of the sum for each level that the piece fits on; level 0 is a new window
        change = 2 * (self.count[size : self.window + 1] - self.count[: room + 1]) + 2
        change[0] -= 1
        change[room] -= 1  # a full window counts no more
        allowed = self.count[: room + 1] > 0
        allowed[0] = True
        change[~allowed] = np.iinfo(np.int64).max
        level = room - int(np.argmin(change[::-1]))  # the fullest of equals
        pieces = self._take(level) if level else []
        pieces.append(piece)
        self._put(level + size, pieces)

    def _take(self, level: int) -> list:
        self.count[level] -= 1
        self.open -= 1
        return self.at[level].pop()

    def _put(self, level: int, pieces: list) -> None:
        if level == self.window:
            self._emit(pieces)
        elif level:
            self.count[level] += 1
            self.open += 1
            self.at.setdefault(level, []).append(pieces)

    def _settle(self, most: int) -> None:
        """Tops up the fullest windows from the emptiest until at most `most` are open."""
        while self.open > most and self.open > 1:
            levels = np.flatnonzero(self.count)
            high, low = int(levels[-1]), int(levels[0])
            into, source = self._take(high), self._take(low)
            while high < self.window and source:
                piece = source.pop()
                size = len(piece[3]) // 4
                part = min(size, self.window - high)
                into.append([piece[0], piece[1], piece[2], piece[3][: 4 * part]])
                if part < size:
                    source.append([piece[0], piece[1], piece[2] + part, piece[3][4 * part :]])
                high, low = high + part, low - part
            self._put(high, into)
            self._put(low, source)

    def finish(self) -> None:
        self._settle(1)
        for level in np.flatnonzero(self.count):
            pieces, left = self._take(int(level)), int(level)
            while left:
                size = 1 << (left.bit_length() - 1)
                self._emit(self._cut(pieces, size))
                left -= size

    @staticmethod
    def _cut(pieces: list, size: int) -> list:
        """Takes `size` ids from the front of pieces."""
        out = []
        while size:
            piece = pieces[0]
            n = len(piece[3]) // 4
            if n <= size:
                out.append(pieces.pop(0))
            else:
                out.append([piece[0], piece[1], piece[2], piece[3][: 4 * size]])
                pieces[0] = [piece[0], piece[1], piece[2] + size, piece[3][4 * size :]]
                n = size
            size -= n
        return out

    def _emit(self, pieces: list) -> None:
        offset = 0
        for doc_id, total, start, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id, offset))
            offset += n
        self.next_id += 1

    def drain(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [[]] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in SCHEMA.split(", ")])


_tokenizers: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    """One for each Python worker, which serves many tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = CachedTokenizer(path)
    return _tokenizers[path]


def _packing(path: str, window: int, open_limit: int, cache: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        encode.limit = cache
        packer = Packer(window, open_limit, TaskContext.get().partitionId() << 36)
        end = np.array([END_ID], "<u4").tobytes()
        for b in parts(batches, rows=512):
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist()), strict=True):
                packer.add(doc_id, ids + end)
            yield packer.drain()
        packer.finish()
        yield packer.drain()

    return pack


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, open_limit: int = OPEN_LIMIT, cache: int = CACHE) -> DataFrame:
    """A row for each piece of a document: where it starts in the document, its length and the CRC-32 of its
    ids, the document's tokens, and the window and offset that it lies at. `cache` bounds the words whose ids a worker keeps."""
    return only(docs, "doc_id", "text").mapInArrow(_packing(path or default_vocabulary(), window, open_limit, cache), SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, cache=STAGE_CACHE)
