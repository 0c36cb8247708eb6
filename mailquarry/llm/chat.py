"""Chat formatting with loss masks from token offsets.

A conversation is rendered whole, encoded once, and its assistant turns' character spans are intersected with
the tokens' spans by binary search. The loss mask is a list of token runs with the characters of the turn that
each covers, so a token that reaches over a turn's edge counts only with its part.

Template: MARK_OPEN role newline text MARK_CLOSE newline for each turn. Inside roles and texts a control
string gets a backslash behind its first character and a backslash is doubled, which unescape() takes back.
Controls are the template's marks and the usual markers of other templates and tokenizers, so an escaped text
holds none of them.

Rows of a conversation come together by a shuffle on its id and a sort by turn, and are read as a stream: a
task holds one conversation at a time.

Defined results: null texts and null roles are empty; rows with the same turn go by role and then text, null
turns first; repeated rows are turns of their own; rows with a null conv_id form one conversation with a
null id. An empty table has only what is added to it. Other columns are not looked at.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import only, table

MARK_OPEN, MARK_CLOSE = "<|turn|>", "<|end|>"

#: Strings that some template or tokenizer takes as control.
CONTROLS = [
    MARK_OPEN,
    MARK_CLOSE,
    "<|endoftext|>",
    "<|startoftext|>",
    "<|im_start|>",
    "<|im_end|>",
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
]

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(MARK_OPEN) + "(.*?)\n(.*?)" + re.escape(MARK_CLOSE) + "\n", re.DOTALL)


def escape(text: str) -> str:
    """Reversible; the result holds no control string: each contains no backslash, and each has one put in."""
    return _CONTROL.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    """As escape(), and a line feed becomes a backslash and n, since it ends the role."""
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m.group(1) == "n" else m.group(1), role)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the assistant's texts in it, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{MARK_OPEN}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, MARK_CLOSE, "\n"]
        at += len(head) + len(body) + len(MARK_CLOSE) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """For each span the tokens [first, last) that meet it and the characters [start, end) of it that they cover.

    offsets are the tokens' spans, sorted; several tokens may share the bytes of one character.
    """
    starts, ends = [a for a, _ in offsets], [b for _, b in offsets]
    out = []
    for a, b in spans:
        first = bisect.bisect_right(ends, a)
        last = bisect.bisect_left(starts, b)
        if a < b and first < last:
            out.append((first, last, max(a, starts[first]), min(b, max(ends[first:last]))))
    return out


def covered(formatted: str, runs: list[tuple[int, int, int, int]], offsets: list[tuple[int, int]]) -> list[str]:
    """The text under the loss mask, read from the tokens: for each run the characters of its tokens, once each."""
    out = []
    for first, last, start, end in runs:
        at, parts = start, []
        for a, b in offsets[first:last]:
            a, b = max(a, at), min(b, end)
            if a < b:
                parts.append(formatted[a:b])
                at = b
        out.append("".join(parts))
    return out


_encoders: dict[str, object] = {}


def encoder(path: str):
    """A byte-level tokenizer that has the template's marks as special tokens; one for each worker."""
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        t.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (MARK_OPEN, MARK_CLOSE)])
        _encoders[path] = t
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


SCHEMA = "conv_id long, n_turns long, formatted string, input_ids array<int>, loss_tokens array<array<int>>, loss_text array<string>"


def _formatting(path: str):
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string())]

    def row(conv_id, turns: list[tuple[str, str]]) -> tuple:
        formatted, spans = render(turns)
        coded = encoder(path).encode(formatted, add_special_tokens=False)
        runs = mask(coded.offsets, spans)
        return conv_id, len(turns), formatted, coded.ids, [[f, n] for f, n, _, _ in runs], covered(formatted, runs, coded.offsets)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, turns, done, size = None, [], [], 0
        for b in batches:
            for conv_id, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if turns and conv_id != own:
                    done.append(row(own, turns))
                    size += len(done[-1][2])
                    turns = []
                    if size > 1 << 20:
                        yield batch(done)
                        done, size = [], 0
                own = conv_id
                turns.append((role or "", text or ""))
        if turns:
            done.append(row(own, turns))
        if done:
            yield batch(done)

    return form


def format_conversations(rows: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, n_turns, formatted, input_ids, loss_tokens (runs [first, last) of tokens) and loss_text (the
    characters under each run) of every conversation of rows (conv_id, turn, role, text)."""
    own = only(rows, "conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return own.select("conv_id", "role", "text").mapInArrow(_formatting(path or default_vocabulary()), SCHEMA)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        conv, n, formatted, loss = (b.column(i).to_pylist() for i in range(4))
        parsed = [parse(f) for f in formatted]
        turns = ["".join(f"{r}\n{t}\n" for r, t in p) for p in parsed]
        texts = ["".join(map(unescape, x)) for x in loss]
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        yield pa.RecordBatch.from_arrays(
            [pa.array(conv, pa.int64()), pa.array(map(len, parsed), pa.int64()), pa.array(map(sha, turns), pa.string()),
             pa.array(map(len, texts), pa.int64()), pa.array(map(sha, texts), pa.string()), pa.array(map(len, formatted), pa.int64())],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = only(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = format_conversations(own.union(extra)).select("conv_id", "n_turns", "formatted", "loss_text")
    return out.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '(<\|turn\|>|<\|end\|>|<\|endoftext\|>|<\|startoftext\|>|<\|im_start\|>|<\|im_end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)', '\1.', 'g') AS body FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(body) + 17) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
