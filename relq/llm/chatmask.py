"""Operator 3: chat formatting with offset-aligned loss masks.

A conversation is rendered as one text, encoded once with character offsets, and the loss mask is
the intersection of two sorted lists of spans, the assistant texts and the tokens: a binary search
finds the first and the last token of each text.  A token that reaches beyond a text (it may hold the
line end before it) carries the part inside, so the mask covers exactly the assistant texts.

Template: ``<|im_start|>role\\n text <|im_end|>\\n`` (without the spaces).  Inside texts a backslash is
doubled and ``<|`` becomes ``<\\|``, so no control string can occur; a role's line ends become ``\\n`` in
letters.  Both are undone when the output is read back.

A conversation of more than ``BLOCK_TURNS`` turn numbers is formatted in blocks of that many, cut
between turns, so that a conversation with a third of all rows is work for many tasks; within a
block, texts are encoded in parts of about ``PART_CHARS``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.llm.common import read

START, END = "<|im_start|>", "<|im_end|>"
BLOCK_TURNS = 1024
PART_CHARS = 1 << 20
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL)


def render(turns: list[tuple[str, str]], loss_role: str = LOSS_ROLE) -> tuple[str, np.ndarray]:
    """The text of (role, text) turns and the [start, end) spans of the texts that bear loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == loss_role and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{END}\n")
        at += len(parts[-1])
    return "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)


def parse(text: str) -> Iterator[tuple[str, str]]:
    """The turns of a rendered text."""
    at = 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        line = text.index("\n", at)
        end = text.index(END, line)
        yield unescape_role(text[at + len(START):line]), unescape(text[line + 1:end])
        at = end + len(END) + 1


def align(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the part [from, to) of it that lies in a span; from = to where none does."""
    lo, hi = starts.copy(), starts.copy()
    for a, b in spans.tolist():
        first = int(np.searchsorted(ends, a, side="right"))
        last = int(np.searchsorted(starts, b, side="left"))
        lo[first:last] = np.maximum(starts[first:last], a)
        hi[first:last] = np.minimum(ends[first:last], b)
    return lo, hi


def loss_text(text: str, lo: list[int], hi: list[int]) -> str:
    """The text under the mask, unescaped; tokens that share a character count it once."""
    out, done = [], 0
    for a, b in zip(lo, hi):
        a = max(a, done)
        if b > a:
            out.append(text[a:b])
            done = b
    return unescape("".join(out))


_TOKENIZERS: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True  # their strings are ordinary text here
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


OUT_SCHEMA = ("conv_id long, block long, part int, n_turns int, text string, ids array<int>, "
              "starts array<int>, ends array<int>, loss_from array<int>, loss_to array<int>")


def format_conversations(conv: DataFrame, path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", block_turns: int = BLOCK_TURNS, part_chars: int = PART_CHARS) -> DataFrame:
    """One row a conversation (more for very long ones, in order of ``block, part``): the rendered text, its
    token ids, their character offsets and, per token, the characters that bear loss.

    Turns are ordered by turn number, then role and text; a null turn number comes first.  Null roles
    and texts are empty.  Rows with a null conversation id form one conversation.
    """
    i32 = pa.list_(pa.int32())
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("n_turns", pa.int32()), ("text", pa.string()),
                        ("ids", i32), ("starts", i32), ("ends", i32), ("loss_from", i32), ("loss_to", i32)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        key, part, turns, size = None, 0, [], 0

        def emit() -> pa.RecordBatch:
            text, spans = render(turns)
            e = tok.encode(text, add_special_tokens=False)
            offsets = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
            lo, hi = align(offsets[:, 0], offsets[:, 1], spans)
            row = [key[0], key[1], part, len(turns), text, e.ids, offsets[:, 0], offsets[:, 1], lo, hi]
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema)], schema=schema)

        for b in it:
            for c, k, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (c, k) != key or size > part_chars:
                    if turns:
                        yield emit()
                    part = part + 1 if (c, k) == key else 0
                    key, turns, size = (c, k), [], 0
                turns.append((role, text))
                size += len(text)
        if turns:
            yield emit()

    blank = F.lit("")
    rows = conv.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                       F.coalesce(F.col(role_col), blank).alias("role"), F.coalesce(F.col(text_col), blank).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 62))))
    return (rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
            .select("conv_id", "block", "role", "text").mapInArrow(run, OUT_SCHEMA))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the output of :func:`format_conversations` alone: a row a conversation.

    SHA-256 must be fed in order, so the blocks of a conversation stream through one task, one at a time.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None

        def done() -> tuple:
            return key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for b in it:
            out = []
            for c, text, lo, hi in zip(*(b.column(i).to_pylist() for i in range(4))):
                if state is None or c != key:
                    if state is not None:
                        out.append(done())
                    key, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, turn in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{turn}\n".encode())
                loss = loss_text(text, lo, hi)
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, type=pa.int64()) for i, c in enumerate(zip(*out))], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) if i else pa.array([v], type=pa.int64()) for i, v in enumerate(done())], names)

    return (formatted.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part").select("conv_id", "text", "loss_from", "loss_to")
            .mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


CONTROL = f"{END}{START}assistant ok"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``conversations`` and conversation -1.

    Null texts are empty; long texts go in parts; rows that repeat a turn number are turns of their own, in the order of
    role and text; a null conv_id is a conversation like any other; an empty table leaves conversation -1; columns beyond
    ``conv_id, turn, role, text`` are not read.
    """
    conv = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(conv.unionByName(extra), tokenizer_path()))


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'))
             + length('<|im_start|>') + length('<|im_end|>') + 2 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
