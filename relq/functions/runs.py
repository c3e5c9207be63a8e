"""Texts of Arrow batches cut into runs of characters of one class, all texts of a part at once.

A run is a piece of the text's own bytes: a cut text is the same data buffer under finer offsets, and no character or run is a
Python object.  The classes are those of Spark's regular expressions (``\\p{L}``, ``\\p{N}``), read off once a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SPACE, LETTER, NUMBER, OTHER, LESS = range(5)
PART_BYTES = 2 << 20  # text that is cut at once


def char_classes(spark: SparkSession):
    """Broadcast table of the class of every code point (1.1 MB)."""
    sc = spark.sparkContext
    if getattr(sc, "_relq_classes", None) is None:  # on the context itself, as the shipped package
        code = F.col("id")
        # surrogates are no characters and occur in no text
        char = F.when(~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        kind = F.when(char.rlike(r"^\p{L}$"), LETTER).when(char.rlike(r"^\p{N}$"), NUMBER).otherwise(OTHER)
        rows = spark.range(0x110000).select("id", kind.cast("int").alias("kind")).toArrow()
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        table[rows["id"].to_numpy()] = rows["kind"].to_numpy()
        table[[ord(c) for c in " \t\n\r"]], table[ord("<")] = SPACE, LESS
        sc._relq_classes = sc.broadcast(table)
    return sc._relq_classes


def text_parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``PART_BYTES`` of text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PART_BYTES, "right")))
        yield at, upto
        at = upto


class Characters:
    """The bytes of an array of texts in one row, the class of each byte's character, the first byte of each text.

    All bytes of a character have its class, so a run of characters is a run of bytes; only characters beyond ASCII are decoded."""

    def __init__(self, texts: pa.Array, classes: np.ndarray):
        texts = texts.cast(pa.binary()).fill_null(b"")
        try:
            self._read(texts, classes)
        except UnicodeDecodeError:  # what is no UTF-8 is replaced, as Spark's regular expressions see it
            self._read(pa.array([t.decode("utf-8", "replace").encode() for t in texts.to_pylist()], pa.binary()), classes)

    def _read(self, texts: pa.Array, classes: np.ndarray) -> None:
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        self.data = memoryview(texts.buffers()[2] or b"")[bounds[0]:bounds[-1]]
        self.code, self.first = np.frombuffer(self.data, dtype=np.uint8), bounds - bounds[0]
        table = np.full(256, OTHER, dtype=np.uint8)
        table[:0x80] = classes[:0x80]
        self.kind = table[self.code]
        beyond = np.flatnonzero(self.code >= 0x80)
        if len(beyond):
            str(self.data, "utf-8")  # the whole text must be UTF-8: its bytes beyond ASCII alone might look so
            chars = np.frombuffer(str(self.code[beyond], "utf-8").encode("utf-32-le"), dtype=np.uint32)
            lead = (self.code[beyond] & 0xC0) != 0x80
            self.kind[beyond] = classes[chars][np.cumsum(lead) - 1]

    def starts(self, kind: np.ndarray) -> np.ndarray:
        """Where a text or a run of one ``kind`` begins, one place more than there are bytes."""
        at = np.ones(len(kind) + 1, dtype=bool)
        np.not_equal(kind[1:], kind[:-1], out=at[1:-1])
        at[self.first] = True
        return at

    def cut(self, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """(number of the first run of each text and of all, the runs)."""
        at = np.flatnonzero(starts)
        if len(at) == 0 or at[-1] != len(self.code):
            at = np.append(at, len(self.code))
        runs = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(self.data))
        return np.searchsorted(at[:-1], self.first), runs


def split_pieces(texts: pa.Array, classes: np.ndarray, markers: tuple[str, ...]) -> pa.ListArray:
    """The pieces of each text: markers (they begin with ``<``), runs of letters, of digits, of white space and of other characters
    but ``<``, which is a piece of its own.  A single space goes with the run of letters, digits or others after it.  Null: none."""
    c = Characters(texts, classes)
    starts = c.starts(c.kind)
    less = np.flatnonzero(c.kind == LESS)
    starts[less] = True
    starts[less + 1] = True
    end = c.first[np.searchsorted(c.first, less, "right")] if len(less) else less  # of the text that holds it
    for m in markers:
        code = [ord(x) for x in m]
        found = less + len(code) <= end
        for j, x in enumerate(code[1:], 1):
            found[found] = c.code[less[found] + j] == x
        at = less[found]
        starts[(at[:, None] + np.arange(1, len(code))).ravel()] = False
        starts[at + len(code)] = True
        less, end = less[~found], end[~found]
    # a run of one space: its start, the start after it, and what follows in the same text
    alone = np.flatnonzero(starts[:-2] & starts[1:-1] & (c.code[:-1] == 0x20)) if len(c.code) > 1 else np.empty(0, np.int64)
    after = c.kind[alone + 1]
    begins = np.zeros(len(c.code) + 1, dtype=bool)
    begins[c.first] = True
    alone = alone[((after == LETTER) | (after == NUMBER) | (after == OTHER)) & ~begins[alone + 1]]
    starts[alone + 1] = False
    bounds, runs = c.cut(starts)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), runs)


def split_words(texts: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(row, word) of all words of the texts: runs of letters, digits and underscores."""
    c = Characters(texts, classes)
    word = (c.kind == LETTER) | (c.kind == NUMBER) | (c.code == ord("_"))
    starts = c.starts(word)
    bounds, runs = c.cut(starts)
    own = word[starts[:-1]]
    return np.repeat(np.arange(len(texts)), np.diff(bounds))[own], runs.filter(pa.array(own))
