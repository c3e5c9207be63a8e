"""Tokenisation re-aimed as a Spark job.

Built-in tokenizer: pieces are the matches of one regular expression that
covers every character (special markers, letter runs, digit runs, other runs,
whitespace runs), taken from the whole text and then truncated to ``max_len``.  A task
cuts the texts of a batch together by the classes of their characters; another pattern than
the built-in one goes through ``regexp_extract_all``.  Ids come from a vocabulary table: pieces counted over
the whole texts (summed in each task, so a hot piece costs one row per
task), numbered by (count desc, piece).

Texts are cut once (:func:`cut_texts`): the pass that keeps a sample's first pieces also counts the pieces of the whole texts,
and one written table holds both.

Ids are looked up through chunk dictionaries.  Samples are written in chunks of bounded size, their kept pieces as numbers
within the chunk's distinct pieces; those meet the vocabulary in a join, and the chunk gets its own small dictionary back, next to its samples.
A piece of text is a row once a chunk, whatever it occurs; no token ever is a row and no sample is put
together again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from relq.functions.runs import char_classes, split_pieces, text_parts
from relq.operators.positions import materialize, with_position
from relq.templates import CHATML, MAX_TOKENS


def piece_pattern(markers=CHATML) -> str:
    specials = "|".join(m.replace("|", r"\|") for m in (markers["start"], markers["end"], markers["eos"]))
    return specials + r"| ?\p{L}+| ?\p{N}+| ?[^ \t\n\r\p{L}\p{N}<]+|<|[ \t\n\r]+"


PIECE_RE = piece_pattern()
CHUNK_SAMPLES = 4096
MERGE_PIECES = 1 << 20  # pieces that a task holds before it merges them, and sends them on if most are distinct


def pieces(text: Column, pattern: str = PIECE_RE) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def splitter(df: DataFrame, text: Column, pattern: str) -> tuple[Column, Callable[[pa.Array], Iterator[tuple[int, int, pa.ListArray]]]]:
    """How texts become lists of pieces: the column that the tasks read, and what cuts it there, as (first row, row after
    the last, pieces) of its parts."""
    if pattern != PIECE_RE:
        return pieces(text, pattern), lambda column: iter([(0, len(column), column)])
    classes, markers = char_classes(df.sparkSession), (CHATML["start"], CHATML["end"], CHATML["eos"])
    return text, lambda column: ((lo, hi, split_pieces(column.slice(lo, hi - lo), classes.value, markers)) for lo, hi in text_parts(column))


class PieceCounts:
    """Pieces counted in a task: merged, and sent on if most are distinct, whenever ``MERGE_PIECES`` are held."""

    schema = pa.schema([("piece", pa.string()), ("count", pa.int64())])

    def __init__(self):
        self.held: list[pa.Table] = []
        self.rows = 0

    def _merge(self) -> None:
        t = pa.concat_tables(self.held).group_by("piece").aggregate([("count", "sum")])
        self.held, self.rows = [pa.table([t["piece"], t["count_sum"]], schema=self.schema)], t.num_rows

    def add(self, piece: pa.Array, count: pa.Array) -> Iterator[pa.RecordBatch]:
        self.held.append(pa.table([piece, count], schema=self.schema))
        self.rows += len(piece)
        if self.rows > MERGE_PIECES:
            self._merge()
            if self.rows > MERGE_PIECES // 2:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if len(self.held) > 1:
            self._merge()
        for t in self.held:
            yield from t.to_batches(max_chunksize=1 << 16)
        self.held, self.rows = [], 0


def piece_counts(texts: DataFrame, text_col: str, pattern: str = PIECE_RE) -> DataFrame:
    """``(piece, count)``: pieces are counted in the task that splits the texts."""
    column, lists = splitter(texts, F.col(text_col), pattern)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts()
        for _, _, own in (part for b in it for part in lists(b.column(0))):
            c = pc.value_counts(own.flatten())
            yield from counts.add(c.field("values"), c.field("counts"))
        yield from counts.rest()

    return summed(texts.select(column.alias("p")).mapInArrow(run, "piece string, count long"))


def summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("piece").agg(F.sum("count").alias("count"))


@dataclass(frozen=True)
class Cut:
    """Texts that were cut once: ``table`` holds samples with their kept pieces as numbers within a chunk (``_codes``, packed), the
    pieces of the chunks (``_chunk, _code, piece``) and the counts of all pieces of the whole texts (``piece, count``)."""

    table: DataFrame
    carried: tuple[str, ...]

    @property
    def samples(self) -> DataFrame:
        return self.table.where("_codes IS NOT NULL").select(*self.carried, "n_prompt", "n_full", "n_full_untruncated", "_codes", "_chunk")

    @property
    def words(self) -> DataFrame:
        return self.table.where("_code IS NOT NULL").select("_chunk", "_code", "piece")

    @property
    def counts(self) -> DataFrame:
        return self.table.where("count IS NOT NULL").select("piece", "count")


def build_vocab(texts: DataFrame | Cut, text_col: str = "full_text", pattern: str = PIECE_RE) -> DataFrame:
    """Vocabulary ``(piece, count, id)`` over whole texts; ids by (count desc, piece).  Texts that :func:`cut_texts` has cut
    are not read again."""
    counted = summed(texts.counts) if isinstance(texts, Cut) else piece_counts(texts, text_col, pattern)
    # the counts are small but cost a pass over every text: written once before they are numbered
    return with_position(counted, [F.col("count").desc(), F.col("piece")], name="id", materialize_input=True)


def kept_pieces(codes: pa.ListArray, length: np.ndarray, prompt_chars: pa.Array, max_len: int) -> list[pa.Array]:
    """``[n_prompt, n_full, n_full_untruncated, kept codes]`` of lists of pieces, given as numbers of distinct pieces
    of ``length`` characters.

    The tokens of the prompt are the kept pieces of the full text that start before the
    prompt's end.  Exact when ``full_text`` starts with ``prompt_text`` (the chat render
    guarantees it): pieces before the boundary are the same in both texts, and the piece that
    crosses it is one piece in either.  Capped by the number of kept pieces, as truncation does."""
    n_all = pc.list_value_length(codes).to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.minimum(n_all, max_len)
    bounds = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    kept = codes.flatten().to_numpy()[(np.cumsum(n_all) - n_all)[row] + np.arange(bounds[-1]) - bounds[row]]
    start = starts_within(length[kept], bounds)
    limit = pc.fill_null(prompt_chars, 0).to_numpy(zero_copy_only=False)
    n_prompt = np.bincount(row[start < limit[row]], minlength=len(n))
    return [*(pa.array(c, pa.int32()) for c in (n_prompt, n, n_all)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(kept))]


def packed(bounds: pa.Array, codes: pa.Array) -> pa.Array:
    """Lists of 32-bit numbers as their little-endian bytes: rows of bytes are moved and written whole, lists entry by entry."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds.to_numpy() * 4).astype(np.int32)),
                                                                pa.py_buffer(codes.to_numpy().astype("<i4"))])


def unpacked(rows: pa.ChunkedArray) -> np.ndarray:
    """The numbers of all rows that :func:`packed` made, one after the other."""
    parts = [np.frombuffer(b"".join(c.to_pylist()), dtype="<i4") for c in rows.chunks]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)


def starts_within(length: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where each piece starts in its own text: running sums of lengths between ``bounds``."""
    upto = np.concatenate([[0], np.cumsum(length)])
    return upto[:-1] - np.repeat(upto[bounds[:-1]], np.diff(bounds))


def _cut(df: DataFrame, key: str, max_len: int, pattern: str, carry: tuple[str, ...], chunk_samples: int, counted: bool) -> Cut:
    # the prompt is the head of the full text: its tokens are counted on the kept pieces of the full
    # text, so the document is split into pieces once
    column, lists = splitter(df, F.coalesce("full_text", F.lit("")), pattern)
    base = df.select(key, *carry, F.length("prompt_text").alias("_pc"), column.alias("_text"))
    own = base.schema.fields[:-2]
    counts = [StructField(n, IntegerType()) for n in ("n_prompt", "n_full", "n_full_untruncated")]
    schema = StructType([*own, *counts, StructField("_codes", BinaryType()), StructField("_chunk", LongType()),
                         StructField("_code", IntegerType()), StructField("piece", StringType()), StructField("count", LongType())])
    schema = StructType([StructField(f.name, f.dataType) for f in schema.fields])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, rows, types = TaskContext.get().partitionId() << 32, [], 0, {}

        def batch(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, types[f.name]) for f in schema.fields], names=schema.names)

        def ended() -> Iterator[pa.RecordBatch]:
            """The rows of a chunk: its samples, their pieces numbered over all parts of the chunk, and these pieces."""
            kept = pa.chunked_array([k.values for _, k in held]).unify_dictionaries()
            for (head, k), codes in zip(held, kept.chunks):
                n = len(head["n_full"])
                yield batch(**head, _codes=packed(k.offsets, codes.indices), _chunk=pa.array(np.full(n, chunk)))
            words = kept.chunk(0).dictionary
            if len(words):
                yield batch(_chunk=pa.array(np.full(len(words), chunk)), _code=pa.array(np.arange(len(words), dtype=np.int32)), piece=words)

        total = PieceCounts()
        for b in it:
            types = types or {f.name: b.schema.field(f.name).type for f in own} | {
                **{f.name: pa.int32() for f in counts}, "_codes": pa.binary(), "_chunk": pa.int64(), "_code": pa.int32(), "piece": pa.string(), "count": pa.int64()}
            for lo, hi, found in lists(b.column(len(own) + 1)):
                every = found.flatten().dictionary_encode()
                words, codes = every.dictionary, every.indices
                if counted and len(words):
                    count = pa.array(np.bincount(codes.to_numpy(), minlength=len(words)))
                    for c in total.add(words, count):
                        yield batch(piece=c.column(0), count=c.column(1))
                length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False))]).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(bounds), codes)
                head = [c.slice(lo, hi - lo) for c in b.columns[:len(own) + 1]]
                *numbers, kept = kept_pieces(found, length, head[-1], max_len)
                used = np.zeros(len(words), dtype=bool)  # a chunk holds no piece that none of its samples keeps
                used[kept.values.to_numpy()] = True
                place = (np.cumsum(used, dtype=np.int32) - np.int32(1))[kept.values.to_numpy()]
                kept = pa.ListArray.from_arrays(kept.offsets, pa.DictionaryArray.from_arrays(pa.array(place), words.filter(pa.array(used))))
                columns, at = dict(zip([f.name for f in (*own, *counts)], [*head[:-1], *numbers])), 0
                while at < hi - lo:
                    n = min(hi - lo - at, chunk_samples - rows)
                    part = kept.slice(at, n)
                    first = part.offsets.to_numpy()
                    part = pa.ListArray.from_arrays(pa.array(first - first[0]), part.values.slice(int(first[0]), int(first[-1] - first[0])))
                    held.append(({k: c.slice(at, n) for k, c in columns.items()}, part))
                    at, rows = at + n, rows + n
                    if rows == chunk_samples:
                        yield from ended()
                        chunk, held, rows = chunk + 1, [], 0
        if held:
            yield from ended()
        for c in total.rest():
            yield batch(piece=c.column(0), count=c.column(1))

    return Cut(materialize(base.mapInArrow(run, schema)), (key, *carry))


def cut_texts(df: DataFrame, key: str = "sample_id", max_len: int = MAX_TOKENS, carry: tuple[str, ...] = (),
              chunk_samples: int = CHUNK_SAMPLES) -> Cut:
    """Cut prompt/full texts by the built-in pattern in one pass, for both :func:`build_vocab` and :func:`tokenize`."""
    return _cut(df, key, max_len, PIECE_RE, carry, chunk_samples, True)


def tokenize(df: DataFrame | Cut, vocab: DataFrame, key: str = "sample_id", max_len: int = MAX_TOKENS,
             pattern: str = PIECE_RE, offsets: bool = False, carry: tuple[str, ...] = (), chunk_samples: int = CHUNK_SAMPLES) -> DataFrame:
    """``(key, *carry, input_ids, n_prompt, n_full, n_full_untruncated[, offsets])`` from prompt/full text.

    ``full_text`` must start with ``prompt_text``, as the chat render makes it.  The text is split into pieces once (a
    :class:`Cut` already was, and says key, length and carried columns itself), and the
    kept pieces (``max_len`` at most) are written in chunks; a chunk's samples and its dictionary meet in one task, where all
    pieces of all samples are looked up at once.  A piece that the vocabulary lacks has a null id.  Character offsets
    are running sums of piece lengths within a sample.  Repeated keys are samples of their own.
    """
    cut = df if isinstance(df, Cut) else _cut(df, key, max_len, pattern, carry, chunk_samples, False)
    rows, ids = cut.samples, ArrayType(IntegerType())
    plain = [f for f in rows.schema.fields if f.name not in ("_codes", "_chunk")]
    schema = StructType([*plain, StructField("input_ids", ids), *([StructField("offsets", ids)] if offsets else [])])
    words = cut.words.join(vocab.select("piece", F.col("id").cast("int").alias("id")), "piece", "left").select(
        F.col("_chunk").alias("_of"), "_code", "id", F.length("piece").alias("_length"))

    def look_up(samples: pa.Table, words: pa.Table) -> pa.Table:
        bounds = np.concatenate([[0], np.cumsum(samples["n_full"].to_numpy())]).astype(np.int32)
        code, number = unpacked(samples["_codes"]), words["_code"].to_numpy()
        at = np.zeros(len(number), dtype=np.int64)
        at[number] = np.arange(len(number))  # the place of each piece in the dictionary
        at = at[code]
        cols = [samples[f.name] for f in plain] + [pa.ListArray.from_arrays(pa.array(bounds), words["id"].combine_chunks().take(pa.array(at)))]
        if offsets:
            start = starts_within(words["_length"].to_numpy().astype(np.int64)[at], bounds)
            cols.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(start.astype(np.int32))))
        return pa.table(cols, names=schema.names)

    out = rows.groupBy("_chunk").cogroup(words.groupBy("_of")).applyInArrow(look_up, schema)
    return out.select(*cut.carried, "input_ids", "n_prompt", "n_full", "n_full_untruncated", *(["offsets"] if offsets else []))
