"""Operator 6: vector best-fit packing of token sequences.

Every document becomes its token ids and an end id; documents longer than a sequence are cut into
full sequences and a last, shorter piece.  A sequence has three capacities: tokens, documents and
attention cost (the sum of squared piece lengths).  A full piece fills a sequence alone.  The rest are
packed by vector best-fit decreasing: pieces in falling size, each into the open sequence that fits
it under every capacity and scores best, by the dot product of demand and residual (weighted by the
capacities) or by the smallest norm of what would stay free; a new one opens if none fits.

Packing is done in blocks of a bounded number of pieces: a block holds a spread of all lengths (pieces
are dealt by hash), so each wastes less than a sequence or two.  No block grows with the corpus.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.llm.common import batches_of, materialize, read, unused
from relq.llm.substrings import word_hashes

TOKENS = 2048
DOCUMENTS = TOKENS  # documents of a sequence: none is shorter than its end id
ATTENTION = TOKENS * TOKENS  # sum of squared piece lengths of a sequence
BLOCK_PIECES = 20_000
RUN_BYTES = 1 << 20  # text that is read at once
_ODD_SPACE = re.compile(rb"[\t\x0b\x0c\r]")

# ---- tokens -------------------------------------------------------------------------------------

_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:;=?@\[-`{}~]+")  # no digits, quotes, < > |
_PIECES = re.compile(r"[^\W\d_]+|(?:[^\w]|_)+")


class WordTokenizer:
    """Ids of white-space separated words of a word-end BPE file, with a bounded store of known words.

    No token spans white space, so a text's ids are those of its words in order.  Words of plain
    letters and marks are merged in batches by a byte-pair coder built from the same file (its merges
    by rank, the word end as a zero byte); any other word is given to the tokenizer itself.  Known words are found by their
    64-bit hashes; the store is emptied when it is full.
    """

    def __init__(self, path: str, known: int = 500_000):
        import tiktoken
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte_of = {c: b for b, c in _byte_letters().items()}
        # ranks of the coder: 0-255 the bytes, then the file's tokens in the order of their ids (= of their merges)
        ranks, ids, end = {bytes([b]): b for b in range(256)}, {}, "</w>"
        for rank, (token, i) in enumerate(sorted(vocab.items(), key=lambda x: x[1]), start=256):
            word = token.endswith(end) and token != end
            try:
                raw = bytes(byte_of[c] for c in (token[:-len(end)] if word else token)) + (b"\0" if word else b"")
            except KeyError:  # special tokens
                continue
            if len(raw) > 1:
                ranks[raw] = rank
            ids[ranks[raw]] = i
        self.coder = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.to_id = np.zeros(max(ranks.values()) + 1, dtype="<u4")
        self.to_id[list(ids)] = list(ids.values())
        self.closes = np.zeros(len(self.to_id), dtype=bool)
        self.closes[[r for raw, r in ranks.items() if raw.endswith(b"\0")]] = True
        self.limit = known
        self._forget()

    def _forget(self) -> None:
        """The store: hashes of words, rising, and where their ids lie in ``flat``."""
        self.hashes, self.at, self.size = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype="<u4")

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Little-endian ids of words."""
        out: dict[str, bytes] = {}
        plain = [w for w in words if _PLAIN.fullmatch(w)]
        if plain:
            parts = [_PIECES.findall(w.lower()) for w in plain]
            ranks = np.array(self.coder.encode_ordinary("".join(p + "\0" for q in parts for p in q)), dtype=np.int64)
            raw = self.to_id[ranks].tobytes()
            stops = np.flatnonzero(self.closes[ranks]) + 1  # one a part
            ends = (stops[np.cumsum([len(q) for q in parts]) - 1] * 4).tolist()
            at = 0
            for w, e in zip(plain, ends):
                out[w] = raw[at:e]
                at = e
        other = [w for w in words if w not in out]
        for w, e in zip(other, self.library.encode_batch_fast(other, add_special_tokens=False) if other else ()):
            out[w] = np.array(e.ids, dtype="<u4").tobytes()
        return out

    def encode_batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        held: list[bytes] = []
        size = 0
        for t in texts:
            raw = (t or "").encode("utf-8", "surrogatepass")
            if size and size + len(raw) > RUN_BYTES:
                yield from self._together(held)
                held, size = [], 0
            if len(raw) > RUN_BYTES:
                yield b"".join(x for part in _parts(raw, RUN_BYTES) for x in self._together([part]))
                continue
            held.append(raw)
            size += len(raw) + 1
        yield from self._together(held)

    def _together(self, texts: list[bytes]) -> list[bytes]:
        """The ids of a few texts: distinct words are looked up by their 64-bit hashes, then the ids of all words are laid out."""
        stream = b"\n".join(texts)
        if _ODD_SPACE.search(stream):  # white space that does not end a word here
            return [self._singly(t) for t in texts]
        start, h = word_hashes(stream)
        order = np.argsort(h, kind="stable")
        s = h[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, dtype=np.int64)
        found = s[first]
        place = np.searchsorted(self.hashes, found)
        new = place == len(self.hashes)
        new[~new] = self.hashes[place[~new]] != found[~new]
        if new.any():
            if len(self.hashes) > self.limit:
                self._forget()
                new[:] = True
            words = stream.split()
            ids = self._learn([words[i].decode("utf-8", "surrogatepass") for i in order[first[new]].tolist()])
            self._store(found[new], [ids[words[i].decode("utf-8", "surrogatepass")] for i in order[first[new]].tolist()])
            place = np.searchsorted(self.hashes, found)
        own = np.empty(len(h), dtype=np.int64)
        own[order] = np.repeat(place, np.diff(first, append=len(s)))
        size = self.size[own]
        end = np.cumsum(size)
        out = self.flat[np.repeat(self.at[own] - (end - size), size) + np.arange(end[-1] if len(end) else 0)].tobytes()
        words_of = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
        cut = [0, *(np.concatenate([[0], end])[words_of] * 4).tolist()]
        return [out[a:b] for a, b in zip(cut, cut[1:])]

    def _store(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        size = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        at = np.searchsorted(self.hashes, hashes)
        begin = len(self.flat) + np.cumsum(size) - size
        self.hashes, self.at, self.size = (np.insert(a, at, b) for a, b in ((self.hashes, hashes), (self.at, begin), (self.size, size)))
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), dtype="<u4")])

    def _singly(self, text: bytes) -> bytes:
        words = text.decode("utf-8", "surrogatepass").replace("\n", " ").split(" ")
        ids = self._learn(sorted({w for w in words if w}))
        return b"".join([ids[w] for w in words if w])


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the file: printable ones themselves, the others from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _parts(text: bytes, size: int) -> Iterator[bytes]:
    """A long text, cut at blanks and line ends into parts of about ``size`` bytes."""
    at = 0
    while at < len(text):
        stop = min((i for i in (text.find(b" ", at + size), text.find(b"\n", at + size)) if i >= 0), default=len(text))
        yield text[at:stop]
        at = stop


_CODERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One a Python worker, kept between tasks."""
    if path not in _CODERS:
        _CODERS[path] = WordTokenizer(path)
    return _CODERS[path]


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS, end_id: int = 0) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document's ids and the end id, cut at ``tokens``.

    Null and empty texts are the end id alone.  Rows that repeat an id are documents of their own
    (their pieces repeat).  ``ids_crc32`` is that of the piece's little-endian unsigned 32-bit ids.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((n, pa.int64()) for n in names[2:])])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokenizer(path)
        for big in it:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                out: list[tuple] = []
                for d, ids in zip(b.column(0).to_pylist(), coder.encode_batch(b.column(1).to_pylist())):
                    ids += end
                    for piece, a in enumerate(range(0, len(ids), 4 * tokens)):
                        part = ids[a:a + 4 * tokens]
                        out.append((d, piece, a // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long"))


# ---- best fit -----------------------------------------------------------------------------------

def best_fit(lengths: np.ndarray, tokens: int = TOKENS, documents: int | None = None, attention: int | None = None,
             rule: str = "dot") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece by vector best-fit decreasing.

    Bins of equal residuals are alike, so they are kept as stacks by residual (tokens, documents,
    attention); a piece looks at the distinct residuals with room for it, not at the bins.  Without a
    capacity for documents or attention only the token residual tells bins apart, and both rules choose
    the fullest bin that fits.  A piece above a capacity by itself is an error.
    """
    if rule not in ("dot", "norm"):
        raise ValueError("rule must be 'dot' or 'norm'")
    n_cap = documents if documents is not None else float("inf")
    a_cap = attention if attention is not None else float("inf")
    if len(lengths) and (lengths.max() > tokens or int(lengths.max()) ** 2 > a_cap or n_cap < 1):
        raise ValueError("a piece exceeds a capacity")
    scale = np.array([1 / tokens, 0 if n_cap == float("inf") else 1 / n_cap, 0 if a_cap == float("inf") else 1 / a_cap])
    where, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    keys: list[tuple] = []  # sorted distinct residuals
    stacks: dict[tuple, list[int]] = {}
    bins = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        best, best_score = None, None
        for k in range(bisect_left(keys, (n,)), len(keys)):
            key = keys[k]
            if key[1] < 1 or key[2] < n * n:
                continue
            if not scale[1] and not scale[2]:
                best = key  # keys rise by free tokens: the first is the fullest bin
                break
            free = np.array([key[0], key[1] if scale[1] else 0, key[2] if scale[2] else 0]) * scale
            need = np.array([n, 1 if scale[1] else 0, n * n if scale[2] else 0]) * scale
            score = float(((free - need) ** 2).sum()) if rule == "norm" else float((free * need).sum() / max(1e-12, (free ** 2).sum() ** 0.5) * -1 + (free - need).sum())
            if best_score is None or score < best_score:
                best, best_score = key, score
        if best is None:
            b, best = bins, (tokens, n_cap, a_cap)
            bins += 1
        else:
            stack = stacks[best]
            b = stack.pop()
            if not stack:
                del stacks[best]
                keys.pop(bisect_left(keys, best))
        where[i], offset[i] = b, tokens - best[0]
        left = (best[0] - n, best[1] - 1, best[2] - n * n)
        if left[0] > 0:
            if left not in stacks:
                insort(keys, left)
                stacks[left] = []
            stacks[left].append(b)
    return where, offset


def pack(pieces: DataFrame, tokens: int = TOKENS, documents: int | None = None, attention: int | None = None,
         rule: str = "dot", block: int = BLOCK_PIECES) -> DataFrame:
    """``pieces`` (any columns, with ``doc_id, piece, length``) plus ``sequence_id`` and ``offset``.

    ``sequence_id`` is unique, not dense.  Pieces are packed in ``ceil(count / block)`` blocks.  Input columns that have the two new
    names are replaced.  Rows that repeat a piece are pieces of their own, null ids are allowed, equal lengths may go
    either way; a null length or one above a capacity is an error; an empty table gives an empty one.
    """
    written = materialize(pieces.drop("sequence_id", "offset"))
    block_col, = unused(written, "block")
    full = F.col("length") == tokens
    n_full, n_rest = written.agg(F.count_if(full), F.count_if(~full)).first()
    blocks = max(1, -(-n_rest // block))
    cols = written.columns
    schema = written.schema.add("sequence_id", "long").add("offset", "long")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; a block is at most about ``block`` rows."""
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            where, offset = best_fit(t["length"].to_numpy(), tokens, documents, attention, rule)
            seq = (t[block_col].to_numpy().astype(np.int64) << 40) + where
            out = t.drop_columns([block_col]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))
            yield from out.to_batches(max_chunksize=65536)

        for b in it:
            marks = b.column(b.num_columns - 1).to_numpy()
            at = 0
            while at < len(marks):
                stop = int(np.searchsorted(marks, marks[at], side="right"))
                if held and held[0].column(held[0].num_columns - 1)[0].as_py() != marks[at]:
                    yield from flush()
                    held = []
                held.append(b.slice(at, stop - at))
                at = stop
        if held:
            yield from flush()

    # a full piece is a sequence by itself; its id is drawn from the rows' own numbers, beyond all blocks
    alone = written.where(full).select(*cols, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    mark = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    rest = (written.where(~full).withColumn(block_col, mark).repartition(block_col).sortWithinPartitions(block_col, "doc_id", "piece")
            .select(*cols, block_col).mapInArrow(run, schema))
    return rest.unionByName(alone)


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` in sequences of 2,048 tokens, 2,048 documents and 2,048 squared of attention.

    Null and empty texts are their end id; long texts are cut; repeated rows and ids are pieces of their own; an empty table
    gives no rows; columns beyond ``doc_id`` and ``text`` are not read.
    """
    pieces = token_pieces(read(spark, sf_dir, "documents"), tokenizer_path())
    return pack(pieces, documents=DOCUMENTS, attention=ATTENTION).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
