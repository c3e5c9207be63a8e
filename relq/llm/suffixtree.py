"""Operator 7: language-model scoring with a probabilistic suffix tree.

The symbols are the bytes of a text's tokens (words, A-Z lower-cased, with one space between) and one
line end that closes the text; no word holds either byte, so token sequences and symbol sequences are
the same thing.  The tree's contexts have up to ``DEPTH`` symbols.  A context is kept if it occurs
``MIN_COUNT`` times in the training symbols, however many there are, and its next-symbol distribution
diverges from that of the context one shorter (by ``MIN_KL`` nats a symbol, and beyond what its sample size
explains); the suffixes of a kept context are kept as well.  Distributions are smoothed towards that of the
next shorter context, the root's towards equal shares of all 256 bytes.  The longest kept suffix of what was
read scores the next symbol.

The tree grows with the corpus, so it is never in one place.  A *gram* is a full-depth context and its next
symbol; each chunk of texts (below) sends its distinct grams, with their training counts, to buckets by the
context's last three symbols.  A bucket has all that contexts of three symbols and more need: it sums
the counts, prunes, and finds the probabilities of its grams.  Chunks are dealt to groups, as many as the root of
their number: the grams of a group's chunks are summed before the bucket sees them, and probabilities go back
the same way, so no task meets the grams of all chunks.  Contexts of one and two
symbols (at most 256 + 65,536) are counted on the driver and broadcast.

The base score needs the corpus count of every word of every text, which no broadcast can hold.  Texts
are dealt once into chunks of bounded size; distinct words by chunk meet their counts in a join, and each
chunk gets back the counts of its own words, next to its texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.llm.common import batches_of, materialize, read, training_row
from relq.llm.substrings import word_hashes

DEPTH = 5  # longest context in bytes; with the next symbol it must fit a long
MIN_COUNT = 3
MIN_KL = 0.002
PRIOR = 4.0  # weight of the shorter context, in symbols
CHUNK_BYTES = 32 << 20
END = 10  # the line end that closes a text and fills the context before it
LOW = 2  # contexts up to this length are on the driver
BUCKETS = 1024
PART_BYTES = 2 << 20  # text whose grams a task sorts at once
WORD_BYTES = 1 << 20  # text whose words it hashes at once


# ---- texts and chunks ---------------------------------------------------------------------------

def tokens_of(text: bytes | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased; none for null, empty and blank ones."""
    return (text or b"").lower().split()  # bytes: lower() and split() know ASCII only


def chunked(docs: DataFrame, id_col: str, text_col: str, training, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(chunk, doc_id, training, text)`` with normal text; a chunk has about ``chunk_bytes`` (or one long text)."""
    schema = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("training", pa.bool_()), ("text", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for b in it:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                texts = [b" ".join(tokens_of(t)) for t in part.column(2).to_pylist()]
                chunks = []
                for t in texts:
                    if size and size + len(t) > chunk_bytes:
                        chunk, size = chunk + 1, 0
                    chunks.append(chunk)
                    size += len(t) + 1
                yield pa.RecordBatch.from_arrays([pa.array(chunks, type=pa.int64()), part.column(0), part.column(1), pa.array(texts, type=pa.binary())], schema=schema)

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), training.alias("training"), F.col(text_col).cast("binary").alias("text"))
            .mapInArrow(run, "chunk long, doc_id long, training boolean, text binary"))


def hashed_words(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(the texts as one stream, the 64-bit hash of each of its words, the text it belongs to)."""
    stream = b"\n".join(texts)
    start, h = word_hashes(stream)
    begin = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
    return stream, h, np.repeat(np.arange(len(texts)), np.diff(begin, prepend=0))


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts h, first place of each value in it)."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, dtype=np.int64)


def word_counts(chunks: DataFrame) -> DataFrame:
    """``(chunk, word, k)``: the words of each chunk's texts with their occurrences in training texts (0: none).

    Inside a chunk words are told apart by 64-bit hashes (two of a million distinct ones fall together in one of
    3 * 10^7 chunks), between chunks by themselves.  A chunk that several tasks read has several rows a word."""
    schema = pa.schema([("chunk", pa.int64()), ("word", pa.binary()), ("k", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, texts, training, size = None, [], [], 0
        h, k, words = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object)

        def add() -> None:
            nonlocal h, k, words, texts, training, size
            stream, own, text = hashed_words(texts)
            order, at = _runs(own)
            if len(at):
                times = np.add.reduceat(np.array(training, dtype=np.int64)[text[order]], at)
                found = own[order[at]]
                place = np.searchsorted(h, found)
                old = place < len(h)
                old[old] = h[place[old]] == found[old]
                k[place[old]] += times[old]
                split = stream.split()
                fresh = np.empty(int((~old).sum()), dtype=object)
                fresh[:] = [split[i] for i in order[at[~old]].tolist()]
                h, k, words = (np.insert(a, place[~old], b) for a, b in ((h, found[~old]), (k, times[~old]), (words, fresh)))
            texts, training, size = [], [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal h, k, words
            if texts:
                add()
            yield from batches_of({"chunk": np.full(len(k), chunk), "word": words, "k": k}, schema)
            h, k, words = h[:0], k[:0], words[:0]

        for b in it:
            for i in range(b.num_rows):
                c, train, text = (b.column(n)[i].as_py() for n in range(3))
                if c != chunk:
                    if chunk is not None:
                        yield from emit()
                    chunk = c
                texts.append(text)
                training.append(train)
                size += len(text)
                if size >= WORD_BYTES:
                    add()
        if chunk is not None:
            yield from emit()

    return chunks.select("chunk", "training", "text").mapInArrow(run, "chunk long, word binary, k long")


# ---- counting -----------------------------------------------------------------------------------

def _stream(texts: list[bytes]) -> np.ndarray:
    """Texts with ``DEPTH`` line ends before and one after each."""
    return np.frombuffer(b"".join(x for t in texts for x in (bytes([END]) * DEPTH, t, bytes([END]))), dtype=np.uint8)


def _gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context, next symbol) of full depth as packed numbers, sorted, with counts."""
    s = _stream(texts)
    n = len(s) - DEPTH
    g = s[:n].astype(np.int64)
    for i in range(1, DEPTH + 1):  # in place: a part's grams stand in memory once
        np.left_shift(g, 8, out=g)
        np.bitwise_or(g, s[i:i + n], out=g)
    for e in np.cumsum([len(t) + 1 + DEPTH for t in texts])[:-1].tolist():  # windows that reach into the next text's filling are none
        g[e - DEPTH:e] = -1
    g.sort()
    g = g[(len(texts) - 1) * DEPTH:]
    at = np.flatnonzero(g[1:] != g[:-1]) + 1
    at = np.concatenate([[0], at])
    return g[at], np.diff(at, append=len(g))


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")  # keys are sorted runs, which a stable sort merges
    keys = keys[order]
    at = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return keys[at], np.add.reduceat(counts[order], at)


_ZSTD: list = []


def _coders() -> list:
    if not _ZSTD:  # one pair a Python worker
        _ZSTD.extend([zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()])
    return _ZSTD


def _pack(x: np.ndarray) -> bytes:
    """Longs, compressed byte place by byte place."""
    return _coders()[0].compress(np.ascontiguousarray(x, dtype="<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(x: bytes) -> np.ndarray:
    raw = _coders()[1].decompress(x)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _pack_grams(g: np.ndarray) -> bytes:
    return _pack(np.diff(g, prepend=0))


def _unpack_grams(x: bytes) -> np.ndarray:
    return np.cumsum(_unpack(x))


def chunk_grams(chunks: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(chunk, bucket, grams, k)``: the distinct grams of each chunk's texts, sorted, and their occurrences in training
    texts (0: none), packed, a row a bucket.  A chunk that several tasks read has several rows a bucket."""
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("grams", pa.binary()), ("k", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        chunk, held, texts, size = None, (none, none), ([], []), 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            parts = [held]
            for t, training in zip(texts, (0, 1)):
                if t:
                    g, c = _gram_counts(t)
                    parts.append((g, c * training))
                    t.clear()
            return _sums(*(np.concatenate(x) for x in zip(*parts)))

        def emit(g: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            bucket = (((((g >> 8) & 0xFFFFFF) * 0x9E3779B1) & 0xFFFFFFFF) * BUCKETS >> 32).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            own, at = np.unique(bucket[order], return_index=True)
            g, c = (np.split(x[order], at[1:]) for x in (g, c))
            yield from batches_of({"chunk": np.full(len(own), chunk), "bucket": own, "grams": [_pack_grams(x) for x in g],
                                   "k": [_pack(x) for x in c]}, schema, 1024)

        for b in it:
            for i in range(b.num_rows):  # a text at a time
                c, train, text = (b.column(k)[i].as_py() for k in range(3))
                if c != chunk:
                    if chunk is not None:
                        yield from emit(*merged())
                    chunk, held, size = c, (none, none), 0
                texts[bool(train)].append(text)
                size += len(text)
                if size >= part_bytes:
                    held = merged()
                    size = 0
        if chunk is not None:
            yield from emit(*merged())

    return chunks.select("chunk", "training", "text").mapInArrow(run, "chunk long, bucket int, grams binary, k binary")


def low_counts(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a context of ``LOW`` symbols and its next symbol in all texts, with their training counts."""
    schema = pa.schema([("pair", pa.int64()), ("c", pa.int64())])
    mask = (1 << 8 * (LOW + 1)) - 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, dtype=np.int64),) * 2
        for b in it:
            if b.num_rows:
                g = np.concatenate([_unpack_grams(x) for x in b.column(0).to_pylist()])
                k = np.concatenate([_unpack(x) for x in b.column(1).to_pylist()])
                held = _sums(np.concatenate([held[0], g & mask]), np.concatenate([held[1], k]))
        yield from batches_of({"pair": held[0], "c": held[1]}, schema)

    t = grams.select("grams", "k").mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    pair, c = (t[x].to_numpy().astype(np.int64) for x in ("pair", "c"))
    order = np.argsort(pair)
    return pair[order], c[order]


# ---- levels -------------------------------------------------------------------------------------

class Level:
    """The contexts of one length.  ``key`` are its sorted (context, next symbol) pairs with counts ``c``, ``ctx`` its contexts
    and ``at`` the place of each pair's context; ``q`` is a pair's share in its context, ``p`` its probability if
    the context is kept; ``apart`` says which contexts reach the count and pass the divergence test."""

    def __init__(self, d: int, grams: np.ndarray, counts: np.ndarray, up: "Level | None", least: float, min_kl: float, prior: float):
        self.d = d
        self.key, c = _sums(grams & _mask(d), counts)
        self.ctx, self.at = np.unique(self.key >> 8, return_inverse=True)
        total = np.bincount(self.at, weights=c, minlength=len(self.ctx))
        self.q = c / np.maximum(total, 1)[self.at]
        if up is None:
            self.p, self.apart = (c + 1) / (total[self.at] + 256), np.ones(len(self.ctx), dtype=bool)
            return
        below = up.find(self.key)
        self.p = (c + prior * up.p[below]) / (total[self.at] + prior)
        seen = c > 0
        kinds = np.bincount(self.at[seen], minlength=len(self.ctx))
        kl = np.bincount(self.at[seen], weights=self.q[seen] * np.log(self.q[seen] / up.q[below[seen]]), minlength=len(self.ctx))
        self.apart = (total >= max(1, least)) & (kl >= min_kl) & (kl * total >= 0.5 * kinds * np.log(np.maximum(total, 1)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The places of the pairs that end longer ones."""
        return np.searchsorted(self.key, keys & _mask(self.d))


def _mask(d: int) -> int:
    return (1 << 8 * (d + 1)) - 1


def _keep(levels: list[Level], kept_beyond: np.ndarray) -> list[np.ndarray]:
    """Which contexts of the levels, shortest first, are kept; ``kept_beyond`` are kept contexts one longer than the last level's."""
    out = []
    for lv in reversed(levels):
        kept = lv.apart | np.isin(lv.ctx, kept_beyond & (_mask(lv.d) >> 8))
        kept_beyond = lv.ctx[kept]
        out.append(kept)
    return out[::-1]


def _longest(grams: np.ndarray, levels: list[Level], kept: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """``p``, replaced by the probability in the longest kept context of each gram."""
    for lv, k in zip(levels, kept):
        at = lv.find(grams)
        p = np.where(k[lv.at[at]], lv.p[at], p)
    return p


def gram_costs(grams: DataFrame, min_count: int = MIN_COUNT, min_kl: float = MIN_KL, prior: float = PRIOR) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``(chunk, grams, cost)``: log10 probabilities of each chunk's grams (packed floats) where a context longer than ``LOW`` is
    kept, else NaN, and the pairs of ``LOW`` symbols and the next with the log10 probabilities that hold there."""
    pair, c = low_counts(grams)
    least = max(1, min_count)
    low: list[Level] = []
    for d in range(LOW + 1):
        low.append(Level(d, pair, c, low[-1] if low else None, least, min_kl, prior))
    shared = grams.sparkSession.sparkContext.broadcast(low[-1])
    none = np.zeros(0, dtype=np.int64)
    groups = max(1, math.isqrt(grams.select("chunk").distinct().count()))
    own = grams.withColumn("team", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int"))

    def all_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return _sums(np.concatenate([_unpack_grams(x) for x in t["grams"].to_pylist()]), np.concatenate([_unpack(x) for x in t["k"].to_pylist()]))

    def team_sums(t: pa.Table) -> pa.Table:
        g, k = all_of(t)
        return pa.table({"bucket": t["bucket"][:1], "team": t["team"][:1], "grams": pa.array([_pack_grams(g)]), "k": pa.array([_pack(k)])})

    schema = pa.schema([("bucket", pa.int32()), ("team", pa.int32()), ("grams", pa.binary()), ("cost", pa.binary())])

    def probabilities(t: pa.Table) -> pa.Table:
        g, k = all_of(t)
        levels = [shared.value]
        for d in range(LOW + 1, DEPTH + 1):
            levels.append(Level(d, g, k, levels[-1], least, min_kl, prior))
        levels = levels[1:]
        kept = _keep(levels, none)
        cost = np.log10(_longest(g, levels, kept, np.full(len(g), np.nan))).astype(np.float32)
        texts = t["grams"].to_pylist()
        parts = [cost[np.searchsorted(g, _unpack_grams(x))].tobytes() for x in texts]
        # a row without a team: the contexts of LOW symbols that are kept because a longer one is
        roots = np.unique(levels[0].ctx[kept[0]] & (_mask(LOW) >> 8))
        return pa.table([[*t["bucket"].to_pylist(), None], [*t["team"].to_pylist(), None], [*texts, roots.tobytes()], [*parts, None]], schema=schema)

    summed = own.groupBy("bucket", "team").applyInArrow(team_sums, "bucket int, team int, grams binary, k binary")
    costs = materialize(summed.groupBy("bucket").applyInArrow(probabilities, "bucket int, team int, grams binary, cost binary"))
    out = pa.schema([("chunk", pa.int64()), ("grams", pa.binary()), ("cost", pa.binary())])

    def to_chunks(left: pa.Table, right: pa.Table) -> pa.Table:
        """The probabilities of a team's grams, dealt to its chunks."""
        if not left.num_rows:
            return out.empty_table()
        g = _unpack_grams(right["grams"][0].as_py())
        cost = np.frombuffer(right["cost"][0].as_py(), dtype=np.float32)
        return pa.table([left["chunk"], left["grams"], [cost[np.searchsorted(g, _unpack_grams(x))].tobytes() for x in left["grams"].to_pylist()]], schema=out)

    dealt = (own.select("bucket", "team", "chunk", "grams").groupBy("bucket", "team")
             .cogroup(costs.where("team is not null").groupBy("bucket", "team")).applyInArrow(to_chunks, "chunk long, grams binary, cost binary"))
    roots = costs.where("team is null and grams != x''").select("grams").distinct().collect()
    beyond = np.unique(np.concatenate([none, *(np.frombuffer(r.grams, dtype=np.int64) for r in roots)]))
    kept = _keep(low, beyond)
    return dealt, pair, np.log10(_longest(pair, low, kept, np.zeros(len(pair)))).astype(np.float32)


class Costs:
    """The costs of grams in a hash table of 2 to 4 places a gram; a taken place sends a gram to the next one."""

    def __init__(self, grams: np.ndarray, cost: np.ndarray):
        bits = max(4, (2 * len(grams)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.cost = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.float32)
        step = 0
        while len(grams):
            at = self.place(grams, step)
            free = self.keys[at] == -1
            self.keys[at[free]] = grams[free]
            put = self.keys[at] == grams
            self.cost[at[put]] = cost[put]
            grams, cost, step = grams[~put], cost[~put], step + 1

    def place(self, grams: np.ndarray, step: int) -> np.ndarray:
        at = ((grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)
        return (at + step) & self.last if step else at

    def of(self, grams: np.ndarray) -> np.ndarray:
        """The costs of grams that are all in the table."""
        at = self.place(grams, 0)
        out = self.cost[at]
        left, step = np.flatnonzero(self.keys[at] != grams), 1
        while len(left):
            if step > self.last:
                raise KeyError("a gram without a cost")
            at = self.place(grams[left], step)
            out[left] = self.cost[at]
            left, step = left[self.keys[at] != grams[left]], step + 1
        return out


def score_grams(texts: list[bytes], costs: Costs, step: int = 1 << 17) -> np.ndarray:
    """log10 probability of each text and its end."""
    s = _stream(texts)
    off = np.concatenate([[0], np.cumsum([len(t) + 1 + DEPTH for t in texts])])
    inner = np.ones(len(s), dtype=bool)  # windows that reach into the next text's filling are none
    for i in range(1, DEPTH + 1):
        inner[off[1:] - i] = False
    total = np.zeros(len(texts))
    for at in range(0, len(s) - DEPTH, step):
        n = min(step, len(s) - DEPTH - at)
        g = np.zeros(n, dtype=np.int64)
        for i in range(DEPTH + 1):
            g = (g << 8) | s[at + i:at + i + n]
        ok = inner[at:at + n]
        v = np.zeros(n)
        v[ok] = costs.of(g[ok])
        first, last = np.searchsorted(off, [at, at + n - 1], side="right") - 1
        total[first:last + 1] += np.add.reduceat(v, np.concatenate([[0], off[first + 1:last + 1] - at]))
    return total


# ---- scores -------------------------------------------------------------------------------------

OUT = "doc_id long, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, **kw) -> DataFrame:
    """A row a document: tokens (the end is one), known ones, the corpus's training tokens, the base score (unigrams with
    one added to every count and one unseen kind) and the tree's log10 probability of the text.

    Null and blank texts are the end alone.  Rows that repeat an id are documents of their own.  Without any
    training text all counts are 0 and the tree is the root's equal shares.
    """
    spark = docs.sparkSession
    chunks = materialize(chunked(docs, id_col, text_col, training, chunk_bytes))
    probabilities, pair, pair_cost = gram_costs(materialize(chunk_grams(chunks)), **kw)
    low = spark.sparkContext.broadcast((pair, pair_cost))
    rows = word_counts(chunks)
    counts = materialize(rows.groupBy("word").agg(F.sum("k").alias("c")))
    n, v = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    texts = chunks.where("training").count()
    n, v = (n or 0) + texts, v + (texts > 0)  # the end is a token
    sent = rows.join(counts, "word").select("chunk", "word", "c", F.lit(None).cast("binary").alias("cost"))
    sent = sent.unionByName(probabilities.select("chunk", F.col("grams").alias("word"), F.lit(None).cast("long").alias("c"), "cost"))
    schema = pa.schema([("doc_id", pa.int64()), ("training", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        text = left["text"].to_pylist()
        is_word = pc.is_null(right["cost"])
        known = right.filter(is_word)
        hashes = [np.zeros(0, dtype=np.uint64)]
        for b in known.select(["word"]).to_batches(max_chunksize=1 << 16):
            hashes.append(word_hashes(b" ".join(b.column(0).to_pylist()))[1])
        h, c = np.concatenate(hashes), known["c"].to_numpy()
        order = np.argsort(h)
        h, c = h[order], c[order]
        log = np.log10((c + 1) / (n + v + 1))
        end = float(np.log10((texts + 1) / (n + v + 1)))
        sums = [np.zeros((3, 0))]
        for part in _slabs(text, WORD_BYTES):
            _, own, whose = hashed_words(part)
            at = np.searchsorted(h, own)
            sums.append(np.stack([np.bincount(whose, weights=w, minlength=len(part)) for w in (np.ones(len(own)), c[at] > 0, log[at])]))
        count, seen, base = np.concatenate(sums, axis=1)
        tokens, known_n, base = count.astype(np.int64) + 1, seen.astype(np.int64) + (texts > 0), base + end
        own = right.filter(pc.invert(is_word))
        grams = np.concatenate([_unpack_grams(x) for x in own["word"].to_pylist()])
        cost = np.frombuffer(b"".join(own["cost"].to_pylist()), dtype=np.float32)
        grams, at = np.unique(grams, return_index=True)
        cost = cost[at]
        pair, pair_cost = low.value
        cost = np.where(np.isnan(cost), pair_cost[np.searchsorted(pair, grams & _mask(LOW))], cost)
        costs = Costs(grams, cost)
        score = np.concatenate([score_grams(part, costs) for part in _slabs(text)])
        return pa.table([left["doc_id"], left["training"], tokens, known_n, [n] * len(text), base, score], schema=schema)

    return chunks.groupBy("chunk").cogroup(sent.groupBy("chunk")).applyInArrow(run, OUT)


def _slabs(texts: list[bytes], size: int = 8 << 20) -> Iterator[list[bytes]]:
    """Runs of texts of about ``size`` bytes."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t) + DEPTH + 1
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, learning from ids whose crc32 modulo 7 is not 2.

    Null, empty and blank texts are the end alone; long texts are read like any other; repeated rows and ids are documents
    of their own, a null id is a training row; an empty table gives no rows; columns beyond ``doc_id`` and ``text`` are not read.
    """
    docs = read(spark, sf_dir, "documents")
    return score_texts(docs, training_row(F.col("doc_id"), 7, 2)).select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
