"""Operator 11: removal of long repeated word runs with suffix automata of reference shards.

A window is ``window`` consecutive words of one text.  A word goes if it lies in a window whose words also start
anywhere else, in another text or the same one; all windows are judged on the input.

Which texts can share a window is found first.  Of the k-grams inside a window the one with the smallest hash is its
*anchor*: equal windows have equal anchors.  Neighbouring windows with one anchor form a *passage* (at most
``2 * window - k`` words), so every window of the corpus lies in exactly one passage.  A passage whose anchor occurs
once holds no repeated window.  All others are reference text.

Reference text is dealt to shards by anchor, so equal windows meet in one shard, and a shard has a bounded number of
distinct passages, each with the number of its occurrences.  A task builds the suffix automaton of a shard; its states
carry how often their words occur.  The shard's passages are then streamed through the automaton: the matching
statistic of a position is the length of the longest run that ends there and occurs twice or more, and every run of
``window`` words or longer is removed.  (An automaton goes to the task that streams the passages dealt to
its shard, not to all tasks: sent to every text, all of the corpus would be read once a shard.)

An anchor with more passages than a shard holds (a common line amid ever new words) is cut further: its passages become
single windows, dealt by their whole words, and go the same way.

Equal texts are one text with a count.  What a text loses depends on its words alone, so results are joined back to rows
by two hashes of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.llm.common import batches_of, materialize, read

WINDOW = 35
K = 10
SHARD_PASSAGES = 2048
RUN_BYTES = 1 << 20  # text that is split into words at once
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


# ---- anchors ------------------------------------------------------------------------------------

def word_runs(text: bytes, size: int = RUN_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``size`` bytes: a long text is never a list as a whole."""
    for part in _parts(text, size):
        yield part.split()  # bytes: split() knows ASCII white space only


def _parts(text: bytes, size: int) -> Iterator[bytes]:
    """The text, cut at white space into parts of about ``size`` bytes."""
    at = 0
    while at < len(text):
        m = _SPACE.search(text, at + size) if len(text) - at > size else None
        stop = m.start() if m else len(text)
        yield text[at:stop]
        at = stop


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd number modulo 2^64 and of its inverse: sums of prefixes give the polynomial hash of any run."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)

    def hashes(self, values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The hash of each run values[start:stop], whatever stands before it."""
        n = len(values)
        if len(self.up) < n + 1:
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                x = np.full(max(n + 1, 1 << 16), b, dtype=np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * self.up[:n], out=sums[1:])
        return _mix((sums[stop] - sums[start]) * self.down[start])


_BYTES, _WORDS = Powers(0x2545F4914F6CDD1D), Powers(0xD1342543DE82EF95)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word."""
    data = np.frombuffer(text, dtype=np.uint8)
    edge = np.diff(_IS_SPACE[data].astype(np.int8), prepend=np.int8(1), append=np.int8(1))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return start, _BYTES.hashes(data.astype(np.uint64) + np.uint64(1), start, stop)


def anchored_passages(words: np.ndarray, owner: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor hash) of each passage in a stream of word hashes; ``owner`` numbers the texts."""
    n = len(words) - window + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),)
    at = np.arange(len(words) - k + 1)
    g = _WORDS.hashes(words, at, at + k)
    run, width, low, place = window - k + 1, 1, g, at
    while width < run:  # the leftmost smallest hash of ``width`` neighbours and its place
        step = min(width, run - width)
        a, b = low[:len(low) - step], low[step:]
        place = np.where(b < a, place[step:], place[:len(place) - step])
        low = np.minimum(a, b)
        width += step
    first = np.flatnonzero(owner[:n] == owner[window - 1:])  # windows of one text
    place = place[first]
    new = np.ones(len(first), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1)
    begin = np.flatnonzero(new)
    return first[begin], np.diff(begin, append=len(first)), g[place[begin]]


_PACKED = np.dtype([("start", "<i8"), ("n", "<i4"), ("anchor", "<i8")])


def _packed(first: np.ndarray, n: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    p = np.zeros(len(first), dtype=_PACKED)
    p["start"], p["n"], p["anchor"] = first, n, anchor.view(np.int64)
    return p


def text_passages(texts: list[bytes], window: int, k: int, size: int = RUN_BYTES) -> list[bytes]:
    """The packed passages of each text: short texts are read together, a long one part by part."""
    out, held, weight = [b""] * len(texts), [], 0

    def together() -> None:
        stream = b"\n".join(texts[i] for i in held)
        start, h = word_hashes(stream)
        begin = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(texts[i]) + 1 for i in held])]))  # first words of the texts
        owner = np.repeat(np.arange(len(held)), np.diff(begin))
        first, n, anchor = anchored_passages(h, owner, window, k)
        whose = owner[first]
        p = _packed(first - begin[whose], n, anchor)
        cut = np.searchsorted(whose, np.arange(len(held) + 1)).tolist()
        for i, a, b in zip(held, cut, cut[1:]):
            out[i] = p[a:b].tobytes()

    for i, text in enumerate(texts):
        if len(text) > size:
            made, carry, at = [], np.zeros(0, dtype=np.uint64), 0
            for part in _parts(text, size):
                h = np.concatenate([carry, word_hashes(part)[1]])
                first, n, anchor = anchored_passages(h, np.zeros(len(h), dtype=np.int8), window, k)
                made.append(_packed(first + at, n, anchor).tobytes())
                keep = min(len(h), window - 1)  # windows that reach into the next part start there
                at += len(h) - keep
                carry = h[len(h) - keep:]
            out[i] = b"".join(made)
            continue
        held.append(i)
        weight += len(text)
        if weight > size:
            together()
            held, weight = [], 0
    if held:
        together()
    return out


def text_keys(text_col: str) -> tuple[Column, Column, Column]:
    t = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return t.alias("t"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2")


def passages_of(docs: DataFrame, text_col: str, window: int, k: int) -> DataFrame:
    """``(k1, k2, c, p)``: the packed passages of each distinct text of a window or more, and how many rows have that text."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("p", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            packed = text_passages(b.column(0).to_pylist(), window, k)
            some = pa.array([bool(p) for p in packed], type=pa.bool_())
            yield pa.record_batch([b.column(1), b.column(2), pa.array(packed, type=pa.binary())], schema=schema).filter(some)

    return (docs.select(*text_keys(text_col)).mapInArrow(run, "k1 long, k2 long, p binary")
            .groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("c"), F.first("p").alias("p")))


def _unpacked(texts: DataFrame) -> DataFrame:
    """A row a passage."""
    schema = pa.schema([("anchor", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("c", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                packed = b.column(3).to_pylist()
                p = np.frombuffer(b"".join(packed), dtype=_PACKED)
                times = [len(x) // _PACKED.itemsize for x in packed]
                k1, k2, c = (np.repeat(b.column(i).to_numpy(), times) for i in range(3))
                yield from batches_of({"anchor": p["anchor"], "k1": k1, "k2": k2, "start": p["start"], "n": p["n"], "c": c}, schema)

    return texts.select("k1", "k2", "c", "p").mapInArrow(run, "anchor long, k1 long, k2 long, start long, n int, c long")


# ---- automaton ----------------------------------------------------------------------------------

class SuffixAutomaton:
    """The suffix automaton of several word sequences with counts.

    ``step[s]`` are the moves of state s, ``link[s]`` the state of its longest shorter suffix elsewhere, ``length[s]`` its longest
    run of words, ``count[s]`` how often that run occurs.
    """

    def __init__(self):
        self.step: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self.often: list[int] = []

    def _split(self, s: int, word, have: int) -> int:
        """A state for the runs of ``have`` that come from ``s``."""
        step, link = self.step, self.link
        twin = len(step)
        step.append(dict(step[have]))
        link.append(link[have])
        self.length.append(self.length[s] + 1)
        self.count.append(0)
        link[have] = twin
        while s >= 0 and step[s].get(word) == have:
            step[s][word] = twin
            s = link[s]
        return twin

    def add(self, words: list, times: int = 1) -> None:
        """One more sequence, which occurs ``times``."""
        step, link, length, count = self.step, self.link, self.length, self.count
        s = 0
        for w in words:
            have = step[s].get(w)
            if have is None:
                new = len(step)
                step.append({})
                link.append(0)
                length.append(length[s] + 1)
                count.append(times)
                step[s][w] = new
                s = link[s]
                while s >= 0:
                    have = step[s].get(w)
                    if have is not None:
                        link[new] = have if length[have] == length[s] + 1 else self._split(s, w, have)
                        break
                    step[s][w] = new
                    s = link[s]
                s = new
            else:
                s = have if length[have] == length[s] + 1 else self._split(s, w, have)
                count[s] += times

    def close(self) -> "SuffixAutomaton":
        """Counts of suffixes; ``often[s]``: the length of the longest suffix of s that occurs twice or more, -1 where s does."""
        n = np.array(self.length)
        order = np.argsort(n, kind="stable")
        count, link = self.count, self.link
        for s in order[:0:-1].tolist():
            count[link[s]] += count[s]
        self.often = [0] * len(n)
        for s in order[1:].tolist():
            up = link[s]
            self.often[s] = -1 if count[s] > 1 else self.length[up] if self.often[up] == -1 else self.often[up]
        return self

    def repeated_runs(self, words: list) -> list[int]:
        """For each position, the length of the longest run that ends there and occurs twice or more in the automaton's sequences."""
        step, link, length, often = self.step, self.link, self.length, self.often
        out, s, n = [], 0, 0
        for w in words:
            have = step[s].get(w)
            while have is None and s:
                s = link[s]
                n = length[s]
                have = step[s].get(w)
            if have is not None:
                s = have
                n += 1
            out.append(n if often[s] < 0 else often[s])
        return out


def removed_words(runs: list[int], window: int) -> np.ndarray | None:
    """Which words lie in a run of ``window`` or more; None: none."""
    if not runs or max(runs) < window:
        return None
    run = np.array(runs)
    end = np.flatnonzero(run >= window) + 1
    cover = np.zeros(len(run) + 1, dtype=np.int64)
    np.add.at(cover, end - run[end - 1], 1)
    np.add.at(cover, end, -1)
    return np.cumsum(cover[:-1]) > 0


def repeated_in_shards(passages: DataFrame, window: int, per_shard: int = SHARD_PASSAGES) -> DataFrame:
    """``(h1, h2, mask)`` of the distinct ``passages`` (key, passage, h1, h2, c) that hold a repeated window; equal keys share a
    shard.  ``mask`` has a bit a word."""
    shards = max(1, -(-passages.count() // per_shard))
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("mask", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        ids: dict[bytes, int] = {}
        automaton, sequences = SuffixAutomaton(), []
        for p, c in zip(t["passage"].to_pylist(), t["c"].to_pylist()):
            sequences.append([ids.setdefault(w, len(ids)) for w in p.split()])
            automaton.add(sequences[-1], c)
        automaton.close()
        masks = []
        for words in sequences:
            out = removed_words(automaton.repeated_runs(words), window)
            masks.append(None if out is None else np.packbits(out).tobytes())
        t = pa.table([t["h1"], t["h2"], pa.array(masks, type=pa.binary())], schema=schema)
        return t.filter(pa.array([m is not None for m in masks], type=pa.bool_()))

    return (passages.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "passage", "h1", "h2", "c")
            .groupBy("shard").applyInArrow(run, "h1 long, h2 long, mask binary"))


# ---- passages and their masks -------------------------------------------------------------------

def _passage_keys() -> tuple[Column, Column]:
    return F.xxhash64("key", "passage").alias("h1"), F.xxhash64("passage", "key").alias("h2")


def _passage_words(texts: DataFrame) -> DataFrame:
    """``(key, passage, c, k1, k2, start)`` from texts with the list ``w`` of their passages with repeated anchors."""
    schema = pa.schema([("key", pa.int64()), ("passage", pa.binary()), ("c", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for lo in range(0, big.num_rows, 64):
                b = big.slice(lo, 64)
                offsets = b.column(4).offsets.to_numpy()
                start, size, anchor = (b.column(i).values.to_numpy()[offsets[0]:offsets[-1]] for i in (4, 5, 6))
                times = np.diff(offsets)
                got = []
                for text, a, n in zip(b.column(0).to_pylist(), (offsets[:-1] - offsets[0]).tolist(), times.tolist()):
                    held, at = [], 0
                    runs = word_runs(text)
                    for p, m in zip(start[a:a + n].tolist(), size[a:a + n].tolist()):
                        while at + len(held) < p + m:
                            drop = min(len(held), max(0, p - at))
                            held, at = held[drop:] + next(runs), at + drop
                        got.append(b" ".join(held[p - at:p - at + m]))
                c, k1, k2 = (np.repeat(b.column(i).to_numpy(), times) for i in (3, 1, 2))
                yield from batches_of({"key": anchor, "passage": got, "c": c, "k1": k1, "k2": k2, "start": start}, schema)

    return (texts.select("t", "k1", "k2", "c", "w.start", "w.words", "w.anchor")
            .mapInArrow(run, "key long, passage binary, c long, k1 long, k2 long, start long"))


def _window_masks(hot: DataFrame, window: int, per_shard: int) -> DataFrame:
    """``(h1, h2, mask)`` of the passages of anchors with too many of them: their single windows are dealt by all their words."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("at", pa.int32()), ("words", pa.int32()), ("passage", pa.binary()), ("c", pa.int64())])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                words = [p.split() for p in b.column(0).to_pylist()]
                size = np.array([len(x) for x in words])
                n = size - window + 1
                h1, h2, c = (np.repeat(b.column(i).to_numpy(), n) for i in (1, 2, 3))
                yield from batches_of({"h1": h1, "h2": h2, "at": np.concatenate([np.arange(m) for m in n]), "words": np.repeat(size, n),
                                       "passage": [b" ".join(x[i:i + window]) for x in words for i in range(len(x) - window + 1)], "c": c}, schema)

    rows = hot.select("passage", "h1", "h2", "c").mapInArrow(cut, "h1 long, h2 long, at int, words int, passage binary, c long")
    rows = materialize(rows.withColumn("key", F.xxhash64("passage")))
    distinct = materialize(rows.groupBy("key", "passage").agg(F.sum("c").alias("c")).select("key", "passage", "c", *_passage_keys()))
    found = repeated_in_shards(distinct, window, per_shard).select(F.col("h1").alias("w1"), F.col("h2").alias("w2"))
    own = rows.select("h1", "h2", "at", "words", *(c.alias(n) for c, n in zip(_passage_keys(), ("w1", "w2"))))
    out = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("mask", pa.binary())])

    def masks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            made = []
            for n, places in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                m = np.zeros(n, dtype=bool)
                for i in places:
                    m[i:i + window] = True
                made.append(np.packbits(m).tobytes())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(made, type=pa.binary())], schema=out)

    hits = own.join(found, ["w1", "w2"]).groupBy("h1", "h2").agg(F.max("words").alias("words"), F.collect_list("at").alias("at"))
    return hits.select("h1", "h2", "words", "at").mapInArrow(masks, "h1 long, h2 long, mask binary")


def repeated_masks(docs: DataFrame, text_col: str = "text", window: int = WINDOW, k: int = K, per_shard: int = SHARD_PASSAGES) -> DataFrame:
    """``(k1, k2, m)``: for each distinct text that loses words a list of (start, mask of the words from there)."""
    texts = materialize(passages_of(docs, text_col, window, k))
    rows = _unpacked(texts)
    anchors = materialize(rows.groupBy("anchor").agg(F.sum("c").alias("c")).where("c > 1").select("anchor"))
    wanted = (rows.join(anchors, "anchor").groupBy("k1", "k2")
              .agg(F.max("c").alias("c"), F.sort_array(F.collect_list(F.struct("start", (F.col("n") + window - 1).alias("words"), "anchor"))).alias("w")))
    whole = docs.select(*text_keys(text_col)).dropDuplicates(["k1", "k2"])
    held = materialize(_passage_words(whole.join(wanted, ["k1", "k2"])).select("*", *_passage_keys()))
    distinct = materialize(held.groupBy("key", "passage").agg(F.sum("c").alias("c")).select("key", "passage", "c", *_passage_keys()))
    hot = materialize(distinct.groupBy("key").count().where(F.col("count") > per_shard).select("key"))
    masks = repeated_in_shards(distinct.join(hot, "key", "left_anti"), window, per_shard).unionByName(
        _window_masks(distinct.join(hot, "key"), window, per_shard))
    return (held.select("h1", "h2", "k1", "k2", "start").join(materialize(masks), ["h1", "h2"])
            .groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "mask")).alias("m")))


# ---- removal ------------------------------------------------------------------------------------

def cleaned_texts(docs: DataFrame, text_col: str = "text", window: int = WINDOW, k: int = K, per_shard: int = SHARD_PASSAGES) -> DataFrame:
    """``(k1, k2, n_words, n_removed, kept)``: a row a distinct text; ``kept`` are the words that stay, a space between."""
    if not 0 < k <= window:
        raise ValueError("k must be 1 to the window")
    masks = materialize(repeated_masks(docs, text_col, window, k, per_shard))
    whole = docs.select(*text_keys(text_col)).dropDuplicates(["k1", "k2"]).join(masks, ["k1", "k2"], "left")
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for lo in range(0, big.num_rows, 256):
                b = big.slice(lo, 256)
                n_words, n_removed, kept = [], [], []
                for text, starts, masks in zip(*(b.column(i).to_pylist() for i in (0, 3, 4))):
                    gone = _gone(starts, masks)
                    parts, n = [], 0
                    for words in word_runs(text):
                        stay = ~gone[n:n + len(words)]
                        n += len(words)
                        if not stay.all():
                            words = [*compress(words, stay.tolist()), *words[len(stay):]]
                        if words:
                            parts.append(b" ".join(words))
                    n_words.append(n)
                    n_removed.append(int(gone.sum()))
                    kept.append(b" ".join(parts))
                yield pa.record_batch([b.column(1), b.column(2), pa.array(n_words), pa.array(n_removed), pa.array(kept, type=pa.binary())], schema=schema)

    return whole.select("t", "k1", "k2", "m.start", "m.mask").mapInArrow(run, "k1 long, k2 long, n_words long, n_removed long, kept binary")


def _gone(starts: list[int] | None, masks: list[bytes] | None) -> np.ndarray:
    """Which words of a text go, up to the last of them."""
    if not starts:
        return np.zeros(0, dtype=bool)
    gone = np.zeros(max(a + 8 * len(m) for a, m in zip(starts, masks)), dtype=bool)
    for a, m in zip(starts, masks):
        bits = np.unpackbits(np.frombuffer(m, dtype=np.uint8)).view(bool)
        gone[a:a + len(bits)] |= bits
    return gone


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K,
                   per_shard: int = SHARD_PASSAGES, outcome: dict[str, Column] | None = None) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for every row.

    Null, empty and blank texts have no words.  Texts shorter than a window lose nothing.  Rows that repeat a text lose
    every window of it; rows that repeat an id, or have none, are rows of their own.  A run that repeats inside one text, overlapping itself or not, goes
    as well.  An empty table gives an empty one; other columns are not read.  ``outcome`` (columns by name, made of ``n_words,
    n_removed, kept``) replaces the last three columns before texts are joined back to their rows.
    """
    texts = cleaned_texts(docs, text_col, window, k, per_shard)
    columns = outcome or {"n_words": F.col("n_words"), "n_removed": F.col("n_removed"), "kept": F.col("kept").cast("string")}
    made = texts.select("k1", "k2", *(c.alias(f"o{i}") for i, c in enumerate(columns.values())))
    rows = docs.select(F.col(id_col).alias("id"), *text_keys(text_col)[1:])
    return rows.join(made, ["k1", "k2"]).select(F.col("id").alias(id_col), *(F.col(f"o{i}").alias(n) for i, n in enumerate(columns)))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 34), ' ') AS t
  FROM (SELECT r, w, unnest(generate_series(1, CAST(len(w) AS BIGINT) - 34)) AS i FROM d)),
g AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY t) AS c FROM v) WHERE c > 1),
x AS (SELECT DISTINCT r, i + j AS i FROM g, (SELECT unnest(generate_series(0, 34)) AS j)),
p AS (SELECT r, i, w[i] AS word FROM (SELECT r, w, unnest(generate_series(1, CAST(len(w) AS BIGINT))) AS i FROM d)),
k AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
  FROM p ANTI JOIN x USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, windows of 35 words.

    Null, empty and blank texts have no words; ties do not arise; equal rows lose all windows; an empty table gives no rows;
    columns beyond ``doc_id`` and ``text`` are not read.
    """
    return remove_repeats(read(spark, sf_dir, "documents"), outcome={
        "n_words": F.col("n_words"), "n_removed": F.col("n_removed"), "kept_sha256": F.sha2(F.col("kept"), 256)})
