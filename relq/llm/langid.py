"""Operator 8: language identification by sparse multinomial logistic regression.

A text is lower-cased, everything but letters and their marks becomes a space, and its character n-grams (1 to 3) are
hashed to buckets.  Weights are log term counts times inverse document frequencies (of all training
documents), scaled to length 1.
The model is trained with follow-the-regularised-leader (FTRL-proximal, one step size a weight) and an
elastic net: the L1 part leaves most weights at exactly zero, the L2 part shrinks the others.  A part of the
training rows is kept back to fit one temperature, which calibrates the probabilities.  Both fits read a
bounded sample in which each language is weighted by its share of all training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.llm.common import batches_of, read, training_row

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"

_OTHER = regex.compile(r"[^\p{L}\p{M}]+")  # marks belong to the letters before them
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the character n-grams of one whole text; empty without a letter."""
    clean = _OTHER.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, clean[:64])) and not any(map(str.isalpha, clean)):
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    c = np.frombuffer(f" {clean} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    key = np.zeros(len(c), dtype=np.uint64)
    count = np.zeros(BUCKETS, dtype=np.int64)
    for n in ORDERS:
        if len(c) < n:
            break
        key = (key[:len(c) - n + 1] << np.uint64(21)) | c[n - 1:]
        mixed = (key + np.uint64(n)) * _MIX[n - 1]
        mixed ^= mixed >> np.uint64(29)
        count += np.bincount(((mixed * _MIX[0]) >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(count)
    return at, count[at].astype(float)


class LanguageModel:
    """``weights`` (buckets + 1, languages), the last row the bias; ``idf`` by bucket; ``temperature``."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float = 1.0):
        self.langs, self.idf, self.weights, self.temperature = langs, idf, weights, temperature

    def vector(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = (1 + np.log(count)) * self.idf[at]
        return x / max(1e-12, np.sqrt((x * x).sum()))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated probability); ``und`` and 0 without a letter or a model."""
        at, count = grams(text)
        if not len(at) or not self.langs:
            return UNKNOWN, 0.0
        z = (self.vector(at, count) @ self.weights[at] + self.weights[-1]) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 3, alpha: float = 0.5,
         beta: float = 1.0, l1: float = 0.05, l2: float = 0.01, seed: int = 3, weights_of: np.ndarray | None = None) -> np.ndarray:
    """Weights (buckets + 1, classes) of a multinomial model by FTRL-proximal over (buckets, values) rows, which weigh
    ``weights_of`` (1 by default)."""
    k = np.ones(len(rows)) if weights_of is None else weights_of
    z = np.zeros((BUCKETS + 1, classes))
    n = np.zeros_like(z)

    def weights(at):
        zz = z[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zz) > l1, w, 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = np.append(rows[i][0], BUCKETS), np.append(rows[i][1], 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * (k[i] * p)
            nn = n[at]
            z[at] += g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha * w
            n[at] = nn + g * g
    return weights(np.arange(BUCKETS + 1))


def fit_temperature(z: np.ndarray, y: np.ndarray, weights_of: np.ndarray | None = None) -> float:
    """The temperature with the smallest (weighted) log loss on kept-back rows (golden-section search in the log)."""
    if not len(y):
        return 1.0

    def loss(t):
        s = z / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return np.average(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y], weights=weights_of)
    a, b, r = np.log(0.02), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """By bucket the number of texts (the only column) that hold one of its n-grams, and the number of texts with a letter."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS + 1, dtype=np.int64)
        for b in it:
            for t in b.column(0).to_pylist():
                at, _ = grams(t)
                df[at] += 1
                df[BUCKETS] += len(at) > 0
        held = np.flatnonzero(df)
        yield from batches_of({"bucket": held, "n": df[held]}, schema)

    df = np.zeros(BUCKETS + 1, dtype=np.int64)
    for r in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r.bucket] = r.n
    return df[:BUCKETS], int(df[BUCKETS])


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 5, held_out: int = 0,
                 max_rows: int = 4000) -> LanguageModel:
    """Fit on at most ``max_rows`` training documents, as many of each language (those with the smallest id hashes),
    weighted by the language's share of all training documents; document frequencies are those of all of them.

    Only text and non-null language of training rows are read; null ids are not used.
    """
    spark = docs.sparkSession
    training = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & training_row(F.col(id_col), modulus, held_out))
    known = training.select(F.col(id_col).cast("long").alias("__id"), F.col(lang_col).alias("__lang"))
    count = dict(known.groupBy("__lang").count().collect())
    langs = sorted(count)
    if not langs:
        return LanguageModel([], np.ones(BUCKETS), np.zeros((BUCKETS + 1, 0)))
    each = max(1, max_rows // len(langs))
    # one bounded top-n a language: no task gathers the rows of a common language
    tops = [known.where(F.col("__lang") == lang).orderBy(F.xxhash64("__id", F.lit(23)), "__id").limit(each) for lang in langs]
    ids = sorted({tuple(r) for r in reduce(DataFrame.unionByName, tops).collect()})
    picked = F.broadcast(spark.createDataFrame(ids, "__id long, __lang string"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [grams(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([a.astype(np.uint16).tobytes() for a, _ in got], type=pa.binary()),
                                              pa.array([c.astype(np.float32).tobytes() for _, c in got], type=pa.binary())], ["lang", "at", "count"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    got = (texts.join(picked, (F.col("id") == F.col("__id")) & (F.col("lang") == F.col("__lang"))).select("text", "__lang").mapInArrow(run, "lang string, at binary, count binary").collect())
    got = sorted((r.lang, bytes(r["at"]), bytes(r["count"])) for r in got)  # the order of tasks must not matter
    got = [g for i, g in enumerate(got) if g[1] and (not i or g != got[i - 1])]  # texts with letters, each once
    rows = [(np.frombuffer(a, dtype=np.uint16).astype(np.int64), np.frombuffer(c, dtype=np.float32).astype(float)) for _, a, c in got]
    y = np.array([langs.index(lang) for lang, _, _ in got], dtype=int)
    stands = np.array([max(1.0, count[lang] / each) for lang in langs])  # training documents a sampled one stands for
    k = stands[y] / max(1e-12, stands[y].mean()) if len(y) else np.ones(0)  # a step's mean size is that of unweighted rows
    df, n = document_frequencies(training.select(F.col(text_col).alias("text")))
    model = LanguageModel(langs, np.log((1 + n) / (1 + df)) + 1, np.zeros((BUCKETS + 1, len(langs))))
    x = [(at, model.vector(at, c)) for at, c in rows]
    back = np.arange(len(x)) % 5 == 4  # kept back for the temperature
    model.weights = ftrl([v for v, b in zip(x, back) if not b], y[~back], len(langs), weights_of=k[~back])
    z = np.array([v @ model.weights[at] + model.weights[-1] for (at, v), b in zip(x, back) if b]).reshape(-1, len(langs))
    model.temperature = fit_temperature(z, y[back], k[back])
    model.weights = model.weights.astype(np.float32)
    return model


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row, repeated ones each; ``und`` with score 0 for null texts and those without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (BUCKETS + 1) x languages floats, whatever the input

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in it:
            if b.num_rows:
                lang, score = zip(*map(m.predict, b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, type=pa.string()), pa.array(score, type=pa.float64())], ["doc_id", "lang_pred", "score"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, lang_pred string, score double"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``; learns from ids whose crc32 modulo 5 is not 0 and that have a language.

    Null, empty and letterless texts are ``und`` with score 0; long texts are read whole; of tied languages the first by name;
    repeated rows have equal results and train once; without a training language all is ``und``; an empty table gives
    no rows; columns beyond ``doc_id``, ``text`` and ``lang`` are not read.
    """
    docs = read(spark, sf_dir, "documents")
    return predict_language(docs, fit_language(docs)).select(
        "doc_id", (~training_row(F.col("doc_id"), 5, 0)).alias("held_out"), "lang_pred", "score")
