"""Operator 2: document quality by Bradley-Terry pairwise ranking.

A document is a vector of surface measures of its whole text: shares of symbol kinds, capitals and
digits, repeated words, bigrams and lines, word lengths, and the worst window of several of them, so
that junk in one part of a long text shows.  Scores are linear in these measures and learned from
preference pairs (a document labelled 1 is preferred to one labelled 0): the logistic loss of the
pair's feature difference, minimised by Newton steps.  Only this fit reads a sample.  A quantile of the
scores of all labelled training rows is the threshold; the quantile is the one that classifies all of them
best, each row counting once, and the reported score is a logistic curve that passes the cut-off there.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.llm.common import class_weights, filter_rows, known_labels, materialize, picked_labels, read, training_row

CUT = 0.3  # scores from here on predict label 1
SYMBOLS = b"#$%&*!|<>{}=/\\_~^@+"
WINDOW_WORDS = 48
WINDOW_BYTES = 320

_KIND = np.zeros(256, dtype=np.int64)  # 0 other, 1 symbol, 2 capital, 3 small, 4 digit, 5 white, 6 mark
_KIND[list(SYMBOLS)] = 1
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 2, 3, 4
_KIND[[9, 10, 11, 12, 13, 32]] = 5
_KIND[list(b".,;:?'\"()-")] = 6

NAMES = ("log_words", "word_length", "long_words", "symbols", "capitals", "digits", "marks", "worst_symbols", "worst_capitals",
         "worst_digits", "best_symbols", "repeat", "worst_repeat", "longest_run", "lexical", "bigrams", "worst_bigrams", "lines", "line_repeat",
         "bare", "worst_bare", "ends", *(f"has_{chr(c)}" for c in SYMBOLS[:8]), "any_symbol_window", "any_capital_window", "any_repeat_window")


def _windows(flags: np.ndarray, width: int) -> np.ndarray:
    """Mean of each window of ``width`` (overlapping by half); the whole if it is shorter."""
    n = len(flags)
    if n <= width:
        return np.array([flags.mean()]) if n else np.zeros(1)
    total = np.concatenate([[0], np.cumsum(flags)])
    at = np.unique(np.append(np.arange(0, n - width, width // 2), n - width))
    return (total[at + width] - total[at]) / width


def features(text: bytes | None) -> np.ndarray:
    """The measures of one whole text; null and blank texts give zeros."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(len(NAMES))
    kind = _KIND[np.frombuffer(text, dtype=np.uint8)]
    count = np.bincount(kind, minlength=7)
    solid = max(1, len(text) - count[5])
    letters = max(1, count[2] + count[3])
    symbol, capital, digit = (_windows(kind == k, WINDOW_BYTES) for k in (1, 2, 4))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    same = np.fromiter(map(operator.eq, words, words[1:]), dtype=bool, count=n - 1)
    runs = np.diff(np.flatnonzero(np.concatenate([[True], ~same, [True]])))
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=n)
    pairs = codes[:-1] * 31 + codes[1:]
    order = np.argsort(pairs, kind="stable")
    again = np.zeros(max(n - 1, 0), dtype=bool)
    again[order[1:]] = pairs[order[1:]] == pairs[order[:-1]]
    bare = np.fromiter((w.isalpha() for w in words), dtype=bool, count=n)
    repeat, twice, plain = _windows(same, WINDOW_WORDS), _windows(again, WINDOW_WORDS), _windows(bare, WINDOW_WORDS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return np.array([
        np.log1p(n), lengths.mean(), (lengths > 20).mean(), count[1] / solid, count[2] / letters, count[4] / solid, count[6] / solid,
        symbol.max(), capital.max(), digit.max(), symbol.min(), same.mean() if n > 1 else 0, repeat.max(), np.log1p(runs.max() - 1),
        len(set(words)) / n, again.mean() if n > 1 else 0, twice.max(), np.log1p(len(lines)), 1 - len(set(lines)) / len(lines),
        bare.mean(), plain.min(), sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines),
        *(min(1.0, 20 * text.count(c) / solid) for c in (SYMBOLS[i:i + 1] for i in range(8))),
        float(symbol.max() > 0.1), float(capital.max() > 0.4), float(repeat.max() > 0.4)])


def feature_rows(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``x``, the measures of ``text_col``, row by row."""
    fields = [docs.schema[c] for c in keep]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = pa.array([features(t.as_py()) for t in b.column(b.num_columns - 1)], type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], x], [*keep, "x"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*keep, F.col(text_col).cast("binary").alias("__text")).mapInArrow(run, f"{schema}, x array<double>")


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 40_000, ridge: float = 1.0, seed: int = 7, steps: int = 25) -> np.ndarray:
    """Weights of the standardised measures that put label 1 before label 0 (at most ``pairs`` pairs)."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return w
    rng = np.random.default_rng(seed)
    m = min(pairs, len(good) * len(bad))
    # every document takes part as often as any other of its class
    a = np.resize(rng.permutation(good), m)
    b = rng.permutation(np.resize(rng.permutation(bad), m))
    d = x[a] - x[b]
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # what is left of each pair
        grad = d.T @ p - ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_quantile(s: np.ndarray, y: np.ndarray, grid: int = 2000) -> float:
    """The score quantile that separates the training labels with the fewest errors (midway in a tie)."""
    if not len(s) or y.min() == y.max():
        return 0.0 if not len(s) else (s.min() - 1.0 if y.min() == 1 else s.max() + 1.0)
    q = np.quantile(s, np.linspace(0, 1, grid + 1))
    errors = np.array([((s >= t) != (y == 1)).sum() for t in q])
    best = np.flatnonzero(errors == errors.min())
    at = best[len(best) // 2]
    below = s[s < q[at]]
    return float((q[at] + below.max()) / 2) if len(below) else float(q[at] - 1e-9)


def best_quantile_of(scores: DataFrame, grid: int = 2000) -> float:
    """:func:`best_quantile` over any number of ``(s, label)`` rows: the quantiles are approximate (a fiftieth of a step of
    the grid), the errors at each are exact counts."""
    n = {r.label: r for r in scores.groupBy("label").agg(F.min("s").alias("low"), F.max("s").alias("high")).collect()}
    if len(n) < 2:
        return 0.0 if not n else (n[1].low - 1.0 if 1 in n else n[0].high + 1.0)
    q = np.unique(scores.agg(F.percentile_approx("s", np.linspace(0, 1, grid + 1).tolist(), 50 * grid)).first()[0])
    schema = "place int, label int, n long, high double"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high = np.zeros((len(q) + 1, 2), dtype=np.int64), np.full((len(q) + 1, 2), -np.inf)
        for b in it:
            s, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = np.searchsorted(q, s, side="right")  # quantiles that the score reaches
            np.add.at(n, (at, y), 1)
            np.maximum.at(high, (at, y), s)
        place, label = np.nonzero(n)
        yield pa.record_batch([pa.array(place, pa.int32()), pa.array(label, pa.int32()), pa.array(n[place, label]), pa.array(high[place, label])],
                              ["place", "label", "n", "high"])

    count, high = np.zeros((len(q) + 1, 2), dtype=np.int64), np.full(len(q) + 1, -np.inf)
    for r in scores.select("s", "label").mapInArrow(run, schema).groupBy("place", "label").agg(F.sum("n").alias("n"), F.max("high").alias("high")).collect():
        count[r.place, r.label] = r.n
        high[r.place] = max(high[r.place], r.high)
    below = np.cumsum(count, axis=0)[:-1]  # rows that do not reach the quantile
    errors = below[:, 1] + (count[:, 0].sum() - below[:, 0])
    best = np.flatnonzero(errors == errors.min())
    at = best[len(best) // 2]
    under = high[:at + 1].max()
    return float((q[at] + under) / 2) if np.isfinite(under) else float(q[at] - 1e-9)


class QualityModel:
    """A fitted ranking: ``score`` maps rows of measures to 0..1; ``CUT`` and above predicts label 1."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, threshold: float):
        self.mean, self.scale, self.w, self.threshold = mean, scale, w, threshold

    def rank(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.rank(x) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_arrays(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> QualityModel:
    """The ranking from sampled rows, which stand for ``weights`` rows each; its threshold is the sample's own."""
    if not len(x):
        return QualityModel(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(len(NAMES)), 0.0)
    mean = np.average(x, axis=0, weights=weights)
    scale = np.maximum(np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weights)), 1e-3)
    z = np.clip((x - mean) / scale, -6, 6)
    w = fit_pairs(z, y)
    return QualityModel(mean, scale, w, best_quantile(z @ w, y))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, x)``: the measures of every row, written once for the fit, the threshold and the scores."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return materialize(feature_rows(rows, ["doc_id", "text_hash"]))


def fit_measured(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", per_class: int = 4000) -> QualityModel:
    """The ranking of :func:`measured` rows.  It is fitted on at most ``per_class`` training rows of each label (those with the smallest id
    hashes), weighted by their class's true count; the threshold is that of all training rows."""
    picked = F.broadcast(picked_labels(labels, id_col, label_col, per_class))  # 2 * per_class ids at most
    sample = rows.select("doc_id", "x").join(picked, F.col("doc_id") == F.col("__id")).select("label", "x")
    got = sorted((r.label, r.x) for r in sample.collect())  # the order of tasks must not matter
    y = np.array([label for label, _ in got], dtype=int)
    model = fit_arrays(np.array([x for _, x in got]), y, class_weights(labels, id_col, label_col, per_class)[y] if len(y) else None)
    if len(y):
        model.threshold = best_quantile_of(training_ranks(rows, labels, model, id_col, label_col))
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                per_class: int = 4000) -> QualityModel:
    """:func:`fit_measured` over the training rows of ``docs``; only their texts and ids and the labels are read."""
    training = docs.where(F.col(id_col).isNotNull() & training_row(F.col(id_col), 5, 0))
    return fit_measured(measured(training, id_col, text_col), labels, id_col, label_col, per_class)


def training_ranks(rows: DataFrame, labels: DataFrame, model: QualityModel, id_col: str, label_col: str) -> DataFrame:
    """``(s, label)`` of all labelled training rows among :func:`measured` ones."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                yield pa.record_batch([b.column(0), pa.array(model.rank(_matrix(b.column(1))))], ["doc_id", "s"])

    ranks = rows.where(F.col("doc_id").isNotNull() & training_row(F.col("doc_id"), 5, 0)).select("doc_id", "x").mapInArrow(run, "doc_id long, s double")
    known = known_labels(labels, id_col, label_col)
    return materialize(ranks.join(known, F.col("doc_id") == F.col("__id")).select("s", "label"))


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(NAMES))


def score_measured(rows: DataFrame, model: QualityModel) -> DataFrame:
    """``(doc_id, text_hash, score, predicted)`` of :func:`measured` rows."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                s = model.score(_matrix(b.column(2)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32))],
                                                 ["doc_id", "text_hash", "score", "predicted"])

    return rows.select("doc_id", "text_hash", "x").mapInArrow(run, "doc_id long, text_hash long, score double, predicted int")


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, score, predicted)`` of every row; null and blank texts are scored as measures of zero."""
    return score_measured(measured(docs, id_col, text_col), model)


def reject_low_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that the model predicts 0 for."""
    return filter_rows(docs, text_col, lambda: lambda texts: model.score(
        np.array([features(t and t.encode()) for t in texts])) >= CUT)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, learning from ``labels.quality`` of ids whose crc32 modulo 5 is not 0.

    Null, empty and blank texts are scored as measures of zero; long texts are read whole; equal texts have equal scores; an id that
    the labels repeat counts once, with its larger label; null ids never train; without labels all scores are equal; an
    empty table gives no rows; other columns of either table, whatever their names, are not read.
    """
    rows = measured(read(spark, sf_dir, "documents"))
    model = fit_measured(rows, read(spark, sf_dir, "labels"))
    return score_measured(rows, model).select("doc_id", (~training_row(F.col("doc_id"), 5, 0)).alias("held_out"), "score", "predicted")
