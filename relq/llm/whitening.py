"""Operator 12: embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become whole numbers, y = floor(scale * c); an offset that all of them share would drop out of
everything below but the means.  The row matrix A holds the centred rows (n*y - S) / n.  It is never in one
place: its rows lie in blocks, a Parquet row each, and every product with it is one job.

A step takes the right vector v, multiplies A v (job 1: the norm and the inner products with all earlier left
vectors come with it), orthogonalises the left vector u against all earlier ones, and multiplies A' u (job 2,
with the inner products once more, for the second orthogonalisation).  A left vector has as many entries as
there are rows, so it isn't stored: it lies in the range of A, u = A p, and the driver keeps p, which is as
long as a vector; tasks make the parts of u that they need.  Right vectors are orthogonalised twice on the
driver.  Where the space is exhausted before all dimensions are reached (repeated or zero singular values) a new right
vector, orthogonal to all others, starts the next part.  The bidiagonal matrix is as small as a vector is
long; its SVD yields components and deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.llm.common import materialize, read
from relq.llm.vectors import dimension, scaled_floor, summed, whole_vectors

SCALE = 64
COMPONENTS = 32
FULL = 512  # up to this many dimensions every direction is reached; beyond it, steps end when the components asked for have settled
SETTLED = 1e-14  # residual of a settled component, as a share of the largest singular value
BROKEN = 1e-11  # a norm below this share of the largest one so far is rounding


# ---- blocks -------------------------------------------------------------------------------------

def whole_blocks(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int = SCALE) -> DataFrame:
    """``(ids, y)``: blocks of an Arrow batch of remaining rows, their ids (nulls kept) and their packed whole numbers."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("y", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, x = whole_vectors(b.column(1), dim)
            if len(at):
                y = scaled_floor(x, scale, 1 << 40)
                yield pa.record_batch([pa.array([b.column(0).take(pa.array(at)).to_pylist()], type=schema[0].type),
                                       pa.array([y.tobytes()], type=pa.binary())], schema=schema)

    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
            .mapInArrow(run, "ids array<long>, y binary"))


def _matrices(it: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for b in it:
        for y in b.column("y"):
            yield np.frombuffer(y.as_py(), dtype=np.int64).reshape(-1, dim)


class Centred:
    """The centred row matrix: products with it are jobs over the blocks."""

    def __init__(self, blocks: DataFrame, dim: int):
        self.blocks, self.dim = blocks.select("y"), dim

        def sums(it: Iterator[pa.RecordBatch]) -> np.ndarray:
            s = np.zeros(dim + 1, dtype=np.int64)
            for y in _matrices(it, dim):
                s[:dim] += y.sum(axis=0)
                s[dim] += len(y)
            return s

        total = summed(self.blocks, sums, "long")
        self.n, self.total = (int(total[dim]), total[:dim]) if len(total) else (0, np.zeros(dim, dtype=np.int64))

    def sum_over_rows(self, f) -> np.ndarray:
        """The sum of ``f(centred rows)`` over all blocks."""
        dim, n, total = self.dim, self.n, self.total

        def partial(it: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            out = None
            for y in _matrices(it, dim):
                v = f(centre(y, n, total))
                out = v if out is None else out + v
            return out

        return summed(self.blocks, partial)

    def left(self, ps: list[np.ndarray], q: np.ndarray) -> np.ndarray:
        """Xv: inner products of A q with the left vectors A p, and with itself (last)."""
        m = np.column_stack([*ps, q])
        return self.sum_over_rows(lambda z: (w := z @ m).T @ w[:, -1])

    def right(self, ps: list[np.ndarray], p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """X'u of u = A p, and the inner products of u with the earlier left vectors and itself."""
        m, dim = np.column_stack([*ps, p]), self.dim

        def f(z: np.ndarray) -> np.ndarray:
            w = z @ m
            return np.concatenate([z.T @ w[:, -1], w.T @ w[:, -1]])

        out = self.sum_over_rows(f)
        return out[:dim], out[dim:]


def centre(y: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """(n*y - S) / n, the numerator exact."""
    if y.size and n * int(np.abs(y).max()) >= 1 << 62:
        raise ValueError("vectors too many or too large for exact sums")
    return (n * y - total) / n


# ---- bidiagonalisation --------------------------------------------------------------------------

def _orthogonal(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """``v`` without its parts along ``others``, in two passes."""
    if others:
        m = np.column_stack(others)
        for _ in range(2):
            v = v - m @ (m.T @ v)
    return v


def bidiagonalise(a: Centred, wanted: int, full: int = FULL, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(singular values falling, right singular vectors as columns) of ``a``, at least the ``wanted`` largest."""
    rng, d = np.random.default_rng(seed), a.dim
    right: list[np.ndarray] = []  # right vectors
    ps: list[np.ndarray] = []  # left vectors, u = A p
    hs: list[np.ndarray] = []  # their products X'u
    alpha, beta = np.zeros(d), np.zeros(d)
    v, largest = rng.standard_normal(d), 0.0
    v /= np.linalg.norm(v)
    for i in range(d):
        right.append(v)
        q = v - beta[i - 1] * ps[-1] if i and beta[i - 1] else v
        c = a.left(ps, q)
        for j, p in enumerate(ps):
            q = q - c[j] * p
        norm = np.sqrt(max(0.0, c[-1] - (c[:-1] ** 2).sum()))
        largest = max(largest, norm)
        w = np.zeros(d)
        if norm > BROKEN * largest:
            p = q / norm
            w, c = a.right(ps, p)
            for j, (old, h) in enumerate(zip(ps, hs)):  # what rounding left along earlier left vectors
                p, w = p - c[j] * old, w - c[j] * h
            fix = np.sqrt(max(0.0, c[-1] - (c[:-1] ** 2).sum()))
            p, w, norm = p / fix, w / fix, norm * fix
            alpha[i] = norm
            ps.append(p)
            hs.append(w)
        if i + 1 == d:
            break
        rest = _orthogonal(w, right)
        b = float(np.linalg.norm(rest))
        largest = max(largest, b)
        if alpha[i] and b > BROKEN * largest:
            beta[i], v = b, rest / b
        else:  # the space is exhausted
            rest = _orthogonal(rng.standard_normal(d), right)
            v = rest / np.linalg.norm(rest)
        if d > full and (i + 1) % 8 == 0 and i + 1 >= 2 * wanted:
            u, s, _ = np.linalg.svd(_bidiagonal(alpha, beta, i + 1))
            if (beta[i] * np.abs(u[i, :wanted]) <= SETTLED * s[0]).all():
                break
    k = len(right)
    _, s, vt = np.linalg.svd(_bidiagonal(alpha, beta, k))
    return s, np.column_stack(right) @ vt.T


def _bidiagonal(alpha: np.ndarray, beta: np.ndarray, k: int) -> np.ndarray:
    return np.diag(alpha[:k]) + np.diag(beta[:k - 1], 1)


# ---- whitening ----------------------------------------------------------------------------------

WHITENED = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE,
           components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row a remaining vector and component.

    Rows whose vector is null, empty, holds a null or a number that is not finite, or has another length than most
    are left out.  A null id is kept as null; repeated rows and ids are rows of their own, and all count for the fit.
    Fewer vectors or dimensions than ``components``, or directions without any deviation (their singular value is
    rounding), give fewer components: one row, equal rows or an empty table give none.  Equal singular values leave
    their directions open, as any basis of their space is right.
    ``deviation`` is exact; a sum beyond a long is an error.
    """
    spark = vectors.sparkSession
    dim = dimension(vectors, vec_col)
    if not dim:
        return spark.createDataFrame([], WHITENED)
    blocks = materialize(whole_blocks(vectors, id_col, vec_col, dim, scale))
    a = Centred(blocks, dim)
    n, total = a.n, a.total
    s, right = bidiagonalise(a, min(components, dim))
    k = int((s[:components] > BROKEN * max(s[0], 1.0)).sum())
    if not k:
        return spark.createDataFrame([], WHITENED)
    e = s[:k] ** 2 / n
    project = right[:, :k] / np.sqrt(e)
    trace = float(a.sum_over_rows(lambda z: np.array([(z * z).sum()]))[0]) / n

    def moments(z: np.ndarray) -> np.ndarray:
        w = z @ project
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    m = a.sum_over_rows(moments)
    mean = m[k * k:] / n
    error = float(np.abs(m[:k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for ids, packed in zip(b.column("ids"), b.column("y")):
                y = np.frombuffer(packed.as_py(), dtype=np.int64).reshape(-1, dim)
                z = centre(y, n, total)
                rows = len(y) * k
                yield pa.record_batch([
                    ids.values.take(pa.array(np.repeat(np.arange(len(y)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                    pa.array(np.full(rows, n)), pa.array(np.repeat(deviations(y, n, total), k)), pa.array((z @ project).ravel()),
                    pa.array(np.tile(e / trace, len(y))), pa.array(np.full(rows, error))], schema=schema)

    return blocks.mapInArrow(run, WHITENED)


def deviations(y: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """The sum over dimensions of (n*y - S) squared, exact."""
    apart = n * y - total
    if apart.size and float(np.abs(apart).max()) ** 2 * y.shape[1] >= 2.0 ** 62:
        sums = [sum(v * v for v in row) for row in apart.tolist()]
        if max(sums) >= 1 << 63:
            raise ValueError("a deviation exceeds a long")
        return np.array(sums, dtype=np.int64)
    return (apart * apart).sum(axis=1)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``embeddings``, up to 32 components of 64 * c.

    Null or odd vectors are left out; null ids, ties and repeated rows stay; an empty table gives no rows; columns
    beyond ``vec_id`` and ``embedding`` are not read.
    """
    return whiten(read(spark, sf_dir, "embeddings"))
