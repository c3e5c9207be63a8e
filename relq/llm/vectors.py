"""Vector columns as numpy matrices, shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension(df: DataFrame, vec_col: str) -> int:
    """The length that most whole vectors have (of equals the largest), 0 if there is none.

    A whole vector is not null, not empty and holds finite numbers only.
    """
    v = F.col(vec_col).cast("array<double>")
    whole = v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    top = (df.where(whole & (F.size(v) > 0)).groupBy(F.size(v).alias("d")).count()
           .orderBy(F.col("count").desc(), F.col("d").desc()).first())
    return int(top.d) if top else 0


def whole_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): the places of the vectors of ``dim`` finite numbers, and those vectors as doubles."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    x = column.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # a null is a NaN
    finite = np.isfinite(x).all(axis=1)
    return np.flatnonzero(fits.to_numpy(zero_copy_only=False))[finite], x[finite]


def scaled_floor(x: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * x) as longs; a number at or beyond ``limit`` is an error, as later sums would not be exact."""
    y = np.floor(x * scale)
    if y.size and np.abs(y).max() >= limit:
        raise ValueError(f"a component times {scale} reaches {limit}")
    return y.astype(np.int64)


def summed(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all tasks of the vectors that ``partial`` makes of a task's batches.

    Every task gives one vector; Spark adds them by place, so what reaches the driver is one vector.
    """
    schema = pa.schema([("i", pa.int32()), ("v", pa.float64() if kind == "double" else pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = partial(it)
        if v is not None:
            yield pa.record_batch([pa.array(np.arange(v.size, dtype=np.int32)), pa.array(v.ravel(), type=schema[1].type)], schema=schema)

    rows = df.mapInArrow(run, f"i int, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows), dtype=np.float64 if kind == "double" else np.int64)
    for r in rows:
        out[r.i] = r.v
    return out
