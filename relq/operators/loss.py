"""Weighted masked token loss.

Over one batch: position t >= 1 is predicted from t-1 (the shift), its loss is
the token's negative log-likelihood, 0 where the label is -100, and the batch
loss is ``sum(nll * w) / (sum(w) + 1e-8)``; masked positions still add their
weight to the denominator.  Per-row sums are array aggregates (no explode), the losses over unmasked positions only;
the per-batch sum is a partial + final aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relq.functions.masks import IGNORE

EPS = 1e-8


def row_sums(labels: Column, weights: Column, nll) -> tuple[Column, Column]:
    """(sum of nll*w, sum of w) over positions 1.. of one row; ``nll(i)`` gives position i's loss.

    A masked position adds nothing to the first sum, so that one runs over the others only."""
    num = F.aggregate(F.arrow_udf(_targets, "array<int>")(labels, weights), F.lit(0.0), lambda a, i: a + F.when(
        F.get(labels, i) == IGNORE, F.lit(0.0)).otherwise(nll(i)) * F.get(weights, i))
    den = F.aggregate(F.slice(weights, 2, 1 << 30), F.lit(0.0), lambda a, w: a + w)
    some = F.size(labels) > 0
    return F.when(some, num), F.when(some, den)


def _targets(labels: pa.Array, weights: pa.Array) -> pa.Array:
    """Positions 1.. whose term may be other than 0: not masked, or of a weight that is no finite number.  Null: no row."""
    n, m = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (labels, weights))
    label, weight = labels.flatten(), weights.flatten()
    bounds = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(bounds[-1]) - bounds[row]
    term = (pc.fill_null(label, 0).to_numpy(zero_copy_only=False) != IGNORE)
    if len(weight):
        finite = np.isfinite(pc.fill_null(weight.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False))
        term |= (place >= m[row]) | ~finite[np.minimum((np.cumsum(m) - m)[row] + place, len(finite) - 1)]
    else:
        term[:] = True
    term &= place > 0
    upto = np.concatenate([[0], np.cumsum(term)])[bounds]
    found = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(place[term].astype(np.int32)))
    return pc.if_else(pc.and_(labels.is_valid(), weights.is_valid()), found, pa.scalar(None, found.type))


def weighted_loss(rows: DataFrame, nll, labels: str = "labels", weights: str = "loss_weights",
                  batch: str = "batch_id") -> DataFrame:
    """D11 per batch: ``(batch_id, weight_sum, loss)``."""
    num, den = row_sums(F.col(labels), F.col(weights), nll)
    per_row = rows.select(batch, num.alias("_num"), den.alias("_den"))
    return per_row.groupBy(batch).agg(
        F.sum("_den").alias("weight_sum"),
        (F.sum("_num") / (F.sum("_den") + EPS)).alias("loss"))
