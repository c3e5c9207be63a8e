"""Label masks and loss weights over token arrays (H20-H23, H25), as ``transform`` lambdas.

``s`` is the number of prompt tokens (after truncation), ``found`` whether the
answer contains the key, ``n`` the number of kept tokens (5 in both stages).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100


def _only(ids: Column, begin: Column, end: Column | None, found: Column | None = None) -> Column:
    """``ids`` at places [begin, end), all else -100, put together from runs: no lambda runs over the tokens.  A null bound
    or ``found`` keeps none."""
    n = F.size(ids)
    a = F.greatest(F.lit(0), F.least(begin.cast("int"), n))
    b = n if end is None else F.greatest(a, F.least(end.cast("int"), n))
    known = begin.isNotNull() if end is None else begin.isNotNull() & end.isNotNull()
    kept = F.concat(F.array_repeat(F.lit(IGNORE), a), F.slice(ids, a + 1, b - a), F.array_repeat(F.lit(IGNORE), n - b))
    none = F.array_repeat(F.lit(IGNORE), n)
    return F.when(ids.isNull(), None).when(known if found is None else known & found, kept).otherwise(none)


def mask_stage1(ids: Column, s: Column, found: Column, n: int = 5) -> Column:
    """Keep tokens [s, s+n) when the key is found; all else -100."""
    return _only(ids, s, s + n, found)


def mask_stage2(ids: Column, s: Column, found: Column, n: int = 5) -> Column:
    """Keep tokens from s+n to the end when the key is found."""
    return _only(ids, s + n, None, found)


def mask_answer(ids: Column, s: Column) -> Column:
    """The whole answer kept, the prompt -100."""
    return _only(ids, s, None)


def loss_weights(ids: Column, s: Column, offsets: Column, key_idx: Column, prompt_chars: Column,
                 anchor: str = "answer", boost: float = 5.0, window: int = 30) -> Column:
    """0 on the prompt, 1 on the answer, ``boost`` on tokens starting within ``window``
    characters after the key.

    ``anchor='answer'`` measures the key position in the full text (the intent);
    ``anchor='reference'`` uses the key's offset inside the answer against full-text
    token offsets, as the original weighting did, which boosts prompt tokens.
    """
    r = key_idx if anchor == "reference" else key_idx + prompt_chars
    weigh = F.arrow_udf(_weights, "array<double>")
    return F.when(ids.isNotNull(), weigh(F.size(ids), s, offsets, key_idx >= 0, r, F.lit(float(boost)), F.lit(window)))


def _weights(n: pa.Array, s: pa.Array, offsets: pa.Array, found: pa.Array, r: pa.Array, boost: pa.Array, window: pa.Array) -> pa.Array:
    """The weights of all rows of a batch at once.  What is null (a bound, an offset) boosts or keeps nothing."""
    size = np.maximum(pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64), 0)  # rows without ids: none
    have = pc.fill_null(pc.list_value_length(offsets), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    bounds = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(bounds[-1]) - bounds[row]
    if np.any((have < size) & offsets.is_valid().to_numpy(zero_copy_only=False)):
        raise ValueError("a row has fewer offsets than ids")
    # a row without offsets is not found; its places read some offset, which does not count
    values = offsets.flatten()
    at = np.minimum((np.cumsum(have) - have)[row] + place, max(len(values) - 1, 0))
    known = (pc.and_kleene(pc.fill_null(found, False), pc.and_(r.is_valid(), offsets.is_valid()))).to_numpy(zero_copy_only=False)[row]
    if len(values):
        start = pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(np.int64)[at]
        known &= values.is_valid().to_numpy(zero_copy_only=False)[at]
        low = pc.fill_null(r, 0).to_numpy(zero_copy_only=False).astype(np.int64)[row]
        known &= (start >= low) & (start <= low + (window[0].as_py() if len(window) else 0))
    else:
        known = np.zeros(len(row), dtype=bool)
    answer = s.is_valid().to_numpy(zero_copy_only=False)[row] & (place >= pc.fill_null(s, 0).to_numpy(zero_copy_only=False)[row])
    weight = np.where(known, boost[0].as_py() if len(boost) else 0.0, answer.astype(np.float64))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(weight))


def pad(arr: Column, to_len: Column, value) -> Column:
    """Right-pad an array to ``to_len`` with ``value``."""
    return F.concat(arr, F.array_repeat(F.lit(value), to_len - F.size(arr)))


def attention(n: Column, to_len: Column) -> Column:
    """1 for real tokens, 0 for padding."""
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), to_len - n))


def as_text(arr: Column) -> Column:
    """Comma-joined text form of an array (type-neutral for comparisons)."""
    return F.array_join(arr.cast("array<string>"), ",")


def ints_as_text(arr: Column) -> Column:
    """:func:`as_text` of integers, written a batch at once."""
    return F.arrow_udf(_joined, "string")(arr)


def doubles_as_text(arr: Column) -> Column:
    """:func:`as_text` of doubles; rows of small whole numbers, as weights are, are written a batch at once."""
    return F.coalesce(F.arrow_udf(_whole_joined, "string")(arr), as_text(arr))


def _joined(lists: pa.Array) -> pa.Array:
    return _join(lists, lambda values: values.cast(pa.string()))


def _join(lists: pa.Array, text) -> pa.Array:
    values = lists.flatten()
    bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    if values.null_count:  # array_join leaves nulls out
        bounds = np.concatenate([[0], np.cumsum(values.is_valid().to_numpy(zero_copy_only=False))])[bounds]
        values = values.drop_null()
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), text(values)), ",")
    return pc.if_else(lists.is_valid(), joined, pa.scalar(None, pa.string()))


def _whole_joined(lists: pa.Array) -> pa.Array:
    """Texts of the rows whose entries are all whole numbers below ten million, which have one decimal; null for others."""
    def text(values: pa.Array) -> pa.Array:
        v = values.dictionary_encode()
        return pa.array([f"{x:.1f}" if x.is_integer() and abs(x) < 1e7 else None for x in v.dictionary.to_pylist()], pa.string()).take(v.indices)

    return _join(lists, text)
