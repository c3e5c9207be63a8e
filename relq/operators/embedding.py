"""The built-in text encoder (J3) inside the tasks that read the texts: hashed word counts per document.

Words (letter, digit and underscore runs of the lower-cased text) fall into ``dim`` buckets by the MD5
draw that all of relq uses; a document's vector is its bucket counts.  Texts are cut into words together, a part of a batch at a
time, and each distinct word of a part is hashed once, whatever it occurs; then (row, bucket) pairs are counted.  No word is
a row and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from relq.functions.hashing import hash_words
from relq.functions.runs import char_classes, split_words, text_parts
from relq.templates import DEFAULT_SEED

DIM = 64


def embed_counts(df: DataFrame, key: str, text: str, dim: int = DIM, seed: int = DEFAULT_SEED, out: str = "embedding") -> DataFrame:
    """``(key, out)``: the word counts of ``text`` by bucket, as an array of doubles; zeros for null and wordless texts.

    Repeated keys are rows of their own.  The vectors are not normalised; the scorer does that.
    """
    classes = char_classes(df.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo, hi in text_parts(b.column(1)):
                row, words = split_words(b.column(1).slice(lo, hi - lo), classes.value)
                words = words.dictionary_encode()
                bucket = hash_words(seed, words.dictionary, "embed") % dim
                at = row * dim + bucket[words.indices.to_numpy()]
                counts = np.bincount(at, minlength=(hi - lo) * dim).astype(np.float64)
                bounds = np.arange(0, len(counts) + 1, dim, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(bounds, counts)], names=[key, out])

    rows = df.select(F.col(key), F.lower(F.col(text)).alias("_text"))
    return rows.mapInArrow(run, StructType([rows.schema.fields[0], StructField(out, ArrayType(DoubleType()))]))
