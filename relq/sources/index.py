"""Vector index as one parquet table keyed by ``doc_id``.

The original keeps vectors and metadata in two files joined by position; a
keyed table needs no positional alignment and lets the scan prune ``text``
until the k hits are known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.functions.vectors import l2_normalize


def write_index(df: DataFrame, path: str, vec_col: str = "embedding", normalize: bool = True) -> None:
    """Persist ``(doc_id, [text], [label], embedding)``, vectors unit-normalised."""
    out = df.withColumn(vec_col, l2_normalize(F.col(vec_col)).cast("array<float>")) if normalize else df
    out.write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index table; select only the columns a step needs so pruning reaches the scan."""
    return spark.read.parquet(path)
