"""JSONL samples: sink with Python's spacing, scans with an explicit schema (A3, A4, A5)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.functions import jsonparse as J
from relq.functions.jsonfmt import json_object, json_string
from relq.operators.positions import grouped_prefix_sum, materialize, with_position

SAMPLE_FIELDS = ("instruction", "input", "output")


def sample_json(fields=SAMPLE_FIELDS) -> F.Column:
    """``json.dumps(sample, ensure_ascii=False)`` of the named string columns (H5)."""
    return json_object([(f, json_string(F.col(f))) for f in fields])


def sample_line(df: DataFrame, fields=SAMPLE_FIELDS) -> DataFrame:
    """One JSONL line per row, in a ``value`` column (the text writer's column)."""
    return df.select(sample_json(fields).alias("value"))


def write_samples(df: DataFrame, path: str, order: str | None = "sample_id", fields=SAMPLE_FIELDS) -> None:
    """A5 (+A6): write JSONL, UTF-8, non-ASCII raw; rows in ``order`` across the part files.

    The sort is a distributed range sort; the writer creates the directory.
    """
    if order:
        df = df.orderBy(order)
    sample_line(df, fields).write.mode("overwrite").text(path)


def _ordered_files(spark: SparkSession, path: str) -> list[str]:
    """Data files of a folder (or the one file) by part number, then name; only their names are listed."""
    names = [r[0] for r in spark.read.format("binaryFile").load(path).select("path").collect()]

    def key(p: str):
        name = p.rsplit("/", 1)[-1]
        m = re.match(r"part-(\d+)", name)
        return (int(m[1]) if m else -1, name, p)
    return sorted(names, key=key)


INDEX_SCHEMA = "file string, block long, size long, first long, lines long, line long"
INDEX_ROW_BYTES = 200  # of a row of the index in a hashed table
BROADCAST_BYTES = 256 << 20


def _blocks(spark: SparkSession, files: list[str]) -> DataFrame:
    """The lines of ``files`` with the file block they were read from and their number in the scan."""
    meta = {"_f": "file_path", "_b": "file_block_start", "_s": "file_block_length"}
    return spark.read.text(files).select("value", *[F.col(f"_metadata.{m}").alias(c) for c, m in meta.items()],
                                         F.monotonically_increasing_id().alias("_mid"))


def line_index(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """The lines of a JSONL folder by file block: ``(file, block, size, first, lines, line)``.

    ``line`` is the number of the block's first line in the order of the files (part number, then offset), ``first`` the number
    that the scan gave it.  One row a file block; the text is read and not written.
    """
    files = _ordered_files(spark, path) if files is None else files
    if not files:
        return spark.createDataFrame([], INDEX_SCHEMA)
    rank = spark.createDataFrame(list(enumerate(files)), "_rank long, _path string")
    blocks = _blocks(spark, files).groupBy("_f", "_b", "_s").agg(F.count(F.lit(1)).alias("lines"), F.min("_mid").alias("first"))
    # listed and scanned names may differ in the scheme's slashes only
    norm = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    ordered = materialize(blocks.join(rank, norm(F.col("_f")) == norm(F.col("_path"))))
    # positions of blocks by (file, offset), then a running sum over positions in chunks: no task holds the blocks of all files
    placed = with_position(ordered.select("_rank", "_b", "_s", "_f", "first", "lines"), ["_rank", "_b"], name="_p")
    summed = grouped_prefix_sum(placed.withColumn("_all", F.lit(0)), "_all", "_p", "lines", "_upto")
    return summed.select(F.col("_f").alias("file"), F.col("_b").alias("block"), F.col("_s").alias("size"), "first", "lines",
                         (F.col("_upto") - F.col("lines")).cast("long").alias("line"))


def write_line_index(spark: SparkSession, path: str, index_path: str) -> None:
    """Persist :func:`line_index`, a small table that later reads number their lines with."""
    line_index(spark, path).write.mode("overwrite").parquet(index_path)


def _numbered_lines(spark: SparkSession, files: list[str], index: DataFrame) -> DataFrame:
    """``(line, value)``: lines numbered by the index, without a shuffle and without a second copy of any text.

    A scan reads each file block in order, so a line's number is that of its block plus its place in it.  The index holds for
    scans that cut the files into the same blocks in the same tasks (the session pins what that depends on).  Another cut
    is an error, never a wrong number: a block that the index lacks, or a place beyond a block's lines, fails the job, and numbers of a
    scan are unique, so blocks whose places all fit are the indexed ones.
    """
    known = index.select(F.col("file").alias("_if"), F.col("block").alias("_ib"), F.col("size").alias("_is"), "first", "lines", F.col("line").alias("_start"))
    if index.count() * INDEX_ROW_BYTES <= BROADCAST_BYTES:
        known = F.broadcast(known)
    met = _blocks(spark, files).join(known, (F.col("_f") == F.col("_if")) & (F.col("_b") == F.col("_ib")) & (F.col("_s") == F.col("_is")), "left")
    place = F.col("_mid") - F.col("first")
    fits = F.coalesce((place >= 0) & (place < F.col("lines")), F.lit(False))
    refuse = F.raise_error(F.concat(F.lit("the line index does not fit this scan, write it again: "), F.col("_f"))).cast("long")
    return met.select(F.when(fits, F.col("_start") + place).otherwise(refuse).alias("line"), "value")


def read_samples(spark: SparkSession, path: str, limit: int | None = None, fields=SAMPLE_FIELDS, index_path: str | None = None) -> DataFrame:
    """A3/A4: JSONL as ``(line, *fields)``; ``line`` is 0-based in file order (part number, then offset).

    Lines are numbered by the index at ``index_path`` (see :func:`write_line_index`), or by one that is made for this read: the
    files are then scanned twice, and only the index is written.

    Every line must be exactly one JSON object with all ``fields`` as strings; anything else (a blank
    line, text behind the object, a missing key) fails the job, as a plain ``json.loads`` loop does.
    ``limit`` counts lines *read*, before any row is dropped downstream; files are read until that
    many lines are found, and lines beyond are not checked.
    """
    files = _ordered_files(spark, path)
    if limit is not None and index_path is None:
        n = 1
        while n < len(files) and spark.read.text(files[:n]).limit(limit).count() < limit:
            n = min(len(files), 4 * n)
        files = files[:n]
    if not files:
        return spark.createDataFrame([], "line long, " + ", ".join(f"`{f}` string" for f in fields))
    if index_path is not None:
        index = spark.read.schema(INDEX_SCHEMA).parquet(index_path)
    else:
        index = materialize(line_index(spark, path, files))
    lines = _numbered_lines(spark, files, index)
    if limit is not None:
        lines = lines.where(F.col("line") < limit)
    w, top = F.col("_w"), F.col("_top")
    values = [J.string_value(F.try_variant_get(top, f"$.{f}", "variant")) for f in fields]
    ok = J.is_valid(w) & J.is_object(top)
    for v in values:
        ok = ok & v.isNotNull()
    checked = F.when(F.coalesce(ok, F.lit(False)), top).otherwise(F.raise_error(F.concat(
        F.lit("not one JSON object with the sample fields, line "), F.col("line").cast("string"))).cast("variant"))
    return (lines.withColumn("_w", J.wrap_parse(F.col("value"))).withColumn("_top", J.field(w, "$"))
            .withColumn("_top", checked).select("line", *[v.alias(f) for v, f in zip(values, fields)]))
