"""Operator 9: benchmark decontamination by winnowing, in DataFrame operations only.

Every text becomes an array of word hashes; hashes of 2, 4 and 8 words follow by combining an
array with itself shifted, so a k-gram costs one step a position.  Winnowing keeps, of every run
of ``window - k + 1`` consecutive k-gram hashes, the smallest.  Two texts that share ``window``
words in a row share that run, hence its smallest hash: no shared span of that length is missed,
and about a third of the positions are kept (k = 6, window = 10).

The fingerprints of documents and benchmark meet in a join.  Documents with a common fingerprint
are the candidates; there every hit is extended: their windows join the benchmark's on the hash of
the whole window and are compared word by word.  Benchmark items shorter than a window count as one
window of their own length; their lengths (below ``window``) add plain n-gram hashes to the
documents' fingerprints.

The distinct fingerprints of the benchmark, a long each, are broadcast up to ``BROADCAST_ROWS`` of them; beyond that
this join shuffles like all others, and adaptive execution splits hot hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.llm.common import materialize, read, unused

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # digits, letters a-z and everything beyond ASCII
A_Z, A_Z_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 1 << 20  # fingerprints, 16 MB in a hashed table


def lower_az(c: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does just that where every character is one byte."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, A_Z, A_Z_LOW))


def words_of(c: Column) -> Column:
    """The words of a text; none for null."""
    return F.coalesce(F.regexp_extract_all(lower_az(c), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _shifted(a: str, b: str, by: int, f) -> Column:
    """f(a[i], b[i + by]) wherever both exist."""
    n = F.greatest(F.least(F.size(a), F.size(b) - by), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(by + 1), n), f)


def _with_grams(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Add ``g{n}``, the hash of the n words from each position, for every n of ``lengths``, from ``words``."""
    df = df.withColumn("g1", F.transform("words", lambda x: F.xxhash64(x)))
    have = 1
    while have * 2 <= max(lengths):
        df = df.withColumn(f"g{have * 2}", _shifted(f"g{have}", f"g{have}", have, lambda x, y: F.xxhash64(x, y)))
        have *= 2
    for n in lengths:
        left = 1 << (n.bit_length() - 1)
        name, rest = f"g{left}", n - left
        done = left
        while rest:
            step = 1 << (rest.bit_length() - 1)
            done += step
            if f"g{done}" not in df.columns:
                df = df.withColumn(f"g{done}", _shifted(name, f"g{step}", done - step, lambda x, y: F.xxhash64(x, y)))
            name, rest = f"g{done}", rest - step
    return df


def _with_minima(df: DataFrame, gram: str, run: int) -> DataFrame:
    """Add ``low``: the smallest of each ``run`` consecutive hashes of ``gram``."""
    df = df.withColumn("low", F.col(gram))
    width = 1
    while width < run:
        step = min(width, run - width)
        df = df.withColumn("low", _shifted("low", "low", step, lambda x, y: F.least(x, y)))
        width += step
    return df


def _fingerprints(df: DataFrame, window: int, k: int, short: list[int]) -> Column:
    def plain(n: int) -> Column:
        return F.array_distinct(F.transform(f"g{n}", lambda x: F.xxhash64(x, F.lit(n))))
    return F.concat(F.array_distinct("low"), *map(plain, short))


def _windows(items: DataFrame, window: int, k: int) -> tuple[DataFrame, list[int]]:
    """The benchmark's windows ``(item_id, length, h, wtext, fp)`` and the lengths of short items."""
    sizes = items.where(F.size("words") > 0)
    short = sorted(r[0] for r in sizes.where(F.size("words") < window).select(F.size("words")).distinct().collect())
    g = _with_minima(_with_grams(sizes, sorted({window, k, *short})), f"g{k}", window - k + 1)
    n = F.size("words")
    whole = F.array(F.struct(F.lit(0).alias("at"), n.alias("length"), F.lit(None).cast("long").alias("h")))
    for m in short:
        whole = F.when(n == m, F.array(F.struct(F.lit(0).alias("at"), n.alias("length"), F.get(f"g{m}", F.lit(0)).alias("h")))).otherwise(whole)
    full = F.transform(f"g{window}", lambda h, i: F.struct(i.alias("at"), F.lit(window).alias("length"), h.alias("h")))
    rows = g.select("item_id", "words", "low", F.explode(F.when(n < window, whole).otherwise(full)).alias("w"))
    text = F.array_join(F.slice("words", F.col("w.at") + 1, F.col("w.length")), " ")
    fp = F.when(F.col("w.length") == window, F.get("low", F.col("w.at"))).otherwise(F.xxhash64("w.h", "w.length"))
    return rows.select("item_id", "w.length", "w.h", text.alias("wtext"), fp.alias("fp")), short


def benchmark_hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", window: int = 10, k: int = 6) -> tuple[DataFrame, DataFrame]:
    """``(every, hits)``.

    ``every`` has a row per document row: ``doc_id, text_hash, n_words``.  ``hits`` has a row per
    distinct (doc_id, text_hash) with at least one window of the benchmark: ``n_hit`` (words inside
    any occurrence), ``items`` (ids as sorted strings) and ``spans`` (merged [start, end) word
    positions).  Null and wordless texts have no words and no hits; rows that repeat an id are
    told apart by their text; items without words or with a null id are no items.
    """
    if not 0 < k <= window:
        raise ValueError("k must be 1 to window")
    items = (bench.select(F.col(item_col).cast("string").alias("item_id"), words_of(F.col(item_text_col)).alias("words"))
             .where(F.col("item_id").isNotNull()))
    wins, short = _windows(items, window, k)
    wins = materialize(wins)
    known = materialize(wins.select("fp").distinct())
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    grams = _with_minima(_with_grams(base.select("doc_id", "text_hash", words_of(F.col("text")).alias("words")),
                                     sorted({k, *short})), f"g{k}", window - k + 1)
    prints = materialize(grams.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"),
                                      _fingerprints(grams, window, k, short).alias("fps")))
    every = prints.select("doc_id", "text_hash", "n_words")
    # written, so that the next join is planned by its real size: few candidates are broadcast, and no text moves
    met = materialize(prints.select("doc_id", "text_hash", F.explode("fps").alias("fp"))
                      .join(known, "fp", "left_semi")
                      .groupBy("doc_id", "text_hash").agg(F.lit(1).alias("__met")).drop("__met"))
    cand = materialize(base.join(met.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"}),
                                 (F.col("text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
                       .dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", words_of(F.col("text")).alias("words")))
    # extend: every window of a candidate against the benchmark's windows, first by hash, then by words
    lengths = [window, *short]
    g = _with_grams(cand, lengths)

    def tagged(n: int) -> Column:
        return F.transform(f"g{n}", lambda h, i: F.struct(i.alias("at"), F.lit(n).alias("length"), h.alias("h")))

    at = F.concat(*map(tagged, lengths))
    distinct = wins.groupBy("length", "h", "wtext").agg(F.lit(1).alias("__one")).drop("__one")
    same = (g.select("doc_id", "text_hash", F.explode(at).alias("w")).select("doc_id", "text_hash", "w.at", "w.length", "w.h")
            .join(distinct, ["length", "h"])
            .groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("at", "length", "wtext"))).alias("found")))
    checked = (cand.join(same.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"}),
                         (F.col("text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")))
               .select("doc_id", "text_hash", F.filter("found", lambda m: F.array_join(
                   F.slice("words", m["at"] + 1, m["length"]), " ") == m["wtext"]).alias("found"))
               .where(F.size("found") > 0))
    checked = materialize(checked)
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def merge(acc: Column, m: Column) -> Column:
        """Add a window to the merged spans; windows come sorted by their start."""
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], m["at"] + m["length"]).alias("end"))
        new = F.struct(m["at"].alias("start"), (m["at"] + m["length"]).alias("end"))
        return F.when((F.size(acc) > 0) & (m["at"] <= last["end"]),
                      F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))
                      ).otherwise(F.concat(acc, F.array(new)))

    spans = F.aggregate("found", empty, merge)
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    names = (checked.select("doc_id", "text_hash", F.explode(F.array_distinct(F.transform("found", lambda m: m["wtext"]))).alias("wtext"))
             .join(wins.select("wtext", "item_id").distinct(), "wtext")
             .groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
             .withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"}))
    hits = (checked.select("doc_id", "text_hash", spans.alias("spans"))
            .join(names, (F.col("text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")))
            .select("doc_id", "text_hash", covered.alias("n_hit"), "items", "spans"))
    return every, hits


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark; all columns are kept.

    Null, empty and wordless texts stay; rows that repeat an id, or have none, are told apart by their text, and exact repeats go
    or stay together; an empty table stays empty, and without benchmark items nothing goes.
    """
    _, hits = benchmark_hits(docs, bench, id_col, text_col, **kw)
    the_id, the_hash = unused(docs, "hit_id", "hit_hash")
    gone = hits.select(F.col("doc_id").alias(the_id), F.col("text_hash").alias(the_hash))
    return docs.join(gone, (F.xxhash64(F.col(text_col)) == F.col(the_hash)) & F.col(id_col).eqNullSafe(F.col(the_id)), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` against whole ``benchmark``, windows of 10 words.

    Null, empty and wordless texts have no words and no hits; long texts are read whole; repeated ids are told apart by their
    text, equal rows have equal results; empty tables give no rows or no hits; other columns are not read.
    """
    every, hits = benchmark_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    h = hits.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "n_hit", "items")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return (every.join(h, (F.col("text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, l, array_to_string(w[p:p + l - 1], ' ') AS t
  FROM (SELECT item_id, w, least(len(w), 10) AS l, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, l, p, array_to_string(w[p:p + l - 1], ' ') AS t
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM wins) WHERE len(w) >= l)),
m AS (SELECT doc_id, item_id, p, wins.l AS l FROM dw JOIN wins ON dw.l = wins.l AND dw.t = wins.t),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
