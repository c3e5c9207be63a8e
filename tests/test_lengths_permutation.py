"""The keyed bijection, length sketches and length buckets."""

import math

import pytest
from pyspark.sql import functions as F

from relq.functions.masks import IGNORE
from relq.operators import batches as B
from relq.operators.lengths import (RANK_ERROR, append_sketches, bucket_edges, length_sketches, merged_sketches, quantiles, rank_errors,
                                    read_sketches)
from relq.operators.permutation import halves, permute, permuted


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 16, 17, 100, 101, 1023, 5000])
def test_permutation_of_every_size(spark, n):
    out = [r.shuffle_pos for r in permute(spark.range(n).withColumnRenamed("id", "pos"), n).collect()]
    assert sorted(out) == list(range(n))
    a, b = halves(n)
    assert n <= a * b < n + a


def test_permutation_depends_on_seed_only(spark):
    rows = spark.range(300).withColumnRenamed("id", "pos").withColumn("row", F.col("pos"))
    one = {r.row: r.shuffle_pos for r in permute(rows, 300).collect()}
    assert {r.row: r.shuffle_pos for r in permute(rows.repartition(7), 300).collect()} == one
    other = {r.row: r.shuffle_pos for r in permute(rows, 300, seed=2).collect()}
    assert sum(one[k] == other[k] for k in one) < 10
    # it mixes: neighbours are far apart on average, as in a random order (a third of n)
    gaps = [abs(one[i] - one[i + 1]) for i in range(299)]
    assert 80 < sum(gaps) / len(gaps) < 120


def test_permutation_has_no_exchange(spark):
    plan = permute(spark.range(0, 100, 1, 4).withColumnRenamed("id", "pos"), 100)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_permutation_refuses_other_positions(spark):
    for bad in (-1, 10):
        with pytest.raises(Exception):
            spark.range(1).select(permuted(F.lit(bad).cast("long"), 10)).collect()
    assert spark.range(1).select(permuted(F.lit(None).cast("long"), 10).alias("x")).first().x is None


def lengths(spark, n=20_000):
    return spark.range(n).select(((F.col("id") * 7919) % 1000).alias("v"), F.when(F.col("id") % 3 == 0, F.lit(5)).alias("w"))


def test_sketch_quantiles_within_rank_error(spark, tmp_path):
    rows, measures = lengths(spark), {"v": F.col("v"), "w": F.col("w")}
    whole = length_sketches(rows.repartition(5), measures)
    found = rank_errors(rows, measures, quantiles(whole)).collect()
    assert len(found) == 6 and all(r.rank_error <= RANK_ERROR for r in found)
    assert {r.measure: r.n for r in found} == {"v": 20_000, "w": 6667}
    # three runs kept as rows of a table, merged later
    for i in range(3):
        append_sketches(length_sketches(rows.where(F.col("v") % 3 == i), measures, run=str(i)), str(tmp_path / "s"))
    merged = read_sketches(spark, str(tmp_path / "s"))
    again = rank_errors(rows, measures, quantiles(merged)).collect()
    assert {r.measure: r.n for r in again} == {"v": 20_000, "w": 6667} and all(r.rank_error <= RANK_ERROR for r in again)
    assert merged_sketches(whole).count() == 2
    assert length_sketches(rows.where("false"), measures).count() == 0


def test_bucket_edges(spark):
    s = length_sketches(lengths(spark), {"v": F.col("v"), "w": F.col("w")})
    edges = bucket_edges(s, "v", 4)
    assert len(edges) == 3 and all(abs(e - 250 * (i + 1)) < 20 for i, e in enumerate(edges))
    assert bucket_edges(s, "w", 4) == [5] and bucket_edges(s, "v", 1) == []


def token_table(spark, sizes):
    return spark.createDataFrame([(i, list(range(n)), [IGNORE] * n, 9) for i, n in enumerate(sizes)],
                                 "sample_id long, input_ids array<int>, labels_s1 array<int>, eos_id int").repartition(3)


def test_bucketed_batches(spark):
    sizes = [(i * 37) % 50 for i in range(101)]
    rows, edges = token_table(spark, sizes), [10, 20, 30]
    out = B.bucketed_batches(rows, edges, 4).collect()
    assert sorted(r.sample_id for r in out) == list(range(101))
    by = {}
    for r in out:
        by.setdefault(r.batch_id, []).append(r)
        assert r.bucket == sum(e < sizes[r.sample_id] for e in edges)
        assert len(r.input_ids) == len(r.labels) == len(r.attention_mask) == r.max_len and sum(r.attention_mask) == sizes[r.sample_id]
    assert sorted(by) == list(range(len(by)))
    of_bucket = {}
    for b, rs in by.items():
        assert len({r.bucket for r in rs}) == 1 and rs[0].max_len == max(sizes[r.sample_id] for r in rs) and len(rs) <= 4
        of_bucket.setdefault(rs[0].bucket, []).append(len(rs))
    for k, n in of_bucket.items():
        total = sum(sum(e < s for e in edges) == k for s in sizes)
        assert len(n) == math.ceil(total / 4) and sum(n) == total
    plain, dealt = (B.padding_share(b).first() for b in (B.padded_batches(rows, 4), B.bucketed_batches(rows, edges, 4)))
    assert dealt.tokens == plain.tokens == sum(sizes) and dealt.padding_share < plain.padding_share / 2


def test_bucketed_batches_odd(spark):
    rows = token_table(spark, [0, 0, 5])
    assert sorted((r.sample_id, r.bucket, r.batch_id) for r in B.bucketed_batches(rows, [], 2).collect()) == [(0, 0, 0), (1, 0, 0), (2, 0, 1)]
    assert B.bucketed_batches(rows.where("false"), [3]).count() == 0
