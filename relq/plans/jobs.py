"""End-to-end jobs, one per step of the original workflow, composed from the operators.

Each job reads tables or files and writes tables or files; nothing is collected.
Run as ``python -m relq.plans.jobs <job> --help``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.operators import evaluation as ev
from relq.operators import retrieval as rt
from relq.operators.batches import padded_batches, with_masks
from relq.operators.embedding import embed_counts
from relq.operators.chat import render_chat, with_answer_key
from relq.operators.gold import gold_flag, gold_rows
from relq.operators.positions import head_rows, slice_rows
from relq.operators.sampling import make_samples, shuffle_order
from relq.operators.tokens import build_vocab, cut_texts, tokenize
from relq.session import configure
from relq.operators.clustered import clustered_topk, write_clustered_index
from relq.sources.index import read_index, write_index
from relq.sources.jsonl import read_samples, write_samples
from relq.templates import CHATML, DEFAULT_SEED


def _corpus(spark: SparkSession, path: str, start=None, stop=None) -> DataFrame:
    """A labelled corpus ``(doc_id, text, label)`` from parquet, optionally sliced by position."""
    corpus = spark.read.parquet(path).select("doc_id", "text", F.col("label").cast("int"))
    return slice_rows(corpus, "doc_id", start, stop) if (start is not None or stop is not None) else corpus


def generate_samples_job(spark, corpus_path, out_path, version=2, start=None, stop=None, num_negatives=1,
                         seed=DEFAULT_SEED, shuffle=False) -> None:
    """Samples as JSONL; v1 files are shuffled in the original, v2 files keep document order."""
    configure(spark)
    s = make_samples(_corpus(spark, corpus_path, start, stop), seed=seed, num_negatives=num_negatives, version=version)
    if shuffle:
        s = s.join(shuffle_order(s, seed), "sample_id")
        write_samples(s, out_path, order="shuffle_pos")
    else:
        write_samples(s, out_path, order="sample_id")


def prepare_training_job(spark, samples_path, out_path, stage="s1", batch_size=4, n_keep=5) -> None:
    """Chat render, built-in tokenizer, masks (stage s1/s2, or v1 with loss weights), padded batches."""
    configure(spark)
    variant = {"s1": "train_s1", "s2": "train_s2", "v1": "train_v1"}[stage]
    s = read_samples(spark, samples_path).withColumnRenamed("line", "sample_id")
    c = with_answer_key(render_chat(s, variant)).select(
        "sample_id", "prompt_text", "full_text", "relevant_idx", F.length("prompt_text").alias("prompt_chars"))
    cut = cut_texts(c, carry=("relevant_idx", "prompt_chars"))
    vocab = build_vocab(cut)
    tok = tokenize(cut, vocab, offsets=(stage == "v1"))
    rows = with_masks(tok, n_keep)
    eos = vocab.where(F.col("piece") == CHATML["eos"]).select("id").first()
    if eos is None:
        raise ValueError(f"the vocabulary has no {CHATML['eos']!r} to pad with")
    pad_id = int(eos["id"])
    if stage == "v1":
        from relq.functions.masks import loss_weights
        rows = rows.withColumn("loss_weights", loss_weights(F.col("input_ids"), F.col("n_prompt"), F.col("offsets"),
                                                            F.col("relevant_idx"), F.col("prompt_chars")))
        b = padded_batches(rows, batch_size, pad_id=pad_id, labels="labels_answer", weights="loss_weights", keys=s)
    else:
        b = padded_batches(rows, batch_size, pad_id=pad_id, labels=f"labels_{stage}", keys=s)
    b.write.mode("overwrite").parquet(out_path)
    vocab.write.mode("overwrite").parquet(out_path.rstrip("/") + "_vocab")


def evaluate_s1_job(spark, samples_path, answers_path, out_path, head=None) -> None:
    """Stage-1 accuracy over the first ``head`` samples, or all (answers: parquet ``(sample_id, answer)``).
    As with selecting ``range(head)``, a file with fewer samples is an error."""
    configure(spark)
    s = read_samples(spark, samples_path).withColumnRenamed("line", "sample_id")
    if head is not None:
        s = head_rows(s, "sample_id", head, require_full=True)
    ev.s1_accuracy(gold_flag(s), spark.read.parquet(answers_path)).write.mode("overwrite").parquet(out_path)


def evaluate_s2_job(spark, samples_path, answers_path, out_path, head=None) -> None:
    """Stage-2 rates and mean summary similarity over the first ``head`` lines, or all (fewer is fine)."""
    configure(spark)
    s = read_samples(spark, samples_path, limit=head).withColumnRenamed("line", "sample_id")
    g = gold_rows(s, on_mismatch="error")
    a = spark.read.parquet(answers_path)
    ev.s2_rates(g, a).write.mode("overwrite").parquet(out_path)
    ev.mean_summary_similarity(g, a).write.mode("overwrite").parquet(out_path.rstrip("/") + "_similarity")


def build_index_job(spark, corpus_path, index_path, start=None, stop=None) -> None:
    """Encode the corpus slice (hashed word counts) and store ``(doc_id, text, label, embedding)``, and the vectors
    once more in blocks that a search can skip (``<index>_clustered``)."""
    configure(spark)
    corpus = _corpus(spark, corpus_path, start, stop)
    write_index(corpus.join(embed_counts(corpus, "doc_id", "text"), "doc_id"), index_path)
    write_clustered_index(read_index(spark, index_path).select("doc_id", "embedding"), index_path.rstrip("/") + "_clustered")


def retrieval_eval_job(spark, index_path, samples_path, out_path, n_queries=None, k=5) -> None:
    """First ``n_queries`` distinct sample queries (None: all), top-k over the index's blocks, judged by label, P@k; also how many
    (query, block) pairs there were and how many were read."""
    configure(spark)
    s = read_samples(spark, samples_path).withColumnRenamed("line", "sample_id")
    fq = rt.first_queries(s, n=n_queries)
    # a query's label: the topic its template belongs to (the first sample it came from)
    from relq.templates import LABEL_TO_QUERIES
    qmap = F.create_map(*[x for lab, qs in LABEL_TO_QUERIES.items() for q in qs for x in (F.lit(q), F.lit(lab))])
    queries = fq.select(F.col("query_rank").alias("query_id"), "query", qmap[F.col("query")].alias("label"))
    queries = queries.join(embed_counts(queries, "query_id", "query"), "query_id")
    index = read_index(spark, index_path)
    counts: dict = {}
    hits = clustered_topk(spark, index_path.rstrip("/") + "_clustered", queries, k=k, counts=counts)
    spark.createDataFrame([(k_, int(v)) for k_, v in counts.items()], "metric string, value long").write.mode("overwrite").parquet(
        out_path.rstrip("/") + "_blocks")
    per_q = rt.precision_at_k(rt.label_judge(hits, queries, index.select("doc_id", "label")), k=k)
    per_q.join(queries.select("query_id", "query"), "query_id").write.mode("overwrite").parquet(out_path)
    rt.mean_precision_at_k(per_q).write.mode("overwrite").parquet(out_path.rstrip("/") + "_mean")


JOBS = {
    "generate": generate_samples_job,
    "prepare": prepare_training_job,
    "eval-s1": evaluate_s1_job,
    "eval-s2": evaluate_s2_job,
    "index": build_index_job,
    "retrieval": retrieval_eval_job,
}


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="relq.plans.jobs")
    p.add_argument("job", choices=sorted(JOBS))
    p.add_argument("args", nargs="*", help="positional paths of the job, in its signature order")
    p.add_argument("--opt", action="append", default=[], help="key=value keyword arguments (ints parsed)")
    ns = p.parse_args(argv)
    kwargs = {}
    for kv in ns.opt:
        k, v = kv.split("=", 1)
        kwargs[k] = int(v) if v.lstrip("-").isdigit() else v
    spark = SparkSession.builder.getOrCreate()
    JOBS[ns.job](spark, *ns.args, **kwargs)


if __name__ == "__main__":
    main()
