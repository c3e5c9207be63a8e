"""Registered queries: one per inventory operator group, each with its DuckDB oracle.

Every query reads the given tables (or what Spark derives from them) in full.
``QUERIES[name](spark, sf_dir) -> DataFrame``; ``ORACLE[name]`` is DuckDB SQL over
the same tables registered as views.  Column names are identical on both sides.
"""

from __future__ import annotations

import os as _os
import uuid as _uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.functions import jsonparse as J
from relq.functions import masks as M
from relq.functions.hashing import hash_u32
from relq.functions.text import extract_query
from relq.functions.vectors import fixed_point, l2_normalize, norm
from relq.operators import batches as B
from relq.operators import evaluation as ev
from relq.operators import retrieval as rt
from relq.operators.embedding import embed_counts
from relq.operators.clustered import clustered_topk, write_clustered_index
from relq.operators.grid import grid_topk
from relq.operators.chat import conversation_masks, prompt_column, render_chat, render_turns, with_answer_key
from relq.operators.gold import gold_flag, gold_rows
from relq.operators.lengths import RANK_ERROR, bucket_edges, length_sketches, quantiles, rank_errors
from relq.operators.loss import weighted_loss as _weighted_loss
from relq.operators.permutation import ROUNDS, permute
from relq.operators.positions import head_rows, materialize, number_by_key, slice_rows, with_position
from relq.operators.sampling import make_samples, shuffle_order
from relq.operators.tokens import build_vocab, cut_texts, tokenize
from relq.plans import sql as S
from relq.plans.answers import damage, derive_answers
from relq.session import checkpoint_dir, configure
from relq.sources import jsonl as JL
from relq.sources.index import read_index, write_index
from relq.sources.report import to_long
from relq.sources.tables import read_corpus, read_embeddings, read_table
from relq.streaming import arrivals as AR
from relq.streaming import distinct as DS
from relq.streaming import scoring as ST
from relq.templates import CHATML, INSTRUCTIONS, MAX_TOKENS, PROMPT_VARIANTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return run
    return deco


# ---- shared plan fragments ------------------------------------------------------------

def samples(spark, sf_dir, version=2) -> DataFrame:
    return make_samples(read_corpus(spark, sf_dir), version=version)


def eval_samples(spark, sf_dir) -> DataFrame:
    """The samples as an evaluation file would hold them: some lines are damaged."""
    return damage(samples(spark, sf_dir))


def gold(spark, sf_dir, keep=()) -> DataFrame:
    return gold_rows(eval_samples(spark, sf_dir), keep=keep, on_mismatch="drop")


def answers(spark, sf_dir) -> DataFrame:
    return derive_answers(gold(spark, sf_dir), silent=True)


def eval_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(gold rows, answers), each written once, as an evaluation reads them: parsing plans hold no answer builder."""
    g = materialize(gold(spark, sf_dir).select("sample_id", "relevant", "gold_query_topic", "gold_document_topic", "gold_summary"))
    return g, materialize(derive_answers(g, silent=True))


# ---- A1, A2, E1 -----------------------------------------------------------------------

@register("corpus_positions", S.with_ctes([("corpus", S.CORPUS)],
          "SELECT doc_id, label, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS pos FROM corpus"))
def corpus_positions(spark, sf_dir):
    """0-based position of every document by doc_id (distributed numbering)."""
    return with_position(read_corpus(spark, sf_dir).select("doc_id", "label"), ["doc_id"])


@register("corpus_slice", S.with_ctes([("corpus", S.CORPUS)], """SELECT doc_id, label, text FROM (
  SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM corpus)
  WHERE pos < (n * 50) // 100"""))
def corpus_slice(spark, sf_dir):
    """A2: the training slice ``[:50%]`` of the corpus by position."""
    return slice_rows(read_corpus(spark, sf_dir), "doc_id", None, "50%").select("doc_id", "label", "text")


# ---- samples (C1-C3, H1-H5, J7, G2, G3, F2) --------------------------------------------

@register("samples_v2", S.with_ctes(S.samples_ctes(2), "SELECT * FROM samples"))
def samples_v2(spark, sf_dir):
    """One positive + one negative per document, structured JSON reason."""
    return samples(spark, sf_dir, 2)


@register("samples_v1", S.with_ctes(S.samples_ctes(1), "SELECT * FROM samples"))
def samples_v1(spark, sf_dir):
    """v1 samples: plain-string reason keyed by document / negative label."""
    return samples(spark, sf_dir, 1)


@register("sample_shuffle", S.with_ctes(S.samples_ctes(1), f"""SELECT sample_id,
  (row_number() OVER (ORDER BY {S.hash_hex(S.SEED, 'sample_id', "'shuffle'")}, sample_id) - 1)::BIGINT AS shuffle_pos
  FROM samples"""))
def sample_shuffle(spark, sf_dir):
    """reproducible full shuffle of the samples, as positions."""
    return shuffle_order(samples(spark, sf_dir, 1))


def _permutation_sql() -> str:
    """The rounds of ``permutation`` as nested selects over (sample_id, s, x), walked by a recursive query."""
    inner = "SELECT sample_id, s, a, b, n, x // b AS l, x % b AS r FROM walk, size WHERE s = 0 OR x >= n"
    for i in range(ROUNDS):
        own, other, m = ("r", "l", "b") if i % 2 else ("l", "r", "a")
        drawn = S.pick(f"concat_ws('|', {i}, {other})", "permute", 1 << 32)
        inner = f"SELECT sample_id, s, a, b, n, ({own} + {drawn}) % {m} AS {own}, {other} FROM ({inner})"
    return S.with_ctes(S.samples_ctes(1) + [
        ("size", """SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM (SELECT count(*) AS n FROM samples))"""),
        ("walk", f"""SELECT sample_id, (row_number() OVER (ORDER BY sample_id) - 1)::BIGINT AS x, 0 AS s FROM samples
  UNION ALL SELECT sample_id, (l * b + r)::BIGINT AS x, s + 1 AS s FROM ({inner})""")],
        "SELECT sample_id, x AS shuffle_pos FROM walk, size WHERE s > 0 AND x < n").replace("WITH ", "WITH RECURSIVE ", 1)


@register("sample_permutation", _permutation_sql())
def sample_permutation(spark, sf_dir):
    """a full shuffle of the samples as a keyed bijection of their positions: nothing is sorted by the shuffled order."""
    pos = with_position(samples(spark, sf_dir, 1).select("sample_id"), ["sample_id"])
    return permute(pos, pos.count())


# ---- gold and answers (B3-B7) -----------------------------------------------------------

@register("gold_rows", S.with_ctes(S.samples_ctes(2) + [("gold", S.GOLD)], "SELECT * FROM gold"))
def gold_rows_q(spark, sf_dir):
    """(query, document) split and gold fields of every sample."""
    return gold(spark, sf_dir)


@register("model_answers", S.with_ctes(S.eval_ctes(), "SELECT * FROM answers"))
def model_answers(spark, sf_dir):
    """Derived answers: one of 28 answer shapes per gold row (the input of the parsing queries)."""
    return answers(spark, sf_dir)


# ---- parsing policies (H9-H15b) -----------------------------------------------------------

@register("flag_lenient", S.with_ctes(S.eval_ctes(), S.LENIENT))
def flag_lenient(spark, sf_dir):
    """Stage-1 lenient flag of every answer (nullable)."""
    _, a = eval_inputs(spark, sf_dir)
    return J.with_lenient_flag(a, "answer", "flag").select("sample_id", "answer_class", "flag")


@register("flag_strict", S.with_ctes(S.eval_ctes() + [("strict", S.STRICT)],
          "SELECT sample_id, answer_class, json_valid, relevance_match, reason_complete FROM strict"))
def flag_strict(spark, sf_dir):
    """Stage-2 strict validity, agreement and completeness per answer."""
    g, a = eval_inputs(spark, sf_dir)
    return ev.s2_scored(g, a, carry=("answer_class",)).select(
        "sample_id", "answer_class", "json_valid", "relevance_match", "reason_complete")


@register("flag_judge", S.with_ctes(S.eval_ctes(), S.JUDGE))
def flag_judge(spark, sf_dir):
    """Retrieval-judge flag of every answer (strict, failure = false)."""
    _, a = eval_inputs(spark, sf_dir)
    return J.with_judge_flag(a, "answer", "flag").select("sample_id", "answer_class", "flag")


# ---- metrics (C4, D1-D8, D15) -------------------------------------------------------------

def _s1_sql(join: str, silent: bool) -> str:
    return S.with_ctes(S.eval_ctes(silent) + [("flags", S.LENIENT), ("gold_flags", S.GOLD_FLAGS)], f"""SELECT
  count(*) AS total, CAST(count_if(pred = gold) AS BIGINT) AS correct, CAST(count_if(pred IS NULL) AS BIGINT) AS failed,
  round(count_if(pred = gold) / greatest(count(*), 1), 6) AS accuracy
  FROM (SELECT g.sample_id, g.gold, f.flag AS pred FROM gold_flags g {join} JOIN flags f USING (sample_id))""")


_S1 = _s1_sql("LEFT", True)


@register("s1_accuracy", _S1)
def s1_accuracy(spark, sf_dir):
    """Stage-1 accuracy with failed parses kept in the total."""
    return ev.s1_accuracy(gold_flag(eval_samples(spark, sf_dir)), answers(spark, sf_dir))


@register("majority_baseline", S.with_ctes(S.samples_ctes(2) + [("gold_flags", S.GOLD_FLAGS)], """SELECT
  count(*) AS total, round(greatest(avg(gold::INTEGER), 1 - avg(gold::INTEGER)), 6) AS majority_rate FROM gold_flags"""))
def majority_baseline(spark, sf_dir):
    """Accuracy of always answering the commoner gold flag."""
    return ev.majority_baseline(gold_flag(eval_samples(spark, sf_dir)))


def _s2_sql(silent: bool) -> str:
    return S.with_ctes(S.eval_ctes(silent) + [("strict", S.STRICT)], """SELECT count(*) AS samples,
  round(count_if(json_valid) / count(*), 6) AS json_valid_rate,
  round(count_if(relevance_match) / count(*), 6) AS relevance_agreement,
  round(count_if(reason_complete) / count(*), 6) AS reason_completeness,
  round(count_if(reason_complete AND coalesce(gq = gold_query_topic, false)) / count(*), 6) AS query_topic_accuracy,
  round(count_if(reason_complete AND coalesce(gd = gold_document_topic, false)) / count(*), 6) AS document_topic_accuracy
  FROM strict""")


@register("s2_rates", _s2_sql(True))
def s2_rates(spark, sf_dir):
    """The five stage-2 rates over all samples."""
    g = gold(spark, sf_dir)
    return ev.s2_rates(g, derive_answers(g, silent=True))


@register("summary_similarity")
def summary_similarity(spark, sf_dir):
    """Mean Ratcliff-Obershelp ratio over complete answers, distinct pairs of summaries scored once (no SQL oracle)."""
    g = gold(spark, sf_dir)
    return ev.mean_summary_similarity(g, derive_answers(g, silent=True))


# ---- retrieval (H26, H27, C5-C7, E4, F1, F3, D9, D10) --------------------------------------


def retrieval_sets(spark, sf_dir):
    """Queries = every vector whose id is divisible by QUERY_MODULUS; index = all the others."""
    emb = read_embeddings(spark, sf_dir)
    is_query = F.col("doc_id") % S.QUERY_MODULUS == 0
    return emb, emb.where(is_query).withColumnRenamed("doc_id", "query_id"), emb.where(~is_query)


def hits(spark, sf_dir):
    emb, q, index = retrieval_sets(spark, sf_dir)
    return rt.knn_topk(index, q, k=S.TOP_K), emb, q, index


@register("normalize", S.with_ctes([("unit", S.UNIT)], """SELECT doc_id, dim, round(nrm, 6) AS norm,
  array_to_string(list_transform(u, lambda x: CAST(round(x * 1000000) AS BIGINT)), ',') AS unit FROM unit"""))
def normalize(spark, sf_dir):
    """L2-normalised vectors (as fixed-point text) and their original norms."""
    e = read_embeddings(spark, sf_dir)
    return e.select("doc_id", F.size("embedding").cast("long").alias("dim"), F.round(norm(F.col("embedding")), 6).alias("norm"),
                    fixed_point(l2_normalize(F.col("embedding"))).alias("unit"))


@register("knn_topk", S.with_ctes(S.retrieval_ctes(), "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM hits"))
def knn_topk(spark, sf_dir):
    """Exact top-5 by cosine for each query over the whole index."""
    h, _, _, _ = hits(spark, sf_dir)
    return h.withColumn("score", F.round("score", 6))


@register("knn_all", S.with_ctes([("unit", S.UNIT)], f"""SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT q.doc_id AS query_id, i.doc_id, round(list_inner_product(q.u, i.u), 9) AS score FROM unit q JOIN unit i ON q.doc_id <> i.doc_id))
  WHERE rank <= {S.TOP_K}"""))
def knn_all(spark, sf_dir):
    """C6, E4, F1 for a query table as large as the index: every vector asks for its 5 nearest others, on a grid of blocks."""
    emb = read_embeddings(spark, sf_dir)
    h = grid_topk(emb, emb.withColumnRenamed("doc_id", "query_id"), k=S.TOP_K, digits=9, exclude_self=True)
    return h.withColumn("score", F.round("score", 6))


@register("knn_clustered", S.with_ctes(S.retrieval_ctes(), "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM hits"))
def knn_clustered(spark, sf_dir):
    """The same hits as ``knn_topk`` from a written index whose blocks are skipped by their bounds."""
    _, q, index = retrieval_sets(spark, sf_dir)
    path = _scratch(spark, "clustered")
    write_clustered_index(index, path)
    return clustered_topk(spark, path, q, k=S.TOP_K).withColumn("score", F.round("score", 6))


@register("precision_at_k", S.with_ctes(S.retrieval_ctes(), "SELECT * FROM pak"))
def precision_at_k(spark, sf_dir):
    """C5, C7, D9, J4 (label judge): P@5 per query."""
    h, emb, q, index = hits(spark, sf_dir)
    return rt.precision_at_k(rt.label_judge(h, q, index), k=S.TOP_K)


@register("mean_precision_at_k", S.with_ctes(S.retrieval_ctes(),
          "SELECT count(*) AS queries, round(avg(p_at_k), 6) AS mean_p_at_k FROM pak"))
def mean_precision_at_k(spark, sf_dir):
    """Mean P@5 over the queries."""
    h, emb, q, index = hits(spark, sf_dir)
    return rt.mean_precision_at_k(rt.precision_at_k(rt.label_judge(h, q, index), k=S.TOP_K))


@register("first_queries", S.with_ctes(S.samples_ctes(2), S.FIRST_QUERIES))
def first_queries(spark, sf_dir):
    """The first 10 distinct queries of the samples, in first-seen order."""
    return rt.first_queries(samples(spark, sf_dir), n=S.MAX_QUERIES)


@register("first_queries_strict", S.with_ctes(S.samples_ctes(2), S.FIRST_QUERIES))
def first_queries_strict(spark, sf_dir):
    """As ``first_queries``; an input without a separator would fail the job."""
    return rt.first_queries(samples(spark, sf_dir), n=S.MAX_QUERIES, strict=True)


@register("first_queries_stream", S.with_ctes(S.samples_ctes(2), S.FIRST_QUERIES))
def first_queries_stream(spark, sf_dir):
    """G1, F3, E5 on a stream: samples arrive as files, state holds the first sample of each query."""
    src, log = _scratch(spark, "samples-stream"), _scratch(spark, "query-log")
    samples(spark, sf_dir).select("sample_id", "input").write.mode("overwrite").json(src)
    DS.run_to_log(DS.first_seen(DS.read_sample_stream(spark, src)), log)
    return DS.ordered_queries(spark, log, S.MAX_QUERIES)


# ---- chat, tokens, masks, batches, loss (H6, H17-H25, E2, E3, D11, D13, D14) -------------


def chat(spark, sf_dir, version=2, variant="train_s1"):
    s = samples(spark, sf_dir, version).select("sample_id", "instruction", "input", "output")
    return with_answer_key(render_chat(s, variant))


def token_rows(spark, sf_dir, version=2, variant="train_s1", offsets=False):
    """Tokens + masks + both weightings per sample, and the keys and lengths of the samples (``sample_id, n_full``)."""
    c = chat(spark, sf_dir, version, variant).select(
        "sample_id", "prompt_text", "full_text", "relevant_idx", F.length("prompt_text").alias("prompt_chars"))
    # one pass over the rendered text both counts its pieces and keeps the first of each sample
    cut = cut_texts(c, carry=("relevant_idx", "prompt_chars"))
    vocab = build_vocab(cut)
    tok = tokenize(cut, vocab, offsets=offsets)
    # the pad/EOS id: one scalar looked up in the vocabulary
    eos = vocab.where(F.col("piece") == CHATML["eos"]).select("id").first()
    rows = B.with_masks(tok, S.N_KEEP).withColumn(
        "eos_id", F.lit(None if eos is None else int(eos["id"])).cast("int"))
    args = (F.col("input_ids"), F.col("n_prompt"), F.col("offsets") if offsets else None, F.col("relevant_idx"),
            F.col("prompt_chars"))
    if offsets:
        rows = (rows.withColumn("weights_reference", M.loss_weights(*args, anchor="reference"))
                    .withColumn("weights_answer", M.loss_weights(*args, anchor="answer")))
    return rows, cut.samples.select("sample_id", "n_full")


@register("chat_render", S.with_ctes(S.samples_ctes(2) + [("chat", S.chat_sql("train_s1"))], """SELECT sample_id,
  length(prompt_text) AS prompt_chars, length(full_text) AS full_chars, md5(prompt_text) AS prompt_md5,
  md5(full_text) AS full_md5, relevant_idx, starts_with(full_text, prompt_text) AS prefix_ok FROM chat"""))
def chat_render(spark, sf_dir):
    """Stage-1 training chat text per sample and the answer-key position."""
    c = chat(spark, sf_dir)
    return c.select("sample_id", F.length("prompt_text").cast("long").alias("prompt_chars"),
                    F.length("full_text").cast("long").alias("full_chars"), F.md5("prompt_text").alias("prompt_md5"),
                    F.md5("full_text").alias("full_md5"), F.col("relevant_idx").cast("long").alias("relevant_idx"),
                    "prefix_ok")


@register("vocab", S.with_ctes(S.token_ctes(2, "train_s1"), "SELECT piece, count, id FROM vocab"))
def vocab_q(spark, sf_dir):
    """Vocabulary of the built-in tokenizer over the whole rendered texts."""
    return build_vocab(chat(spark, sf_dir).select("full_text")).select("piece", "count", "id")


@register("tokens", S.with_ctes(S.token_ctes(2, "train_s1"), f"""SELECT sample_id, n_prompt, n_full,
  n_full_untruncated, {S.txt('input_ids')} AS input_ids, {S.txt('offsets')} AS offsets FROM masks"""))
def tokens_q(spark, sf_dir):
    """Token ids (truncated to 192), prompt length, offsets per sample."""
    rows, _ = token_rows(spark, sf_dir, offsets=True)
    return rows.select("sample_id", F.col("n_prompt").cast("long").alias("n_prompt"),
                       F.col("n_full").cast("long").alias("n_full"),
                       F.col("n_full_untruncated").cast("long").alias("n_full_untruncated"),
                       M.ints_as_text(F.col("input_ids")).alias("input_ids"), M.ints_as_text(F.col("offsets")).alias("offsets"))


@register("label_masks", S.with_ctes(S.token_ctes(2, "train_s1"), f"""SELECT sample_id,
  {S.txt('labels_s1')} AS labels_s1, {S.txt('labels_s2')} AS labels_s2, {S.txt('labels_answer')} AS labels_answer
  FROM masks"""))
def label_masks(spark, sf_dir):
    """Stage-1, stage-2 and answer-only label masks."""
    rows, _ = token_rows(spark, sf_dir)
    return rows.select("sample_id", M.ints_as_text(F.col("labels_s1")).alias("labels_s1"),
                       M.ints_as_text(F.col("labels_s2")).alias("labels_s2"),
                       M.ints_as_text(F.col("labels_answer")).alias("labels_answer"))


@register("label_masks_s2", S.with_ctes(S.token_ctes(2, "train_s2"), f"""SELECT sample_id, n_prompt, n_full, n_full_untruncated,
  {S.txt('labels_s2')} AS labels_s2 FROM masks"""))
def label_masks_s2(spark, sf_dir):
    """H20, H21 on the stage-2 training prompt: prompt length, truncation and stage-2 labels."""
    rows, _ = token_rows(spark, sf_dir, 2, "train_s2")
    return rows.select("sample_id", *[F.col(c).cast("long").alias(c) for c in ("n_prompt", "n_full", "n_full_untruncated")],
                       M.ints_as_text(F.col("labels_s2")).alias("labels_s2"))


@register("loss_weights", S.with_ctes(S.token_ctes(1, "train_v1"), f"""SELECT sample_id,
  {S.txt('weights_reference')} AS weights_reference, {S.txt('weights_answer')} AS weights_answer FROM masks"""))
def loss_weights_q(spark, sf_dir):
    """v1 token weights with both anchors ('reference' reproduces the original offsets)."""
    rows, _ = token_rows(spark, sf_dir, 1, "train_v1", offsets=True)
    return rows.select("sample_id", M.doubles_as_text(F.col("weights_reference")).alias("weights_reference"),
                       M.doubles_as_text(F.col("weights_answer")).alias("weights_answer"))


@register("padded_batches", S.with_ctes(S.token_ctes(2, "train_s1") + [("batched", S.BATCHED)], f"""SELECT sample_id,
  batch_id, max_len,
  {S.txt("list_concat(input_ids, list_transform(range(max_len - n_full), lambda z: eos_id))")} AS input_ids,
  {S.txt("list_concat(list_transform(range(n_full), lambda z: 1), list_transform(range(max_len - n_full), lambda z: 0))")} AS attention_mask,
  {S.txt("list_concat(labels_s1, list_transform(range(max_len - n_full), lambda z: -100))")} AS labels
  FROM batched CROSS JOIN eos"""))
def padded_batches_q(spark, sf_dir):
    """Batches of 4 consecutive samples padded to the batch maximum."""
    rows, keys = token_rows(spark, sf_dir)
    b = B.padded_batches(rows.select("sample_id", "input_ids", "labels_s1", "eos_id"), S.BATCH, labels="labels_s1",
                         keys=keys, lengths="n_full")
    return b.select("sample_id", "batch_id", F.col("max_len").cast("long").alias("max_len"),
                    M.ints_as_text(F.col("input_ids")).alias("input_ids"),
                    M.ints_as_text(F.col("attention_mask")).alias("attention_mask"), M.ints_as_text(F.col("labels")).alias("labels"))


@register("masked_out_report", S.with_ctes(S.token_ctes(2, "train_s1"), f"""SELECT count(*) AS samples,
  CAST(count_if(n_full_untruncated > {MAX_TOKENS}) AS BIGINT) AS truncated, CAST(count_if(n_prompt >= {MAX_TOKENS}) AS BIGINT) AS prompt_fills_window,
  CAST(count_if(list_bool_and(list_transform(labels_s1, lambda x: x = -100)) OR len(labels_s1) = 0) AS BIGINT) AS no_target_s1,
  CAST(count_if(list_bool_and(list_transform(labels_s2, lambda x: x = -100)) OR len(labels_s2) = 0) AS BIGINT) AS no_target_s2,
  sum(len(list_filter(labels_s1, lambda x: x <> -100)))::BIGINT AS target_tokens_s1,
  sum(len(list_filter(labels_s2, lambda x: x <> -100)))::BIGINT AS target_tokens_s2 FROM masks"""))
def masked_out_report_q(spark, sf_dir):
    """Samples with no target token after truncation, truncated samples, target counts."""
    rows, _ = token_rows(spark, sf_dir)
    return B.masked_out_report(rows, MAX_TOKENS)


def _length_measures() -> dict:
    target = lambda c: F.size(F.filter(c, lambda x: x != M.IGNORE))
    return {"target_tokens_s1": target("labels_s1"), "target_tokens_s2": target("labels_s2"), "text_tokens": F.col("n_full_untruncated")}


@register("length_quantiles", S.with_ctes(S.token_ctes(2, "train_s1"), """SELECT measure, samples, quantile, true AS within FROM
  (SELECT unnest(['target_tokens_s1', 'target_tokens_s2', 'text_tokens']) AS measure),
  (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS quantile), (SELECT count(*) AS samples FROM masks)"""))
def length_quantiles(spark, sf_dir):
    """p50, p95 and p99 of target and text tokens from mergeable sketches, held against the exact counts of all lengths: the
    rank of each is within 1 %."""
    rows, _ = token_rows(spark, sf_dir)
    held = materialize(rows.select(*[c.alias(m) for m, c in _length_measures().items()]))
    measures = {m: F.col(m) for m in held.columns}
    found = materialize(quantiles(length_sketches(held, measures)))
    return rank_errors(held, measures, found).select("measure", F.col("n").alias("samples"), "quantile", (F.col("rank_error") <= RANK_ERROR).alias("within"))


BUCKET_EDGES = list(range(16, MAX_TOKENS, 16))


@register("bucketed_batches", S.with_ctes(S.token_ctes(2, "train_s1") + [
    ("bucketed", f"""SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY sample_id) - 1 AS place FROM (
      SELECT *, len(list_filter({BUCKET_EDGES}, lambda e: e < n_full))::INTEGER AS bucket FROM masks)"""),
    ("starts", f"""SELECT bucket, coalesce(sum(ceil(n / {S.BATCH})) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT bucket, count(*) AS n FROM bucketed GROUP BY bucket)"""),
    ("dealt", f"""SELECT b.*, (before + place // {S.BATCH})::BIGINT AS batch_id, max(n_full) OVER (PARTITION BY b.bucket, place // {S.BATCH}) AS max_len
      FROM bucketed b JOIN starts USING (bucket)""")], f"""SELECT sample_id, bucket, batch_id, max_len,
  {S.txt("list_concat(input_ids, list_transform(range(max_len - n_full), lambda z: eos_id))")} AS input_ids,
  {S.txt("list_concat(list_transform(range(n_full), lambda z: 1), list_transform(range(max_len - n_full), lambda z: 0))")} AS attention_mask,
  {S.txt("list_concat(labels_s1, list_transform(range(max_len - n_full), lambda z: -100))")} AS labels
  FROM dealt CROSS JOIN eos"""))
def bucketed_batches_q(spark, sf_dir):
    """E2, D13, H24 with length buckets: batches of 4 samples of one bucket of 16 tokens' width."""
    rows, _ = token_rows(spark, sf_dir)
    b = B.bucketed_batches(rows.select("sample_id", "input_ids", "labels_s1", "eos_id"), BUCKET_EDGES, S.BATCH)
    return b.select("sample_id", "bucket", "batch_id", F.col("max_len").cast("long").alias("max_len"), M.ints_as_text(F.col("input_ids")).alias("input_ids"),
                    M.ints_as_text(F.col("attention_mask")).alias("attention_mask"), M.ints_as_text(F.col("labels")).alias("labels"))


@register("padding_report", S.with_ctes(S.token_ctes(2, "train_s1"), """SELECT layout, count(*) AS rows, sum(n_full)::BIGINT AS tokens, true AS improved
  FROM masks, (SELECT unnest(['in order', 'bucketed']) AS layout) GROUP BY layout"""))
def padding_report(spark, sf_dir):
    """Rows and tokens of batches in sample order and of batches in length buckets whose edges come from the length sketch;
    ``improved``: the bucketed share of padding is not above that of the order."""
    rows, _ = token_rows(spark, sf_dir)
    held = materialize(rows.select("sample_id", "input_ids", "labels_s1", "eos_id"))
    edges = bucket_edges(length_sketches(held, {"tokens": F.size("input_ids")}), "tokens", 16)
    plain = B.padding_share(B.padded_batches(held, S.BATCH)).withColumn("layout", F.lit("in order"))
    dealt = B.padding_share(B.bucketed_batches(held, edges, S.BATCH)).withColumn("layout", F.lit("bucketed"))
    both = materialize(plain.unionByName(dealt))
    least = both.where("layout = 'bucketed'").first().padding_share
    return both.select("layout", "rows", "tokens", (F.col("padding_share") >= F.lit(least)).alias("improved"))


@register("weighted_loss", S.with_ctes(S.token_ctes(1, "train_v1") + [("batched", S.BATCHED), ("rl", S.ROW_LOSS)],
          """SELECT batch_id, round(sum(den), 6) AS weight_sum, round(sum(num) / (sum(den) + 1e-8), 6) AS loss
  FROM rl GROUP BY batch_id"""))
def weighted_loss_q(spark, sf_dir):
    """v1 weighted loss per batch of 4 over a hash-derived token loss."""
    rows, keys = token_rows(spark, sf_dir, 1, "train_v1", offsets=True)
    b = B.padded_batches(rows.select("sample_id", "input_ids", "labels_answer", "weights_reference", "eos_id"),
                         S.BATCH, labels="labels_answer", weights="weights_reference", keys=keys, lengths="n_full")

    def nll(i):
        return (hash_u32(S.SEED, F.col("sample_id"), i, "nll") % 10000) / 1000.0

    out = _weighted_loss(b, nll)
    return out.select("batch_id", F.round("weight_sum", 6).alias("weight_sum"), F.round("loss", 6).alias("loss"))


# ---- sinks and round trips, splits, counts (A3-A9, C8, D12) ------------------------------


def _scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local path on a cluster)."""
    return _os.path.join(checkpoint_dir(spark).rstrip("/"), f"relq-{name}-{_uuid.uuid4().hex[:12]}")


@register("jsonl_lines", S.with_ctes(S.samples_ctes(2), f"SELECT sample_id, {S.jsonl_line()} AS line FROM samples"))
def jsonl_lines(spark, sf_dir):
    """A5, H5: the JSONL line of every sample, byte for byte as Python writes it."""
    s = samples(spark, sf_dir)
    return s.select("sample_id", JL.sample_json().alias("line"))


@register("jsonl_roundtrip", S.with_ctes(S.samples_ctes(2), """SELECT (row_number() OVER (ORDER BY sample_id) - 1)::BIGINT AS line,
  md5(instruction) AS instruction_md5, md5(input) AS input_md5, md5(output) AS output_md5 FROM samples"""))
def jsonl_roundtrip(spark, sf_dir):
    """Write the samples as JSONL in sample order, read them back with line numbers."""
    path = _scratch(spark, "samples-jsonl")
    JL.write_samples(samples(spark, sf_dir), path)
    back = JL.read_samples(spark, path)
    return back.select("line", F.md5("instruction").alias("instruction_md5"), F.md5("input").alias("input_md5"),
                       F.md5("output").alias("output_md5"))


@register("eval_head", S.with_ctes(S.samples_ctes(2), f"""SELECT line, md5(output) AS output_md5 FROM (
  SELECT (row_number() OVER (ORDER BY sample_id) - 1)::BIGINT AS line, output FROM samples) WHERE line < 100"""))
def eval_head(spark, sf_dir):
    """The evaluator's first 100 lines of the JSONL file (the limit counts lines read)."""
    path = _scratch(spark, "eval-jsonl")
    JL.write_samples(samples(spark, sf_dir), path)
    return JL.read_samples(spark, path, limit=100).select("line", F.md5("output").alias("output_md5"))


@register("eval_head_exact", S.with_ctes(S.samples_ctes(2), """SELECT line, md5(output) AS output_md5 FROM (
  SELECT (row_number() OVER (ORDER BY sample_id) - 1)::BIGINT AS line, output FROM samples) WHERE line < 100"""))
def eval_head_exact(spark, sf_dir):
    """the first 100 samples as ``select(range(100))`` takes them: fewer would fail the job."""
    path = _scratch(spark, "eval-jsonl")
    JL.write_samples(samples(spark, sf_dir), path)
    return head_rows(JL.read_samples(spark, path), "line", 100, require_full=True).select("line", F.md5("output").alias("output_md5"))


@register("index_roundtrip", S.with_ctes([("unit", S.UNIT)], """SELECT doc_id, label, dim,
  array_to_string(list_transform(u, lambda x: CAST(round(x * 1000) AS BIGINT)), ',') AS unit FROM unit"""))
def index_roundtrip(spark, sf_dir):
    """Persist the normalised index as parquet and read it back (vectors at 1e-3 precision)."""
    path = _scratch(spark, "index")
    write_index(read_embeddings(spark, sf_dir), path)
    idx = read_index(spark, path)
    return idx.select("doc_id", "label", F.size("embedding").cast("long").alias("dim"),
                      fixed_point(F.transform("embedding", lambda x: x.cast("double")), 1e3).alias("unit"))


_SLICES = {"train": (0, 50), "index": (0, 60), "eval": (50, 100)}  # per cent of the corpus, by position
_PAIRS = [("train", "eval"), ("train", "index"), ("index", "eval")]


def _leak_sql() -> str:
    tag = ", ".join(f"pos >= n * {a} // 100 AND pos < n * {b} // 100 AS in_{k}" for k, (a, b) in _SLICES.items())
    pairs = " UNION ALL ".join(f"""SELECT '{a}' AS left_slice, '{b}' AS right_slice, CAST(count_if(in_{a}) AS BIGINT) AS left_docs, CAST(count_if(in_{b}) AS BIGINT) AS right_docs,
  CAST(count_if(in_{b} AND doc_id IN (SELECT doc_id FROM t WHERE in_{a})) AS BIGINT) AS id_overlap,
  CAST(count_if(in_{b} AND sha256(text) IN (SELECT sha256(text) FROM t WHERE in_{a})) AS BIGINT) AS text_overlap FROM t""" for a, b in _PAIRS)
    return S.with_ctes([("corpus", S.CORPUS), ("positions", S.POSITIONS), ("t", f"SELECT *, {tag} FROM positions")], pairs)


@register("split_leakage", _leak_sql())
def split_leakage(spark, sf_dir):
    """The documents of the train, index and eval slices that another slice has too, by id and by text digest.

    One grouping over (kind of key, key): counts by slice are summed in every task, so a text that a third of all
    documents share is one row a task."""
    corpus = read_corpus(spark, sf_dir)
    # number the cheap key column and join, so each text is hashed once (not again for range sampling)
    keyed = materialize(number_by_key(corpus.select("doc_id", F.sha2("text", 256).alias("h")), corpus.select("doc_id"), "doc_id"))
    n = keyed.count()
    inside = {k: (F.col("pos") >= n * a // 100) & (F.col("pos") < n * b // 100) for k, (a, b) in _SLICES.items()}
    keys = F.array(F.struct(F.lit("id").alias("kind"), F.col("doc_id").cast("string").alias("key")), F.struct(F.lit("text").alias("kind"), F.col("h").alias("key")))
    rows = keyed.select(*[c.alias(k) for k, c in inside.items()], F.inline(keys))
    met = rows.groupBy("kind", "key").agg(*[F.count_if(k).alias(k) for k in _SLICES])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = [total(F.when(F.col("kind") == "id", F.col(k))).alias(f"n_{k}") for k in _SLICES]
    sums += [total(F.when((F.col("kind") == kind) & (F.col(a) > 0), F.col(b))).alias(f"{kind}_{a}_{b}") for a, b in _PAIRS for kind in ("id", "text")]
    pairs = F.array(*[F.struct(F.lit(a).alias("left_slice"), F.lit(b).alias("right_slice"), F.col(f"n_{a}").alias("left_docs"), F.col(f"n_{b}").alias("right_docs"),
                               F.col(f"id_{a}_{b}").alias("id_overlap"), F.col(f"text_{a}_{b}").alias("text_overlap")) for a, b in _PAIRS])
    return met.agg(*sums).select(F.inline(pairs))


@register("counts", S.with_ctes(S.samples_ctes(2) + [("q", f"""SELECT {S.py_strip("replace(substr(input, 1, strpos(input, chr(10) || 'Document:') - 1), 'Query:', '')")} AS query
  FROM samples WHERE strpos(input, chr(10) || 'Document:') > 0""")], """SELECT (SELECT count(*) FROM corpus) AS documents,
  (SELECT count(*) FROM samples) AS samples, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(DISTINCT query) FROM q) AS queries"""))
def counts(spark, sf_dir):
    """Documents, samples, index vectors and distinct text queries (a long-form union, one aggregation, no join)."""
    corpus, emb = read_corpus(spark, sf_dir), read_embeddings(spark, sf_dir)
    one = F.lit(1).cast("long")
    asked = samples(spark, sf_dir).groupBy(extract_query(F.col("input")).alias("query")).agg(F.count(F.lit(1)).alias("n"))
    u = (corpus.select(F.lit("documents").alias("m"), one.alias("n")).unionByName(emb.select(F.lit("vectors").alias("m"), one.alias("n")))
         .unionByName(asked.select(F.lit("samples").alias("m"), "n")).unionByName(asked.where("query is not null").select(F.lit("queries").alias("m"), one.alias("n"))))
    n = lambda m: F.coalesce(F.sum(F.when(F.col("m") == m, F.col("n"))), F.lit(0)).cast("long").alias(m)
    return u.agg(*[n(m) for m in ("documents", "samples", "vectors", "queries")])


_S1_COLS = {"total": 0, "correct": 0, "failed": 0, "accuracy": 4}
_S2_COLS = {"samples": 0, "json_valid_rate": 3, "relevance_agreement": 3, "reason_completeness": 3,
            "query_topic_accuracy": 3, "document_topic_accuracy": 3}
_PK_COLS = {"queries": 0, "mean_p_at_k": 3}


def _long_sql(source: str, cte: str, cols: dict) -> str:
    return " UNION ALL ".join(
        f"SELECT '{source}' AS source, '{m}' AS metric, round({m}::DOUBLE, 6) AS value, printf('%.{d}f', {m}::DOUBLE) AS text FROM {cte}"
        for m, d in cols.items())


_REPORT_SQL = S.with_ctes(
    S.eval_ctes() + [("flags", S.LENIENT), ("gold_flags", S.GOLD_FLAGS), ("strict", S.STRICT)] + S.retrieval_ctes() + [
        ("s1", "SELECT count(*) AS total, CAST(count_if(pred = gold) AS BIGINT) AS correct, "
         "CAST(count_if(pred IS NULL) AS BIGINT) AS failed, round(count_if(pred = gold) / greatest(count(*), 1), 6) AS accuracy FROM "
         "(SELECT g.sample_id, g.gold, f.flag AS pred FROM gold_flags g LEFT JOIN flags f USING (sample_id))"),
        ("s2", """SELECT count(*) AS samples, round(count_if(json_valid) / count(*), 6) AS json_valid_rate,
  round(count_if(relevance_match) / count(*), 6) AS relevance_agreement,
  round(count_if(reason_complete) / count(*), 6) AS reason_completeness,
  round(count_if(reason_complete AND coalesce(gq = gold_query_topic, false)) / count(*), 6) AS query_topic_accuracy,
  round(count_if(reason_complete AND coalesce(gd = gold_document_topic, false)) / count(*), 6) AS document_topic_accuracy
  FROM strict"""),
        ("pk", "SELECT count(*) AS queries, round(avg(p_at_k), 6) AS mean_p_at_k FROM pak")],
    " UNION ALL ".join([_long_sql("stage1", "s1", _S1_COLS), _long_sql("stage2", "s2", _S2_COLS),
                        _long_sql("retrieval", "pk", _PK_COLS),
                        "SELECT 'retrieval', 'p_at_k of query ' || query_id, round(p_at_k::DOUBLE, 6), printf('%.2f', p_at_k::DOUBLE) FROM pak"]))


@register("metric_report", _REPORT_SQL)
def metric_report(spark, sf_dir):
    """Every evaluator's metrics in long form with its printed precision."""
    s1 = s1_accuracy(spark, sf_dir)
    s2 = s2_rates(spark, sf_dir)
    per_query = materialize(precision_at_k(spark, sf_dir))  # read for the rows and for their mean
    pk = rt.mean_precision_at_k(per_query)
    each = per_query.select(F.lit("retrieval").alias("source"), F.concat(F.lit("p_at_k of query "), F.col("query_id").cast("string")).alias("metric"),
                            F.round(F.col("p_at_k").cast("double"), 6).alias("value"), F.format_string("%.2f", F.col("p_at_k").cast("double")).alias("text"))
    return (to_long(s1, _S1_COLS, "stage1").unionByName(to_long(s2, _S2_COLS, "stage2"))
            .unionByName(to_long(pk, _PK_COLS, "retrieval")).unionByName(each))


# ---- text retrieval end to end (J3, F3, F1, C5, D9, D10) ------------------------------------


def rag_hits(spark, sf_dir):
    """(hits, queries, corpus): the first 10 distinct sample queries, encoded like the documents (hashed word
    counts), and their top 5 over every document.  The queries are written once."""
    fq = rt.first_queries(samples(spark, sf_dir), n=S.MAX_QUERIES, carry=("query_label",))
    queries = materialize(fq.select(F.col("query_rank").alias("query_id"), "query", F.col("query_label").alias("label")))
    corpus = read_corpus(spark, sf_dir)
    index = embed_counts(corpus, "doc_id", "text")
    return rt.knn_topk(index, embed_counts(queries, "query_id", "query"), k=S.TOP_K, digits=9), queries, corpus


@register("rag_precision_at_k", S.with_ctes(S.rag_ctes(), f"""SELECT query_id, query,
  round(count_if(label = query_label) / {float(S.TOP_K)}, 6) AS p_at_k FROM hit_rows GROUP BY query_id, query"""))
def rag_precision_at_k(spark, sf_dir):
    """The retrieval evaluation over texts, judged by label (query label = the label of the
    sample where the query was first seen)."""
    h, queries, corpus = rag_hits(spark, sf_dir)
    per_q = rt.precision_at_k(rt.label_judge(h, queries, corpus), k=S.TOP_K)
    return per_q.join(queries.select("query_id", "query"), "query_id").select("query_id", "query", "p_at_k")


@register("rag_prompts", S.with_ctes(S.rag_ctes(), f"""SELECT query_id, rank, doc_id,
  md5({S.prompt_sql(PROMPT_VARIANTS['rag'][0], "'Query: ' || query || chr(10) || 'Document: ' || text")}) AS prompt_md5 FROM hit_rows"""))
def rag_prompts(spark, sf_dir):
    """The judge's prompt of every hit, with the document's text fetched for the hits only."""
    h, queries, corpus = rag_hits(spark, sf_dir)
    return rt.rag_prompts(h, queries, corpus).select("query_id", "rank", "doc_id", F.md5("prompt").alias("prompt_md5"))


def hit_answers(hits: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Stand-in for the judge's generated answers: one of seven shapes per hit, or none."""
    labelled = rt.label_judge(hits, queries, corpus)
    shape = hash_u32(S.SEED, F.concat_ws("|", "query_id", "doc_id"), "hit") % S.HIT_SHAPES
    texts = [F.when(F.col("relevant"), '{"relevant": true}').otherwise('{"relevant": false}'), F.lit('{"relevant": "no"}'),
             F.lit('{"relevant": 0}'), F.lit("relevant: true"), F.lit("[true]"), F.lit('{"relevant": true, "reason": {}}')]
    return (labelled.withColumn("_shape", shape.cast("int")).where("_shape > 0")
            .select("query_id", "doc_id", F.element_at(F.array(*texts), F.col("_shape")).alias("answer")))


@register("rag_judged_precision", S.with_ctes(S.rag_ctes() + [("hit_judged", S.HIT_JUDGED)], f"""SELECT query_id,
  round(count_if(relevant) / {float(S.TOP_K)}, 6) AS p_at_k FROM hit_judged GROUP BY query_id"""))
def rag_judged_precision(spark, sf_dir):
    """P@5 judged from an answer per hit (missing and unreadable answers are not relevant)."""
    h, queries, corpus = rag_hits(spark, sf_dir)
    h = materialize(h)
    return rt.precision_at_k(rt.answer_judge(h, hit_answers(h, queries, corpus)), k=S.TOP_K)


# ---- the stage-1 evaluation on a stream -------------------------------------------------


@register("s1_accuracy_stream", _s1_sql("INNER", False))
def s1_accuracy_stream(spark, sf_dir):
    """Stage-1 accuracy of the answers that arrive, computed by a Structured Streaming job over JSONL files
    (a gold row without an answer is not counted yet; the batch form counts it as a failed parse)."""
    s = eval_samples(spark, sf_dir)
    ans_dir, out_dir = _scratch(spark, "answers-stream"), _scratch(spark, "s1-stream-out")
    derive_answers(gold_rows(s, on_mismatch="drop")).select("sample_id", "answer").write.mode("overwrite").json(ans_dir)
    stream = ST.read_answer_stream(spark, ans_dir)
    # the static side is written once: otherwise every micro-batch would regenerate it from the corpus
    ST.run_to_table(ST.s1_metrics(stream, materialize(gold_flag(s))), out_dir)
    return spark.read.parquet(out_dir)


@register("s1_accuracy_arrivals", _S1)
def s1_accuracy_arrivals(spark, sf_dir):
    """C4, D1, D2 with questions and answers on two streams: a sample that stays silent is a failed parse once the watermark has
    passed its time; every 13th answer arrives twice and one in 17 late."""
    s = eval_samples(spark, sf_dir)
    asked, came, out = (_scratch(spark, f"arrivals-{x}") for x in ("gold", "answers", "out"))
    start = 1_700_000_000  # a second a sample from here on
    gold_flag(s).withColumn("asked_at", F.timestamp_seconds(F.col("sample_id") + start)).write.mode("overwrite").json(asked)
    # answers of samples whose gold can't be split are none: a question without a reference text gets no answer
    a = derive_answers(gold_rows(s, on_mismatch="drop"), silent=True).select("sample_id", "answer")
    after = F.when(F.col("sample_id") % 17 == 0, 3000).otherwise(F.col("sample_id") % 60 + 1)
    a = a.withColumn("answered_at", F.timestamp_seconds(F.col("sample_id") + start + after))
    a = a.unionByName(a.where("sample_id % 13 = 0").withColumn("answered_at", F.col("answered_at") + F.expr("interval 2 seconds")))
    a.write.mode("overwrite").json(came)
    _heartbeat(spark, asked, came)
    AR.run_to_epochs(AR.scored_arrivals(AR.read_stream(spark, asked, AR.GOLD_SCHEMA), AR.read_stream(spark, came, AR.ANSWER_SCHEMA)), out)
    return AR.accuracy_of(spark, out)


def _heartbeat(spark, asked: str, came: str) -> None:
    """A last row far after all others in both streams: it moves the watermark past every open question."""
    end = spark.sql("SELECT timestamp'2200-01-01 00:00:00' AS t")
    end.select(F.lit(-1).alias("sample_id"), F.lit(True).alias("gold"), F.col("t").alias("asked_at")).write.mode("append").json(asked)
    end.select(F.lit(-2).alias("sample_id"), F.lit("").alias("answer"), F.col("t").alias("answered_at")).write.mode("append").json(came)


# ---- multi-turn chat over the conversations table (H6 per turn) --------------------------


_TURN_SEG = (f"{S.lit(CHATML['start'])} || role || chr(10) || CASE WHEN role = 'assistant' THEN text || "
             f"{S.lit(CHATML['eos'])} ELSE text END || {S.lit(CHATML['end'])} || chr(10)")


@register("conversation_turns", f"""SELECT conv_id, turn, role, md5(segment) AS segment_md5, seg_len,
  (sum(seg_len) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - seg_len)::BIGINT AS char_start,
  role = 'assistant' AS is_target
  FROM (SELECT conv_id, turn, role, {_TURN_SEG} AS segment, length({_TURN_SEG})::BIGINT AS seg_len FROM conversations)""")
def conversation_turns(spark, sf_dir):
    """H6 over conversations: each turn's chat segment, its character start and target flag
    (offsets by a skew-safe grouped prefix sum; the conversation is never one row)."""
    r = render_turns(read_table(spark, sf_dir, "conversations"), chunk=64)
    return r.select("conv_id", "turn", "role", F.md5("segment").alias("segment_md5"), "seg_len",
                    F.col("char_start").cast("long").alias("char_start"), "is_target")


# ---- evaluation prompts (H6 variants of section 2.11) ---------------------------------------


_EVAL_PROMPTS_SQL = S.with_ctes(S.samples_ctes(2) + [("gold", S.GOLD)], f"""SELECT sample_id,
  md5({S.prompt_sql(PROMPT_VARIANTS['eval_s1'][0], "instruction || chr(10) || input")}) AS eval_s1_md5,
  md5({S.prompt_sql(PROMPT_VARIANTS['eval_s2'][0], "instruction || chr(10) || chr(10) || 'Query: ' || query || chr(10) || 'Document: ' || document")}) AS eval_s2_md5,
  md5({S.prompt_sql(PROMPT_VARIANTS['rag'][0], "'Query: ' || query || chr(10) || 'Document: ' || document")}) AS rag_md5,
  md5({S.prompt_sql(PROMPT_VARIANTS['smoke'][0], S.lit(INSTRUCTIONS[1]) + " || chr(10) || 'Query: ' || query || chr(10) || 'Document: ' || document")}) AS smoke_md5
  FROM gold JOIN (SELECT sample_id, input FROM samples) USING (sample_id)""")


@register("eval_prompts", _EVAL_PROMPTS_SQL)
def eval_prompts(spark, sf_dir):
    """H6 (section 2.11): the generation prompts of the stage-1, stage-2, retrieval and smoke evaluators
    for every gold row (stage 1 takes the raw input; the others the stripped query and document;
    stage 2 puts two newlines after the instruction)."""
    g = gold(spark, sf_dir, keep=("input",))
    qd = dict(instruction=None, inp=None, query="query", document="document")
    # one projection, four prompt columns: no self-joins
    out = g.select("sample_id",
                   F.md5(prompt_column("eval_s1", instruction="instruction", inp="input")).alias("eval_s1_md5"),
                   F.md5(prompt_column("eval_s2", instruction="instruction", inp=None, query="query",
                                       document="document")).alias("eval_s2_md5"),
                   F.md5(prompt_column("rag", **qd)).alias("rag_md5"),
                   F.md5(prompt_column("smoke", **qd)).alias("smoke_md5"))
    return out


@register("s2_rates_stream", _s2_sql(False))
def s2_rates_stream(spark, sf_dir):
    """Stage-2 rates computed by a Structured Streaming job over the answers as JSONL files
    (every answer present, so it equals the batch result and shares its oracle)."""
    g = materialize(gold(spark, sf_dir))  # the static side, written once
    ans_dir, out_dir = _scratch(spark, "answers-stream2"), _scratch(spark, "s2-stream-out")
    derive_answers(g).select("sample_id", "answer").write.mode("overwrite").json(ans_dir)
    stream = ST.read_answer_stream(spark, ans_dir)
    ST.run_to_table(ST.s2_metrics(stream, g), out_dir)
    return spark.read.parquet(out_dir)


@register("conversation_masks", f"""SELECT conv_id, sum(kept)::BIGINT AS n_tokens,
  sum(CASE WHEN role = 'assistant' THEN kept ELSE 0 END)::BIGINT AS n_target, max(tok_end) > {MAX_TOKENS} AS truncated
  FROM (SELECT *, greatest(0, least(n_pieces, {MAX_TOKENS} - (tok_end - n_pieces))) AS kept FROM (
    SELECT *, sum(n_pieces) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tok_end
    FROM (SELECT conv_id, turn, role, len(regexp_extract_all({_TURN_SEG}, {S.lit(S.PIECE_RE)}))::BIGINT AS n_pieces
          FROM conversations)))
  GROUP BY conv_id""")
def conversation_masks_q(spark, sf_dir):
    """H18-H20 on conversations: tokens in the 192-token window and assistant target tokens per conversation."""
    return conversation_masks(read_table(spark, sf_dir, "conversations"), MAX_TOKENS, chunk=64)
