"""Relevance samples from a labelled corpus.

One positive and ``num_negatives`` negatives per document, all in one narrow
pass: the negatives are drawn per row from the other labels (no join, no
shuffle), the rows are emitted by ``inline`` over a per-document array.  Every
draw is a hash of (seed, key, purpose), so the output does not depend on the
partitioning and is reproduced exactly when a task is retried.

``sample_id = doc_id * (1 + num_negatives) + slot``; slot 0 is the positive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relq.functions.hashing import hash_hex, pick, sample_without_replacement
from relq.functions.jsonfmt import json_bool, json_fixed, json_object
from relq.operators.positions import with_position
from relq.templates import (DEFAULT_SEED, INSTRUCTIONS, LABEL_TO_QUERIES, LABEL_TO_TOPIC, NEG_REASONS, NUM_LABELS,
                            POS_REASONS, SUMMARY_MATCH, SUMMARY_NO_MATCH, SUMMARY_PREFIX)

SAMPLE_COLUMNS = ["sample_id", "doc_id", "slot", "relevant", "label", "query_label", "instruction", "input", "output"]


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def topic_of(label: Column) -> Column:
    """Label -> topic, a folded literal lookup (no join)."""
    return F.element_at(_lit_array([LABEL_TO_TOPIC[i] for i in range(NUM_LABELS)]), label + 1)


def make_input(query: Column, document: Column) -> Column:
    """H3: ``Query: {q}\\nDocument: {d}``."""
    return F.concat(F.lit("Query: "), query, F.lit("\nDocument: "), document)


def make_output_v2(relevant: Column, query_topic: Column, document_topic: Column) -> Column:
    """H4: the structured answer as Python-spaced JSON."""
    summary = F.concat(F.lit(SUMMARY_PREFIX), document_topic,
                       F.when(relevant, F.lit(SUMMARY_MATCH)).otherwise(F.lit(SUMMARY_NO_MATCH)))
    topics = list(LABEL_TO_TOPIC.values())
    summaries = [SUMMARY_PREFIX + t + m for t in topics for m in (SUMMARY_MATCH, SUMMARY_NO_MATCH)]
    reason = json_object([("query_topic", json_fixed(query_topic, topics)),
                          ("document_topic", json_fixed(document_topic, topics)),
                          ("summary", json_fixed(summary, summaries))])
    return json_object([("relevant", json_bool(relevant)), ("reason", reason)])


def make_output_v1(relevant: Column, doc_label: Column, neg_label: Column) -> Column:
    """Positive reason keyed by the document label, negative reason by the negative label."""
    pos = F.element_at(_lit_array([POS_REASONS[i] for i in range(NUM_LABELS)]), doc_label + 1)
    neg = F.element_at(_lit_array([NEG_REASONS[i] for i in range(NUM_LABELS)]), neg_label + 1)
    return json_object([("relevant", json_bool(relevant)),
                        ("reason", json_fixed(F.when(relevant, pos).otherwise(neg),
                                              list(POS_REASONS.values()) + list(NEG_REASONS.values())))])


def make_samples(corpus: DataFrame, seed: int = DEFAULT_SEED, num_negatives: int = 1,
                 version: int = 2) -> DataFrame:
    """``(doc_id, text, label)`` -> one row per sample with SAMPLE_COLUMNS."""
    if not 0 <= num_negatives <= NUM_LABELS - 1:
        raise ValueError(f"num_negatives must be in 0..{NUM_LABELS - 1} (sampling without replacement)")
    label = F.col("label")
    # The other labels; H2: k of them without replacement
    others = F.filter(F.sequence(F.lit(0), F.lit(NUM_LABELS - 1)), lambda l: l != label)
    negs = sample_without_replacement(others, num_negatives, seed, F.col("doc_id"), "neg")
    # Positive first, then the negatives, as one array exploded in place
    entries = F.concat(
        F.array(F.struct(F.lit(0).alias("slot"), label.alias("query_label"), F.lit(True).alias("relevant"))),
        F.transform(negs, lambda l, i: F.struct((i + 1).alias("slot"), l.alias("query_label"),
                                                F.lit(False).alias("relevant"))),
    )
    rows = corpus.select("doc_id", "text", "label", F.inline(entries))
    sid = F.col("doc_id") * (1 + num_negatives) + F.col("slot")
    rows = rows.withColumn("sample_id", sid.cast("long"))
    # Label -> one of its query templates, H1 picks
    qarr = F.array(*[_lit_array(LABEL_TO_QUERIES[i]) for i in range(NUM_LABELS)])
    qidx = pick(seed, F.col("sample_id"), "query", len(LABEL_TO_QUERIES[0])) + 1
    query = F.element_at(F.element_at(qarr, F.col("query_label") + 1), qidx.cast("int"))
    instruction = F.element_at(_lit_array(INSTRUCTIONS),
                               (pick(seed, F.col("sample_id"), "instruction", len(INSTRUCTIONS)) + 1).cast("int"))
    if version == 2:
        output = make_output_v2(F.col("relevant"), topic_of(F.col("query_label")), topic_of(label))
    elif version == 1:
        output = make_output_v1(F.col("relevant"), label, F.col("query_label"))
    else:
        raise ValueError("version must be 1 or 2")
    return rows.select(
        "sample_id", "doc_id", "slot", "relevant", "label", "query_label",
        instruction.alias("instruction"), make_input(query, F.col("text")).alias("input"), output.alias("output"),
    )


def shuffle_order(samples: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    """a reproducible full shuffle, as a position column ``shuffle_pos``.

    The order is ``(md5(seed|sample_id|shuffle), sample_id)``; numbering is the
    distributed E1 numbering, so no single task sees the whole table.
    """
    keyed = samples.select("sample_id", hash_hex(seed, F.col("sample_id"), "shuffle").alias("_h"))
    return with_position(keyed, ["_h", "sample_id"], name="shuffle_pos").drop("_h")
