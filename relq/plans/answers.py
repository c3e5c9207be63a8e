"""Model answers derived from the gold rows (the stand-in for generated text).

No model runs here, so the answers table is derived in Spark from the gold
samples: each sample gets one of the answer shapes of ``ANSWER_CLASSES`` (the parsing
truth table of FIXTURES.md section 3 and answers that are well formed but wrong in one
field), chosen by ``md5(seed|sample_id|answer)`` modulo their number.  Every shape is
built from the sample's own gold values, so the work grows with the corpus.  Some
samples stay unanswered, and some gold lines are damaged, so that every rule of the
evaluators decides something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relq.functions.hashing import hash_u32
from relq.functions.jsonfmt import json_string
from relq.templates import DEFAULT_SEED

ANSWER_CLASSES = [
    "exact", "fenced", "prose prefix", "trailing text", "truncated", "flipped", "string flag", "number 1",
    "number 0", "null flag", "flag missing", "reason missing", "reason partial", "reason string", "reason null",
    "Python boolean", "upper case", "bare true", "array", "two objects", "empty", "single quotes",
    "wrong query topic", "wrong document topic", "short summary", "summary not a string", "null topic", "extra keys",
]
N_CLASSES = len(ANSWER_CLASSES)
SILENT_ONE_IN = 11  # samples without an answer
DAMAGE_ONE_IN = 23  # samples with an input that cannot be split; as many cut and as many with text behind the output


def answer_class(seed: int = DEFAULT_SEED) -> Column:
    return (hash_u32(seed, F.col("sample_id"), "answer") % N_CLASSES).cast("int")


def answer_text(cls: Column, g: Column) -> Column:
    """The answer of shape ``cls`` for gold flag ``g``; ``_reason`` and its parts hold the encoded gold reason."""
    gb = F.when(g, F.lit("true")).otherwise(F.lit("false"))
    nb = F.when(g, F.lit("false")).otherwise(F.lit("true"))
    py = F.when(g, F.lit("True")).otherwise(F.lit("False"))
    up = F.when(g, F.lit("TRUE")).otherwise(F.lit("FALSE"))
    reason = F.col("_reason")

    def obj(flag: Column) -> Column:
        return F.concat(F.lit('{"relevant": '), flag, F.lit(", "), reason, F.lit("}"))

    q, dt, sm = F.col("_q"), F.col("_d"), F.col("_s")

    def fields(query_topic: Column, document_topic: Column, summary: Column) -> Column:
        return F.concat(F.lit('{"relevant": '), gb, F.lit(', "reason": {"query_topic": '), query_topic, F.lit(', "document_topic": '),
                        document_topic, F.lit(', "summary": '), summary, F.lit("}}"))

    exact = obj(gb)
    shapes = [
        exact,
        F.concat(F.lit("```json\n"), exact, F.lit("\n```")),
        F.concat(F.lit("Answer: "), exact),
        F.concat(exact, F.lit(" done")),
        F.concat(F.lit('{"relevant": '), gb, F.lit(', "reason": {"query_to')),
        obj(nb),
        obj(F.lit('"false"')),
        obj(F.lit("1")),
        obj(F.lit("0")),
        obj(F.lit("null")),
        F.concat(F.lit("{"), reason, F.lit("}")),
        F.concat(F.lit('{"relevant": '), gb, F.lit("}")),
        F.concat(F.lit('{"relevant": '), gb, F.lit(', "reason": {"query_topic": '), q, F.lit("}}")),
        F.concat(F.lit('{"relevant": '), gb, F.lit(', "reason": "matches"}')),
        F.concat(F.lit('{"relevant": '), gb, F.lit(', "reason": null}')),
        obj(py),
        obj(up),
        gb,
        F.concat(F.lit('[{"relevant": '), gb, F.lit("}]")),
        F.concat(F.lit('{"relevant": '), gb, F.lit('}\n{"relevant": '), nb, F.lit("}")),
        F.lit(""),
        F.concat(F.lit("{'relevant': "), gb, F.lit("}")),
        fields(F.col("_qx"), dt, sm),
        fields(q, F.col("_dx"), sm),
        fields(q, dt, F.col("_half")),
        fields(q, dt, F.lit("7")),
        fields(F.lit("null"), dt, sm),
        fields(q, dt, F.concat(sm, F.lit(', "extra": [1, 2]'))),
    ]
    out = None
    for i, shape in enumerate(shapes):
        out = F.when(cls == i, shape) if out is None else out.when(cls == i, shape)
    return out


def damage(samples: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    """``samples`` with some inputs that cannot be split, some outputs cut short and some with text behind them."""
    kind = hash_u32(seed, F.col("sample_id"), "damage") % DAMAGE_ONE_IN
    return samples.withColumns({
        "input": F.when(kind == 0, F.replace("input", F.lit("\nDocument:"), F.lit(" Document "))).otherwise(F.col("input")),
        "output": F.when(kind == 1, F.substring("output", F.lit(1), F.length("output") - 5))
                   .when(kind == 2, F.concat("output", F.lit(" x"))).otherwise(F.col("output"))})


def derive_answers(gold: DataFrame, seed: int = DEFAULT_SEED, silent: bool = False) -> DataFrame:
    """``gold_rows`` -> ``(sample_id, answer_class, answer)``; with ``silent`` some samples have no row."""
    if silent:
        gold = gold.where(hash_u32(seed, F.col("sample_id"), "silent") % SILENT_ONE_IN != 0)
    qt, dt, sm = (F.col(f"gold_{c}") for c in ("query_topic", "document_topic", "summary"))
    # each string is encoded once, in a projection of its own
    staged = gold.select("sample_id", "relevant", answer_class(seed).alias("answer_class"),
                         json_string(qt).alias("_q"), json_string(F.concat(qt, F.lit(" x"))).alias("_qx"),
                         json_string(dt).alias("_d"), json_string(F.concat(dt, F.lit(" x"))).alias("_dx"), json_string(sm).alias("_s"),
                         json_string(F.substring(sm, F.lit(1), F.floor(F.length(sm) / 2).cast("int"))).alias("_half"))
    staged = staged.withColumn("_reason", F.concat(F.lit('"reason": {"query_topic": '), F.col("_q"), F.lit(', "document_topic": '), F.col("_d"),
                                                   F.lit(', "summary": '), F.col("_s"), F.lit("}")))
    return staged.select("sample_id", "answer_class", answer_text(F.col("answer_class"), F.col("relevant")).alias("answer"))
