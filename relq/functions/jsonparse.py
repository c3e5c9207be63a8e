"""Model-answer parsing: three policies on purpose distinct.

* lenient  (stage-1 evaluator): strip, drop a ```json fence, parse the text
  between the first ``{`` and the last ``}``, take the Python truthiness of
  ``relevant``; if that is no JSON, a regex fallback; else null.
* strict   (stage-2 evaluator): the whole text must be one JSON value;
  agreement is Python ``==`` against the gold boolean (``1 == True``).
* judge    (retrieval evaluator): strict parse, truthiness, any failure is false.

Strict validity: Spark's JSON parsers accept trailing text after a value, so
the text is wrapped as ``[text,"md5(text)"]`` and is valid only when that parses
to exactly two elements whose second is the digest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relq.functions.text import brace_slice, py_strip, regex_flag, strip_fence

_NUMERIC = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE")
REASON_KEYS = ("query_topic", "document_topic", "summary")


def wrap_parse(t: Column) -> Column:
    """Variant ``[value, digest]`` for text that is exactly one JSON value, else null."""
    digest = F.md5(t)
    w = F.try_parse_json(F.concat(F.lit("["), t, F.lit(',"'), digest, F.lit('"]')))
    ok = (F.size(F.try_variant_get(w, "$", "array<variant>")) == 2) & (F.try_variant_get(w, "$[1]", "string") == digest)
    return F.when(ok, w)


def is_valid(w: Column) -> Column:
    return w.isNotNull()


def vtype(v: Column) -> Column:
    """Type name of a variant ('BOOLEAN', 'STRING', 'BIGINT', 'DECIMAL(p,s)', 'OBJECT<..>', 'VOID', ...)."""
    return F.schema_of_variant(v)


def field(w: Column, path: str) -> Column:
    """Sub-variant at ``path`` of the wrapped value (``$`` = the answer); null when absent."""
    return F.try_variant_get(w, "$[0]" + path[1:], "variant")


def is_object(v: Column) -> Column:
    return F.coalesce(vtype(v).startswith("OBJECT"), F.lit(False))


def _is_number(ty: Column) -> Column:
    return ty.isin(*_NUMERIC) | ty.startswith("DECIMAL")


def truthy(v: Column) -> Column:
    """Python ``bool(value)`` of a JSON value; a missing value (SQL null) is ``None`` -> false."""
    ty = vtype(v)
    return (
        F.when(v.isNull() | (ty == "VOID"), F.lit(False))
        .when(ty == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(ty == "STRING", F.length(F.try_variant_get(v, "$", "string")) > 0)
        .when(ty.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
        .when(ty.startswith("OBJECT"), F.size(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))) > 0)
        .when(_is_number(ty), F.try_variant_get(v, "$", "double") != 0)
        .otherwise(F.lit(False))
    )


def equals_bool(v: Column, gold: Column) -> Column:
    """Python ``value == gold`` for a boolean gold: booleans compare, numbers compare to 1/0."""
    ty = vtype(v)
    num = F.when(gold, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.coalesce(
        F.when(ty == "BOOLEAN", F.try_variant_get(v, "$", "boolean") == gold)
        .when(_is_number(ty), F.try_variant_get(v, "$", "double") == num)
        .otherwise(F.lit(False)),
        F.lit(False),
    )


def string_value(v: Column) -> Column:
    """The value when it is a JSON string, else null."""
    return F.when(vtype(v) == "STRING", F.try_variant_get(v, "$", "string"))


def has_keys(v: Column, keys=REASON_KEYS) -> Column:
    """All keys present in an object (a key whose value is null is present); false for non-objects."""
    names = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    cond = is_object(v)
    for k in keys:
        cond = cond & F.coalesce(F.array_contains(names, k), F.lit(False))
    return cond


# ---- the three policies: each step is its own projection over named columns ---------------
# Nesting the helpers above repeats subtrees (a parsed value is tested, typed and read);
# staging keeps the plan small and lets each intermediate be computed once.

def _stage(df, steps, drop):
    for name, expr in steps:
        df = df.withColumn(name, expr)
    return df.drop(*drop)


def with_lenient_flag(df, answer: str = "answer", out: str = "flag"):
    """Stage-1 flag (H9-H12) as a new column."""
    a = F.col("_l_a")
    b = F.col("_l_b")
    c = F.col("_l_c")
    w = F.col("_l_w")
    steps = [
        ("_l_a", py_strip(F.col(answer))),
        ("_l_b", F.when(a.startswith("```json"), F.substring(a, F.lit(8), F.length(a))).otherwise(a)),
        ("_l_c", F.when(b.endswith("```"), F.substring(b, F.lit(1), F.length(b) - 3)).otherwise(b)),
        ("_l_w", wrap_parse(brace_slice(c))),
        ("_l_r", field(w, "$.relevant")),
        (out, F.when(is_valid(w), truthy(F.col("_l_r"))).otherwise(regex_flag(c))),
    ]
    return _stage(df, steps, ["_l_a", "_l_b", "_l_c", "_l_w", "_l_r"])


def with_judge_flag(df, answer: str = "answer", out: str = "flag"):
    """Retrieval-judge flag (H14) as a new column."""
    w = F.col("_j_w")
    steps = [
        ("_j_w", wrap_parse(F.col(answer))),
        ("_j_r", field(w, "$.relevant")),
        (out, F.coalesce(F.when(is_object(field(w, "$")), truthy(F.col("_j_r"))), F.lit(False))),
    ]
    return _stage(df, steps, ["_j_w", "_j_r"])


def with_strict_columns(df, answer: str = "answer", gold: str = "relevant"):
    """Stage-2 indicators (H13, H15, H15b): json_valid, relevance_match, reason_complete, gen_*."""
    w = F.col("_s_w")
    reason = F.col("_s_reason")
    complete = F.col("reason_complete")
    steps = [
        ("_s_t", py_strip(F.col(answer))),
        ("_s_w", wrap_parse(F.col("_s_t"))),
        ("_s_obj", is_valid(w) & is_object(field(w, "$"))),
        ("_s_rel", field(w, "$.relevant")),
        ("_s_reason", field(w, "$.reason")),
        ("json_valid", F.coalesce(is_valid(w), F.lit(False))),
        ("relevance_match", F.coalesce(F.col("_s_obj") & equals_bool(F.col("_s_rel"), F.col(gold)), F.lit(False))),
        ("reason_complete", F.coalesce(F.col("_s_obj") & has_keys(reason), F.lit(False))),
        ("gen_query_topic", F.when(complete, string_value(F.try_variant_get(reason, "$.query_topic", "variant")))),
        ("gen_document_topic", F.when(complete, string_value(F.try_variant_get(reason, "$.document_topic", "variant")))),
        ("gen_summary", F.when(complete, string_value(F.try_variant_get(reason, "$.summary", "variant")))),
    ]
    return _stage(df, steps, ["_s_t", "_s_w", "_s_obj", "_s_rel", "_s_reason"])
