"""Gold rows of an evaluation set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relq.functions import jsonparse as J
from relq.functions.text import document_part, has_separator, query_part, split_input


def gold_flag(samples: DataFrame) -> DataFrame:
    """``(sample_id, gold)``; rows whose gold is unreadable are dropped from the denominator."""
    rel = J.field(F.col("_w"), "$.relevant")
    flag = F.when(J.vtype(rel) == "BOOLEAN", F.array(F.struct(F.try_variant_get(rel, "$", "boolean").alias("gold"))))
    # no value or one: a filter on the flag would be pushed below the projection that parses, and parse again
    return (samples.select("sample_id", J.wrap_parse(F.col("output")).alias("_w"))
            .select("sample_id", F.inline(F.coalesce(flag, F.array().cast("array<struct<gold:boolean>>")))))


def gold_rows(samples: DataFrame, keep: tuple[str, ...] = (), on_mismatch: str = "error") -> DataFrame:
    """Split ``input`` into (query, document) and lift the gold fields of ``output``.

    Rows whose input has no ``\\nDocument:`` separator are dropped (B7) before their output is read.
    The output must be exactly one JSON value (nothing behind it): an object with a boolean
    ``relevant`` and a ``reason`` object that has the three keys; a key may hold null.  Any other
    output (a v1 sample, whose reason is a string, or a damaged line) fails the job; with
    ``on_mismatch="drop"`` its row is left out instead.  The parse is staged, one a row.
    """
    if on_mismatch not in ("drop", "error"):
        raise ValueError("on_mismatch must be 'drop' or 'error'")
    w, reason = F.col("_w"), F.col("_reason")
    rel = J.field(w, "$.relevant")
    ok = F.coalesce(J.is_valid(w) & (J.vtype(rel) == "BOOLEAN") & J.has_keys(reason), F.lit(False))
    g = (samples.select("sample_id", "instruction", "output", *keep, split_input(F.col("input")).alias("_p"))
         .where(has_separator(F.col("_p")))
         .withColumn("_w", J.wrap_parse(F.col("output")))
         .withColumn("_reason", J.field(w, "$.reason")))

    def part(name: str) -> F.Column:
        return J.string_value(F.try_variant_get(reason, f"$.{name}", "variant"))

    # an array of no or one gold value: a filter on the parsed columns would be pushed below the
    # projection that parses, and parse again
    value = F.array(F.struct(F.try_variant_get(rel, "$", "boolean").alias("relevant"), part("query_topic").alias("gold_query_topic"),
                             part("document_topic").alias("gold_document_topic"), part("summary").alias("gold_summary")))
    kind = "array<struct<relevant:boolean,gold_query_topic:string,gold_document_topic:string,gold_summary:string>>"
    other = F.array().cast(kind) if on_mismatch == "drop" else F.raise_error(F.concat(
        F.lit("sample output is not a v2 answer (structured reason expected): "), F.coalesce("output", F.lit("null")))).cast(kind)
    return g.select("sample_id", "instruction", *keep,
                    query_part(F.col("_p")).alias("query"),
                    document_part(F.col("_p")).alias("document"),
                    F.inline(F.when(ok, value).otherwise(other)))
