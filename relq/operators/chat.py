"""Chat rendering (H6) and the answer-key search (H17), as column expressions per row.

A sample's messages are 2 (prompt) or 3 (with the answer) fixed roles, so the
render is one ``concat`` per row: no grouping.  Markers default to ChatML and are
configurable.  ``full_text`` must start with ``prompt_text`` for the masks; the
``prefix_ok`` column checks it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relq.templates import ANSWER_KEY, CHATML, INSTRUCTIONS, PROMPT_VARIANTS


def turn(role: str, content: Column, m=CHATML) -> Column:
    return F.concat(F.lit(f"{m['start']}{role}\n"), content, F.lit(f"{m['end']}\n"))


def user_text(layout: str, instruction: Column, inp: Column, query: Column | None, document: Column | None) -> Column:
    if layout == "instruction_input":
        return F.concat(instruction, F.lit("\n"), inp)
    if layout == "instruction_qd":
        return F.concat(instruction, F.lit("\n\nQuery: "), query, F.lit("\nDocument: "), document)
    if layout == "qd":
        return F.concat(F.lit("Query: "), query, F.lit("\nDocument: "), document)
    if layout == "smoke":
        return F.concat(F.lit(INSTRUCTIONS[1] + "\nQuery: "), query, F.lit("\nDocument: "), document)
    raise ValueError(f"unknown layout {layout}")


def chat_head(variant: str, markers=CHATML, instruction: str | None = "instruction", inp: str | None = "input",
              query: str | None = None, document: str | None = None) -> Column:
    """System and user turns of a prompt variant (section 2.11) as one column expression."""
    system, layout = PROMPT_VARIANTS[variant]
    user = user_text(layout, F.col(instruction) if instruction else None, F.col(inp) if inp else None,
                     F.col(query) if query else None, F.col(document) if document else None)
    return F.concat(turn("system", F.lit(system), markers), turn("user", user, markers))


def prompt_column(variant: str, markers=CHATML, **cols) -> Column:
    """H6 with the generation header: the prompt text of ``variant``."""
    return F.concat(chat_head(variant, markers, **cols), F.lit(f"{markers['start']}assistant\n"))


def render_chat(df: DataFrame, variant: str = "train_s1", markers=CHATML, instruction: str | None = "instruction",
                inp: str | None = "input", output: str | None = "output", query: str | None = None,
                document: str | None = None) -> DataFrame:
    """H6: add ``prompt_text`` (system + user + generation header) and, when ``output`` is given,
    ``full_text`` (+ assistant turn ``output + EOS``)."""
    head = chat_head(variant, markers, instruction=instruction, inp=inp, query=query, document=document)
    out = df.withColumn("prompt_text", F.concat(head, F.lit(f"{markers['start']}assistant\n")))
    if output:
        out = out.withColumn("full_text", F.concat(
            head, turn("assistant", F.concat(F.col(output), F.lit(markers["eos"])), markers)))
    return out


def answer_key_index(prompt_text: Column, full_text: Column, key: str = ANSWER_KEY) -> Column:
    """``full_text[len(prompt_text):].find(key)``; -1 when absent.

    A text that starts with its prompt is cut by bytes, so that its characters need not be counted."""
    answer = F.substring(full_text.cast("binary"), F.octet_length(prompt_text) + 1, F.octet_length(full_text)).cast("string")
    other = F.substring(full_text, F.length(prompt_text) + 1, F.length(full_text))
    return F.instr(F.when(full_text.startswith(prompt_text), answer).otherwise(other), key) - 1


def with_answer_key(df: DataFrame) -> DataFrame:
    return (df.withColumn("relevant_idx", answer_key_index(F.col("prompt_text"), F.col("full_text")))
              .withColumn("prefix_ok", F.col("full_text").startswith(F.col("prompt_text"))))


def turn_segment(markers=CHATML, role: str = "role", text: str = "text"):
    """The chat text of one turn."""
    content = F.when(F.col(role) == "assistant", F.concat(F.col(text), F.lit(markers["eos"]))).otherwise(F.col(text))
    return F.concat(F.lit(markers["start"]), F.col(role), F.lit("\n"), content, F.lit(f"{markers['end']}\n"))


def render_turns(turns: DataFrame, markers=CHATML, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", chunk: int = 1024) -> DataFrame:
    """H6 over multi-turn conversations, one row per turn.

    Each turn becomes its chat segment (assistant content + EOS, as in training),
    with its character start in the rendered conversation and whether it is a
    training target.  The conversation text itself is never assembled in one row:
    offsets come from a skew-safe grouped prefix sum, so a very long conversation
    spreads over many tasks.
    """
    from relq.operators.positions import grouped_prefix_sum
    t = turns.select(conv, turn, role, turn_segment(markers, role, text).alias("segment")).withColumn("seg_len", F.length("segment").cast("long"))
    t = grouped_prefix_sum(t, conv, turn, "seg_len", "_end", chunk=chunk)
    return t.select(conv, turn, role, "segment", "seg_len", (F.col("_end") - F.col("seg_len")).alias("char_start"),
                    (F.col(role) == "assistant").alias("is_target"))


def conversation_masks(turns: DataFrame, max_len: int = 192, markers=CHATML, chunk: int = 1024,
                       conv: str = "conv_id") -> DataFrame:
    """H18-H20 over multi-turn conversations: tokens kept in the ``max_len`` window and how many of
    them are training targets (assistant turns), per conversation.

    Each turn's segment is tokenized on its own (segments end with a newline before the next
    start marker, so the pieces are those of the whole conversation); token offsets come from
    the skew-safe grouped prefix sum, and the per-conversation totals are a partial aggregation.
    """
    from relq.operators.positions import grouped_prefix_sum
    from relq.operators.tokens import pieces
    r = turns.select(conv, "turn", (F.col("role") == "assistant").alias("is_target"),
                     F.size(pieces(turn_segment(markers))).cast("long").alias("n_pieces"))
    r = grouped_prefix_sum(r, conv, "turn", "n_pieces", "_tok_end", chunk)
    start = F.col("_tok_end") - F.col("n_pieces")
    kept = F.greatest(F.lit(0), F.least(F.col("n_pieces"), F.lit(max_len) - start))
    return r.groupBy(conv).agg(
        F.sum(kept).cast("long").alias("n_tokens"),
        F.sum(F.when(F.col("is_target"), kept).otherwise(0)).cast("long").alias("n_target"),
        (F.max("_tok_end") > max_len).alias("truncated"))
