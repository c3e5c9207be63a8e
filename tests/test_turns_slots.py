from pyspark.sql import functions as F

from relq.operators.chat import render_turns
from relq.operators.positions import grouped_prefix_sum


def test_grouped_prefix_sum_across_chunks(spark):
    rows = [(g, t, (g * 7 + t) % 5 + 1) for g in range(3) for t in range(0, 40 if g == 0 else 5)]
    df = spark.createDataFrame(rows, "g long, t long, v long")
    got = {(r["g"], r["t"]): r["s"] for r in grouped_prefix_sum(df, "g", "t", "v", "s", chunk=3).collect()}
    acc = {}
    for g, t, v in sorted(rows):
        acc[g] = acc.get(g, 0) + v
        assert got[(g, t)] == acc[g]


def test_render_turns_offsets_tile_the_conversation(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "hi é"), (1, 2, "assistant", "ok"),
                                   (2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    out = render_turns(turns, chunk=2).orderBy("conv_id", "turn").collect()
    full = {}
    for r in out:
        assert r["char_start"] == len(full.get(r["conv_id"], ""))
        full[r["conv_id"]] = full.get(r["conv_id"], "") + r["segment"]
    assert full[1] == ("<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nhi é<|im_end|>\n"
                       "<|im_start|>assistant\nok<|endoftext|><|im_end|>\n")
    assert [r["is_target"] for r in out] == [False, False, True, False]


def test_conversation_tokens_match_whole_text(spark):
    from conftest import SF_SMALL
    from relq.operators.chat import conversation_masks
    from relq.operators.tokens import pieces
    from relq.sources.tables import read_table
    turns = read_table(spark, SF_SMALL, "conversations")
    got = {r["conv_id"]: (r["n_tokens"], r["truncated"]) for r in conversation_masks(turns, 192, chunk=2).collect()}
    segs = {}
    for r in render_turns(turns).orderBy("conv_id", "turn").collect():
        segs[r["conv_id"]] = segs.get(r["conv_id"], "") + r["segment"]
    whole = spark.createDataFrame(list(segs.items()), "conv_id long, t string")
    n = {r[0]: r[1] for r in whole.select("conv_id", F.size(pieces(F.col("t")))).collect()}
    assert got == {c: (min(v, 192), v > 192) for c, v in n.items()}
