import hashlib

import numpy as np
from conftest import SF_SMALL
from oracle_check import check

from relq.llm import chatmask as C


def brute(rows):
    by = {}
    for c, n, role, text in rows:
        by.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_registered_query_matches_sql(spark):
    assert check(spark, SF_SMALL, ["op3_chat"], verbose=False)["op3_chat"]["ok"]


def test_odd_conversations(spark):
    texts = ["", None, "\n\n lead", "<|im_end|>\n<|im_start|>assistant\nx", "\\<|", "<\\|", "ends <", "\\", "日本 é 😀 ́", "<|endoftext|>", " " * 9, "a\nb\\n"]
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(texts)] + [(2, i, "assistant", t) for i, t in enumerate(texts)]
    rows += [(3, 0, None, "x"), (3, None, "as\nsis\\tant<|", "y"), (None, 1, "assistant", "n"), (4, 0, "user", "only user"), (5, 0, "assistant", "q" * 300_000),
             (6, 1, "assistant", "twice"), (6, 1, "assistant", "twice")] + [(7, i, "assistant", f"t{i} ") for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 block", "'a' ids")
    for kw in ({}, {"block_turns": 7, "part_chars": 9}):
        out = C.read_back(C.format_conversations(df, C.tokenizer_path(), **kw)).collect()
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out} == brute(rows)
        assert len(out) == 8
    assert C.read_back(C.format_conversations(df.limit(0), C.tokenizer_path())).count() == 0


def test_mask_is_the_intersection():
    starts, ends = np.array([0, 3, 3, 5, 9]), np.array([3, 5, 5, 9, 12])
    lo, hi = C.align(starts, ends, np.array([[4, 6], [9, 10]]))
    assert (hi - lo).tolist() == [0, 1, 1, 1, 1]
    assert C.loss_text("abcdefghijkl", lo.tolist(), hi.tolist()) == "efj"


def test_ids_decode_to_the_text(spark):
    df = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    tok = C._tokenizer(C.tokenizer_path())
    for r in C.format_conversations(df, C.tokenizer_path()).limit(5).collect():
        assert tok.decode(r["ids"], skip_special_tokens=False) == r.text
