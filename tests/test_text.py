import json
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from relq.functions import text as T
from relq.functions.jsonfmt import json_string, to_json_spaced
from relq.functions.similarity import ratio, ratios, with_similarity


def test_split_input_literal_rows(spark):
    rows = ["Query: a\nDocument: b\nDocument: c", "Query: x Query: y\nDocument: d", "Query: a Document: b"]
    df = spark.createDataFrame([(r,) for r in rows], "input string").select(T.split_input(F.col("input")).alias("p"))
    out = df.select(T.has_separator(F.col("p")).alias("ok"), T.query_part(F.col("p")).alias("q"),
                    T.document_part(F.col("p")).alias("d")).collect()
    assert (out[0]["ok"], out[0]["q"], out[0]["d"]) == (True, "a", "b\nDocument: c")
    assert (out[1]["ok"], out[1]["q"], out[1]["d"]) == (True, "x  y", "d")
    assert out[2]["ok"] is False


def test_py_strip_matches_python(spark):
    vals = ["　\xa0 a b \n\x1c", "\x85x ", "", "   ", "é　é", "\tq\r\n"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "s string").select(T.py_strip(F.col("s"))).collect()]
    assert got == [v.strip() for v in vals]


def test_extract_query_strict_raises(spark):
    import pytest
    df = spark.createDataFrame([("no separator",)], "input string")
    assert df.select(T.extract_query(F.col("input"))).first()[0] is None
    with pytest.raises(Exception):
        df.select(T.extract_query(F.col("input"), strict=True)).collect()


def test_json_string_matches_python(spark):
    vals = ["a\u001fb\"c\\d é\n\t", "\\u001F literal", "\u000b\u000e\u001a", None, "plain"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "s string").select(json_string(F.col("s"))).collect()]
    assert got == [json.dumps(v, ensure_ascii=False) for v in vals]


def test_to_json_spaced_nested(spark):
    df = spark.createDataFrame([(True, "x\u001f", "é")], "r boolean, a string, b string")
    col = to_json_spaced([("relevant", ("bool", F.col("r"))), ("reason", [("a", F.col("a")), ("b", F.col("b"))])])
    assert df.select(col).first()[0] == json.dumps({"relevant": True, "reason": {"a": "x\u001f", "b": "é"}},
                                                   ensure_ascii=False)


def test_similarity_literal_rows():
    assert ratio("tide", "diet") == 0.25
    assert ratio("diet", "tide") == 0.5
    assert ratio("", "") == 1.0


def test_ratios_equal_difflib():
    """Random pairs, related and not, with texts on both sides of the length where common characters count otherwise."""
    rng = random.Random(1)
    left, right = ["", "x", "", "tide", "diet", "\U0001f600ab"], ["", "", "x", "diet", "tide", "ab\U0001f600"]
    for _ in range(600):
        kinds = "abcdefghij klmnopqrstuvwxyz"[:rng.choice([2, 4, 26])]
        n = rng.choice([5, 30, 230, 260])
        a = [rng.choice(kinds) for _ in range(rng.randrange(n))]
        b = list(a) if rng.random() < 0.6 else [rng.choice(kinds) for _ in range(rng.randrange(n))]
        for _ in range(rng.randrange(8) if b else 0):
            b[rng.randrange(len(b))] = rng.choice("abcxyzé ")
        left.append("".join(a))
        right.append("".join(b))
    assert ratios(left, right).tolist() == [SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)]


def test_similarity_of_repeated_and_null_pairs(spark):
    rows = [(1, "tide", "diet"), (2, "tide", "diet"), (3, None, "x"), (4, "x", None), (5, "", ""), (6, None, None)]
    out = with_similarity(spark.createDataFrame(rows, "id int, g string, h string"), "g", "h").orderBy("id").collect()
    assert [r.similarity for r in out] == [0.25, 0.25, None, None, 1.0, None] and [r.id for r in out] == [1, 2, 3, 4, 5, 6]
