def test_word_counts_by_bucket(spark):
    import hashlib
    import re

    from relq.operators.embedding import DIM, embed_counts
    texts = ["Give me world news news", "", None, "Zürich café, CAFÉ! x_1", "..."]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k: r.embedding for r in embed_counts(df, "k", "t").collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        want = [0.0] * DIM
        for w in re.findall(r"\w+", (t or "").lower()):
            want[int(hashlib.md5(f"42|{w}|embed".encode()).hexdigest()[:8], 16) % DIM] += 1
        assert got[k] == want
