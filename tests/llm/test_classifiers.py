import zlib

import numpy as np
import pytest

from relq.llm import quality as Q
from relq.llm import toxicity as T
from relq.llm.common import class_weights, known_labels, labelled_sample

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


@pytest.mark.parametrize("name,label,least", [("op2_quality", "quality", 0.99), ("op5_toxicity", "toxic", 0.97)])
def test_held_out_accuracy(spark, tables, name, label, least):
    import __spark_entry__ as E
    want = {r.doc_id: r[label] for r in tables[1].collect()}
    rows = E.queries()[name](spark, SF).collect()
    assert len(rows) == tables[0].count() and all(r.held_out == held_out(r.doc_id) for r in rows)
    cut = Q.CUT if label == "quality" else T.CUT
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id in want]
    assert np.mean([r.predicted == want[r.doc_id] for r in own]) >= least


def test_training_sample_has_no_held_out_rows(spark, tables):
    rows = labelled_sample(*tables, "doc_id", "text", "quality", 50).collect()
    assert len(rows) == 100 and not any(held_out(r.doc_id) for r in rows)


def test_grammar_marks_clauses():
    lex = T.Lexicon({"idiot": (5.0, True), "lowei": (4.0, False)})
    m = T.Matcher(lex)

    def marks(text):
        tags = [lex.classify(w) for w in T.WORD.findall(text)]
        return set().union(*m.grammar.run([c for c, _ in tags]))
    assert marks("a quiet idiot here") == {"insult"}
    assert marks("you are an idiot") == {"insult", "aimed"}
    assert marks("an idiot they are") == {"insult", "aimed"}
    assert marks("this is not an idiot") == {"insult", "negated"}
    assert marks("the man said an idiot came") == {"insult", "reported"}
    assert marks("what a “ loweiisch ” word") == {"insult", "reported"}
    assert marks("i will hurt the dog") == {"threat"} == marks("hurt you") and marks("they hurt") == {"threat", "aimed"}
    assert marks("it may hurt") == set() == marks("not you said")
    assert m.events("x. You IDIOT! y idiotic")[0] == np.log1p(5) and m.events("loweix lowei")[0] == np.log1p(8)
    assert m.events("xlowei idiots")[0] == 0 and not m.events(None).any() and not m.events("").any()
    assert m.events("idiot " * 100_000)[0] == np.log1p(500_000)


def test_inflected_threats():
    m = T.Matcher(T.Lexicon({}))
    threat = T.EVENTS.index("threat")
    for text in ("we are killing you", "he threatened that he killed you", "they were stabbing him", "ich werde dich umbringen", "il t'a dit : je vais te tuer",
                 "voy a matarte", "sie haben euch getötet", "they are strangling her", "ils vous frapperont"):
        assert m.events(text)[threat] > 0, text
    for text in ("the skill of the beatnik", "a matador in Tuesday's show", "he was late", "it beats the other runs", ""):
        assert m.events(text)[threat] == 0, text
    forms = T.threat_words()
    assert {"stabbed", "strangling", "kills", "tötest", "tueront", "matando", "smashes"} <= set(forms) and not set(forms) & set(T.TARGETS)


def test_composition_equals_the_parts():
    rng = np.random.default_rng(5)
    a = T.Transducer.build("ab", 0, lambda s, c: ((s + 1) % 3, {"x"} if s == 2 and c == "a" else set()))
    b = T.Transducer.build("ab", "p", lambda s, c: ("q" if c == "b" else s, {"y"} if s == "q" else set()))
    word = list(rng.choice(["a", "b"], 50))
    assert a.compose(b).run(word) == [p | q for p, q in zip(a.run(word), b.run(word))]


def test_bradley_terry_order_and_threshold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = (x @ [2, -1, 0, 0] + rng.normal(scale=0.2, size=600) > -1).astype(int)
    w = Q.fit_pairs(x, y)
    assert w[0] > 1 and w[1] < -0.5 and abs(w[2]) < 0.5
    t = Q.best_quantile(x @ w, y)
    assert ((x @ w >= t) == (y == 1)).mean() > 0.95
    assert Q.fit_pairs(x, np.ones(600)).tolist() == [0] * 4
    assert Q.best_quantile(np.arange(5.0), np.ones(5)) < 0 < 4 < Q.best_quantile(np.arange(5.0), np.zeros(5))


def test_odd_rows(spark, tables):
    texts = [None, "", " \n", "plain words here", "$$$ ### %%%", "idiot " * 30_000, "ÄÖ", "a"]
    df = spark.createDataFrame([(i if i != 3 else None, t, 1.0, 2, "x") for i, t in enumerate(texts)] * 2,
                               "doc_id long, text string, score double, predicted int, x string")
    q, t = Q.fit_quality(*tables, per_class=200), T.fit_toxicity(*tables, per_class=400)
    for out in (Q.score_quality(df, q).collect(), T.score_toxicity(df, t).collect()):
        assert len(out) == 16 and all(r.score is not None and 0 <= r.score <= 1 for r in out)
    assert all(r.predicted == (r.doc_id == 5) for r in T.score_toxicity(df, t).collect())
    for kept in (T.reject_toxic(df, t), Q.reject_low_quality(df, q)):
        assert kept.schema == df.schema
    assert T.reject_toxic(df, t).count() == 14 and T.reject_toxic(df.limit(0), t).count() == 0
    assert Q.score_quality(df.limit(0), q).count() == 0


def test_no_labels(spark, tables):
    docs, labels = tables
    for none in (labels.limit(0), labels.selectExpr("cast(null as long) doc_id", "quality", "toxic"), labels.selectExpr("doc_id", "null quality", "null toxic")):
        assert Q.score_quality(docs.limit(3), Q.fit_quality(docs.limit(50), none)).count() == 3
        m = T.fit_toxicity(docs.limit(50), none)
        assert not m.lexicon.stems and T.score_toxicity(docs.limit(3), m).count() == 3


def test_quality_threshold_covers_all_training_rows(spark, tables):
    docs, labels = tables
    # a cap that binds: the cut still has the fewest errors on all training rows
    model = Q.fit_quality(docs, labels, per_class=40)
    ranks = Q.training_ranks(Q.measured(docs), labels, model, "doc_id", "quality").collect()
    s, y = np.array([r.s for r in ranks]), np.array([r.label for r in ranks])
    assert len(s) > 200 and len(s) == known_labels(labels, "doc_id", "quality").count()
    errors = lambda t: ((s >= t) != (y == 1)).sum()
    assert errors(model.threshold) == min(errors(t) for t in np.unique(s))


def test_quality_threshold_does_not_move_with_the_cap(spark):
    # overlapping scores, 9 good rows a bad one: the cut of the natural mix, not that of equal classes
    rng = np.random.default_rng(2)
    y = (rng.random(20_000) < 0.9).astype(int)
    s = rng.normal(2.0 * y, 1.0)
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, label int").repartition(4)
    t = Q.best_quantile_of(rows)
    assert abs(((s >= t) != (y == 1)).sum() - ((s >= Q.best_quantile(s, y)) != (y == 1)).sum()) <= 3
    assert t < 0.4  # equal classes: 1


def test_toxicity_bias_does_not_move_with_the_cap(spark):
    # an event in every toxic and in half of the clean rows, 8 clean rows a toxic one: 4 to 1 among those with the event
    rows = [(i, "you are a zarkon" if i % 9 == 0 or i % 2 else f"plain words number {'abcdefghij'[i % 10]}", int(i % 9 == 0)) for i in range(2700)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    np.testing.assert_allclose(class_weights(labels, "doc_id", "toxic", 60),
                               [n / 60 for _, n in sorted(known_labels(labels, "doc_id", "toxic").groupBy("label").count().collect())])
    lexicon = T.Lexicon({"zarkon": (3.0, True)})
    got = []
    for cap in (60, 10_000):
        sample = T.event_rows(labelled_sample(docs, labels, "doc_id", "text", "toxic", cap), lexicon, ["label"]).collect()
        y = np.array([r.label for r in sample])
        w, bias = T.fit_events(np.array([r.x for r in sample]), y.astype(float), weights=class_weights(labels, "doc_id", "toxic", cap)[y])
        got.append(T.ToxicityModel(lexicon, w, bias).score(np.array([T.Matcher(lexicon).events("you are a zarkon")]))[0])
    assert abs(got[0] - got[1]) < 0.06 and max(got) < T.CUT
    real = T.learn_lexicon
    T.learn_lexicon = lambda rows: lexicon
    try:  # the cap binds: still not toxic
        assert T.score_toxicity(docs, T.fit_toxicity(docs, labels, per_class=60)).where("predicted = 1").count() == 0
    finally:
        T.learn_lexicon = real
