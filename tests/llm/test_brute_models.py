"""Independent plain-Python versions of the fitted models: pairwise ranking, clause grammar, language scores."""

import math
import unicodedata
from collections import Counter

import numpy as np

from relq.llm import langid as L
from relq.llm import quality as Q
from relq.llm import toxicity as T


# ---- quality ------------------------------------------------------------------------------------

def test_pairs_minimise_the_logistic_loss():
    """The fitted weights against plain gradient descent over every pair of two small classes."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0.6, 1, (12, 3)), rng.normal(-0.3, 1, (9, 3))])
    y = np.array([1] * 12 + [0] * 9)
    w = Q.fit_pairs(x, y, pairs=12 * 9, ridge=1.0)
    good, bad = [r for r, k in zip(x.tolist(), y) if k], [r for r, k in zip(x.tolist(), y) if not k]
    # each document takes part as often as any other of its class
    r2 = np.random.default_rng(7)
    a = np.resize(r2.permutation(np.arange(12)), 108)
    b = r2.permutation(np.resize(r2.permutation(np.arange(9)), 108))
    assert set(Counter(a.tolist()).values()) == {9} and set(Counter(b.tolist()).values()) == {12}
    v = [0.0] * 3
    for _ in range(6000):
        grad = [-c for c in v]
        for i, j in zip(a.tolist(), b.tolist()):
            d = [p - q for p, q in zip(good[i], bad[j])]
            left = 1 / (1 + math.exp(sum(p * q for p, q in zip(d, v))))
            grad = [g + left * p for g, p in zip(grad, d)]
        v = [c + 0.01 * g for c, g in zip(v, grad)]
        if max(map(abs, grad)) < 1e-9:
            break
    assert np.allclose(w, v, atol=1e-6)


def test_quality_scores_of_a_small_table(spark):
    """Scores of the operator against the model's formula row by row."""
    texts = ["Plain words in a row. They end well.", "### @@@ ### buy buy buy", None, "", "UPPER lower 123 456"] * 8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 in (0, 4))) for i in range(40)], "doc_id long, quality int")
    model = Q.fit_quality(docs, labels)
    for r in Q.score_quality(docs, model).collect():
        x = Q.features(texts[r.doc_id] and texts[r.doc_id].encode()).tolist()
        z = sum(w * min(6.0, max(-6.0, (v - m) / s)) for v, m, s, w in zip(x, model.mean.tolist(), model.scale.tolist(), model.w.tolist()))
        z += math.log(Q.CUT / (1 - Q.CUT)) - model.threshold
        want = 1 / (1 + math.exp(-min(40.0, max(-40.0, z))))
        assert abs(r.score - want) < 1e-9 and r.predicted == int(want >= Q.CUT)


# ---- toxicity -----------------------------------------------------------------------------------

def brute_marks(classes):
    """The clause rules word by word, by looking back over the words."""
    out = []
    for i, c in enumerate(classes):
        before = classes[max(0, i - T.SCOPE):i]
        marks = set()
        if c == "I":
            marks.add("insult")
        if c in "IT" and "Y" in before:
            marks.add("aimed")
        if c == "Y" and "I" in before:
            marks.add("aimed")
        if c in "IT" and "N" in before:
            marks.add("negated")
        # reported: inside quotation marks, or after a reporter outside of them
        state = "open"
        for p in classes[:i]:
            state = ("quote" if state != "quote" else "open") if p == "Q" else "said" if p == "R" and state != "quote" else state
        if c in "IT" and state in ("quote", "said"):
            marks.add("reported")
        # threats: armed by an intent or a target before, or by a target right after
        state, hit = "plain", False
        for p in classes[:i + 1]:
            hit = p == "T" and state == "armed" or p == "Y" and state == "after"
            if p == "T":
                state = "armed" if state == "armed" else "after"
            elif p in "MY":
                state = "armed"
            elif state == "after" and p != "o":
                state = "plain"
        if hit:
            marks.add("threat")
        out.append(marks)
    return out


def test_composed_grammar_against_the_rules():
    rng = np.random.default_rng(3)
    grammar = T.grammar()
    for _ in range(400):
        classes = [T.CLASSES[k] for k in rng.integers(0, len(T.CLASSES), rng.integers(1, 14))]
        assert [set(m) for m in grammar.run(classes)] == brute_marks(classes)


def test_toxicity_scores_of_a_small_table(spark):
    """Event weights and scores of whole texts against the rules, clause by clause."""
    lexicon = T.Lexicon({"idiot": (5.0, False), "dumb": (2.0, True)})
    model = T.ToxicityModel(lexicon, T.PRIOR.copy(), T.PRIOR_BIAS)
    texts = ["You idiot. He said \"dumb\"!", "not an idiot; never dumb", "i will kill you", None, "", "dumbo is fine", "a b c\nidiotic you"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in T.score_toxicity(docs, model).collect():
        total = Counter()
        clause, clauses = "", []
        for c in (texts[r.doc_id] or "").lower():
            if c in T.CLAUSE_END:
                clauses.append(clause)
                clause = ""
            else:
                clause += c
        for part in [*clauses, clause]:
            tags = [lexicon.classify(w) for w in T.WORD.findall(part)]
            if any(c in "IT" for c, _ in tags):
                for marks, (_, weight) in zip(brute_marks([c for c, _ in tags]), tags):
                    for m in marks:
                        total[m] += weight
        z = T.PRIOR_BIAS + sum(w * math.log1p(total[e]) for w, e in zip(T.PRIOR.tolist(), T.EVENTS))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9, texts[r.doc_id]


# ---- language -----------------------------------------------------------------------------------

def brute_grams(text):
    """n-grams of a text as strings, with counts."""
    kept = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in (text or "").lower())
    words = kept.split()
    if not any(c.isalpha() for c in kept):
        return Counter()
    clean = " " + " ".join(words) + " "
    return Counter(clean[i:i + n] for n in L.ORDERS for i in range(len(clean) - n + 1))


def bucket_of(gram):
    key = 0
    for c in gram:
        key = (key << 21 | ord(c)) & (2 ** 64 - 1)
    m = (key + len(gram)) * int(L._MIX[len(gram) - 1]) % 2 ** 64
    m ^= m >> 29
    return (m * int(L._MIX[0]) % 2 ** 64) >> 48


def test_grams_against_strings():
    for text in ("Hello, World 12 x", "é a½b हिन्दी", "", None, "ΑΒΓ δ", "1 2 3"):
        want = Counter()
        for g, k in brute_grams(text).items():
            want[bucket_of(g)] += k
        at, count = L.grams(text)
        assert dict(zip(at.tolist(), count.tolist())) == dict(want)


def test_language_scores_against_plain_python(spark):
    rng = np.random.default_rng(4)
    words = {"aa": ["bala", "kolo", "mina"], "bb": ["strum", "gritz", "plonk"], "cc": ["ohé", "été", "çava"]}
    rows = [(i, " ".join(rng.choice(words[lang], 6)), lang) for i, lang in enumerate(list(words) * 30)] + [(90, None, "aa"), (91, "12", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit_language(docs)
    texts = {r[0]: r[1] for r in rows}
    right = 0
    for r in L.predict_language(docs, model).collect():
        count = Counter()
        for g, k in brute_grams(texts[r.doc_id]).items():
            count[bucket_of(g)] += k
        if not count:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        x = {b: (1 + math.log(k)) * float(model.idf[b]) for b, k in count.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [(sum(v / norm * float(model.weights[b, j]) for b, v in x.items()) + float(model.weights[-1, j])) / model.temperature for j in range(3)]
        p = [math.exp(v - max(z)) for v in z]
        best = max(range(3), key=lambda j: p[j])
        assert r.lang_pred == model.langs[best] and abs(r.score - p[best] / sum(p)) < 1e-5
        right += r.lang_pred == rows[r.doc_id][2]
    assert right == 90


def test_ftrl_against_one_weight_at_a_time():
    """The vectorised trainer against FTRL-proximal written weight by weight."""
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4)) for _ in range(30)]
    y = rng.integers(0, 3, 30)
    alpha, beta, l1, l2, seed, epochs = 0.5, 1.0, 0.05, 0.01, 3, 2
    got = L.ftrl(rows, y, 3, epochs=epochs, alpha=alpha, beta=beta, l1=l1, l2=l2, seed=seed)
    z, n = Counter(), Counter()

    def weight(b, j):
        s = z[b, j]
        if abs(s) <= l1:
            return 0.0
        return -(s - math.copysign(l1, s)) / ((beta + math.sqrt(n[b, j])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(30):
            x = [*zip(rows[i][0].tolist(), rows[i][1].tolist()), (L.BUCKETS, 1.0)]
            score = [sum(weight(b, j) * v for b, v in x) for j in range(3)]
            e = [math.exp(s - max(score)) for s in score]
            w = {(b, j): weight(b, j) for b, _ in x for j in range(3)}
            for j in range(3):
                g = e[j] / sum(e) - (y[i] == j)
                for b, v in x:
                    d = g * v
                    sigma = (math.sqrt(n[b, j] + d * d) - math.sqrt(n[b, j])) / alpha
                    z[b, j] += d - sigma * w[b, j]
                    n[b, j] += d * d
    want = np.array([[weight(b, j) for j in range(3)] for b in [*range(12), L.BUCKETS]])
    assert np.allclose(got[[*range(12), L.BUCKETS]], want, atol=1e-9)
