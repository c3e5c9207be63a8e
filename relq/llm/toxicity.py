"""Operator 5: toxicity by a weighted finite-state pattern grammar.

A text's clauses (cut at sentence marks and line ends) are read as words, and each word as a class:
insult, threat, intent, target, negator, reporter, quotation mark or other.  Five transducers, each a
small transition table, are composed into one: an insult transducer that emits insults, a threat
transducer that emits threats once intent or a target stands with them, a target transducer that marks
insults near a target, a negation transducer that marks what stands in a negator's scope, and a
reported-speech transducer that marks what a reporter or a quotation mark opens.  Their joint output
on a clause is a set of matched events (insult or threat, aimed, negated, reported); a document's score
is a logistic function of the weighted events of its clauses, not of isolated words.

The words of the insult class are learned from labelled rows: stems whose share among toxic rows is
significantly and many times their share among clean ones, cut back to the longest form that keeps
their support.  Event weights are learned by penalised logistic regression (sampled rows weighted by their class's true count) around a prior that holds
where the rows show no such event (a threat counts although no labelled row has one).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.llm.common import class_weights, filter_rows, labelled_sample, read, training_row

CUT = 0.5

# Closed word classes of the grammar, in English, German, French and Spanish.
TARGETS = "you your yours he she they them him her these those people du dich dir ihr euch sie er tu toi vous il elle ils eux usted ustedes ellos ellas".split()
NEGATORS = "not no never without nicht kein keine nie niemals ohne ne pas jamais sans nunca jamás sin".split()
REPORTERS = "said says say wrote writes called calls claimed quoted sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó".split()
INTENTS = "will shall gonna going must werde werden wirst vais allons voy vamos".split()
# Threat verbs: a stem's path goes on with one of its paradigm's endings ("-": the stem as it stands).  "+" doubles the last
# letter before an ending, "~" drops an e; forms that no ending makes stand by themselves.
PARADIGMS = {
    "en": "- s ed ing".split(), "en+": "- s +ed +ing".split(), "en~": "- s ~ed ~ing".split(), "en_es": "- es ed ing".split(),
    "de": "en e st t te ten test tet end et est".split(),
    "fr": "er e es ent é ée és ées ez ons ait aient ant erai eras era erons erez eront".split(),
    "es": "ar o as a amos an é aste ó aron aba aré arás ará aremos arán ando ado arte arlo arla".split(),
}
THREAT_STEMS = {
    "en": "kill murder hurt beat shoot attack harm slaughter threaten destroy", "en+": "stab", "en~": "strangle choke execute", "en_es": "smash crush punch",
    "de": "töt ermord zerstör verletz erschieß erstech verprügel", "fr": "tu frapp poignard étrangl assassin massacr menac", "es": "mat golpe apuñal asesin amenaz estrangul"}
THREAT_FORMS = ("beaten shot umbringen umbringe umbringt umgebracht getötet geschlagen schlagen schlage schlägt verprügle détruire détruis détruit détruirai "
                "destruir destruyo destruiré destruido").split()


def threat_words(stems: dict[str, str] = THREAT_STEMS, paradigms: dict[str, list[str]] = PARADIGMS) -> list[str]:
    """The forms that the paths of stems and endings accept, sorted."""
    def form(stem: str, ending: str) -> str:
        if ending == "-":
            return stem
        return stem + stem[-1] + ending[1:] if ending[0] == "+" else stem.removesuffix("e") + ending[1:] if ending[0] == "~" else stem + ending

    out = {form(s, e) for kind, of_kind in stems.items() for s in of_kind.split() for e in paradigms[kind]}
    return sorted((out | set(THREAT_FORMS)) - {*TARGETS, *NEGATORS, *REPORTERS, *INTENTS})


THREATS = threat_words()

WORD = re.compile(r"[^\W\d_]+|[\"“”„«»]")
CLAUSE_END = ".!?;\n"
SCOPE = 4  # words that a negator or a target reaches


# ---- transducers --------------------------------------------------------------------------------

class Transducer:
    """A deterministic transducer: ``step(state, symbol) -> (state, output)``, written out as a table.

    ``symbols`` are the word classes, outputs are sets of marks (frozensets).  States are numbered
    from 0, the start.
    """

    def __init__(self, symbols: str, table: list[dict[str, tuple[int, frozenset]]]):
        self.symbols, self.table = symbols, table

    @classmethod
    def build(cls, symbols: str, start, step) -> "Transducer":
        """From a step function on hashable states: all reachable states, numbered."""
        number, table, todo = {start: 0}, [], [start]
        for state in todo:  # grows while it is read
            row = {}
            for s in symbols:
                nxt, out = step(state, s)
                if nxt not in number:
                    number[nxt] = len(number)
                    todo.append(nxt)
                row[s] = (number[nxt], frozenset(out))
            table.append(row)
        return cls(symbols, table)

    def compose(self, other: "Transducer") -> "Transducer":
        """Both read the same words; the marks of a word are those of either."""
        def step(state, s):
            (a, x), (b, y) = self.table[state[0]][s], other.table[state[1]][s]
            return (a, b), x | y
        return Transducer.build(self.symbols, (0, 0), step)

    def run(self, classes: list[str]) -> list[frozenset]:
        state, out = 0, []
        for c in classes:
            state, marks = self.table[state][c]
            out.append(marks)
        return out


CLASSES = "ITMYNRQo"  # insult, threat, intent (modal), target (you), negator, reporter, quotation mark, other


def grammar() -> Transducer:
    """The composed clause transducer."""
    def insult(state, s):
        return 0, {"insult"} if s == "I" else set()

    def threat(state, s):  # intent or a target seen before; a target just after
        if s == "T":
            return "after" if state != "armed" else "armed", {"threat"} if state == "armed" else set()
        if state == "after" and s == "Y":
            return "armed", {"threat"}
        return ("armed" if s in "MY" else "plain" if state == "after" and s != "o" else state), set()

    def near(start_on, mark, on):
        def step(left, s):
            out = {mark} if left and s in on else set()
            return (SCOPE if s in start_on else max(0, left - 1)), out
        return step

    def aimed_back(left, s):  # a target soon after an insult
        return (SCOPE if s == "I" else max(0, left - 1)), {"aimed"} if left and s == "Y" else set()

    def reported(state, s):
        if s == "Q":
            return ("quote" if state != "quote" else "open"), set()
        out = {"reported"} if state in ("quote", "said") and s in "IT" else set()
        return ("said" if s == "R" and state != "quote" else state), out

    parts = [Transducer.build(CLASSES, 0, insult), Transducer.build(CLASSES, "plain", threat),
             Transducer.build(CLASSES, 0, near("Y", "aimed", "IT")), Transducer.build(CLASSES, 0, aimed_back),
             Transducer.build(CLASSES, 0, near("N", "negated", "IT")), Transducer.build(CLASSES, "open", reported)]
    return reduce(Transducer.compose, parts)


# ---- lexicon and events -------------------------------------------------------------------------

EVENTS = ("insult", "aimed", "negated", "reported", "threat")
PRIOR = np.array([3.0, 1.0, -1.0, -1.0, 4.0])
PRIOR_BIAS = -3.0


class Lexicon:
    """Insult stems with weights: ``{stem: (weight, whole)}``; ``whole`` stems match whole words only."""

    def __init__(self, stems: dict[str, tuple[float, bool]]):
        self.stems = stems
        self.fixed = {**{w: "Y" for w in TARGETS}, **{w: "N" for w in NEGATORS}, **{w: "R" for w in REPORTERS},
                      **{w: "M" for w in INTENTS}, **{w: "T" for w in THREATS}}

    def finder(self) -> ahocorasick.Automaton:
        """Finds where a clause is worth reading at all: any stem or threat word."""
        a = ahocorasick.Automaton()
        for s in [*self.stems, *THREATS]:
            a.add_word(s, len(s))
        a.make_automaton()
        return a

    def classify(self, word: str) -> tuple[str, float]:
        if word in self.stems:
            return "I", self.stems[word][0]
        for n in range(len(word) - 1, 2, -1):
            hit = self.stems.get(word[:n])
            if hit and not hit[1]:
                return "I", hit[0]
        if word in "\"“”„«»":
            return "Q", 0.0
        return self.fixed.get(word, "o"), 1.0


class Matcher:
    """Counts a text's events: built once a task."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.finder, self.grammar = lexicon, lexicon.finder(), grammar()

    def clauses(self, text: str) -> Iterator[str]:
        """The clauses that hold a stem or a threat, each once, from left to right."""
        done = 0
        for end, length in self.finder.iter(text):
            at = end - length + 1
            if at < done or (at and text[at - 1].isalpha()):
                continue  # in a clause that was given, or inside a word
            left = max(text.rfind(m, done, at) for m in CLAUSE_END) + 1
            right = min((i for i in (text.find(m, end) for m in CLAUSE_END) if i >= 0), default=len(text))
            yield text[max(left, done):right]
            done = right

    def events(self, text: str | None) -> np.ndarray:
        """log(1 + weight of the matched events) by kind, of the whole text; zeros for null and blank."""
        total = dict.fromkeys(EVENTS, 0.0)
        for clause in self.clauses((text or "").lower()):
            tags = [self.lexicon.classify(w) for w in WORD.findall(clause)]
            for marks, (_, weight) in zip(self.grammar.run([c for c, _ in tags]), tags):
                for m in marks:
                    total[m] += weight
        return np.log1p([max(0.0, total[e]) for e in EVENTS])


def _choose(found: dict, keep: float) -> dict[str, tuple[float, bool]]:
    """Stems by falling significance, none a prefix of another; see :func:`learn_lexicon`."""
    stems: dict[str, tuple[float, bool]] = {}
    taken: set[str] = set()  # chosen stems and their prefixes
    for s in sorted((s for s in found if not s.endswith("$")), key=lambda s: (-found[s].g2, len(s), s)):
        if s in taken or any(s[:n] in stems for n in range(3, len(s))):
            continue
        while True:
            longer = [t for t in found if len(t) == len(s) + 1 and t.startswith(s) and not t.endswith("$") and found[t].bad >= keep * found[s].bad]
            if not longer:
                break
            s = longer[0]
        whole = s + "$" in found and found[s + "$"].bad >= keep * found[s].bad
        stems[s] = (float(min(found[s].weight, 6.0)), whole)
        taken.update(s[:n] for n in range(3, len(s) + 1))
    return stems


def learn_lexicon(rows: DataFrame, min_g2: float = 24.0, min_ratio: float = 8.0, keep: float = 0.95, word_rows: int = 10) -> Lexicon:
    """Insult stems from ``(label, text)`` rows.

    Copies would make all of their words look toxic, so of rows that share any of four MinHashes
    of word triples one stays.  A stem (3 letters or more) qualifies by the G-statistic of its rows
    and by the ratio of its smoothed shares.  Of stems that contain one another the most significant is
    taken, lengthened while ``keep`` of its support stays; if that makes a word, it matches whole words only.  A whole word
    of a stem's family that ``word_rows`` rows hold has its own weight, which may be below zero.
    """
    schema = "label int, words array<string>, m1 long, m2 long, m3 long, m4 long"
    seeds = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for b in it:
            out = []
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = re.findall(r"[^\W\d_]+", (text or "").lower())
                if not words:
                    continue
                g = np.array([xxhash.xxh64_intdigest(" ".join(words[i:i + 3])) for i in range(max(1, len(words) - 2))], dtype=np.uint64)
                low = [int(((g ^ s) * s).min()) >> 1 for s in seeds]
                out.append({"label": label, "words": sorted({w[:24] for w in words if len(w) > 2}), **{f"m{i + 1}": v for i, v in enumerate(low)}})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                [("label", pa.int32()), ("words", pa.list_(pa.string())), *((f"m{i}", pa.int64()) for i in range(1, 5))]))

    docs = rows.select("label", "text").mapInArrow(run, schema)
    for m in ("m1", "m2", "m3", "m4"):
        docs = docs.dropDuplicates(["label", m])
    docs = docs.select("label", "words").persist()  # at most 2 * per_class rows; recomputed if lost
    try:
        n = {r.label: r.n for r in docs.groupBy("label").agg(F.count("*").alias("n")).collect()}
        bad, good = n.get(1, 0), n.get(0, 0)
        stem = F.explode(F.array_distinct(F.flatten(F.transform("words", lambda w: F.concat(
            F.transform(F.sequence(F.lit(3), F.length(w)), lambda k: F.substring(w, F.lit(1), k)), F.array(F.concat(w, F.lit("$"))))))))
        x, y = F.col("bad"), F.col("good")
        share = (x + y) / F.lit(float(max(1, bad + good)))
        g2 = 2 * (x * F.log(x / (share * bad)) + F.when(y > 0, y * F.log(y / (share * good))).otherwise(0.0))
        ratio = ((x + 0.5) / (bad + 1)) / ((y + 0.5) / (good + 1))
        counts = (docs.select("label", stem.alias("stem")).groupBy("stem")
                  .agg(F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") == 0).alias("good")))
        found = {r.stem: r for r in counts.where((x > 0) & (g2 >= min_g2) & (ratio >= min_ratio))
                 .select("stem", "bad", g2.alias("g2"), F.log(ratio).alias("weight")).collect()}
        stems = _choose(found, keep)
        families = [s for s, (_, whole) in stems.items() if not whole]
        words = [] if not families else (counts.where(F.col("stem").endswith("$") & (x + y >= word_rows) & F.col("stem").rlike(
            "^(" + "|".join(map(re.escape, families)) + ")")).select("stem", F.log(ratio).alias("weight")).collect())
    finally:
        docs.unpersist()
    for r in words:
        w = r.stem[:-1]
        if w not in stems:
            stems[w] = (float(min(r.weight, 6.0)), True)
    return Lexicon(stems)


# ---- model --------------------------------------------------------------------------------------

class ToxicityModel:
    def __init__(self, lexicon: Lexicon, w: np.ndarray, bias: float):
        self.lexicon, self.w, self.bias = lexicon, w, bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.w + self.bias, -40, 40)))


def fit_events(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50, weights: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression around the prior weights (Newton steps); a row counts ``weights`` times (once by default)."""
    k = np.ones(len(x)) if weights is None else weights
    prior = np.append(PRIOR, PRIOR_BIAS)
    w = prior.copy()

    def loss(v):
        m = z @ v
        return (k * (np.logaddexp(0, m) - y * m)).sum() + ridge / 2 * ((v - prior) ** 2).sum()
    z = np.column_stack([x, np.ones(len(x))]) if len(x) else np.zeros((0, len(prior)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        grad = z.T @ (k * (y - p)) - ridge * (w - prior)
        hess = (z * (k * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def event_rows(docs: DataFrame, lexicon: Lexicon, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``x``, the event weights of the whole text, row by row."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for b in it:
            x = pa.array([matcher.events(t.as_py()) for t in b.column(b.num_columns - 1)], type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], x], [*keep, "x"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, f"{schema}, x array<double>")


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                 per_class: int = 4000) -> ToxicityModel:
    """Fit on at most ``per_class`` training rows of each label (those with the smallest id hashes); in the event
    weights and the bias each class has the weight of all its training rows."""
    rows = labelled_sample(docs, labels, id_col, text_col, label_col, per_class).persist()
    try:
        lexicon = learn_lexicon(rows)
        got = event_rows(rows, lexicon, ["label"]).collect()
    finally:
        rows.unpersist()
    x = np.array([r.x for r in got]).reshape(-1, len(EVENTS))
    y = np.array([r.label for r in got], dtype=int)
    return ToxicityModel(lexicon, *fit_events(x, y.astype(float), weights=class_weights(labels, id_col, label_col, per_class)[y]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, score, predicted)`` of every row; null and blank texts have no events."""
    text = F.col(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.lexicon)
        for b in it:
            if b.num_rows:
                s = model.score(np.array([matcher.events(t.as_py()) for t in b.column(2)]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32))],
                                                 ["doc_id", "text_hash", "score", "predicted"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
            .mapInArrow(run, "doc_id long, text_hash long, score double, predicted int"))


def reject_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that the model predicts 1 for."""
    def keep():
        matcher = Matcher(model.lexicon)
        return lambda texts: model.score(np.array([matcher.events(t) for t in texts])) < CUT
    return filter_rows(docs, text_col, keep)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, learning from ``labels.toxic`` of ids whose crc32 modulo 5 is not 0.

    Null, empty and wordless texts have no events; long texts are read whole; equal texts have equal scores; an id that the labels
    repeat counts once, with its larger label; null ids never train; without labels the prior weights score; an empty table
    gives no rows; other columns of either table, whatever their names, are not read.
    """
    docs = read(spark, sf_dir, "documents")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", (~training_row(F.col("doc_id"), 5, 0)).alias("held_out"), "score", "predicted")
