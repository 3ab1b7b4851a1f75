"""Operator 4: toxicity by a weighted finite-state grammar over clauses.

Five weighted transducers read the classes of the words and marks of a line, one after another: insults
that pile up, threats that reach a person, insults that are addressed to a target, negation, and reported
speech. Each passes on a class for each that it reads, with a weight; `compose` makes one transducer of
two, whose states are pairs and whose weights are the products. Two more read what the five wrote from
the right, composed likewise: negation that follows (a verb-final `nicht`), and a verb of saying after a
quote. What is written for an insult or a threat is a finding, and its weight is a product of named
factors (PRIOR), kept as their exponents so that the factors can be learned.

Commas, colons, brackets, quote marks and sentence ends part clauses: piling, reach and negation begin
anew there. Reported speech goes on over them: from a verb of saying to the end of its clause, and
through a quote that it opens or closes, over sentences, to the other quote mark or the line's end.
Negated verbs of opinion (`don't think`) reach further. A threat's target is a person: possessives count
only before one (`your mother`), so `weeds in your garden` is none.

The lexicon of insults is learned from labelled documents: words and word beginnings that occur in far
more toxic documents than clean ones, weighted by log odds. A clause scores the sum of its findings,
each lexicon weight times context weight. A logistic regression turns a text's clause scores into a
probability; its weights and the factors are fitted together, the factors held near PRIOR where
labelled documents say nothing of them.

Learning takes at most MAX_ROWS labelled documents of either label (a documented bound); counts of
lexicon entries are summed by Spark. Every text is scored whole. Null and empty texts have no clause
and get the score of a text without findings. Without labels the lexicon is empty and all texts score
alike. Rows that repeat are scored each on their own; a doc_id with several labels counts as toxic if
one of them is. An empty table gives no rows. Other columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, texts
from .learn import Scale, fit_logistic, labelled_sample, sigmoid

#: Labelled documents of either label to learn from; lengths of word beginnings; words that a task keeps.
MAX_ROWS, STEMS, MAX_TABLE = 6_000, range(3, 13), 200_000

# Closed-class words of the grammar, in English, German, French and Spanish.
NEGATIONS = "not never no isn't aren't wasn't don't nicht kein keine nie ne pas jamais non nunca ni".split()
REPORTS = "said says say called calls wrote quoted reported sagte schrieb nannte dit appelé écrit dijo llamó escribió".split()
TARGETS = "you you're they them he she him her du dich sie tu te toi vous ils elle usted ustedes tú ellos".split()
OWNERS = "your their his dein deine ihr euer ton ta votre vos leur su tus vuestro".split()
KIN = """mother mom father dad family kids children wife husband son daughter brother sister mutter vater familie kinder
mère père famille enfants madre padre familia hijos""".split()
OPINIONS = "think believe mean denke glaube finde pense crois creo pienso".split()
LATER = "nicht".split()
# Stems of verbs of threat and the endings that they take, by language.
THREAT_STEMS = {
    "kill murder stab stabb shoot burn beat destroy hurt strangl": " s es e ed ing er",
    "töt schlag schläg verprügel ermord verbrenn": " e en st t et te",
    "tu frapp assassin brûl": "er erai erons ez",
    "mat golpe quem": "ar aré aremos aré ando",
}
THREATS = {stem + ending.strip() for stems, endings in THREAT_STEMS.items() for stem in stems.split() for ending in endings.split(" ")} - set("tu".split())

#: Classes of words and marks, and what a threat becomes: BARE before it has met a person, MENACE when it has.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BARE, MENACE, OWNER, RELATIVE, OPINION, QUOTE, PAUSE, STOP, LINE = range(15)
CLASSES, FINDINGS, PARTS = range(15), {INSULT, BARE, MENACE}, {QUOTE, PAUSE, STOP, LINE}
#: Factors of the context of a finding before learning, and how many documents' worth they are held to.
PRIOR = {"piled": 1.1, "addressed": 1.25, "bare": 0.3, "negated": 0.15, "reported": 0.4}
HOLD, THREAT_WEIGHT, REACH = 20.0, 4.0, 3
FACTORS = list(PRIOR)
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: A word, or marks that part clauses: a quote mark by itself, others as one.
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”„«»]|[.,;:!?|()]+")
QUOTES, STOPS = frozenset("\"“”„«»"), re.compile("[.;!?|]")
N_FEATURES = 4

Weight = tuple[int, ...]
ONE: Weight = (0,) * len(FACTORS)


def factor(name: str) -> Weight:
    """The weight that is one factor: exponent 1 of it, 0 of the others."""
    return tuple(int(f == name) for f in FACTORS)


def times(a: Weight, b: Weight) -> Weight:
    return tuple(x + y for x, y in zip(a, b))


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, class read) to (next state, class written, weight)."""

    start: object
    arcs: dict = field(hash=False)

    def run(self, classes) -> list[tuple[int, Weight]]:
        """What is written for each class read, and its weight."""
        state, out = self.start, []
        for c in classes:
            state, written, weight = self.arcs[state, c]
            out.append((written, weight))
        return out


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that writes what `second` writes on reading what `first` writes."""
    start = (first.start, second.start)
    arcs, todo = {}, [start]
    while todo:
        state = todo.pop()
        for c in CLASSES:
            if (state, c) in arcs or (state[0], c) not in first.arcs:
                continue
            a, middle, one = first.arcs[state[0], c]
            b, written, two = second.arcs[state[1], middle]
            arcs[state, c] = ((a, b), written, times(one, two))
            todo.append((a, b))
    return Transducer(start, arcs)


def _machine(states, step) -> Transducer:
    """A transducer whose arc for (state, class) is step(state, class), or else passes the class on."""
    arcs = {(s, c): step(s, c) for s in states for c in CLASSES}
    return Transducer(states[0], arcs)


def insults() -> Transducer:
    """A further insult in a clause weighs as one that is piled on."""

    def step(some, c):
        return c not in PARTS and (some or c == INSULT), c, factor("piled") if some and c == INSULT else ONE

    return _machine([False, True], step)


def threats(reach: int = REACH) -> Transducer:
    """A threat is bare at first; a person within reach in its clause makes it a menace."""

    def step(state, c):
        left, owned = state
        if c == THREAT:
            return (reach, False), BARE, ONE
        if left and (c == TARGET or c == RELATIVE and owned):
            return (0, False), MENACE, ONE
        left = 0 if c in PARTS else max(left - 1, 0)
        return (left, c == OWNER and left > 0), c, ONE

    return _machine([(n, owned) for n in range(reach + 1) for owned in (False, True)], step)


def targets(reach: int = REACH) -> Transducer:
    """An insult within reach after a target is addressed; threats without a target are weak."""

    def step(left, c):
        if c in (TARGET, OWNER, MENACE):
            return reach, c, ONE
        weight = factor("addressed") if c == INSULT and left else factor("bare") if c == BARE and not left else ONE
        return 0 if c in PARTS else max(left - 1, 0), c, weight

    return _machine(list(range(reach + 1)), step)


def negation(reach: int = REACH) -> Transducer:
    """Findings within reach after a negation in a clause are negated; a negated verb of opinion reaches two words further."""

    def step(left, c):
        if c == NEGATION:
            return reach, c, ONE
        if c == OPINION and left:
            return reach + 2, c, ONE
        return 0 if c in PARTS else max(left - 1, 0), c, factor("negated") if c in FINDINGS and left else ONE

    return _machine(list(range(reach + 3)), step)


def reported_speech() -> Transducer:
    """Findings after a verb of saying are reported: to the end of the clause, or in the quote that it opens."""
    none, just, said, waiting, inside, other_quote, closed, closing, tag = range(9)

    def step(state, c):
        weight = factor("reported") if c in FINDINGS and state in (just, said, tag, inside) else ONE
        if c == LINE:
            return none, c, weight
        if state in (inside, other_quote):
            return closed if c == QUOTE else state, c, weight
        if c == REPORT:  # at the end of a quote the verb belongs to it
            return tag if state in (closed, closing) else just, c, weight
        if c == QUOTE:
            return other_quote if state in (none, closed, closing) else inside, c, weight
        if c == STOP:
            return none, c, weight
        if c == PAUSE:  # right after the verb the clause goes on, else only a quote may follow
            return {just: said, said: waiting, tag: waiting}.get(state, state), c, weight
        return {just: said, tag: said, waiting: none, closed: closing, closing: none}.get(state, state), c, weight

    return _machine(list(range(9)), step)


def later_negation(reach: int = REACH) -> Transducer:
    """Read from the right: findings within reach before a negation that follows, in its clause, are negated."""

    def step(left, c):
        if c == NEGATION:
            return reach, c, ONE
        return 0 if c in PARTS else max(left - 1, 0), c, factor("negated") if c in FINDINGS and left else ONE

    return _machine(list(range(reach + 1)), step)


def later_report(reach: int = 2) -> Transducer:
    """Read from the right: a quote is reported if a verb of saying follows its end within reach."""
    none, inside, other_quote = 0, -1, -2

    def step(state, c):
        weight = factor("reported") if c in FINDINGS and state == inside else ONE
        if c == LINE:
            return none, c, weight
        if state < 0:
            return none if c == QUOTE else state, c, weight
        if c == QUOTE:
            return inside if state else other_quote, c, weight
        if c == REPORT:
            return reach + 1, c, weight
        return 0 if c == STOP else max(state - (c != PAUSE), 0), c, weight

    return _machine([none, *range(1, reach + 2), inside, other_quote], step)


def grammar() -> Transducer:
    """The five transducers composed in order."""
    machine = insults()
    for part in (threats(), targets(), negation(), reported_speech()):
        machine = compose(machine, part)
    return machine


MACHINE, FROM_RIGHT = grammar(), compose(later_negation(), later_report())
_LISTS = ((KIN, RELATIVE), (OPINIONS, OPINION), (OWNERS, OWNER), (THREATS, THREAT), (TARGETS, TARGET), (REPORTS, REPORT), (NEGATIONS, NEGATION))
_CLOSED = {w: c for words, c in _LISTS for w in words}


def read(classes: list[int], later: list[bool]) -> list[tuple[int, Weight]]:
    """What the grammar writes for a line's classes, and its weight; `later`: which negations also act from the right."""
    left = MACHINE.run(classes)
    seen = [OTHER if c == NEGATION and not acts else c for (c, _), acts in zip(left, later)]
    right = FROM_RIGHT.run(reversed(seen))
    return [(c, times(a, b)) for (c, a), (_, b) in zip(left, reversed(right))]


_LETTERS: list[np.ndarray] = []


def spaced(many: list[str]) -> list[str]:
    """Lower-case texts with all but the letters of words as spaces, one more at either end."""
    if not _LETTERS:
        chars = map(chr, range(0x110000))
        _LETTERS.append(np.array([i if c.isalnum() and not c.isdecimal() else 32 for i, c in enumerate(chars)], "<u4"))
    codes = np.frombuffer("".join(many).encode("utf-32-le"), np.uint32)
    mapped, out, at = _LETTERS[0][codes].tobytes().decode("utf-32-le"), [], 0
    for t in many:
        out.append(f" {mapped[at : at + len(t)]} ")
        at += len(t)
    return out


def stems(word: str) -> list[str]:
    """What may stand in the lexicon for a word: the word with an end mark, and its beginnings."""
    return [word + "$", *(word[:n] for n in STEMS if n <= len(word))]


class _Kept(dict):
    """Values of a function by argument, at most MAX_TABLE of them."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= MAX_TABLE:
            self.clear()
        value = self[key] = self.make(key)
        return value


@dataclass
class Grammar:
    """A fitted model: lexicon weights, context factors, scaling and logistic weights of the features."""

    lexicon: dict[str, float]
    factors: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    scale: Scale | None = None
    weights: np.ndarray | None = None

    def __post_init__(self):
        self._heads = {e.rstrip("$")[:3] for e in self.lexicon} | {w[:3] for w in _CLOSED}
        self._words, self._contexts, self._scanner = _Kept(self._classify), {}, None

    def __reduce__(self):
        return Grammar, (self.lexicon, self.factors, self.scale, self.weights)

    def _classify(self, word: str) -> tuple[int, float]:
        """Class of a word or of marks, and the weight in the lexicon."""
        if not word[0].isalpha():
            return (QUOTE if word in QUOTES else STOP if STOPS.search(word) else PAUSE), 0.0
        if word[:3] not in self._heads:
            return OTHER, 0.0
        if word in _CLOSED:
            return _CLOSED[word], THREAT_WEIGHT
        weight = max((self.lexicon.get(s, 0.0) for s in stems(word)), default=0.0)
        return (INSULT, weight) if weight else (OTHER, 0.0)

    def _may_find(self, lows: list[str]) -> list[bool]:
        """Whether lower-case texts have a word that can lead to a finding; one automaton scans for them."""
        if self._scanner is None:
            import ahocorasick

            self._scanner = ahocorasick.Automaton()
            for e in [*self.lexicon, *(w + "$" for w in THREATS)]:
                self._scanner.add_word(" " + re.sub("'.*", "$", e).replace("$", " "), 1)
            self._scanner.make_automaton()
        return [next(self._scanner.iter(t), None) is not None for t in spaced(lows)]

    def findings(self, many: list[str]) -> list[list[tuple[int, float, Weight]]]:
        """(clause, lexicon weight, context weight) of each finding in each text."""
        lows = [t.lower().replace("’", "'") for t in many]
        return [self._findings(t) if may else [] for t, may in zip(lows, self._may_find(lows))]

    def _findings(self, low: str) -> list[tuple[int, float, Weight]]:
        out, clause = [], 0
        for line in low.split("\n"):
            tokens = TOKEN.findall(line)
            classes = [self._words[w] for w in tokens]
            if any(c in (INSULT, THREAT) for c, _ in classes):
                written = read([c for c, _ in classes], [w in LATER for w in tokens])
                for (what, weight), (c, size) in zip(written, classes):
                    clause += c in PARTS
                    if what in FINDINGS:
                        out.append((clause, size if what == INSULT else THREAT_WEIGHT, weight))
            clause += 1
        return out

    def features(self, many: list[str]) -> np.ndarray:
        rows = [
            summary([(k, size * self._times(weight)) for k, size, weight in found], len(t.split()) if found else 0)
            for t, found in zip(many, self.findings(many))
        ]
        return np.array(rows, float).reshape(-1, N_FEATURES)

    def _times(self, weight: Weight) -> float:
        got = self._contexts.get(weight)
        if got is None:
            got = self._contexts[weight] = math.prod(self.factors[f] ** n for f, n in zip(FACTORS, weight))
        return got

    def scores(self, many: list[str]) -> np.ndarray:
        return sigmoid(self.scale(self.features(many)) @ self.weights)


def summary(findings: list[tuple[int, float]], n_words: int) -> tuple[float, ...]:
    """Of clause scores, from (clause, score) of findings: highest, log of the sum, and the sum by the words."""
    if not findings:
        return (0.0,) * N_FEATURES
    clauses: dict[int, float] = {}
    for k, score in findings:
        clauses[k] = clauses.get(k, 0.0) + score
    total = sum(clauses.values())
    return (max(clauses.values()), math.log1p(total), total / math.sqrt(n_words), math.log1p(100 * total / n_words))


def _toxic_counts(batches):
    """Toxic documents that have an entry, summed over a task."""
    seen: Counter = Counter()
    for batch in slices(batches):
        for text in texts(batch):
            seen.update({s for w in set(WORD.findall(text.lower().replace("’", "'"))) for s in stems(w)})
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["entry", "n"])


def _clean_counts(entries: set[str]):
    """Clean documents that have one of the entries, summed over a task."""

    def run(batches):
        known = _Kept(lambda word: [s for s in stems(word) if s in entries])
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in texts(batch):
                seen.update({s for w in set(WORD.findall(text.lower().replace("’", "'"))) for s in known[w]})
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["entry", "n"])

    return run


def learn_lexicon(sample: DataFrame, least_docs: int = 5, least_odds: float = 2.5) -> dict[str, float]:
    """Weights of words (with an end mark) and word beginnings from sample(text, y).

    An entry needs `least_docs` toxic documents and smoothed log odds of `least_odds`. Entries that a
    shorter one outweighs are left out, as a word takes the highest weight of its entries. The sample
    has at most MAX_ROWS documents of either label, which bounds what comes to the driver.
    """
    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    count = lambda f, y: sample.where(F.col("y") == y).select("text").mapInArrow(f, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    toxic = {r.entry: r.n for r in count(_toxic_counts, 1).where(F.col("n") >= least_docs).collect()}
    clean = {r.entry: r.n for r in count(_clean_counts(set(toxic)), 0).collect()}
    odds = {e: math.log((k + 0.5) / (n.get(1, 0) + 1)) - math.log((clean.get(e, 0) + 0.5) / (n.get(0, 0) + 1)) for e, k in toxic.items()}
    strong = {e: min(w, 8.0) for e, w in odds.items() if w >= least_odds}
    shorter = lambda e: (e[:k] for k in STEMS if k < len(e))
    return {e: w for e, w in strong.items() if all(strong.get(s, 0.0) < w for s in shorter(e))}


def fit(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = MAX_ROWS) -> Grammar:
    """Learn the lexicon, the context factors and the regression from labels(doc_id, toxic) where `learn` holds."""
    rows = labelled_sample(docs, labels, "toxic", learn, max_rows).select("text", "y")
    sample = materialize(rows.repartition(docs.sparkSession.sparkContext.defaultParallelism), "toxic-sample")
    model = Grammar(learn_lexicon(sample))
    found = sample.mapInArrow(_found(model), FOUND).toPandas()
    y, n_words = found["y"].to_numpy(float), found["n_words"].to_numpy()
    docs_of = [list(zip(k, s, map(tuple, w))) for k, s, w in zip(found["clause"], found["size"], found["context"])]

    contexts = sorted({w for d in docs_of for _, _, w in d})

    def at(theta: np.ndarray) -> np.ndarray:
        value = {w: math.exp(float(np.dot(w, theta))) for w in contexts}
        x = np.zeros((len(docs_of), N_FEATURES))
        for i, d in enumerate(docs_of):
            if d:
                x[i] = summary([(k, s * value[w]) for k, s, w in d], n_words[i])
        return x

    prior = np.log(list(PRIOR.values()))
    theta = _fit_factors(at, y, prior)
    model = Grammar(model.lexicon, dict(zip(FACTORS, np.exp(theta).tolist())))
    x = at(theta)
    model.scale = Scale(x)
    model.weights = fit_logistic(model.scale(x), y)
    return model


def _fit_factors(at, y: np.ndarray, prior: np.ndarray, rounds: int = 3, step: float = 0.05) -> np.ndarray:
    """Log factors that raise the likelihood of the labels, held to the prior by HOLD documents a unit."""
    if len(y) == 0 or y.min() == y.max():
        return prior

    def loss(theta, scale, weights):
        z = scale(at(theta)) @ weights
        return float(np.logaddexp(0, -z)[y == 1].sum() + np.logaddexp(0, z)[y == 0].sum() + HOLD / 2 * ((theta - prior) ** 2).sum())

    theta = prior.copy()
    for _ in range(rounds):
        x = at(theta)
        scale = Scale(x)
        weights = fit_logistic(scale(x), y)
        mid = loss(theta, scale, weights)
        for k in range(len(theta)):  # a Newton step for each factor from three values
            unit = np.eye(len(theta))[k] * step
            low, high = (loss(theta + s * unit, scale, weights) for s in (-1, 1))
            bend = max((high - 2 * mid + low) / step**2, HOLD)
            move = float(np.clip(-(high - low) / (2 * step) / bend, -0.5, 0.5))
            new = loss(theta + move / step * unit, scale, weights)
            if new < mid:
                theta, mid = theta + move / step * unit, new
    return theta


FOUND = "y int, n_words long, clause array<int>, size array<double>, context array<array<int>>"


def _found(model: Grammar):
    def run(batches):
        for batch in slices(batches):
            many = texts(batch)
            rows = model.findings(many)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    pa.array([len(t.split()) for t in many], pa.int64()),
                    pa.array([[k for k, _, _ in r] for r in rows], pa.list_(pa.int32())),
                    pa.array([[s for _, s, _ in r] for r in rows], pa.list_(pa.float64())),
                    pa.array([[list(w) for _, _, w in r] for r in rows], pa.list_(pa.list_(pa.int32()))),
                ],
                names=["y", "n_words", "clause", "size", "context"],
            )

    return run


def score(docs: DataFrame, model: Grammar) -> DataFrame:
    """doc_id, score: the probability that a document is toxic."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(texts(batch)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Grammar, limit: float = 0.5) -> DataFrame:
    """Rows of docs, with all their columns, that score below `limit`."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches):
            many = [t or "" for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(model.scores(many) < limit))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots would be taken for fields
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
