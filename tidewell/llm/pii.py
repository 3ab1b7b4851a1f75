"""Operator 9: personal data by weak supervision, with DataFrame functions only.

Base spans come from four patterns with checks (e-mail, IP address, payment card, phone number).
Further candidates (long tokens, digit groups) are voted on by labelers: patterns, gazetteers of key
prefixes and of context words, quoting, letter-digit mixture, length. Expectation-maximisation over all
candidates estimates the labelers' reliabilities; its posteriors train the final span classifier, a
logistic regression over the shape of a span and its wider surroundings, which the labelers do not
see. The classifier alone decides on the candidates.

Offsets count code points, ends are exclusive. Null text is the empty text. Patterns are written so
that matching takes time in proportion to the text, whatever it holds: a run that may start a match
is entered at its start, or where the match before ended, and repeats never give back characters.

Rows that repeat are searched each on their own. Without candidates there is nothing to learn and
nothing is added. An empty table gives no rows. detect() reads doc_id and text alone; redact() carries
all columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import weak_labels
from .common import let, materialize, quoted

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\\.{_HOST}++)++",
    "ip": "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}",
    "card": "[0-9](?:[ -]?[0-9])++",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]",
}
_TOKEN = "A-Za-z0-9_"
#: Candidates beyond the base patterns: long tokens, and groups of digits.
SECRET = f"(?<![{_TOKEN}])[{_TOKEN}]{{20,}}+"
NUMBER = "(?<![0-9A-Za-z+.])[0-9]{3}[- ][0-9]{2,3}[- ][0-9]{4}(?![0-9A-Za-z])"

# Words that announce secrets or numbers of a person, and prefixes of keys.
SECRET_WORDS = "token|secret|password|passwd|pwd|api[_ -]?key|apikey|access[_ -]?key|bearer|credential|auth"
NUMBER_WORDS = "ssn|social security|phone|tel|mobile|call|fax|passport|account"
KEY_PREFIXES = "sk_|pk_|ghp_|gho_|AKIA|ASIA|xox|glpat|eyJ|AIza"

KINDS = [*PATTERNS, "secret", "number"]
_SPAN = "cast(array() as array<struct<start:int,end:int,text:string>>)"


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of the leftmost non-overlapping matches."""

    def place(hits):
        def step(acc, k):
            start = acc["at"] + F.length(F.get(acc["gaps"], k))
            end = start + F.length(F.get(hits, k))
            span = F.struct(start.alias("start"), end.alias("end"), F.get(hits, k).alias("text"))
            return F.struct(end.alias("at"), acc["gaps"].alias("gaps"), F.concat(acc["spans"], F.array(span)).alias("spans"))

        zero = F.struct(F.lit(0).alias("at"), F.split(text, pattern, -1).alias("gaps"), F.expr(_SPAN).alias("spans"))
        found = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), zero, step, lambda acc: acc["spans"])
        return F.when(F.size(hits) > 0, found).otherwise(F.expr(_SPAN))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def _ip_ok(m: Column) -> Column:
    parts = F.transform(F.split(m, "\\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card_ok(m: Column) -> Column:
    def luhn(d):
        def step(acc, i):
            digit = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
            twice = digit * 2
            return acc + F.when(i % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(digit)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), step) % 10 == 0

    return let(_digits(m), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))


def _phone_ok(m: Column) -> Column:
    return F.length(_digits(m)).between(8, 15)


CHECKS = {"email": lambda m: F.lit(True), "ip": _ip_ok, "card": _card_ok, "phone": _phone_ok}


def _check(kind: str):
    return lambda s: CHECKS[kind](s["text"])


def _named(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def base_spans(text: Column) -> dict[str, Column]:
    """Checked spans of each base kind."""
    return {k: F.filter(_matches(text, p), _check(k)) for k, p in PATTERNS.items()}


def _candidates(text: Column, kind: str, pattern: str) -> Column:
    def add(spans):
        return F.transform(
            spans,
            lambda s: F.struct(
                F.lit(kind).alias("kind"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                s["text"].alias("text"),
                F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24))).alias("before"),
                F.substring(text, s["end"] + 1, F.lit(1)).alias("after"),
            ),
        )

    return add(_matches(text, pattern))


def find(docs: DataFrame) -> DataFrame:
    """docs' columns with base (array of kind, start, end) and candidates that overlap no base span."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = base_spans(text)
    named = [F.transform(spans[k], _named(k)) for k in PATTERNS]
    more = F.concat(_candidates(text, "secret", SECRET), _candidates(text, "number", NUMBER))
    got = docs.withColumn("base", F.concat(*named)).withColumn("candidates", more)
    clear = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    return got.withColumn("candidates", F.filter("candidates", clear))


def _vote(good: Column, bad: Column | bool = False) -> Column:
    return F.when(good, 1).when(F.lit(False) if bad is False else bad, -1).otherwise(0)


def labelers(c: Column) -> list[Column]:
    """Votes on a candidate: 1 personal or secret, -1 not, 0 abstains."""
    text, before = c["text"], c["before"]
    digits, size = F.length(_digits(text)), F.length(text)
    context = before.rlike(f"(?i)(?:{SECRET_WORDS}|{NUMBER_WORDS})[^\\n]{{0,8}}$")
    return [
        _vote(context, ~before.rlike("[A-Za-z]")),
        _vote(text.rlike(f"^(?:{KEY_PREFIXES})") | text.rlike("^[0-9a-f]{32,}$") | text.rlike("^[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}$")),
        _vote(before.rlike("[=:] ?[\"']?$") | c["after"].isin('"', "'"), before.rlike("[A-Za-z]$")),
        _vote((digits * 8 >= size) & (digits < size) | text.rlike("[- ]"), digits * 16 < size),
        _vote(size.between(9, 12) | size.between(32, 64), size > 200),
    ]


def features(c: Column) -> list[Column]:
    """Yes-no features of a span for the final classifier: its shape and its wider surroundings."""
    text, before = c["text"], c["before"]
    size = F.length(text)
    share = lambda chars: (size - F.length(F.translate(F.lower(text), chars, ""))) / size
    return [
        c["kind"] == "number",
        share("0123456789") >= 0.25,
        share("aeiouyàáâäèéêëìíîïòóôöùúûü") >= 0.3,
        F.size(F.array_distinct(F.split(F.lower(text), ""))) <= 17,
        F.size(F.split(text, "[0-9]+")) > 4,
        text.rlike("[a-z]") & text.rlike("[A-Z]"),
        text.rlike("_"),
        text.rlike("[A-Za-z]{8}"),
        text.rlike("(.)\\1{3}"),
        size < 32,
        size > 64,
        before.rlike(f"(?i)(?:{SECRET_WORDS}|{NUMBER_WORDS})"),
        before.rlike("(?:^|\\n)[^\\n]{0,3}$"),
        before.rlike("[^A-Za-z0-9_ \\n]$"),
    ]


class SpanModel:
    """Logistic regression over features(), trained on posteriors; it accepts from one half on."""

    def __init__(self, bias: float, weights: list[float]):
        self.bias, self.weights = bias, weights

    def accepts(self, c: Column) -> Column:
        total = F.lit(self.bias)
        for on, w in zip(features(c), self.weights):
            total = total + F.when(on, w).otherwise(0.0)
        return total >= 0


def fit(candidates: DataFrame, ridge: float = 1.0, rounds: int = 8) -> SpanModel:
    """Train on a column c of candidates: reliabilities first, then the classifier by Newton steps.

    Candidates are counted by the features they show, so a step is an aggregation over those patterns.
    Without candidates the model accepts nothing.
    """
    c = F.col("c")
    names = [f"v{i}" for i in range(len(labelers(c)))]
    on = features(c)
    shown = F.filter(F.array(F.lit(0), *[F.when(f, F.lit(i + 1)) for i, f in enumerate(on)]), lambda i: i.isNotNull())
    rows = candidates.select(shown.alias("f"), *[v.alias(n) for v, n in zip(labelers(c), names)])
    model = weak_labels.fit(rows, names, prior=0.5)
    posterior = model.posterior([F.col(n) for n in names])
    patterns = materialize(rows.groupBy("f").agg(F.count("*").alias("n"), F.sum(posterior).alias("p")), "pii-patterns")
    k = len(on) + 1
    w = np.zeros(k)
    w[0] = -1.0
    for _ in range(rounds):
        z = F.aggregate("f", F.lit(0.0), lambda acc, i: acc + F.get(F.array(*map(F.lit, w.tolist())), i))
        q = 1 / (1 + F.exp(-z))
        scored = patterns.select("f", (F.col("n") * q - F.col("p")).alias("g"), (F.col("n") * q * (1 - q)).alias("h"))
        first = scored.select(F.explode("f").alias("i"), F.lit(-1).alias("j"), F.col("g").alias("v"))
        pairs = scored.select("f", F.explode("f").alias("i"), "h").select("i", F.explode("f").alias("j"), F.col("h").alias("v"))
        grad, bend = ridge * w, ridge * np.eye(k)
        for r in first.unionByName(pairs).groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # k * (k + 1) sums
            if r.j < 0:
                grad[r.i] += r.v
            else:
                bend[r.i, r.j] += r.v
        step = np.linalg.solve(bend, grad)
        w = w - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-4:
            break
    return SpanModel(float(w[0]), w[1:].tolist())


def accepted(found: DataFrame, model: SpanModel) -> DataFrame:
    """Replace candidates by `extra`: the accepted ones as (kind, start, end)."""
    keep = F.filter("candidates", model.accepts)
    extra = F.transform(keep, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return found.withColumn("extra", extra).drop("candidates")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base, extra: the spans of every document."""
    found = materialize(find(docs.select("doc_id", "text")).drop("text"), "pii")
    model = fit(found.select(F.explode("candidates").alias("c")))
    return accepted(found, model)


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of its text replaced by its kind in angle brackets; other columns stay."""
    some = docs.select("text").where(F.col("text").rlike(SECRET) | F.col("text").rlike(NUMBER))  # the others have no candidates
    candidates = materialize(find(some).select(F.explode("candidates").alias("c")), "pii-candidates")
    model = fit(candidates)
    text = F.col("text")
    mark = accepted(find(docs.withColumn("row", F.struct(*[quoted(c) for c in docs.columns])).select("row", "text")), model)
    spans = F.array_sort(F.transform(F.concat("base", "extra"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"))
        inside = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(inside)

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    out = mark.withColumn("clean", F.when(F.size(F.concat("base", "extra")) == 0, text).otherwise(clean))
    return out.select(*[F.col("clean").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, by kind as listed, then start, comma-joined."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["s"].cast("string"), s["e"].cast("string"))), ",")
