"""Operator 6: quality rules as weak supervision, with DataFrame functions only.

Rules on counts of a text vote for it, against it, or abstain. Expectation-maximisation over all
documents estimates how far each rule is to be trusted, and a document is kept on its posterior
chance of being good rather than by passing every rule.

Words are runs of other than ASCII white space. Null text has no words. A text of fewer than three
words has no three-word window. Windows are compared by 64-bit hashes of their words within a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import weak_labels
from .common import let, materialize

SPACE = "[ \\t-\\r]+"
_NUMBERS = "cast(array() as array<bigint>)"


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that a text has twice or more, the first time included."""

    def hashes(w):
        places = F.sequence(F.lit(0), F.size(w) - 3)
        return F.when(F.size(w) >= 3, F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(
            F.expr(_NUMBERS)
        )

    def covered(s):
        twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
        step = lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(i, acc["to"])).alias("n"), (i + 3).alias("to"))
        return F.aggregate(places, zero, step, lambda acc: acc["n"])

    def count(h):
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(placed, covered))

    return let(words, lambda w: let(hashes(w), count))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules look at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    without = lambda chars: F.length(text).cast("long") - F.length(F.translate(text, chars, ""))
    from_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_kinds"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )
    from_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
        ),
    )
    got = docs.select(
        "doc_id",
        from_words.alias("w"),
        from_lines.alias("l"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        without("#*$%&|<>").alias("n_symbols"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        without("!?").alias("n_marks"),
        without("|<>").alias("n_bars"),
        without("#*$%&").alias("n_signs"),
        F.length(F.regexp_replace(text, "\\P{L}+", "")).cast("long").alias("n_letters"),
    )
    return got.select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "n_upper", "n_marks", "n_bars", "n_signs", "n_letters")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(stats: DataFrame) -> tuple[DataFrame, list[str]]:
    """Votes of the rules; a rule that has too little to go by abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    mean, symbols = F.col("word_chars") / n, F.col("n_symbols") / n
    repeat, marks = F.col("n_repeat_words") / n, F.col("n_marks") / n
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    upper, letters = F.col("n_upper") / chars, F.col("n_letters") / chars
    lines, dup = F.col("n_lines"), F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    kinds, enough = F.col("n_kinds") / F.sqrt(n), F.col("n_words") >= 20
    rules = [
        _vote(mean.between(3, 9), (mean < 2) | (mean > 14)),
        _vote(symbols < 0.05, symbols > 0.2),
        _vote(F.col("n_bars") / n < 0.05, F.col("n_bars") / n > 0.2),
        _vote(F.col("n_signs") / n < 0.05, F.col("n_signs") / n > 0.2),
        _vote(letters > 0.85, letters < 0.8),
        _vote((lines >= 4) & (dup < 0.1), (lines >= 4) & (dup > 0.3)),
        _vote(enough & (repeat < 0.1), enough & (repeat > 0.25)),
        _vote(upper < 0.15, upper > 0.4),
        _vote(marks < 0.1, marks > 0.4),
        _vote(enough & (kinds > 3), enough & (kinds < 1.5)),
    ]
    names = [f"v{i}" for i in range(len(rules))]
    return stats.withColumns(dict(zip(names, rules))), names


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Counts of each document, base_failed, quality (posterior chance of being good) and kept."""
    stats = materialize(statistics(docs), "rule-counts")
    voted, names = votes(stats)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # documents that fail the base rules are decided already and would only teach the rules their length
    model = weak_labels.fit(voted.where(~failed), names, prior=0.8, begin=weak_labels.FAULTS)
    scored = voted.withColumn("base_failed", failed).withColumn("quality", model.posterior([F.col(v) for v in names]))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
