"""The toxicity grammar: each transducer, the composition, what a state changes, and held-out labels."""

import pytest
from pyspark.sql import functions as F

from tidewell.llm import toxicity as T
from tidewell.llm.common import fold, table


def classes(words):
    names = {"x": T.OTHER, "idiot": T.INSULT, "hurt": T.THREAT, "you": T.TARGET, "not": T.NEGATION, "said": T.REPORT}
    return [names[w] for w in words.split()]


def weight(words):
    """Products of the factors of the findings of one clause."""
    out = []
    for written, w in T.MACHINE.run(classes(words)):
        if written in T.FINDINGS:
            value = 1.0
            for f, n in zip(T.FACTORS, w):
                value *= T.PRIOR[f] ** n
            out.append(round(value, 6))
    return out


def test_composition_equals_the_transducers_one_after_another():
    parts = [T.insults(), T.threats(), T.targets(), T.negation(), T.reported_speech()]
    for words in ("you x not idiot said idiot", "hurt x you idiot idiot", "x x x x", "not hurt x x x x you said hurt you"):
        line, total = classes(words), [T.ONE] * len(words.split())
        for part in parts:
            got = part.run(line)
            line, total = [c for c, _ in got], [T.times(a, w) for a, (_, w) in zip(total, got)]
        assert T.MACHINE.run(classes(words)) == list(zip(line, total))
    assert isinstance(T.MACHINE.start, tuple) and len({s for s, _ in T.MACHINE.arcs}) > 16


@pytest.mark.parametrize("words, found", [
    ("idiot", [1.0]), ("you x idiot", [1.25]), ("you x x x x idiot", [1.0]), ("x not x idiot", [0.15]), ("not x x x x idiot", [1.0]),
    ("said x idiot", [0.4]), ("said you not idiot", [0.075]), ("idiot idiot", [1.0, 1.1]), ("hurt x x x x", [0.3]), ("hurt you", [0.3, 1.0]), ("x you x", []),
])
def test_what_states_change(words, found):
    assert weight(words) == pytest.approx(found)


@pytest.mark.parametrize("text, found", [
    ('He said: "you are an idiot".', [5 * 1.25 * 0.4]), ('"You are an idiot," he said', [5 * 1.25 * 0.4]), ("“Go. You idiot. Go,” she wrote", [5 * 1.25 * 0.4]),
    ('He said "hello". You idiot', [5 * 1.25]), ('"hello" he said, you idiot', [5 * 1.25]), ('"You are an idiot" and "no"', [5 * 1.25]),
    ("du bist ein idiot nicht", [5 * 1.25 * 0.15]), ("ein idiot, nicht du", [5.0]), ("I don't think you are an idiot", [5 * 1.25 * 0.15]),
    ("I don’t think you are an idiot", [5 * 1.25 * 0.15]), ("you are not, idiot", [5.0]), ("he kills you", [4 * 1.0, 4.0]), ("killing you all", [4 * 0.3, 4.0]),
    ("they will murder you", [4 * 1.0, 4.0]), ("how to kill weeds in your garden", [4 * 0.3]), ("I will kill your mother", [4 * 0.3, 4.0]),
    ("said, in short, idiot", [5.0]), ('he said to her, "idiot', [5 * 0.4]), ('he said "one\nidiot', [5.0]), ("", []), ('"""', []), ("idiot", [5.0]),
])
def test_findings_of_texts(text, found):
    model = T.Grammar({"idiot$": 5.0})
    assert [size * model._times(weight) for _, size, weight in model.findings([text])[0]] == pytest.approx(found)


def test_reading_from_the_right_equals_its_parts():
    for words in ("you x not idiot said idiot", "hurt x you idiot not idiot", "idiot x said idiot not"):
        line = classes(words)[::-1]
        first = T.later_negation().run(line)
        second = T.later_report().run([c for c, _ in first])
        assert T.FROM_RIGHT.run(line) == [(c, T.times(a, b)) for (_, a), (c, b) in zip(first, second)]


def test_clauses_are_judged_apart_and_predictions_follow_the_states(spark):
    toxic = [(i, f"the meeting {i} went badly you idiot", 1) for i in range(40)]
    clean = [(100 + i, f"the meeting {i} went well and all were content", 0) for i in range(60)]
    cases = {
        500: "the meeting went badly you idiot", 501: "he is not an idiot at all", 502: "they said he was no idiot", 503: "not now, idiot",
        504: "I will hurt you", 505: "the shoes hurt", 506: None, 507: "", 508: "idiot " + "word " * 200_000,
    }
    df = spark.createDataFrame(toxic + clean + [(k, t, None) for k, t in cases.items()], "doc_id long, text string, toxic int")
    docs = df.select("doc_id", "text", F.lit("x").alias("score"), F.lit(1).alias("y"))
    model = T.fit(docs, df.select("doc_id", "toxic").where("toxic is not null"), F.lit(True))
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    assert got[500] > 0.5 > got[501] > got[502] and got[503] > 0.5
    assert got[504] > got[505] and got[506] == got[507] < 0.5
    ignored = T.Grammar(model.lexicon, dict.fromkeys(T.FACTORS, 1.0), model.scale, model.weights)
    assert ignored.scores([cases[501]])[0] > 0.5  # the same model without its states
    assert {r.doc_id for r in T.keep_clean(docs, model).where("doc_id >= 500").collect()} >= {501, 502, 506, 507}
    assert T.score(docs.where("doc_id < 0"), model).count() == 0


def test_repeated_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "you scum"), (1, "you scum"), (2, "fine")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, toxic int")
    assert len({r.score for r in T.score(docs, T.fit(docs, labels.limit(0), F.lit(True))).collect()}) == 1
    assert T.score(docs, T.fit(docs, labels, F.lit(True))).count() == 3


def test_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = T.fit(docs, labels, fold(F.col("doc_id"), 5) != 0)
    held = T.score(docs, model).join(labels.where(fold(F.col("doc_id"), 5) == 0), "doc_id").select("score", "toxic").collect()
    assert len(held) > 50 and sum((r.score >= 0.5) == (r.toxic == 1) for r in held) >= 0.95 * len(held)
