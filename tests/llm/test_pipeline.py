"""The pipeline of corpus_pipeline.py: each stage against brute force, odd rows, and the chain."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tidewell.llm.common import table  # noqa: E402
from tidewell.llm.queries import tokenizer_path  # noqa: E402

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
COPY = "a quiet text of more than five words that is here twice"
ROWS = [
    (2, COPY), (2, COPY), (7, COPY), (3, None), (4, ""), (5, "mail me at a@b.org or 10.0.0.1 now"), (6, "long " * 100_000), (8, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "kept": F.lit("clash"), "row": F.lit(1), "a.b": F.lit(2), "more": F.create_map(F.lit("k"), F.lit(1))})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, docs, name):
    got = STAGES[name](spark, docs, SF)
    if name != "sentencepiece":
        assert got.columns == docs.columns and STAGES[name](spark, docs.limit(0), SF).count() == 0
    ids = sorted(r.doc_id for r in got.select("doc_id").collect())
    want = sorted(r[0] for r in ROWS)
    assert ids == ([2, 3, 4, 5, 6, 8] if name == "near_dedup" else want)


def test_near_copies_go_by_their_own_texts(spark):
    """Rows that repeat an id with other texts are judged each by its own; one row of a component stays."""
    one, two, three = "one two three four five six seven", "other words that share nothing at all", "a third text of words that nobody else has"
    rows = [(1, one, 1), (1, two, 2), (1, three, 3), (1, three, 4), (5, one, 5), (7, two, 6), (9, "", 7), (9, None, 8), (9, three, 9), (None, two, 10), (None, "lone words of a row without any id", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(3)
    got = STAGES["near_dedup"](spark, df, SF).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id == 1) == sorted((1, t) for t in (one, two, three))
    assert [r for r in got if r.doc_id in (5, 7)] == [] and sum(r.doc_id == 9 for r in got) == 2
    assert [r.n_chars for r in got if r.doc_id is None] == [11]


def test_near_dedup_by_brute_force(spark):
    """Of the given documents those stay whose component, by all pairs of full sets, has no smaller id."""
    rows = sorted((r.doc_id, r.text) for r in table(spark, SF, "documents").collect())
    words = [re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in words]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= 75 * len(sets[i] | sets[j]) and part[i] != part[j]:
                part = [min(part[i], part[j]) if p in (part[i], part[j]) else p for p in part]
    got = {r.doc_id for r in STAGES["near_dedup"](spark, table(spark, SF, "documents"), SF).collect()}
    assert got == {rows[k][0] for k in range(len(rows)) if part[k] == k}


def test_masking_and_contamination_by_plain_code(spark, docs):
    masked = {r.doc_id: r for r in STAGES["pii"](spark, docs, SF).collect()}
    assert masked[5].text == "mail me at <EMAIL> or <IP> now" and masked[5].n_chars == len(masked[5].text)
    items = [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (r.text or "").lower()) for r in table(spark, SF, "benchmark").collect()]
    tables = table(spark, SF, "documents")
    windows = {tuple(w[i : i + 13]) for w in items for i in range(max(len(w) - 12, 1)) if w}
    kept = set()
    for r in tables.collect():
        w, hit = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")), set()
        for n in {len(x) for x in windows}:
            hit |= {k for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            kept.add(r.doc_id)
    assert {r.doc_id for r in STAGES["decontaminate"](spark, tables, SF).collect()} == kept


def test_the_chain(spark):
    import sentencepiece

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    source = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert 0.5 * len(source) < len(got) <= len(source) and got.keys() <= source.keys()
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    plain = [i for i in got if not re.search("[0-9@]", source[i] or "")]  # nothing to mask
    for i in plain:
        ids = model.encode(source[i] or "", add_eos=True)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert plain
