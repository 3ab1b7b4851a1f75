"""Near-duplicates: rows that repeat an id, odd tables, and recall against all rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import minhash
from tidewell.llm.common import table

A, B = "one two three four five six seven", "other words that share nothing at all"


@pytest.mark.parametrize("order, parts", [((0, 1, 2, 3), 1), ((3, 1, 0, 2), 4)])
def test_one_id_with_several_texts_keeps_its_rows_and_links_them(spark, order, parts):
    rows = [(1, A), (5, B), (5, A), (7, B)]
    docs = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").repartition(parts)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 1, False), (7, 1, False)]


def test_repeated_rows_nulls_and_clashing_columns(spark):
    texts = [(2, A, 9), (2, A, 8), (3, None, 1), (3, "", 1), (4, " \n", 1), (9, A, 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, node long").withColumn("row", F.lit(1)).withColumn("bucket", F.lit("x"))
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(2, 3, 2, True), (2, 3, 2, True), (3, 0, 3, True), (3, 0, 3, True), (4, 0, 4, True), (9, 3, 2, False)]


def test_buckets_of_several_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 999, 90)]
    texts = [" ".join(w if rng.random() > 0.03 * (k % 4) else f"e{rng.integers(99)}" for w in base) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    order = lambda: sorted(tuple(r) for r in minhash.near_duplicates(docs).collect())
    whole = order()
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 500)
    assert order() == whole


def test_recall_of_ids_divisible_by_20_against_all_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = docs.collect()
    component = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    which, hashes = minhash.shingle_hashes([r.text or "" for r in rows])
    sets = [set(h.tolist()) for h in np.split(hashes, np.cumsum(np.bincount(which, minlength=len(rows)))[:-1])]
    found = missed = 0
    for (i, x), (j, y) in itertools.product(enumerate(rows), enumerate(rows)):
        if x.doc_id % 20 == 0 and i != j and sets[i] and 3 * len(sets[j]) <= 4 * len(sets[i]) and 3 * len(sets[i]) <= 4 * len(sets[j]):
            same = len(sets[i] & sets[j])
            if 100 * same >= 75 * (len(sets[i]) + len(sets[j]) - same):
                found += 1
                missed += component[x.doc_id] != component[y.doc_id]
    assert found >= 5 and missed == 0
