"""Operator 12 against plain counting over all documents."""

import math
import random
import re
from collections import Counter

import pytest

from tidewell.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    holders = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * holders[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", {"k": 1}) for i, t in docs], "doc_id long, text string, `a.b` string, score map<string,int>").repartition(5)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, rank int")
    return sorted((tuple(r) for r in lexical.rank(d, b).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["ÉTÉ", "naïve", "日本", "X9"]
    pick = lambda m: " ".join(vocabulary[min(int(rng.expovariate(0.03)), len(vocabulary) - 1)] for _ in range(m))
    docs = [(k, pick(rng.choice([1, 5, 30, 200]))) for k in range(n)]
    docs += [(n + k, docs[k % 7][1]) for k in range(60)]  # copies, so that scores tie
    items = [(f"i{k}", pick(rng.choice([1, 3, 12]))) for k in range(25)]
    return docs, items


@pytest.mark.parametrize("bucket, seeds", [(2048, 20_000), (16, 40), (3, 1)])
def test_equal_to_plain_counting(spark, monkeypatch, bucket, seeds):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "SEEDS", seeds)
    docs, items = corpus(bucket)
    assert found(spark, docs, items) == brute(docs, items)


def test_several_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 7)
    docs, items = corpus(5, 120)
    assert found(spark, docs, items) == brute(docs, items)


def test_nulls_repeats_and_empties(spark):
    docs = [(1, None), (2, ""), (None, "Alpha beta"), (None, "alpha"), (4, "alpha-beta"), (4, "ALPHA beta"), (5, "...!"), (6, "gamma " * 5000)]
    items = [("a", "alpha BETA beta"), ("a", "gamma"), (None, "beta"), ("n", None), ("e", "?!"), ("z", "absent")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_bounds_leave_most_documents_unscored():
    """A floor prunes whole buckets by length and documents by coordinate."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    weights = np.array([5000, 10] + [3000] * 50)
    root = np.sqrt(weights.astype(float))
    lists = [[0, *range(2, 6)]] * 5 + [[1, int(rng.integers(2, 52))] for _ in range(995)]
    impacts = [[900_000] * len(x) for x in lists]
    length = np.array([np.sqrt(sum((i * root[t]) ** 2 for t, i in zip(x, y))) for x, y in zip(lists, impacts)])
    order = np.argsort(-length)
    batch = pa.table({"doc_id": order, "length": length[order], "terms": [lists[k] for k in order], "impacts": [impacts[k] for k in order]})
    bucket = lexical.Bucket(batch, root)
    item = lexical.Item({0: 2, 1: 1}, weights, root)
    docs, scores = bucket.candidates(item, 9_000_000_000)
    assert len(docs) == 5 and (scores == 9_000_000_000).all()
    assert bucket.candidates(item, 10**13) is None
