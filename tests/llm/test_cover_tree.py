"""Operator 11 against all pairs, on mixtures of clusters, copies and scattered vectors."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.llm import cover_tree
from tidewell.llm.common import table
from tidewell.llm.queries import QUERIES


def brute(rows, cosine=0.9):
    """(id, n_links, component, kept) by all pairs."""
    good = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for (_, v), g in zip(rows, good)]
    part, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = part[i], part[j]
                part = [b if p == a else p for p in part]
    out = []
    for i, (name, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if part[k] == part[i] and rows[k][0] is not None]
        component = min(ids, default=None)
        out.append((name, links[i], component, name == component))
    return sorted(out, key=str)


def found(spark, rows, kind="float", **more):
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], f"vec_id long, embedding array<{kind}>, `a.label` int")
    return sorted((tuple(r) for r in cover_tree.near_vectors(df, **more).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def mixture(n=500, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(6, dim))
    vectors = [*rng.normal(size=(n // 5, dim))]
    for spread in (0.02, 0.1, 0.2, 0.3):
        for c in at:
            vectors += [*(c / np.linalg.norm(c) + rng.normal(size=(n // 30, dim)) * spread)]
    vectors += vectors[:40] + [3 * v for v in vectors[200:220]]
    return [(int(i), np.float32(v).tolist()) for i, v in enumerate(vectors)]


def test_equal_to_all_pairs(spark):
    rows = mixture()
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("block, stream, leaf", [(64, 1, 8), (20, 2, 4)])
def test_many_cells_blocks_and_streams(spark, monkeypatch, block, stream, leaf):
    """Small limits, so that cells, blocks, streams and trees of several levels all come up."""
    for name, value in (("BLOCK", block), ("STREAM", stream), ("SHAPE", (leaf, 4, 3))):
        monkeypatch.setattr(cover_tree, name, value)
    rows = mixture(400, 5, 11)
    assert found(spark, rows) == brute(rows)


def test_a_dense_ball_of_unlike_vectors_is_linked_by_bounds(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 32)
    rng = np.random.default_rng(5)
    ball = np.eye(1, 8) + rng.normal(size=(200, 8)) * 0.01
    rows = [(int(i), np.float32(v).tolist()) for i, v in enumerate(np.concatenate([ball, rng.normal(size=(30, 8))]))]
    assert found(spark, rows) == brute(rows)


def test_products_are_made_for_few_of_the_pairs_of_a_ball():
    """The traversal links a dense ball and prunes far ones without looking at pairs."""
    rng = np.random.default_rng(5)
    at = np.eye(3, 16).repeat(400, 0) + rng.normal(size=(1200, 16)) * 0.005
    x = at / np.linalg.norm(at, axis=1, keepdims=True)
    block = cover_tree.Block(np.arange(1200), np.ones(1200, np.int64), x, 0.9)
    seen = []
    block._linked = lambda a, b, f=block._linked: (seen.append(len(a) * len(b)), f(a, b))[1]
    block.meet()
    assert sum(seen) < 1200 * 1200 / 20 and set(block.counts) == {400}


def test_nulls_zeros_lengths_and_repeated_ids(spark):
    rows = [
        (5, [1.0, 0.0]), (5, [2.0, 0.1]), (None, [1.0, 0.01]), (None, [0.0, -1.0]), (7, None), (8, []), (9, [0.0, 0.0]), (10, [None, 1.0]),
        (11, [float("nan"), 1.0]), (12, [float("inf"), 1.0]), (13, [1.0, 0.0, 0.0]), (14, [1.0, 0.0, 0.0]), (15, [-1.0, 0.0]), (3, [1.0, 0.0]),
    ]
    got = found(spark, rows)
    want = [(i, n, c, True if i is None and c is None else k) for i, n, c, k in brute(rows)]
    assert got == sorted(want, key=str)
    assert found(spark, []) == []


def test_double_components_near_the_threshold(spark):
    """Cosines a hair above and below 0.9, and components far beyond what squares can hold."""
    side = lambda c: [c, (1 - c * c) ** 0.5]
    rows = [(1, [1.0, 0.0]), (2, side(0.9 + 1e-12)), (3, [1e200, -2.2e199]), (4, side(-0.9 + 1e-12)), (5, [-1e-200, 0.0])]
    got = {r[0]: r[1] for r in found(spark, rows, "double")}
    assert got == {1: 2, 2: 1, 3: 1, 4: 0, 5: 0}


def test_the_query_equals_all_pairs_of_the_given_table(spark):
    """Every vector of the smallest table."""
    sf = "/root/testdata/sf0.001"
    pdf = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>")).toPandas()
    x = np.stack(pdf["embedding"])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.9).sum(1) - 1
    got = QUERIES["op11_cover_tree"](spark, sf).toPandas().set_index("vec_id")
    assert got["n_links"].reindex(pdf["vec_id"]).tolist() == links.tolist()
    assert isinstance(pdf, pd.DataFrame) and len(got) == len(pdf)
