"""Operator 13 against plain cuts, and the index against all its boundaries."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import fill_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXT = st.text(alphabet="ab<PSM> \t\n\x0b\x1c\xa0é日😀", max_size=60)


def plain(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_boundaries_and_index(many):
    offsets, first = fill_middle.boundaries(many)
    for error in (0, 1, 127):
        index = fill_middle.RankIndex(offsets, first, error)
        assert np.abs(index.residuals).max() <= error
        for k, text in enumerate(many):
            want = np.cumsum([0, *map(len, TOKEN.findall(text))]).tolist()
            assert offsets[first[k] : first[k + 1]].tolist() == want
            ranks = np.arange(len(want))
            assert index.cut(np.full(len(want), k), ranks).tolist() == want


def test_a_long_text_needs_few_segments():
    rng = random.Random(2)
    text = " ".join("x" * rng.randint(1, 12) for _ in range(200_000)) + " " * 5000 + "y" * 90_000 + " end"
    offsets, first = fill_middle.boundaries([text])
    index = fill_middle.RankIndex(offsets, first)
    assert len(index.at) < len(offsets) / 20 and np.abs(index.residuals.astype(int)).max() <= fill_middle.ERROR
    assert (index.cut(np.zeros(len(offsets), int), np.arange(len(offsets))) == offsets).all()


def test_transform_and_restore(spark):
    rng = random.Random(4)
    bits = ["word", "été", "日本語", "😀", " ", "\n\n", "\t", "<P>", "<S", "P>", "x" * 400]
    docs = [(k, " ".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 3, 40, 3000])))) for k in range(300)]
    docs += [(1, "again again"), (1, "again again"), (None, "no id at all"), (301, None), (302, ""), (303, "  \n"), (304, "q" * 1_000_000)]
    df = spark.createDataFrame([(i, t, 0, {"a": 1}) for i, t in docs], "doc_id long, text string, `n.n` int, form map<string,int>")
    got = [tuple(r) for r in fill_middle.transform(df).collect()]
    assert sorted(got, key=str) == sorted((plain(*d) for d in docs), key=str)
    assert {"plain", "psm", "spm"} == {g[2] for g in got}
    digests = fill_middle.digest_documents(df).collect()
    assert sorted(r.restored_sha256 for r in digests) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in docs)
    assert fill_middle.transform(df.limit(0)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.integers(-5, 10**12), TEXT)
def test_every_output_gives_its_text_back(doc_id, text):
    _, _, form, _, _, output = plain(doc_id, text)
    assert fill_middle.restore(output, form) == text
