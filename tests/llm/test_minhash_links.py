import numpy as np
import pytest

from tidewell.llm import minhash


@pytest.mark.parametrize("seed", [4446, 6466])
def test_pair_at_the_threshold_with_unlike_signatures_is_linked(spark, seed):
    words = [f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**9, 68)]
    texts = [" ".join(words[:60]), " ".join(words[:52] + words[60:])]  # 48 of 64 shingles: 0.75, but 164 of 250 equal bytes
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == [(1, 56, 1, True), (2, 56, 1, False)]
