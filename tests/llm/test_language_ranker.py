"""The ranker without Spark: ranks of many profiles, and a table of n-grams that is let go between batches."""

import random

import numpy as np

from tidewell.llm import language_id


def some_profiles(rng, languages, top):
    table = language_id.GramTable()
    table.places(language_id.words(["".join(rng.choice("abcdefghij ") for _ in range(20_000))]))
    return {f"l{i:03}": np.array(rng.sample(table.codes.tolist(), top)) for i in range(languages)}


def test_ranks_are_kept_for_grams_of_profiles_alone():
    rng = random.Random(1)
    profiles = some_profiles(rng, 150, 200)
    ranker = language_id.Ranker(profiles, 200)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(3000)) for _ in range(20)]
    got = ranker.predict(texts)
    assert ranker.place.dtype == np.int16 and ranker.place.shape == (150, len({int(g) for p in profiles.values() for g in p}) + 1)
    assert len(ranker.column) == len(ranker.table.codes) > ranker.place.shape[1]
    for text, lang, score in zip(texts, *got):
        table = language_id.GramTable()
        grams = table.of(table.places(language_id.words([text])))
        codes, times = np.unique(table.codes[grams], return_counts=True)
        mine = [int(c) for c, _ in sorted(zip(codes, times), key=lambda x: (-x[1], x[0]))][:200]
        far = {k: sum(abs(p.tolist().index(g) - i) if g in set(p.tolist()) else 200 for i, g in enumerate(mine)) for k, p in profiles.items()}
        assert lang == min(sorted(far), key=far.get) and abs(score - max(0, 1 - far[lang] / (len(mine) * 200))) < 1e-12


def test_a_table_let_go_between_batches_changes_nothing(monkeypatch):
    rng = random.Random(2)
    profiles = some_profiles(rng, 5, 100)
    batches = [["".join(rng.choice("abcdefghijxyz ") for _ in range(rng.randrange(300))) for _ in range(8)] + [""] for _ in range(6)]
    whole = language_id.Ranker(profiles)
    expected = [whole.predict(b) for b in batches]
    monkeypatch.setattr(language_id, "MAX_WORDS", 20)
    small = language_id.Ranker(profiles)
    for batch, (langs, scores) in zip(batches, expected):
        got = small.predict(batch)
        assert got[0] == langs and (got[1] == scores).all()


def test_grams_come_in_batch_by_batch():
    profiles = {"a": np.array([ord("a"), ord("b")]), "z": np.array([ord("z")])}
    ranker = language_id.Ranker(profiles, 2)
    assert ranker.predict(["aab", "zz"])[0] == ["a", "z"]
    assert ranker.predict(["qqq zzzz", "", "ba"])[0] == ["z", "und", "a"]
    assert language_id.Ranker({}).predict(["a", ""])[0] == ["und", "und"]
