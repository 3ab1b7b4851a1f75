"""The training-data operators on small fixtures: odd rows, brute force, exact round trips."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, language_id, minhash, pii, quality_model, quality_rules, sentencepiece_codec, token_files, toxicity, url_filter
from tidewell.llm.queries import tokenizer_path

ODD = [None, "", " ", "a", "a  b", "▁x ▁▁ y", "\ta\n b ", "é　 ﬁ", "x" * 30_000, "a\x00b", "word " * 3000, "<|endoftext|> it's", "1.2.3.4 a@b.c", "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_sentencepiece_equals_the_library(docs, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    path = tokenizer_path("piece_bpe_32k.model")
    got, digests = rows(sentencepiece_codec.encode_documents(docs, path)), rows(sentencepiece_codec.digest_documents(docs, path))
    for i, t in enumerate(ODD):
        ids = model.encode(t or "", add_eos=True)
        assert got[i].ids == ids and got[i].decoded == model.decode(ids)
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.digest_documents(none, path).count() == 0


def test_token_files_round_trip(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    token_files.write_token_files(docs, str(tmp_path / "t"), path, 0, files=3)
    got, start = rows(token_files.token_index(spark, str(tmp_path / "t"))), 0
    for i, t in enumerate(ODD):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.index_documents(none, path, 0).count() == 0


def test_contamination_by_hand(spark, docs, none):
    items = spark.createDataFrame([(1, "Same"), (10, "same!"), (2, None), (3, "word " * 13)], "item_id long, text string")
    got = rows(decontaminate.report(docs, items))
    assert got[13].n_hit == 1 and got[13].contaminated and got[13].items_sha256 == hashlib.sha256(b"1,10").hexdigest()
    assert (got[10].n_words, got[10].n_hit, got[10].n_items) == (3000, 3000, 1)
    assert got[0].n_words == 0 and not got[0].contaminated
    assert decontaminate.report(none, items).count() == 0 and decontaminate.report(docs, items.limit(0)).where("contaminated").count() == 0
    spans = rows(decontaminate.find_items(docs, items))[13].chars
    assert [(s.start, s.end) for s in spans] == [(0, 4)]


def test_blocks_of_items_give_the_same(docs, spark, monkeypatch):
    items = spark.createDataFrame([(1, "Same"), (3, "word " * 13), (4, "a b")], "item_id long, text string")
    whole = sorted(decontaminate.report(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 3)
    assert sorted(decontaminate.report(docs, items).collect()) == whole


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for _ in texts:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    root[i] = root[j] = min(root[i], root[j])
    return [len(s) for s in sets], root


def test_near_duplicates_equal_brute_force(spark, docs, none):
    rng = np.random.default_rng(1)
    base = [[f"w{x}" for x in rng.integers(0, 500, 120)] for _ in range(6)]
    texts = [*ODD]
    for words in base:
        for k in range(12):
            edited = [("e%d" % rng.integers(1000)) if rng.random() < 0.004 * k else w for w in words]
            texts.append(" ".join(edited))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes, roots = brute_components(texts)
    got = rows(minhash.near_duplicates(df))
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == list(zip(sizes, roots))
    assert minhash.near_duplicates(none).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31)], "a long, b long")
    got = rows(minhash.connected_components(edges), "node")
    assert all(got[i].component == 0 for i in range(1, 21)) and got[31].component == 30


def test_rule_counts_by_hand(docs, none):
    got = rows(quality_rules.judge(docs))
    assert (got[10].n_words, got[10].n_repeat_words, got[10].base_failed, got[10].kept) == (3000, 3000, True, False)
    assert (got[0].n_words, got[0].word_chars, got[0].n_dup_lines) == (0, 0, 0)
    assert quality_rules.judge(none).count() == 0


def test_personal_data_by_hand(spark, docs, none):
    text = "é a@b.c_d@e.fg 1.2.3.4 300.1.1.1 x 4111 1111 1111 1111 x +1 (555) 555-0100 token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\""
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y")], "doc_id long, text string, base string")
    got = rows(pii.detect(df))
    assert [(s.kind, text[s.start : s.end]) for s in got[1].base] == [
        ("email", "a@b.c"), ("email", "_d@e.fg"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 555-0100"),
    ]
    masked = rows(pii.redact(df.drop("base")))
    assert masked[1].text.startswith("é <EMAIL><EMAIL> <IP> 300.1.1.1 x <CARD> x <PHONE>") and masked[2].text is None
    assert pii.detect(none).count() == 0


def test_quality_and_toxicity_learn(spark, none):
    good = [(i, f"the quiet river {i} ran past old stones and green fields", 1, 0) for i in range(40)]
    bad = [(100 + i, "BUY!! BUY!! NOW!! NOW!! ### $$$ idiot scum", 0, 1) for i in range(40)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int, toxic int")
    docs, labels = df.select("doc_id", "text"), df.where("doc_id % 2 = 0").select("doc_id", "quality", "toxic")
    tox = rows(toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))))
    assert tox[1].score < 0.5 < tox[101].score
    assert toxicity.keep_clean(df, toxicity.fit(docs, labels, F.lit(True))).count() == 40
    featured = quality_model.featurize(docs)
    qual = rows(quality_model.score(featured, quality_model.fit(featured, labels, F.lit(True))))
    assert qual[101].score < qual[1].score
    empty = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert toxicity.score(none, empty).count() == 0


def test_languages(spark, docs, none):
    train = spark.createDataFrame([(1, "the and of this that with", "en"), (2, "der die das und nicht", "de"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string")
    profiles = language_id.fit(train, F.lit(True))
    got = rows(language_id.identify(train, profiles))
    assert (got[1].lang_pred, got[2].lang_pred, got[3].lang_pred) == ("en", "de", "und")
    assert rows(language_id.identify(docs, profiles))[1].lang_pred == "und"
    assert language_id.identify(none, profiles).count() == 0


def test_url_rules(spark):
    urls = [None, "nothing", "http://A.example.com/en/x?q=/y", "https://www.example.com/en/", "http://x.net/es/1", "http://com", "http://free-bets.example.org/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = rows(url_filter.judge(df, url_filter.fit(url_filter.labelled_urls(spark)), url_filter.RULES, ["page_id"]), "page_id")
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(6)] == [
        ("", "", None), ("", "", None), ("a.example.com", "/en/x", "example.com/en/"),
        ("www.example.com", "/en/", "www.example.com/en/"), ("x.net", "/es/1", "net/es/"), ("com", "", None),
    ]
    assert got[6].verdict == "block" and got[3].verdict == "allow"
