"""The table of words that a worker process keeps between tasks."""

import os
import shutil

import public_tokenizers
import pytest

from tidewell.llm import token_files


def test_kept_for_the_file_as_it_was_read(tmp_path):
    path = str(tmp_path / "t.json")
    shutil.copy(public_tokenizers.path("byte_bpe_50k.json"), path)
    first = token_files.word_table(path)
    first.encode(["some words"])
    assert token_files.word_table(path) is first and len(first.places) == 2
    os.utime(path, ns=(1, 1))
    assert token_files.word_table(path) is not first


def test_a_fault_leaves_no_word_without_ids(monkeypatch):
    table = token_files.WordTable(public_tokenizers.path("byte_bpe_50k.json"))
    want = table.encode(["some new words"])[0].tolist()
    table._clear()
    with monkeypatch.context() as m, pytest.raises(ValueError):
        m.setattr(table, "_whole", lambda many: (_ for _ in ()).throw(ValueError()) if many else [])
        table.encode(["some new words"])
    assert table.encode(["some new words"])[0].tolist() == want
