"""Operator 1: SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the vocabulary has a whitespace marker after another character (checked when the model
is opened), so merges never cross the start of a marked word, and a text's ids are the ids of its
marked words, one after another. Each task keeps the distinct marked words it has met in a table,
segments only new ones with the library, and joins the ids back by position. The table of a task is
bounded (MAX_TABLE words) and starts anew when full; only speed depends on it, never a result.

Null text encodes as the empty text: the end id alone. Very long texts are cut only at marked words.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts, without_collector

MARK = "▁"
#: Distinct marked words that a task keeps, and the longest marked word that is kept.
MAX_TABLE, MAX_WORD = 300_000, 64


class ChunkCodec:
    """The library's encode and decode with each distinct marked word segmented once.

    An entry of the table holds a marked word's ids, the same as text, and what they decode to.
    Joining the decoded words with spaces is the library's decode of the joined ids, as decode turns
    a marker into a space and drops the one that begins the text.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        sample = "a  b\tc\n\u3000\uff21\ufb01 "
        # the model only marks spaces and has no piece across a marker: else texts go to it whole
        self.plain = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and (
            self.model.normalize(sample) == (MARK + sample).replace(" ", MARK)
        )
        self.starts = np.array([p[0] == MARK for p in pieces])
        self.names = [str(i) for i in range(len(pieces))]
        self.end = self.model.eos_id()
        self.table: dict[str, tuple[list[int], str, str]] = {}

    def words(self, text: str) -> list[str]:
        """Marked words of a text, each without its first marker."""
        if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
            return [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", self.model.normalize(text))]
        return text.split(" ")

    def _segment(self, words: list[str]) -> None:
        """Put new marked words in the table.

        They go to the library as texts of a few hundred words, in which a piece that starts with a
        marker starts the next word. Words with further markers, and the bare marker, go alone.
        """
        alone = [w for w in words if MARK in w or not w]
        decode = self.model.decode
        got = [self.model.encode(w.replace(MARK, " "), num_threads=1) if w else [self.model.piece_to_id(MARK)] for w in alone]
        back = [decode(g) for g in got]
        plain = [w for w in words if w and MARK not in w] if alone else words
        for at in range(0, len(plain), 400):
            part = plain[at : at + 400]
            ids = self.model.encode(" ".join(part), num_threads=1)
            cuts = np.flatnonzero(self.starts[ids]).tolist()
            if len(cuts) != len(part):
                raise RuntimeError("a marked word was not segmented on its own")
            got += [ids[a:b] for a, b in zip(cuts, [*cuts[1:], len(ids)])]
            back += decode(ids).split(" ")
        name = self.names.__getitem__
        keys = [*alone, *plain] if alone else plain
        self.table.update(zip(keys, zip(got, [" ".join(map(name, g)) for g in got], back, strict=True), strict=True))

    def entries(self, many: list[str]) -> list[list[tuple[list[int], str, str]]]:
        """For each text the entries of its marked words by position."""
        words = [self.words(t) if t else [] for t in many]
        new = [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in self.table]
        if new and len(self.table) + len(new) > MAX_TABLE:
            self.table.clear()
            new = list(dict.fromkeys(chain.from_iterable(words)))
        if new:
            self._segment(new)
        out = [list(map(self.table.__getitem__, ws)) for ws in words]
        for w in new:
            if len(w) > MAX_WORD:
                del self.table[w]
        return out

    def encode(self, many: list[str]) -> list[list[int]]:
        """Ids of each text, the end id last."""
        if not self.plain:
            return [[*ids, self.end] for ids in self.model.encode(many, num_threads=1)]
        return [[*chain.from_iterable(e[0] for e in row), self.end] for row in self.entries(many)]

    def decode(self, many: list[list[int]]) -> list[str]:
        return self.model.decode(many, num_threads=1)

    def digests(self, many: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: number of ids, SHA-256 of the ids as text, SHA-256 of the decoded text."""
        sha, out = hashlib.sha256, []
        if not self.plain:
            ids = self.encode(many)
            parts = [(len(i), " ".join(map(str, i)), d) for i, d in zip(ids, self.decode(ids))]
        else:
            parts = []
            for row in self.entries(many):
                ids, names, decoded = zip(*row) if row else ((), (), ())
                parts.append((sum(map(len, ids)) + 1, " ".join([*names, str(self.end)]), " ".join(decoded)))
        return [(n, sha(i.encode()).hexdigest(), sha(d.encode()).hexdigest()) for n, i, d in parts]


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids array<int> with the end id last, decoded: the text that those ids stand for."""

    @without_collector
    def run(batches):
        codec = ChunkCodec(model_file)
        for batch in slices(batches):
            ids = codec.encode(texts(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(codec.decode(ids))],
                names=["doc_id", "ids", "decoded"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """encode_documents, with the ids and the decoded text carried as digests rather than values."""

    @without_collector
    def run(batches):
        codec = ChunkCodec(model_file)
        for batch in slices(batches):
            n, ids, decoded = zip(*codec.digests(texts(batch)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
