"""Operator 7: language identification by rank-order profiles.

A language's profile is its TOP most frequent character n-grams (one to three characters within
words, word ends marked) in rank order. A document's own TOP n-grams are ranked the same way, and its
distance to a profile is the sum of how far each n-gram is out of place; one that the profile lacks
counts TOP places. The nearest profile is the prediction.

N-grams never leave a word, so a task cuts each distinct word into n-grams once, keeps them by number
in a table of bounded size, and counts a text's n-grams from the numbers of its words. Profiles come
from all learning rows: tasks count words per language and from them n-grams, Spark sums the counts
and ranks them. A profile has a fixed size, and so has what is broadcast per language.

Letters are Unicode letters, lower-cased; all else separates words. Null text, and text without a
letter, is `und` with score 0. Equal counts rank by the n-gram's code points, equal distances by the
language's name. Without any learning row every text is `und`, and an empty table gives no rows. Rows
that repeat are judged each on their own. Other columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, texts, without_collector

TOP = 300
#: Distinct words, and n-grams of them, that a task keeps.
MAX_WORDS, MAX_GRAMS = 400_000, 8_000_000
_SHIFT = np.int64(21)  # bits of a code point


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            out[c] = ord(ch.lower()[0])
    return out


_TABLE: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_letters())
    return _TABLE[0]


def words(many: list[str]) -> list[list[str]]:
    """Lower-cased words of letters of each text."""
    codes = np.frombuffer("".join(many).encode("utf-32-le"), np.uint32)
    low = letter_table()[codes].astype("<u4").tobytes().decode("utf-32-le")
    out, at = [], 0
    for t in many:
        out.append(low[at : at + len(t)].split())
        at += len(t)
    return out


class _Places(dict):
    """Key to its place; a new key gets the next place."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key):
        place = self[key] = len(self)
        self.new.append(key)
        return place


def _expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of each of many ranges, one range after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class GramTable:
    """N-grams of words by number.

    A gram packs up to three code points, 21 bits each, where 0 is a word end; pairs are marked by bit
    62. Single word ends are no grams, and no word end stands inside a triple. A word's grams are
    `grams[ends[w] : ends[w + 1]]`, as numbers into `codes`.
    """

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.words, self.numbers, self.codes = _Places(), _Places(), np.zeros(0, np.int64)
        self.grams, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def full(self) -> bool:
        return len(self.words) > MAX_WORDS or len(self.grams) > MAX_GRAMS

    def places(self, rows: list[list[str]]) -> np.ndarray:
        """The words of all rows, one row after another, by place; new ones are cut into n-grams."""
        n = sum(map(len, rows))
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(rows)), np.int64, n)
        new, self.words.new = self.words.new, []
        if new:
            low = np.frombuffer(("\0" + "\0".join(new) + "\0").encode("utf-32-le"), np.uint32).astype(np.int64)
            word = np.cumsum(low[:-1] == 0) - 1  # of a mark: the word after it
            letter, inner = np.flatnonzero(low), np.flatnonzero(low[1:-1])
            pair = (np.int64(1) << 62) | (low[:-1] << _SHIFT) | low[1:]
            three = (low[inner] << (2 * _SHIFT)) | (low[inner + 1] << _SHIFT) | low[inner + 2]
            owner = np.concatenate([word[letter], word[:], word[inner + 1]])
            order = np.argsort(owner, kind="stable")
            codes, which = np.unique(np.concatenate([low[letter], pair, three])[order], return_inverse=True)
            number = np.fromiter(map(self.numbers.__getitem__, codes.tolist()), np.int32, len(codes))
            self.numbers.new = []
            self.codes = np.fromiter(self.numbers, np.int64, len(self.numbers))
            self.grams = np.concatenate([self.grams, number[which]])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.bincount(owner, minlength=len(new)))])
        return at

    def of(self, at: np.ndarray) -> np.ndarray:
        """Numbers of the grams of the words at these places, one word after another."""
        return self.grams[_expand(self.ends[at], self.ends[at + 1] - self.ends[at])]


@without_collector
def _count(batches):
    """Counts of n-grams per language over the rows of a task."""
    table, sums = GramTable(), {}

    def emit():
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(table.codes[at]), pa.array(n[at])], names=["lang", "gram", "n"]
            )
        sums.clear()

    for batch in slices(batches, 2_000_000):
        if table.full():
            yield from emit()
            table.clear()
        rows, langs = words(texts(batch)), batch.column(1).to_pylist()
        at = table.places(rows)
        ends = np.cumsum([len(r) for r in rows])
        for lang in dict.fromkeys(langs):
            mine = np.concatenate([at[ends[i] - len(rows[i]) : ends[i]] for i in range(len(rows)) if langs[i] == lang])
            word, times = np.unique(mine, return_counts=True)
            weight = np.repeat(times, table.ends[word + 1] - table.ends[word])
            n = np.bincount(table.of(word), weights=weight, minlength=len(table.codes)).astype(np.int64)
            old = sums.get(lang)
            if old is not None:
                n[: len(old)] += old
            sums[lang] = n
    yield from emit()


def fit(docs: DataFrame, learn: Column, top: int = TOP) -> dict[str, np.ndarray]:
    """Profiles: for each language its `top` grams in rank order, from rows with lang for which `learn` holds."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= top)
    profiles: dict[str, list[int]] = {}
    for r in ranked.orderBy("lang", "rank").collect():  # `top` rows a language
        profiles.setdefault(r.lang, []).append(r.gram)
    return {lang: np.array(grams, np.int64) for lang, grams in profiles.items()}


class Ranker:
    """Distances of texts to profiles.

    Ranks are kept for grams of profiles alone, two bytes for each of them and language; a gram of texts
    has the number of its profile gram, and all that no profile has share one more.
    """

    def __init__(self, profiles: dict[str, np.ndarray], top: int = TOP):
        self.langs, self.top = sorted(profiles), top
        self.known = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
        self.place = np.full((len(self.langs), len(self.known) + 1), -1, np.int16 if top < 1 << 15 else np.int32)
        for i, lang in enumerate(self.langs):
            self.place[i, np.searchsorted(self.known, profiles[lang])] = np.arange(len(profiles[lang]))
        self.table = GramTable()
        self._forget()

    def _forget(self) -> None:
        self.ranked, self.column = -1, np.zeros(0, np.int32)

    def _rank(self) -> None:
        """For each new gram of the table the number of its profile gram, and for all grams their place by code points."""
        codes = self.table.codes
        new = codes[len(self.column) :]
        at = np.searchsorted(self.known, new)
        found = np.append(self.known, -1)[at] == new  # no gram is below 0
        self.column = np.concatenate([self.column, np.where(found, at, len(self.known)).astype(np.int32)])
        self.by_code = np.empty(len(codes), np.int64)
        self.by_code[np.argsort(codes)] = np.arange(len(codes))
        self.ranked = len(codes)

    def _first(self, grams: np.ndarray) -> np.ndarray:
        """The `top` most frequent of a text's grams, equal counts by code points."""
        size = self.ranked
        if len(grams) * 4 > size:
            times = np.bincount(grams, minlength=size)
            kinds = np.flatnonzero(times)
            times = times[kinds]
        else:  # a short text among many grams
            kinds, times = np.unique(grams, return_counts=True)
        key = times * size + (size - 1 - self.by_code[kinds])
        if len(kinds) > self.top:
            best = np.argpartition(key, len(key) - self.top)[-self.top :]
            kinds, key = kinds[best], key[best]
        return kinds[np.argsort(-key)]

    def predict(self, many: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(many), np.zeros(len(many))
        if self.table.full():
            self.table.clear()
            self._forget()
        rows = words(many)
        at = self.table.places(rows)
        if self.ranked != len(self.table.codes):
            self._rank()
        out, scores, end = [], np.zeros(len(many)), 0
        for i, row in enumerate(rows):
            begin, end = end, end + len(row)
            if not row:
                out.append("und")
                continue
            first = self._first(self.table.of(at[begin:end]))
            place = self.place[:, self.column[first]].astype(np.int64)
            off = np.where(place < 0, self.top, np.abs(place - np.arange(len(first)))).sum(1)
            best = int(off.argmin())
            out.append(self.langs[best])
            scores[i] = 1 - off[best] / (len(first) * self.top)
        return out, np.clip(scores, 0, 1)


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score."""

    @without_collector
    def run(batches):
        ranker = Ranker(profiles)
        for batch in slices(batches, 2_000_000):
            langs, scores = ranker.predict(texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
