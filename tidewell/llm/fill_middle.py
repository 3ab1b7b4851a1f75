"""Operator 13: fill-in-the-middle by a learned index from token rank to offset.

A text of n tokens has n + 1 boundaries. Their code-point offsets, as a function of rank, are fitted by
straight segments: a segment runs between two boundaries, is split where it errs most as long as it errs by
more than ERROR, and all boundaries keep what the line misses as a residual of one byte. A cut at a rank is
predicted by its segment in whole numbers and corrected by the residual, which gives its offset exactly.
The fit goes over all texts of a batch at once; its rounds grow with the logarithm of the text's length as a rule.

The cuts and the form come from the sha256 of seed and doc_id alone, so that any task gives the same result again.
Texts that hold a marker stay plain, so that the parts of every other output are told apart and its text
is rebuilt exactly. Null texts are empty ones, and plain. A null doc_id counts as the empty string in the
hash. Rows that repeat a doc_id each keep a row with the same draws. An empty table gives no rows. Texts of any
length are read whole. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

#: Fixed values of the transformation: markers, seed, share of texts transformed, share of these in suffix-first form.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80
#: Code points by which a segment errs at most; residuals are bytes.
ERROR = 127


def boundaries(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all token boundaries of each text, one after the other, and where each text's begin (with the end)."""
    codes = np.frombuffer("\n".join([*many, ""]).encode("utf-32-le"), np.uint32)  # each text ends with a newline of ours
    space = (codes == 0x20) | ((codes >= 9) & (codes <= 13))
    sizes = np.array([len(t) for t in many], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    word_ends = np.flatnonzero(~space[:-1] & space[1:]) + 1 if len(codes) else np.zeros(0, np.int64)
    loose = ends[(sizes > 0) & space[np.maximum(ends - 1, 0)]]  # white space that no word follows is a token too
    places = np.sort(np.concatenate([starts, word_ends, loose]))
    text = np.searchsorted(ends, places, side="left")
    # an empty text has its one boundary, at 0
    first = np.searchsorted(text, np.arange(len(many) + 1))
    return places - starts[text], first


class RankIndex:
    """Segments and residuals of the boundaries of many texts."""

    def __init__(self, offsets: np.ndarray, first: np.ndarray, error: int = ERROR):
        self.first = first
        last = first[1:] - 1
        knots = np.zeros(len(offsets), bool)
        knots[first[:-1]] = knots[last] = True
        while True:
            self.at = np.flatnonzero(knots)
            self.value = offsets[self.at]
            miss = offsets - self.predict(np.arange(len(offsets)))
            wrong = np.abs(miss) > error
            if not wrong.any():
                break
            # split each segment that errs too much where it errs most
            segment = np.cumsum(knots) - 1
            order = np.lexsort((np.abs(miss), segment))
            worst = order[np.concatenate([segment[order][1:] != segment[order][:-1], [True]])]
            knots[worst[wrong[worst]]] = True
        self.residuals = miss.astype(np.int8)

    def predict(self, places: np.ndarray) -> np.ndarray:
        """Offsets on the segments' lines, rounded down; places count all boundaries of all texts."""
        left = np.searchsorted(self.at, places, side="right") - 1
        right = np.minimum(left + 1, len(self.at) - 1)
        run = np.maximum(self.at[right] - self.at[left], 1)
        return self.value[left] + (places - self.at[left]) * (self.value[right] - self.value[left]) // run

    def cut(self, texts_at: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Offset of the boundary of this rank in each text: predicted, then corrected."""
        places = self.first[texts_at] + ranks
        return self.predict(places) + self.residuals[places]


def draws(doc_id) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def restore(output: str, form: str) -> str:
    """The text that an output of this form was made from."""
    if form == "plain":
        return output
    if form == "psm":
        prefix, rest = output[len(PREFIX) :].split(SUFFIX)
        suffix, middle = rest.split(MIDDLE)
    else:
        suffix, rest = output[len(SUFFIX) :].split(PREFIX)
        prefix, middle = rest.split(MIDDLE)
    return prefix + middle + suffix


def _transformed(batches):
    for batch in slices(batches, 2_000_000):
        ids, many = batch.column(0).to_pylist(), texts(batch)
        if not many:
            continue
        offsets, first = boundaries(many)
        index = RankIndex(offsets, first)
        n = np.diff(first) - 1
        hashes = np.array([draws(i) for i in ids], np.int64)
        one, two = hashes[:, 0] % (n + 1), hashes[:, 1] % (n + 1)
        every = np.arange(len(many))
        begin, end = index.cut(every, np.minimum(one, two)).tolist(), index.cut(every, np.maximum(one, two)).tolist()
        form, out = [], []
        for k, text in enumerate(many):
            if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or hashes[k, 2] % 100 >= RATE:
                form.append("plain")
                out.append(text)
                continue
            prefix, middle, suffix = text[: begin[k]], text[begin[k] : end[k]], text[end[k] :]
            form.append("spm" if hashes[k, 3] % 100 < SPM_RATE else "psm")
            out.append(f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if form[-1] == "spm" else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")
        plain = np.array([f == "plain" for f in form])
        sizes = [pa.array(np.array(x, np.int64), mask=plain) for x in (begin, np.subtract(end, begin))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n.astype(np.int64)), pa.array(form), *sizes, pa.array(out)],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )


OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def transform(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_transformed, OUTPUT)


def _digests(batches):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for batch in _transformed(batches):
        output, form = batch.column(5).to_pylist(), batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array([sha(o) for o in output], pa.string()), pa.array([sha(restore(o, f)) for o, f in zip(output, form)], pa.string())],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
        )


def digest_documents(docs: DataFrame) -> DataFrame:
    """Like transform(), with digests of the output and of the text rebuilt from it instead of the output."""
    kind = OUTPUT.replace("output string", "output_sha256 string, restored_sha256 string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digests, kind)
