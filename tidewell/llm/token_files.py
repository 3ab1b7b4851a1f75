"""Operator 5: token ids as Parquet files with dictionary encoding, bounded row groups and page indexes.

Documents are dealt by ranges of doc_id, tokenised, and written in ascending doc_id order as rows
(doc_id, n_tokens, ids list<int>), one file a range, numbered in order; no sort stands between the
sorted documents and the files. Row groups and pages are small and the writer keeps a page index, so
a reader that wants a range of doc_ids, or only metadata columns, skips the rest. `start` counts the
ids of all documents before, from sums per file: the files are few, their documents many.

Null text counts as the empty text: its only id is the end id. Repeated doc_ids each keep a row, in
the order in which they are read, and may lie in several files. An empty table gives no rows. Other
columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, slices, texts, without_collector

#: Where a text may be cut with no token across: before a space that starts a word, and around runs
#: of white space as the tokenizer's own pre-tokenisation cuts them.
CUT = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space other than space and newline: texts with it are cut by CUT, others at single spaces.
RARE = re.compile("[^\\S \n]")
#: Characters that Python and the tokenizer may class differently as white space or not.
UNSURE = re.compile("[\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]")
#: Distinct words, and characters in them, that a task keeps.
MAX_TABLE, MAX_CHARS = 600_000, 12_000_000
#: Bytes of a row group and of a page.
ROW_GROUP, PAGE = 16 << 20, 256 << 10


class _Places(dict):
    """Word to its place in the table; a new word gets the next place."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, word):
        place = self[word] = len(self)
        self.new.append(word)
        return place


class WordTable:
    """The tokenizer's ids of texts, with each distinct word encoded once.

    A word stands in the table by its place: `ends` says where its ids end in `ids`. A key is what
    follows a single space; what has no such space before it is kept as a tuple of itself.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        kind = (self.tokenizer.pre_tokenizer, self.tokenizer.normalizer)
        self.cuts = "ByteLevel" in type(kind[0]).__name__ and not kind[0].add_prefix_space and kind[1] is None
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else re.compile("(?!)")
        space = self.tokenizer.encode(" a", add_special_tokens=False).tokens[0][0] if self.cuts else ""
        pieces = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        self.starts = np.array([p[:1] == space for p in pieces])
        self._clear()

    def _clear(self) -> None:
        self.places, self.chars, self.ids, self.ends = _Places(), 0, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _whole(self, many: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(many, add_special_tokens=False)]

    def _keys(self, text: str) -> list:
        """The words of a text as keys of the table."""
        if "  " in text or " \n" in text or "\n " in text or RARE.search(text):
            return [w[1:] if w[0] == " " and not w[1:2].isspace() and len(w) > 1 else (w,) for w in CUT.findall(text)]
        words = text.split(" ")
        words[0] = (words[0],)
        if not words[-1]:
            words[-1] = (" ",)
        return words

    def _learn(self) -> None:
        """Encode the new words and put their ids after those of the others.

        Words after a space go to the library as texts of a few hundred, in which an id that stands
        for a space and what follows starts the next word.
        """
        new, self.places.new = self.places.new, []
        alone = [i for i, w in enumerate(new) if type(w) is tuple]
        spaced = [w for w in new if type(w) is not tuple]
        parts = self._whole([" " + " ".join(spaced[at : at + 400]) for at in range(0, len(spaced), 400)])
        flat = np.fromiter(chain.from_iterable(parts), np.int32)
        cuts = np.flatnonzero(self.starts[flat])
        if len(cuts) != len(spaced):
            raise RuntimeError("a word was not encoded on its own")
        sizes = np.zeros(len(new), np.int64)
        if alone:  # few: put the two kinds together in the order of the new words
            others = self._whole([new[i][0] for i in alone])
            is_alone = np.zeros(len(new), bool)
            is_alone[alone] = True
            sizes[is_alone] = [len(x) for x in others]
            sizes[~is_alone] = np.diff(np.append(cuts, len(flat)))
            both, mine = np.empty(int(sizes.sum()), np.int32), np.repeat(is_alone, sizes)
            both[mine], both[~mine] = np.fromiter(chain.from_iterable(others), np.int32), flat
            flat = both
        else:
            sizes[:] = np.diff(np.append(cuts, len(flat)))
        self.chars += sum(map(len, spaced)) + sum(len(new[i][0]) for i in alone)
        self.ids = np.concatenate([self.ids, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def encode(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and how many each has."""
        alone = range(len(many))
        if self.cuts:
            alone = [i for i, t in enumerate(many) if UNSURE.search(t) or self.special.search(t)]
        whole = dict(zip(alone, self._whole([many[i] for i in alone])))
        if len(self.places) > MAX_TABLE or self.chars > MAX_CHARS:
            self._clear()
        keys = [[] if i in whole or not t else self._keys(t) for i, t in enumerate(many)]
        counts = np.fromiter(map(len, keys), np.int64, len(many))
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(keys)), np.int64, int(counts.sum()))
        try:
            self._learn()
        except BaseException:
            self._clear()  # words without ids must not stay for a next task
            raise
        sizes = self.ends[at + 1] - self.ends[at]
        flat = self.ids[np.repeat(self.ends[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
        last = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        lengths = np.diff(last)
        if whole:
            parts = [flat[last[i] : last[i + 1]] if i not in whole else np.array(whole[i], np.int32) for i in range(len(many))]
            flat, lengths = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return flat, lengths


#: The table that a worker process keeps for its next task, by its tokenizer file as it was read.
_KEPT: dict[tuple, WordTable] = {}


def word_table(tokenizer_file: str) -> WordTable:
    """The table of this process: tasks that follow each other in a worker read the tokenizer once and share learned words."""
    at = os.stat(tokenizer_file)
    key = (tokenizer_file, at.st_mtime_ns, at.st_size)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = WordTable(tokenizer_file)
    return _KEPT[key]


def _tokens(tokenizer_file: str, end_id: int):
    @without_collector
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        table = word_table(tokenizer_file)
        for batch in slices(batches):
            flat, lengths = table.encode(texts(batch))
            values = np.insert(flat, np.cumsum(lengths), end_id).astype(np.int32, copy=False)
            offsets = np.concatenate([[0], np.cumsum(lengths + 1)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths + 1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                names=["doc_id", "n_tokens", "ids"],
            )

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, files: int | None = None) -> None:
    """Tokenise docs(doc_id, text) and write token files under `path`, in ascending doc_id order.

    Two tables result: tokens (doc_id, n_tokens, ids) in doc_id order within and across its numbered
    files, and parts (part, start): ids in all files before. `files` is the number of ranges.
    """
    spark = docs.sparkSession
    files = files or max(docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    # the row's number lets a doc_id that many rows repeat be dealt to several ranges
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    dealt = numbered.repartitionByRange(files, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    tokens = dealt.select("doc_id", "text").mapInArrow(_tokens(tokenizer_file, end_id), "doc_id long, n_tokens long, ids array<int>")
    options = {
        "compression": "zstd",
        "maxRecordsPerFile": 0,  # one file a range, so that its number is the range's
        "parquet.enable.dictionary": "true",
        "parquet.block.size": ROW_GROUP,
        "parquet.page.size": PAGE,
        "parquet.page.row.count.limit": 20_000,
        "parquet.dictionary.page.size": 1 << 20,
    }
    tokens.write.options(**options).parquet(f"{path}/tokens")
    sums = read_token_files(spark, path).groupBy(_part()).agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).coalesce(1).write.parquet(f"{path}/parts")


def _part():
    """Number of the token file that a row is read from."""
    return F.regexp_extract(F.col("_metadata.file_name"), "^part-([0-9]+)", 1).cast("int").alias("part")


def _crcs(batches):
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("ids"))
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.asarray(lists.offsets) - lists.offsets[0].as_py()
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:])]
        at = {n: i for i, n in enumerate(batch.schema.names)}
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(at[n]) for n in ("doc_id", "part", "place", "n_tokens")), pa.array(sums, pa.int64())],
            names=["doc_id", "part", "place", "n_tokens", "ids_crc32"],
        )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the token files: filters on doc_id and unread columns reach the files."""
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(f"{path}/tokens")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    # rows of a file stand in order, so a running sum inside the file gives each document's place
    rows = read_token_files(spark, path).select("doc_id", _part(), F.col("_metadata.row_index").alias("place"), "n_tokens", "ids")
    sums = rows.mapInArrow(_crcs, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    starts = spark.read.schema("part int, start long").parquet(f"{path}/parts")
    before = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    return (
        sums.withColumn("inside", inside)
        .join(starts, "part")
        .select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )


def index_documents(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """Write the token files of docs in the shared folder and return token_index of what was written."""
    path = f"{shared_dir(docs.sparkSession)}/tidewell/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer_file, end_id)
    return token_index(docs.sparkSession, path)
