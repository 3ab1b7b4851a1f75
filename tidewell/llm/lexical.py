"""Operator 12: ranked lexical search by buckets of like length, with exact scores in integers.

A document is a vector of term impacts, an item one of term weights; the score is their inner product.
1. One scan of the documents counts terms and keeps, of each document, the terms that any item of a block
   holds with their occurrences. Numbers of documents, terms and holders of a term are sums over all of them.
2. Both sides are scaled by the root of the term's weight, which leaves products alone and lets lengths say
   more. Documents are dealt by length, longest first, and cut into buckets of BUCKET documents.
3. A document of the 10 best scores at least what the 10th best of any set of documents scores. This floor
   comes first from SEEDS documents or so, by a hash, and rises in each task. By the Cauchy-Schwarz inequality
   no bucket whose longest vector times the item's length stays under the floor holds one.
4. In a bucket, each of the item's strongest coordinates bounds the coordinate of a document that can reach
   the floor; where that bound is above 0 only the documents in its range, by a list sorted by coordinate, go on.
5. The survivors are scored by whole numbers alone; the best of all tasks are ranked, ties by doc_id.

Nothing is dropped by a bound that rounding could reach: bounds give way by SLACK. Items go in blocks of ITEMS, each a
scan of its own, so that what is sent to tasks has a bound; each item row is ranked by itself, also if its item_id repeats.
Null texts have no terms. Rows that repeat a doc_id are documents of their own; a null doc_id ranks after others of its
score. Empty tables and items without terms give no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, slices, texts

TOP = 10
#: Items of a block; documents of a bucket; documents that the first floor is read from, about.
ITEMS, BUCKET, SEEDS = 2_000, 2_048, 20_000
#: Coordinates of an item that bound those of a document.
FOCUS = 4
SLACK = 1e-9

_TABLE = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of digits, letters and characters past ASCII, A-Z lower-cased, as UTF-8."""
    return (text or "").encode().translate(_TABLE).split(b" ") if text else []


def _counted(vocabulary: dict[bytes, int]):
    """Rows (row, doc_id, n, terms, tfs) of documents with a term; terms are places in the vocabulary."""

    def run(batches):
        for batch in slices(batches, 2_000_000):
            ns, at, tfs, ends = [], [], [], [0]
            for text in texts(batch):
                counts = Counter(terms(text))
                counts.pop(b"", None)
                ns.append(sum(counts.values()))
                held = counts.keys() & vocabulary.keys()
                at += [vocabulary[w] for w in held]
                tfs += [counts[w] for w in held]
                ends.append(len(at))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (at, tfs)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int64()), *lists], names=["row", "doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(np.array(ns) > 0, pa.bool_()))
            pa.default_memory_pool().release_unused()

    return run


def weight(documents: int, holders: int) -> int:
    """The weight of a term that so many of all documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


def _impacts(documents: int, total: int, root: np.ndarray):
    """Rows (row, doc_id, length, terms, impacts): impacts are whole numbers, the length is of the scaled vector."""

    def run(batches):
        for batch in slices(batches):
            tfs, at = batch.column(4), batch.column(3)
            sizes = tfs.value_lengths().to_numpy()
            m = np.array([25 + 75 * n * documents // total for n in batch.column(2).to_pylist()], np.int64)
            tf, where = tfs.flatten().to_numpy().astype(np.int64), at.flatten().to_numpy()
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes))
            ends = np.cumsum(sizes)
            length = np.sqrt(np.add.reduceat((impact * root[where]) ** 2, ends - sizes)) if len(sizes) else np.zeros(0)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (where, impact)]  # an impact is at most a million
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(length), *lists], names=["row", "doc_id", "length", "terms", "impacts"])

    return run


class Bucket:
    """Documents of like length, their coordinates by document and by term."""

    def __init__(self, batch: pa.Table, root: np.ndarray):
        self.ids = batch["doc_id"].to_pylist()
        self.length = batch["length"].to_numpy()
        at, impacts = batch["terms"].combine_chunks(), batch["impacts"].combine_chunks()
        self.sizes = at.value_lengths().to_numpy()
        self.ends = np.cumsum(self.sizes)
        self.terms, self.impacts = at.flatten().to_numpy(), impacts.flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        share = self.impacts * root[self.terms] / np.maximum(self.length[doc], 1e-300)  # the coordinate of the unit vector
        self.scratch = np.zeros(len(root), np.int64)
        order = np.lexsort((-share, self.terms))
        self.doc, self.share, self.by_term = doc[order], share[order], self.impacts[order]
        self.starts = np.searchsorted(self.terms[order], np.arange(len(root) + 1))

    def scores(self, docs: np.ndarray, item: Item) -> np.ndarray:
        """Exact scores of some documents for an item."""
        weights = self.scratch
        weights[item.terms] = item.by_term
        n = self.sizes[docs]
        first = np.cumsum(n) - n
        places = np.repeat(self.ends[docs] - n - first, n) + np.arange(n.sum())
        products = np.concatenate([[0], np.cumsum(weights[self.terms[places]] * self.impacts[places])])
        weights[item.terms] = 0
        return products[first + n] - products[first]

    def candidates(self, item: Item, floor: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Documents that can reach the floor with their scores; None if no document of this length can."""
        bound = item.length * self.length[0]
        if bound * (1 + SLACK) < floor:
            return None
        least = min(1.0, floor / bound * (1 - SLACK)) if bound else 0.0
        low = item.share * least - np.sqrt((1 - least * least) * np.maximum(0, 1 - item.share**2)) - SLACK  # by coordinate, strongest first
        ranges = []
        for f in np.flatnonzero(low > 0)[:FOCUS]:
            s, e = self.starts[item.terms[f]], self.starts[item.terms[f] + 1]
            ranges.append(self.doc[s : s + np.searchsorted(-self.share[s:e], -low[f], side="right")])
        if ranges:
            ranges.sort(key=len)
            docs = ranges[0]
            for other in ranges[1:]:
                if len(docs):
                    held = np.zeros(len(self.sizes), bool)
                    held[other] = True
                    docs = docs[held[docs]]
            if not len(docs):
                return docs, docs
            return docs, self.scores(docs, item)
        sums = np.zeros(len(self.sizes), np.int64)  # no coordinate bounds: every document of any of the terms
        for term, w in zip(item.terms, item.by_term):
            s, e = self.starts[term], self.starts[term + 1]
            sums[self.doc[s:e]] += w * self.by_term[s:e]
        docs = np.flatnonzero(sums)
        return docs, sums[docs]


class Item:
    """An item's weights, and the unit vector of its scaled coordinates, strongest first."""

    def __init__(self, counts: dict[int, int], weights: np.ndarray, root: np.ndarray):
        at = np.array(sorted(counts), np.int64)
        n = np.array([counts[i] for i in at.tolist()], np.int64)
        scaled = root[at] * n
        self.length = math.sqrt((scaled * scaled).sum())
        order = np.argsort(-scaled, kind="stable")
        self.terms, self.by_term = at[order], (weights[at] * n)[order]
        self.share = scaled[order] / (self.length or 1.0)


def _search(block: list[dict[int, int]], weights: np.ndarray, floors: dict[int, int], top: int, size: int):
    """Rows (item, doc_id, score): the best documents of each item in a task, none under its floor."""
    root = np.sqrt(weights.astype(float))

    def run(batches):
        best = {i: [] for i in range(len(block))}
        floor = dict(floors)
        active = set(best)
        items = [Item(counts, weights, root) for counts in block]

        def see(table: pa.Table) -> None:
            bucket = Bucket(table, root)
            for i in sorted(active):
                found = bucket.candidates(items[i], floor.get(i, 1))
                if found is None:
                    active.discard(i)  # further buckets are no longer
                    continue
                docs, scores = found
                good = scores >= max(1, floor.get(i, 1))
                if not good.any():
                    continue
                docs, scores = docs[good], scores[good]
                if len(scores) > top:  # all that tie with the last of the best
                    last = np.partition(scores, len(scores) - top)[len(scores) - top]
                    docs, scores = docs[scores >= last], scores[scores >= last]
                ids = [bucket.ids[d] for d in docs.tolist()]
                best[i] = sorted([*best[i], *zip(ids, scores.tolist())], key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:top]
                if len(best[i]) == top:
                    floor[i] = max(floor.get(i, 1), best[i][-1][1])

        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - n)
                held.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
                if n == size:
                    if active:
                        see(pa.Table.from_batches(held))
                    held, n = [], 0
        if n and active:
            see(pa.Table.from_batches(held))
        out = [(i, d, s) for i, found in best.items() for d, s in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())],
            names=["item", "doc_id", "score"],
        )

    return run


FOUND = "item int, doc_id long, score long"


def _best(found: DataFrame, top: int) -> DataFrame:
    """The best rows of each item, ranked."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _rank_block(docs: DataFrame, block: list[tuple[int, list[bytes]]], top: int) -> DataFrame:
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, words in block for w in words}))}
    items = [dict(Counter(vocabulary[w] for w in words)) for _, words in block]
    counted = docs.mapInArrow(_counted(vocabulary), "row long, doc_id long, n long, terms array<int>, tfs array<int>")
    counted = materialize(counted, "counted")
    documents, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holders = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # one row a term of the block
    weights = np.array([weight(documents, holders.get(k, 0)) for k in range(len(vocabulary))], np.int64)
    root = np.sqrt(weights.astype(float))
    vectors = counted.where(F.size("terms") > 0).mapInArrow(_impacts(documents, total, root), "row long, doc_id long, length double, terms array<int>, impacts array<int>")
    vectors = materialize(vectors, "vectors")

    def search(some: DataFrame, floors: dict[int, int]) -> DataFrame:
        dealt = some.repartitionByRange(F.desc("length"), "row").sortWithinPartitions(F.desc("length"), "row")
        return _best(dealt.select("doc_id", "length", "terms", "impacts").mapInArrow(_search(items, weights, floors, top, BUCKET), FOUND), top)

    seeds = vectors.where(F.pmod(F.xxhash64("row"), F.lit(max(1, documents // SEEDS))) == 0)
    floors = dict(search(seeds, {}).where(F.col("rank") == top).select("item", "score").collect())  # one row an item of the block
    best = search(vectors, floors)
    names = docs.sparkSession.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], "item int, item_id string")
    found = materialize(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
    discard(counted)
    discard(vectors)
    return found


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each item with a score above 0."""
    spark: SparkSession = docs.sparkSession
    kind = items.schema["item_id"].dataType
    texts_of = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    listed = items.select(F.col("item_id").cast("string"), "text").toLocalIterator()
    read = ((r.item_id, [w for w in terms(r.text) if w]) for r in listed)
    blocks = iter(lambda: list(islice(read, ITEMS)), [])
    found = [_rank_block(texts_of, block, top) for block in blocks]
    if not found:
        return spark.createDataFrame([], "item_id string, rank int, doc_id long, score long")
    out = reduce(DataFrame.unionByName, found)
    return out.select(F.col("item_id").cast(kind).alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
