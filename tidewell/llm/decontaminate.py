"""Operator 3: benchmark decontamination with one Aho-Corasick automaton over normalised items.

Texts are normalised by lower-casing A-Z and keeping words of letters, digits and non-ASCII
characters. Windows of `size` consecutive words of each item (the whole item if shorter) form one
automaton, which scans each document once; matches map back to word positions and to character
offsets of the original text.

Items are taken in blocks of at most BLOCK_CHARS normalised characters, so the automaton that is
broadcast has a proven bound; a benchmark of any size goes through as several blocks, and per
row the blocks' spans are merged. Documents come as they are dealt and are not shuffled for one
block; for several, rows are written once with a number, and only the spans are shuffled.

Null and empty texts have no words and are clean. Items without words have no window. Items with
equal windows are all reported. Repeated rows are judged each on their own.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, texts

SIZE = 13
#: Normalised characters of the items in one automaton: about 40 times as many bytes as a worker holds.
BLOCK_CHARS = 2_000_000

#: Bytes that are no part of a word become spaces, A-Z become a-z, others stay.
_TABLE = bytes(
    32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)


def words(text: str) -> list[bytes]:
    """Normalised words of a text, in UTF-8."""
    return text.encode().translate(_TABLE).split()


def windows(text: str, size: int) -> set[str]:
    """Windows of an item as the automaton's keys: words set off by spaces, one character a byte."""
    w = words(text)
    n = min(size, len(w))
    return {" " + b" ".join(w[i : i + n]).decode("latin-1") + " " for i in range(len(w) - n + 1)} if w else set()


def automaton(items: list[tuple[int, str]], size: int):
    """An Aho-Corasick automaton whose values are (words in the window, items that have it)."""
    import ahocorasick

    found: dict[str, list[int]] = {}
    for item, text in items:
        for key in windows(text, size):
            found.setdefault(key, []).append(item)
    out = ahocorasick.Automaton()
    for key, ids in found.items():
        out.add_word(key, (key.count(" ") - 1, tuple(ids)))
    if found:
        out.make_automaton()
    return out, bool(found)


def scan(machine, text: str) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, word spans [start, end) inside found windows merged in order, items found."""
    line = text.encode().translate(_TABLE).split()
    if not line or machine is None:
        return len(line), [], set()
    joined = " " + b" ".join(line).decode("latin-1") + " "
    spans, items, starts = [], set(), None
    for end, (n, ids) in machine.iter(joined):
        if starts is None:  # places of the spaces: a window ends at one
            starts = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
        last = int(np.searchsorted(starts, end))
        spans.append((last - n, last))
        items.update(ids)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return len(line), merged, items


def offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets [start, end) in the original text of spans given in words."""
    if not spans:
        return []
    raw = text.encode()
    inside = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(chars[edges[2 * a]]), int(chars[edges[2 * b - 1]])) for a, b in spans]


SCHEMA = "doc_id long, n_words long, words array<struct<start:int,end:int>>, chars array<struct<start:int,end:int>>, items array<long>"


def _scanner(items, size: int):
    def run(batches):
        machine, any_window = automaton(items.value, size)
        for batch in slices(batches):
            rows = [(text, *scan(machine if any_window else None, text)) for text in texts(batch)]
            pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            as_rows = lambda spans: [{"start": a, "end": b} for a, b in spans]
            keys = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(batch.schema.get_field_index(n)) for n in keys),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([as_rows(r[2]) for r in rows], pairs),
                    pa.array([as_rows(offsets(r[0], r[2])) for r in rows], pairs),
                    pa.array([sorted(r[3]) for r in rows], pa.list_(pa.int64())),
                ],
                names=[*keys, "n_words", "words", "chars", "items"],
            )

    return run


def _blocks(items: DataFrame):
    """Items in blocks of at most BLOCK_CHARS characters (one long item may exceed that alone)."""
    rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    block, used = [], 0
    for row in rows.toLocalIterator():  # one partition at a time
        if block and used + len(row.text) > BLOCK_CHARS:
            yield block
            block, used = [], 0
        block.append((row.item_id, row.text))
        used += len(row.text)
    yield block


def find_items(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """Per document: n_words, merged word spans and character spans of the original, items found."""
    spark, blocks = docs.sparkSession, _blocks(items)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return docs.select("doc_id", "text").mapInArrow(_scanner(spark.sparkContext.broadcast(first), size), SCHEMA)
    # many blocks: each row's few spans meet by its number, which is written once, as doc_ids may repeat
    numbered, found = materialize(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows"), []
    for block in chain([first, second], blocks):
        sent = spark.sparkContext.broadcast(block)
        rows = numbered.mapInArrow(_scanner(sent, size), f"row long, {SCHEMA}")
        # the first block's rows are kept for all documents, as they count words, the others' where they hold an item
        found.append(materialize(rows if not found else rows.where(F.size("items") > 0), "items"))
        sent.destroy()  # what it found is written, so one block is held at a time
    parts = reduce(DataFrame.unionByName, found)
    merged = parts.groupBy("row", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("words")).alias("words"),
        F.flatten(F.collect_list("chars")).alias("chars"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.select("doc_id", "n_words", _merge("words").alias("words"), _merge("chars").alias("chars"), "items")


def _merge(name: str):
    """Spans sorted and joined where they touch or overlap."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(
            F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"], F.greatest(last["end"], x["end"]).alias("end")))
        )
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= x["start"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(name), empty, step)


def judge(found: DataFrame, percent: int = 5) -> DataFrame:
    """Add n_hit and contaminated: at least `percent` of the words, and one, are inside windows."""
    hit = F.aggregate("words", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    rule = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
    return found.withColumn("n_hit", hit).withColumn("contaminated", rule)


def report(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """judge() with the items carried as their number and a digest."""
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return judge(find_items(docs, items, size)).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )
