"""Operator 10: near-duplicates by MinHash, banding, verification and connected components.

1. Each text becomes its set of distinct word shingles, as 64-bit hashes. PERMUTATIONS universal hash
   functions give its minima; BANDS bands of ROWS minima each give its buckets, and the low bytes of
   the minima its signature.
2. Texts with one and the same set are one class, so thousands of copies cost one row from here on.
3. Classes that share a bucket are candidates. Pairs are never listed bucket by bucket: each bucket
   first compares its members with one leader, the member that shares most with others.
4. Signature verification: a pair goes on if LEAST_EQUAL of its signature bytes agree. Links are then
   confirmed on full shingle sets.
5. Connected components by alternating large-star and small-star.
6. In buckets that still hold several components, members outside a bucket's leading component are
   compared with the members of other components, inside tasks, by signatures and then on full sets.
   No partner is capped, and only links leave the tasks.

A pair at the threshold of 0.75 shares no bucket by a chance of (1 - 0.75^5)^50, about 1e-6. That
fewer than LEAST_EQUAL of 250 bytes agree, of which each does by a chance of 0.751, is 5.5 deviations
away, a chance of about 5e-8: signatures lose far less than the banding that chooses the candidates.

What is joined by class, bucket or node is a table by itself, so that Spark can split the rows of a
hot key (a class of many copies, a bucket of many near copies, the hub of a component) over tasks.

Null and empty texts, and texts without words, have an empty set and stay alone. A text of fewer
words than a shingle has is one shingle. doc_id is taken to name a document: rows that repeat one with
different texts are linked with each other through it, and each row is kept as a row of its own. A null doc_id
names nothing: its row belongs to the smallest id that is not null among what it is linked with, and without one
its component is null and it is kept. An empty table gives no rows. Other columns of docs, whatever their names, are not read.
first_copies() instead tells rows of one doc_id apart by their texts.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, slices, texts

SHINGLE, PERCENT = 5, 75
ROWS, BANDS = 5, 50
PERMUTATIONS = ROWS * BANDS
#: Equal signature bytes, of PERMUTATIONS, from which on a pair is verified on full sets.
LEAST_EQUAL = 150
#: Ids of documents that are sent to all executors; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Members of a bucket, and shingles in their sets, that meet in one task; larger buckets are dealt out
#: as a grid of such blocks.
BLOCK, BLOCK_SHINGLES = 1_500, 3_000_000
#: Pairs of a task that are compared at once.
PAIRS_AT_ONCE = 50_000
#: Shingles of partners that are looked up at once.
SHINGLES_AT_ONCE = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)
    return _mix(k * _ODD) | np.uint64(1), _mix(k * _ODD + np.uint64(12345))


def _inverse_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    base = 0x5851F42D4C957F2D
    inverse = pow(base, -1, 1 << 64)
    powers = np.full(n, base, np.uint64)
    back = np.full(n, inverse, np.uint64)
    powers[:1] = back[:1] = 1
    return np.multiply.accumulate(powers), np.multiply.accumulate(back)


def shingle_hashes(many: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text: (row of the text, hash), by row and hash.

    Words are runs of other than ASCII white space with A-Z lower-cased; a text of fewer words than
    `size`, but not none, has its whole word sequence as its one shingle.
    """
    raws = [t.encode().lower() for t in many]
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    lengths = np.array([len(r) + 1 for r in raws], np.int64)
    ends_of_rows = np.cumsum(lengths)
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    powers, back = _inverse_powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(data.astype(np.uint64) + np.uint64(1)) * powers)])
    words = _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    row = np.searchsorted(ends_of_rows, starts, side="right")
    counts = np.bincount(row, minlength=len(many))
    n = len(words)
    joined = words.copy()
    for k in range(1, size):  # positions past a text's end are dropped below
        joined = _mix(joined * np.uint64(3) + np.concatenate([words[k:], np.zeros(min(k, n), np.uint64)])[:n])
    last = np.cumsum(counts)
    place = np.arange(n) - (last - counts)[row]
    whole = place + size <= counts[row]
    rows, hashes = row[whole], joined[whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        alone = []
        for i in short:
            h = np.array([counts[i]], np.uint64) * _ODD
            for w in words[last[i] - counts[i] : last[i]]:
                h = _mix(h * np.uint64(5) + w)
            alone.append(h[0])
        rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, np.array(alone, np.uint64)])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[fresh], hashes[fresh]


def _fingerprints(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set of shingles; the sets begin at `at`, and none is empty."""
    return np.add.reduceat(_mix(hashes), at), np.add.reduceat(_mix(hashes ^ _ODD), at)


def _sketch(batches):
    a, b = _coefficients()
    band_salt = _mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD)
    for batch in slices(batches, 2_000_000):
        many = texts(batch)
        rows, hashes = shingle_hashes(many)
        sizes = np.bincount(rows, minlength=len(many))
        full = np.flatnonzero(sizes)
        low, keys = np.zeros((len(many), PERMUTATIONS), np.uint8), np.zeros((len(many), BANDS), np.int64)
        one, two = np.zeros(len(many), np.uint64), np.zeros(len(many), np.uint64)
        if len(full):
            at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            minima = np.empty((PERMUTATIONS, len(full)), np.uint64)
            for k in range(PERMUTATIONS):
                minima[k] = np.minimum.reduceat((hashes * a[k] + b[k]) >> np.uint64(24), at)
            low[full] = _mix(minima).astype(np.uint8).T
            key = np.tile(band_salt[:, None], (1, len(full)))
            for r in range(ROWS):
                key = _mix(key * np.uint64(7) + minima[r::ROWS])
            keys[full] = key.T.view(np.int64)
            one[full], two[full] = _fingerprints(hashes, at)
        offsets = pa.array(np.arange(0, len(many) * BANDS + 1, BANDS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(sizes.astype(np.int64)),
                pa.array(one.view(np.int64)),
                pa.array(two.view(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                pa.array([x.tobytes() for x in low], pa.binary()),
            ],
            names=["row", "doc_id", "n_shingles", "fp1", "fp2", "buckets", "signature"],
        )


SKETCH = "row long, doc_id long, n_shingles long, fp1 long, fp2 long, buckets array<long>, signature binary"


def _sets(batches):
    for batch in slices(batches, 2_000_000):
        many = texts(batch)
        rows, hashes = shingle_hashes(many)
        sizes = np.bincount(rows, minlength=len(many))
        ends = np.cumsum(sizes)
        full = np.flatnonzero(sizes)
        if not len(full):
            continue
        one, two = _fingerprints(hashes, (ends - sizes)[full])
        offsets = np.concatenate([[0], ends[full]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(full)),
                pa.array(one.view(np.int64)),
                pa.array(two.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64))),
            ],
            names=["least", "fp1", "fp2", "shingles"],
        )


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b): the component is its smallest node.

    Alternating large-star and small-star until no edge changes. Each step's edges are a table in the
    shared folder, deleted when the next step's is written; only a test for changes reaches the driver.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # large-star: link larger neighbours to the smallest of a node and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "near")
        stars = both.join(near, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(stars, "large")
        # small-star: link a node and its smaller neighbours to the smallest of them
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "near")
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        old, edges = edges, materialize(small, "edges")
        for done in (old, near, large, least):
            discard(done)
        # done when each node has one edge and no edge leads to a node that has one
        ends = edges.groupBy("a").agg(F.count("*").alias("n")).join(edges.select(F.col("b").alias("a"), F.lit(1).alias("led")).distinct(), "a", "left")
        if ends.where("n > 1 or led = 1").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(node, component) after further links (a, b)."""
    name = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    ends = links.join(name("a"), "a", "left").join(name("b"), "b", "left")
    between = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("root"))
    old = labels.join(joined, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    fresh = joined.join(labels.select(F.col("node").alias("component")), "component", "left_anti")
    return materialize(old.unionByName(fresh.select(F.col("component").alias("node"), F.col("root").alias("component"))), "labels")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    same = F.size(F.array_intersect("x", "y"))
    return both.where(100 * same >= percent * (F.size("x") + F.size("y") - same)).select("a", "b")


def _near_pairs(ask, group, part, band, sizes, prints, signatures, percent):
    """Rows (asker, member) of the pairs of the same group and of different components that can reach the threshold.

    A pair that shares an earlier bucket is left to that bucket, so each pair is compared once. Pairs
    are laid out PAIRS_AT_ONCE at a time, over many groups if they are small.
    """
    q, m = np.flatnonzero(ask), np.flatnonzero(~ask)
    first = np.searchsorted(group[m], group[q], side="left")
    counts = np.searchsorted(group[m], group[q], side="right") - first
    ends = np.cumsum(counts)
    found = [np.zeros((2, 0), np.int64)]
    at = 0
    while at < len(q):
        before = ends[at] - counts[at]
        to = max(at + 1, int(np.searchsorted(ends, before + PAIRS_AT_ONCE, side="right")))
        n = counts[at:to]
        x = np.repeat(q[at:to], n)
        y = m[np.repeat(first[at:to] - (ends[at:to] - n - before), n) + np.arange(len(x))]
        for keep in (
            lambda x, y: part[x] != part[y],
            lambda x, y: 100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y]),
            lambda x, y: (signatures[x] == signatures[y]).sum(1) >= LEAST_EQUAL,
            lambda x, y: ~((prints[x] == prints[y]) & (np.arange(BANDS) < band[x][:, None])).any(1),
        ):
            kept = keep(x, y)
            x, y = x[kept], y[kept]
        found.append(np.stack([x, y]))
        at = to
    return np.concatenate(found, axis=1)


def _pairs_in_blocks(percent: int):
    """Possible pairs of each block of a bucket: a member outside the leading component, and one of another.

    The rows of a block come one after the other. Out come the nodes of the pairs, one row each,
    the greater of a pair with its partners as a list.
    """
    keys = ["bucket", "row", "col"]

    def rows(done):
        key = np.stack([done[k].to_numpy().astype(np.int64) for k in keys])
        fresh = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])
        starts, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        node, part, band, sizes, ask = (done[n].to_numpy() for n in ("node", "component", "band", "n_shingles", "asks"))
        prints = done["prints"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        signatures = np.frombuffer(b"".join(done["signature"].to_pylist()), np.uint8).reshape(len(node), -1)
        x, y = _near_pairs(ask, group, part, band, sizes, prints, signatures, percent)
        pairs = np.stack([group[x], np.maximum(node[x], node[y]), np.minimum(node[x], node[y])])
        pairs = pairs[:, np.lexsort(pairs[::-1])]
        pairs = pairs[:, np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(0)])[: pairs.shape[1]]]  # two askers meet both ways
        at = np.flatnonzero(np.concatenate([[True], (pairs[:2, 1:] != pairs[:2, :-1]).any(0)])[: pairs.shape[1]])
        heads = pairs[:2, at]
        names = set(map(tuple, heads.T.tolist()))
        others = [t for t in map(tuple, np.unique(pairs[::2], axis=1).T.tolist()) if t not in names]
        block = starts[np.concatenate([heads[0], np.array([g for g, _ in others], np.int64)])]
        ends = np.concatenate([at, np.full(1 + len(others), pairs.shape[1])]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                *(pa.array(key[i, block], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))),
                pa.array([*heads[1].tolist(), *(n for _, n in others)], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(pairs[2])),
            ],
            names=[*keys, "node", "partners"],
        )

    def run(batches):
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            if held is None or not held.num_rows:
                continue
            key = np.stack([held[k].to_numpy().astype(np.int64) for k in keys])
            starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            whole = held.num_rows if batch is None else int(starts[-1])  # the last block may go on in the next batch
            done, held = held.slice(0, whole), held.slice(whole)
            at = 0
            while at < whole:  # few rows at a time, but whole blocks, so that their pairs stay small
                to = int(np.append(starts, whole)[np.searchsorted(np.append(starts, whole), min(at + BLOCK, whole))])
                yield rows(done.slice(at, to - at))
                at = to

    return run


def _verify_block(percent: int):
    """Links between the nodes of a block, of those that are connected already in the block none."""

    def run(pdf):
        import pandas as pd

        nodes = pdf["node"].to_numpy()
        order = np.argsort(nodes)
        sizes = np.array([len(x) for x in pdf["shingles"]], np.int64)
        starts = np.cumsum(sizes) - sizes
        ids = np.unique(np.concatenate(list(pdf["shingles"])), return_inverse=True)[1]
        mark = np.zeros(len(ids), np.uint8)
        part = np.arange(len(nodes))
        links = []
        for a, partners in enumerate(pdf["partners"]):
            if partners is None or not len(partners):
                continue
            every = order[np.searchsorted(nodes[order], partners)]
            own = ids[starts[a] : starts[a] + sizes[a]]
            mark[own] = 1
            for b in np.array_split(every, 1 + sizes[every].sum() // SHINGLES_AT_ONCE):
                b = b[part[b] != part[a]]
                if not len(b):
                    continue
                n = sizes[b]
                first = np.cumsum(n) - n
                same = np.add.reduceat(mark[ids[np.repeat(starts[b] - first, n) + np.arange(n.sum())]], first, dtype=np.int64)
                for k in b[100 * same >= percent * (sizes[a] + n - same)]:
                    if part[k] != part[a]:
                        part[part == part[k]] = part[a]
                        links.append((nodes[a], nodes[k]))
            mark[own] = 0
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _cross_links(members: DataFrame, labels: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that meet in a bucket; members(bucket, band, node, n, shingles).

    Blocks first find the pairs that can reach the threshold, then get the shingle sets of just the nodes
    in those pairs, each once a block, and verify inside the task: pairs are at no time rows.
    """
    named = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    per = named.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    top = per.groupBy("bucket").agg(
        F.max_by("component", F.struct("k", -F.col("component"))).alias("top"), F.count("*").alias("parts"), (F.sum("k") - F.max("k")).alias("askers")
    )
    open_ = named.join(materialize(top.where("parts > 1"), "open"), "bucket").join(signatures, "node")
    # a bucket of over BLOCK members, or of long ones, becomes a grid: askers in rows, as many as they need, and members in columns
    columns_ = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    columns_ = F.least(columns_, F.col("n")).cast("int")
    rows_ = F.least(F.greatest(F.lit(1), F.ceil(columns_ * F.col("askers") / F.col("n"))), F.col("askers")).cast("int")
    place = lambda parts: F.pmod(F.xxhash64("node"), parts.cast("long")).cast("int")
    cells = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    columns = ["bucket", "band", "node", "component", "n_shingles", "prints", "signature"]
    member = open_.select(*columns, F.lit(False).alias("asks"), place(columns_).alias("col"), cells(rows_).alias("row"))
    asks = open_.where(F.col("component") != F.col("top")).select(*columns, F.lit(True).alias("asks"), cells(columns_).alias("col"), place(rows_).alias("row"))
    block = ["bucket", "row", "col"]
    dealt = member.unionByName(asks).repartition(*block).sortWithinPartitions(*block)  # most blocks are small: a task takes many at once
    likely = dealt.mapInArrow(_pairs_in_blocks(percent), "bucket long, row int, col int, node long, partners array<long>")
    likely = materialize(likely, "likely").join(sets, "node")
    return likely.groupBy(*block).applyInPandas(_verify_block(percent), "a long, b long").distinct()


def _sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Shingle sets of nodes(node, least, fp1, fp2): of the text of document `least` with these fingerprints.

    Up to BROADCAST_IDS ids go to where the texts are; more meet the texts in a shuffle.
    """
    ids = nodes.select(F.col("least").alias("doc_id")).distinct()
    small = ids.count() <= BROADCAST_IDS
    texts_of = docs.select("doc_id", "text").join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
    got = texts_of.mapInArrow(_sets, "least long, fp1 long, fp2 long, shingles array<long>")
    return materialize(got.join(nodes, ["least", "fp1", "fp2"]).select("node", "shingles").dropDuplicates(["node"]), "sets")


def _same_ids(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of one doc_id that has several texts."""
    ids = full.groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("fp1", "fp2") for f in (F.min, F.max)])
    several = materialize(ids.where("min_fp1 <> max_fp1 or min_fp2 <> max_fp2").select("doc_id"), "repeated-ids")
    rows = full.select("doc_id", *CLASS).join(several, "doc_id").join(classes.select(*CLASS, "node"), CLASS).select("doc_id", "node").distinct()
    first = rows.groupBy("doc_id").agg(F.min("node").alias("b"))
    return rows.join(first, "doc_id").select(F.col("node").alias("a"), "b").where("a <> b")


#: What texts with one and the same set of shingles share.
CLASS = ["fp1", "fp2", "n_shingles"]


def _components(docs: DataFrame, percent: int, through_ids: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, CLASS) of all documents, and classes (CLASS, component_id, first) of those with words.

    component_id is the smallest doc_id reachable by links; first is the doc_id and node of the class that holds it.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    sketches = materialize(numbered.mapInArrow(_sketch, SKETCH), "sketches")
    full = sketches.where("n_shingles > 0")
    # a class is named by the number of one of its rows, which stands for it
    classes = materialize(full.groupBy(*CLASS).agg(F.min("doc_id").alias("least"), F.min("row").alias("node")), "classes")
    one = sketches.join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    exploded = one.select(F.col("row").alias("node"), F.col("n_shingles").cast("int").alias("size"), F.posexplode("buckets").alias("band", "bucket"))
    shared = materialize(exploded.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).where("n > 1"), "shared")
    members = materialize(exploded.drop("size").join(shared, "bucket"), "members")
    near_nodes = members.groupBy("node").agg(F.sum("n").alias("weight"))
    signatures = materialize(one.select(F.col("row").alias("node"), "n_shingles", "signature", F.col("buckets").alias("prints")).join(near_nodes, "node"), "signatures")

    best = members.join(signatures.select("node", "weight"), "node").groupBy("bucket").agg(
        F.max_by("node", F.struct("weight", -F.col("node"))).alias("leader")
    )
    stars = members.join(materialize(best, "leaders"), "bucket").where("node <> leader")
    stars = stars.select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct()
    one_side = signatures.select(F.col("node").alias("a"), F.col("signature").alias("x"))
    other = signatures.select(F.col("node").alias("b"), F.col("signature").alias("y"))
    likely = materialize(stars.join(one_side, "a").join(other, "b").mapInArrow(_likely, "a long, b long"), "likely")

    sets = _sets_of(docs, classes.join(signatures.select("node"), "node", "left_semi"))
    links = _verify(likely, sets, percent)
    links = links.unionByName(_same_ids(full, classes)) if through_ids else links
    labels = connected_components(links)
    more = materialize(_cross_links(members, labels, signatures.drop("weight"), sets, percent), "links")
    if not more.isEmpty():
        labels = _merge(labels, more)

    rooted = classes.join(labels, "node", "left").withColumn("root", F.coalesce("component", "node"))
    order = F.struct(F.col("least").isNull().alias("unnamed"), "least", "node")  # a null id comes last
    least = materialize(rooted.groupBy("root").agg(F.min(order).alias("first")), "least")
    named = rooted.join(least, "root").select(*CLASS, F.col("first.least").alias("component_id"), (F.col("first.node") == F.col("node")).alias("leads"))
    return sketches, materialize(named, "components")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    sketches, named = _components(docs, percent, True)
    rows = sketches.select("doc_id", *CLASS).join(named, CLASS, "left")  # empty sets are in no class
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _classes_of(at: int):
    """A batch's columns with the class of each text; `at` is the place of the texts."""

    def run(batches):
        for batch in slices(batches, 2_000_000):
            many = [t or "" for t in batch.column(at).to_pylist()]
            rows, hashes = shingle_hashes(many)
            sizes = np.bincount(rows, minlength=len(many))
            full = np.flatnonzero(sizes)
            prints = np.zeros((2, len(many)), np.uint64)
            if len(full):
                prints[:, full] = _fingerprints(hashes, (np.cumsum(sizes) - sizes)[full])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(p.view(np.int64)) for p in prints), pa.array(sizes.astype(np.int64))], names=[f"c{i}" for i in range(batch.num_columns)] + CLASS
            )

    return run


def first_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows of docs without near copies: of each component one row stays, with the smallest doc_id, and all texts without words do.

    Links are of texts alone: rows that repeat a doc_id with other texts are judged each by its own. All columns are kept as they are.
    """
    sketches, named = _components(docs, percent, False)
    with_words = sketches.where("n_shingles > 0")
    # by id and class: whether its row stays, the smallest id of the class that leads its component
    per = with_words.groupBy("doc_id", *CLASS).agg(F.count("*").alias("n")).join(named, CLASS)
    judged = materialize(per.select("doc_id", *CLASS, "n", (F.col("leads") & F.col("component_id").eqNullSafe(F.col("doc_id"))).alias("stays")), "judged")
    unclear = materialize(judged.where("not stays or n > 1").select("doc_id").distinct(), "unclear")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (f"c{names.index(n)}" for n in ("doc_id", "text"))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_id"))
    ids = unclear.select(F.col("doc_id").alias("_id"))
    clear = plain.join(ids, same, "left_anti")
    # of these, only ids with a row that stays, or with a text without words, have their texts read again
    again = judged.where("stays").select("doc_id").unionByName(sketches.where("n_shingles = 0").select("doc_id")).distinct()
    again = materialize(again.join(unclear.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"), "again")
    some = plain.join(again.select(F.col("doc_id").alias("_id")), same, "left_semi")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields) + ", fp1 long, fp2 long, n_shingles long"
    classed = materialize(some.mapInArrow(_classes_of(names.index("text")), schema), "classed")
    alike = same & (F.col("fp1") == F.col("_fp1")) & (F.col("fp2") == F.col("_fp2")) & (F.col("n_shingles") == F.col("_n"))
    stay = judged.where("stays").select(F.col("doc_id").alias("_id"), F.col("fp1").alias("_fp1"), F.col("fp2").alias("_fp2"), F.col("n_shingles").alias("_n"))
    held = classed.where("n_shingles > 0").join(stay, alike, "left_semi")
    # rows of one id and class: the first by their whole content
    content = F.sha2(F.to_json(F.struct(*plain.columns)), 256)
    parts = [doc_id, *CLASS]
    one = held.withColumn("_sha", content).withColumn("_i", F.row_number().over(Window.partitionBy(*parts).orderBy("_sha"))).where("_i = 1")
    out = clear.unionByName(one.select(*plain.columns)).unionByName(classed.where("n_shingles = 0").select(*plain.columns))
    return out.toDF(*names)


def _likely(batches):
    for batch in batches:
        at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        x, y = (np.frombuffer(b"".join(at[n].to_pylist()), np.uint8).reshape(-1, PERMUTATIONS) for n in "xy")
        keep = pa.array((x == y).sum(1) >= LEAST_EQUAL)
        yield pa.RecordBatch.from_arrays([at["a"].filter(keep), at["b"].filter(keep)], names=["a", "b"])
