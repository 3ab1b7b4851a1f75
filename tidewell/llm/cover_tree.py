"""Operator 11: near-duplicate vectors, exactly, by a cover tree and a dual traversal.

Unit vectors have cosine >= c where their distance is <= t = sqrt(2 - 2c), so bounds of distances decide.

1. Vectors that are one and the same become one class, so thousands of copies cost one row from here on.
2. The upper levels of the tree are nested nets of halving radii over a sample of at most SAMPLE classes.
   Each class goes to its nearest centre; a cell's covering radius is the largest distance found, over all.
3. Traversal of cell pairs by centre distance d and radii a, b: d - a - b > t prunes, d + a + b <= t links
   all with all, without looking at them; other pairs are open.
4. A vector visits the cells of open pairs that it may reach: within radius and t of the centre, and within
   t of the plane between the two centres. Cells and their visitors meet in blocks, the visitors as a stream.
5. In a block both sides become small trees with halving radii, and the same traversal goes down them;
   leaves are compared by products in double precision. A level that gathers few points is not made.
6. Out come a count for each class and the edges of a spanning forest; components by large-star and small-star.

Where vectors are clustered, whole cells are pruned or linked. Vectors that all lie at about the same
distance of each other leave the bounds nothing, and all blocks meet, by one product of matrices each.

Null or zero vectors, and those with null or non-finite components, link with nothing. Vectors of other
lengths than each other's don't link; each length is a pass of its own. Rows that repeat a vec_id are
vectors of their own, and a null vec_id is one too: its component is the smallest id that is not null, and
without any it is null and the row kept. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices
from .minhash import connected_components

COSINE = 0.9
#: Classes that are read to lay out the upper levels, and the bytes and number of their centres at most.
SAMPLE, CENTRE_BYTES, CENTRES = 16_384, 16_000_000, 4_096
#: Members of a cell that the layout aims at, and that meet in one block at most (larger cells are several blocks).
BLOCK = 8_192
#: Blocks of visitors that a block of members meets in one task.
STREAM = 16
#: Points of a leaf; children tried at a node; points that a child gathers at least.
SHAPE = 64, 16, 8
#: Rows of a product at once.
ROWS = 1_024
#: Distances this close to a bound are not decided by it.
SLACK = 1e-9


def _units(raw: list[bytes] | np.ndarray, single: bool) -> np.ndarray:
    """Unit vectors in double precision from their bytes."""
    x = np.frombuffer(b"".join(raw), np.float32 if single else np.float64).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pack(batches):
    """Rows (row, id, dim, raw): the bytes of each vector, null where it links with nothing."""
    for batch in slices(batches):
        lists = batch.column(2)
        lists = lists.cast(pa.large_list(lists.type.value_type))
        values, sizes = lists.flatten(), np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        missing = np.asarray(values.is_null().to_numpy(zero_copy_only=False))
        x = values.fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        marks = lambda b: np.concatenate([[0], np.cumsum(b)])
        bad, full = marks(missing | ~np.isfinite(x)), marks(x != 0)
        good = (bad[ends] == bad[ends - sizes]) & (full[ends] > full[ends - sizes])
        width = x.dtype.itemsize
        data = x.tobytes()
        raw = [data[(e - n) * width : e * width] if g else None for e, n, g in zip(ends.tolist(), sizes.tolist(), good.tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes.astype(np.int32)), pa.array(raw, pa.binary())], names=["row", "id", "dim", "raw"])


def lay_out(x: np.ndarray, k: int, t: float) -> np.ndarray:
    """Places of at most k centres among the rows of x: nested nets of halving radii.

    A level takes half of the centres left at most, so that dense places get finer ones.
    """
    least = np.full(len(x), 4.0)
    chosen: list[int] = []
    radius = 1.0
    while len(chosen) < k and radius > t / 16:
        room = max(1, (k - len(chosen) + 1) // 2) if radius / 2 > t / 16 else k - len(chosen)
        for _ in range(room):
            far = np.flatnonzero(least > radius)
            if not len(far):
                break
            chosen.append(int(far[0]))
            least = np.minimum(least, np.sqrt(np.maximum(0, 2 - 2 * (x @ x[far[0]]))))
        radius /= 2
    return np.array(chosen, np.int64)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def _homes(centres: np.ndarray, single: bool):
    def run(batches):
        for batch in slices(batches):
            x = _units(batch.column(2).to_pylist(), single)
            home, least = [], []
            for at in range(0, len(x), ROWS):
                d = _distances(x[at : at + ROWS], centres)
                best = d.argmin(1)
                home.append(best)
                least.append(d[np.arange(len(best)), best])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(home).astype(np.int32)), pa.array(np.concatenate(least))], names=["node", "copies", "raw", "home", "far"]
            )

    return run


def _mixed(node: np.ndarray) -> np.ndarray:
    """A number for each node by which the members of a cell are dealt to blocks."""
    x = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def _pieces(batches, rows: int):
    """Batches of at most so many rows, so that a table of rows by centres stays small."""
    for batch in slices(batches):
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def turns(k: int) -> np.ndarray:
    """Of k cells, [home, cell]: whether home's vectors visit the cell; of two cells one visits the other, by turns."""
    home, cell = np.indices((k, k))
    return (home == cell) | ((cell < home) ^ ((cell + home) % 2 == 1))


def _visits(centres, radii, open_, blocks, streams, t: float, single: bool):
    """Rows (cell, block, stream, kind, node, copies, raw): members (kind 0) and visitors (1) of each block.

    A pair of cells meets in one of them; a cell of several blocks has its members visit the blocks before theirs.
    """
    between, visiting = _distances(centres, centres), open_ & turns(len(centres))

    def run(batches):
        for batch in _pieces(batches, max(1, 2_000_000 // len(centres))):
            node, home = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            x = _units(batch.column(2).to_pylist(), single)
            d = _distances(x, centres)
            own, deal = d[np.arange(len(x)), home], _mixed(node)
            block = (deal % blocks[home].astype(np.uint64)).astype(np.int64)
            out = []
            member = np.flatnonzero(open_[home].any(1))
            for j in range(int(streams[home[member]].max()) if len(member) else 0):
                m = member[streams[home[member]] > j]
                out.append((home[m], block[m], np.full(len(m), j), np.zeros(len(m), int), m))
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d * d - (own * own)[:, None]) / (2 * between[home])
            reach = visiting[home] & (d <= radii + t + SLACK) & ((plane <= t + SLACK) | ~np.isfinite(plane))
            who, cell = np.nonzero(reach)
            for i in range(int(blocks[cell].max()) if len(cell) else 0):
                v = (blocks[cell] > i) & ((cell != home[who]) | (i < block[who]))
                w, c = who[v], cell[v]
                out.append((c, np.full(len(w), i), ((deal[w] >> np.uint64(12)) % streams[c].astype(np.uint64)).astype(np.int64), np.ones(len(w), int), w))
            if not out:
                continue
            key = [np.concatenate(part) for part in zip(*out)]
            for at in range(0, len(key[0]), 20_000):
                piece = [k[at : at + 20_000] for k in key]
                rows = batch.take(pa.array(piece[4]))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(k.astype(np.int32)) for k in piece[:4]), rows.column(0), rows.column(1), rows.column(2)],
                    names=["cell", "block", "stream", "kind", "node", "copies", "raw"],
                )

    return run


class Tree:
    """A small cover tree: nodes (centre, radius, points, children), each child of half the radius at most."""

    def __init__(self, x: np.ndarray, t: float, shape: tuple[int, int, int] = SHAPE):
        self.x, self.t, self.shape = x, t, shape
        self.root = self._node(np.arange(len(x)))

    def _node(self, points: np.ndarray, grow: bool = True) -> tuple:
        centre = self.x[points[0]]
        d = np.sqrt(np.maximum(0, 2 - 2 * (self.x[points] @ centre)))
        radius, children = float(d.max()), []
        leaf, most, gathers = self.shape
        if grow and len(points) > leaf and 2 * radius > self.t:
            rest, loose = points, []
            for _ in range(most):
                if not len(rest):
                    break
                near = np.sqrt(np.maximum(0, 2 - 2 * (self.x[rest] @ self.x[rest[0]]))) <= radius / 2
                near[0] = True
                gathered, rest = rest[near], rest[~near]
                if len(gathered) >= gathers:
                    children.append(self._node(gathered))
                else:
                    loose.append(gathered)
            if children and (loose or len(rest)):
                children.append(self._node(np.concatenate([*loose, rest]), grow=False))
        return centre, radius, points, children


class Block:
    """The members of a block, what has been counted for them, and which of them are connected."""

    def __init__(self, nodes, copies, x: np.ndarray, cosine: float, shape: tuple[int, int, int] = SHAPE):
        self.nodes, self.copies, self.x, self.cosine, self.shape = nodes, copies, x, cosine, shape
        self.t = math.sqrt(2 - 2 * cosine)
        self.tree = Tree(x, self.t, shape)
        self.counts, self.part = np.zeros(len(x), np.int64), np.arange(len(x))

    def _linked(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        cos = x @ y.T
        mask = cos >= self.cosine
        for i, j in zip(*np.nonzero(np.abs(cos - self.cosine) < 1e-13)):  # a product's order of sums must not decide
            mask[i, j] = math.fsum(x[i] * y[j]) >= self.cosine
        return mask

    def meet(self, nodes=None, copies=None, x=None) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Compare with visitors, or with itself: what visitors count, and edges that connect two parts."""
        alone = x is None
        if alone:
            nodes, copies, x, tree = self.nodes, self.copies, self.x, self.tree
        else:
            tree = Tree(x, self.t, self.shape)
        k = len(self.nodes)
        part = self.part if alone else np.concatenate([self.part, np.arange(k, k + len(x))])
        shift, name = (0, nodes) if alone else (k, np.concatenate([self.nodes, nodes]))
        counts, edges = np.zeros(len(x), np.int64), []

        def join(i: int, j: int) -> None:
            if part[i] != part[j]:
                edges.append((int(name[i]), int(name[j])))
                part[part == part[j]] = part[i]

        def link_all(p: np.ndarray, q: np.ndarray) -> None:
            """Connect the first of p with all of q, and the first of q with all of p."""
            for one, many in ((p[0], q + shift), (q[0] + shift, p)):
                while len(far := many[part[many] != part[one]]):
                    join(one, int(far[0]))

        # counts go to the members' side and to the visitors'; alone, a pair of nodes is met both ways round
        todo = [(self.tree.root, tree.root)]
        while todo:
            a, b = todo.pop()
            d = float(np.sqrt(max(0.0, 2 - 2 * float(a[0] @ b[0]))))
            if d - a[1] - b[1] > self.t + SLACK:
                continue
            if d + a[1] + b[1] <= self.t - SLACK:
                self.counts[a[2]] += copies[b[2]].sum()
                counts[b[2]] += self.copies[a[2]].sum()
                link_all(a[2], b[2])
            elif a[3] and (not b[3] or len(a[2]) >= len(b[2])):
                todo += [(c, b) for c in a[3]]
            elif b[3]:
                todo += [(a, c) for c in b[3]]
            else:
                for at in range(0, len(a[2]), ROWS):
                    p = a[2][at : at + ROWS]
                    mask = self._linked(self.x[p], x[b[2]])
                    if alone:
                        mask |= p[:, None] == b[2]
                    rows, cols = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
                    if not len(rows):
                        continue
                    mask, p, q = mask[np.ix_(rows, cols)], p[rows], b[2][cols]
                    self.counts[p] += mask @ copies[q]
                    counts[q] += mask.T @ self.copies[p]
                    while (apart := mask & (part[p][:, None] != part[q + shift])).any():
                        for i in np.flatnonzero(apart.any(1)):
                            join(int(p[i]), int(q[apart[i].argmax()] + shift))
        if not alone:
            self.part = _renumbered(part)[:k]
        return counts, edges


def _renumbered(part: np.ndarray) -> np.ndarray:
    """The same parts, each named by its first row."""
    first = np.unique(part, return_index=True, return_inverse=True)
    return first[1][first[2]]


def _compare(cosine: float, single: bool, alike: np.ndarray, shape: tuple[int, int, int]):
    """Rows (a, b, n): n classes' copies that a is linked with in a block, or an edge (a, b) with n = 0.

    Rows come by block, members first: these are held, and visitors pass by. In the first stream of a block
    the members also meet each other, unless their cell is `alike`, one that the bounds alone link.
    """

    def rows(counts, edges, nodes):
        some = np.flatnonzero(counts)
        a = np.concatenate([nodes[some], np.array([e[0] for e in edges], np.int64)])
        b = np.concatenate([nodes[some], np.array([e[1] for e in edges], np.int64)])
        n = np.concatenate([counts[some], np.zeros(len(edges), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])

    def run(batches):
        key, held, block = None, [], None

        def ready(own: bool):
            """The block of the members held; `own`: they meet each other here."""
            nodes = np.concatenate([h[0] for h in held])
            made = Block(nodes, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), cosine, shape)
            edges = []
            if own:
                edges = made.meet()[1]
            return made, edges

        for batch in chain(batches, [None]):
            parts = []
            if batch is not None and batch.num_rows:
                keys = np.stack([batch.column(i).to_numpy() for i in range(4)])
                cuts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0), [True]]))
                parts = [(tuple(keys[:, s].tolist()), batch.slice(s, e - s)) for s, e in zip(cuts[:-1], cuts[1:])]
            for now, piece in parts if batch is not None else [((None,) * 4, None)]:
                if now[:3] != key:
                    if held and block is None:  # members without visitors
                        block, edges = ready(key[2] == 0 and not alike[key[0]])
                        yield rows(np.zeros(0, np.int64), edges, block.nodes[:0])
                    if block is not None:
                        yield rows(block.counts, [], block.nodes)
                    key, held, block = now[:3], [], None
                if piece is None:
                    continue
                for at in range(0, piece.num_rows, BLOCK):
                    cut = piece.slice(at, BLOCK)
                    got = cut.column(4).to_numpy(), cut.column(5).to_numpy(), _units(cut.column(6).to_pylist(), single)
                    if now[3] == 0:
                        held.append(got)
                        continue
                    if not held:
                        continue  # visitors of a block without members
                    if block is None:
                        block, edges = ready(key[2] == 0 and not alike[key[0]])
                        yield rows(np.zeros(0, np.int64), edges, block.nodes[:0])
                    counts, edges = block.meet(*got)
                    yield rows(counts, edges, got[0])

    return run


def _forest(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of edges on the driver, a few for each cell at most, those that connect two parts."""
    parent: dict[int, int] = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    kept = []
    for a, b in edges:
        if (ra := root(a)) != (rb := root(b)):
            parent[ra] = rb
            kept.append((a, b))
    return kept


def _links(spark: SparkSession, classes: DataFrame, cosine: float, dim: int, single: bool) -> tuple[DataFrame, DataFrame]:
    """Of classes(node, copies, raw) of one length: (node, n) rows to be summed, n with the node's own copies, and edges (a, b)."""
    t = math.sqrt(2 - 2 * cosine)
    n = classes.count()
    k = max(1, min(CENTRES, CENTRE_BYTES // (8 * dim), -(-n // BLOCK)))
    sample = classes.orderBy(F.xxhash64("node"), "node").select("raw").limit(min(SAMPLE, 4 * k)).collect()
    x = _units([r.raw for r in sample], single)
    centres = x[lay_out(x, k, t)]
    homes = materialize(classes.mapInArrow(_homes(centres, single), "node long, copies long, raw binary, home int, far double"), "homes")
    stats = homes.groupBy("home").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"), F.max("far").alias("far"), F.min("node").alias("first")).collect()
    k = len(centres)
    size, weight, radii, first = np.zeros(k, np.int64), np.zeros(k, np.int64), np.full(k, -1.0), np.full(k, -1, np.int64)
    for r in stats:
        size[r.home], weight[r.home], radii[r.home], first[r.home] = r.n, r.copies, r.far, r.first

    d = _distances(centres, centres)
    np.fill_diagonal(d, 0)
    some = (size > 0)[:, None] & (size > 0)
    reach = radii[:, None] + radii
    whole = some & (d + reach <= t - SLACK)
    open_ = some & ~whole & (d - reach <= t + SLACK)
    blocks = np.maximum(1, -(-size // BLOCK))
    visitors = ((open_ & turns(k)) * size[:, None]).sum(0)
    streams = np.maximum(1, -(-visitors // (STREAM * BLOCK)))

    dealt = homes.select("node", "copies", "raw", "home").mapInArrow(
        _visits(centres, radii, open_, blocks, streams, t, single), "cell int, block int, stream int, kind int, node long, copies long, raw binary"
    )
    keys = ["cell", "block", "stream"]
    found = dealt.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(_compare(cosine, single, whole.diagonal(), SHAPE), "a long, b long, n long")
    found = materialize(found, "found")
    counted = found.where("n > 0").select(F.col("a").alias("node"), "n")
    edges = found.where("n = 0").select("a", "b")

    linked = [c for c in range(k) if whole[c].any()]
    if linked:  # cells that the bounds alone link
        names = spark.createDataFrame([(c, int(weight[whole[c]].sum()), int(first[whole[c].argmax()])) for c in linked], "home int, n long, b long")
        members = homes.join(F.broadcast(names), "home")
        counted = counted.unionByName(members.select("node", "n"))
        between = _forest([(int(first[a]), int(first[b])) for a in linked for b in np.flatnonzero(whole[a, :a])])
        edges = edges.unionByName(members.select(F.col("node").alias("a"), "b").where("a <> b"))
        if between:
            edges = edges.unionByName(spark.createDataFrame(between, "a long, b long"))
    return counted, edges


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """id, n_links (other vectors with cosine >= `cosine`), component_id (smallest id reachable), kept."""
    spark = vectors.sparkSession
    single = dict(vectors.select(F.col(vector_col).alias("v")).dtypes)["v"] == "array<float>"
    kind = F.col(vector_col).cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), kind.alias("v"))
    packed = materialize(rows.mapInArrow(_pack, "row long, id long, dim int, raw binary"), "packed")
    classes = packed.where("raw is not null").groupBy("raw", "dim")
    classes = materialize(classes.agg(F.min("row").alias("node"), F.min("id").alias("least"), F.count("*").alias("copies")), "classes")
    counted, edges = None, None
    for dim in sorted(r.dim for r in classes.select("dim").distinct().collect()):
        c, e = _links(spark, classes.where(F.col("dim") == dim).select("node", "copies", "raw"), cosine, dim, single)
        counted, edges = (c, e) if counted is None else (counted.unionByName(c), edges.unionByName(e))
    if counted is None:
        counted, edges = spark.createDataFrame([], "node long, n long"), spark.createDataFrame([], "a long, b long")
    totals = counted.groupBy("node").agg(F.sum("n").alias("n"))
    labels = connected_components(edges)
    rooted = classes.select("node", "least").join(totals, "node", "left").join(labels, "node", "left").withColumn("root", F.coalesce("component", "node"))
    rooted = materialize(rooted.select("node", "least", "root", "n"), "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = rooted.join(least, "root").select("node", "n", "component_id")
    # a class of one row is that row; only rows of classes with copies look for theirs
    several = classes.where("copies > 1").select("raw", F.col("node").alias("of"))
    nodes = packed.join(several, "raw", "left").select("row", "id", F.coalesce("of", "row").alias("node"))
    out = nodes.join(named, "node", "left").withColumn("component", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
