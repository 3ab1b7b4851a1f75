"""Histogram boosting for all seasons at once: columns as one-byte bins, second-order gains, sibling histograms by subtraction.

A frame has a row an example: features (an array of doubles, null or NaN where unknown), y, weight and `since`, the first
fold whose fit sees it; fold k learns from rows with since <= k. Unknown values are the fold's median, and bins lie between
quantiles of what the fold sees. Barrier tasks keep their share of rows as bins and margins. In a level of all folds' trees they
add up gradients and second derivatives by (fold, node, column, bin), for the smaller child of each split alone: its sibling is
what is left of the parent. From the same sums every task grows the same trees, so KEEP rounds are one job; the driver holds the
trees, whatever the number of examples.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import ordered, together
from tidewell.operators.trees import medians_by_fold
from tidewell.sources import files

#: Bins of a column at most; rounds of a job, at the end of which the driver has the trees so far.
BINS, KEEP = 64, 110


def edges_by_fold(rows: DataFrame, folds: int, d: int) -> list[list[np.ndarray]]:
    """By fold and column the distinct quantiles that part its bins; a value equal to an edge lies below it."""
    long = rows.select("since", F.posexplode("features").alias("column", "x")).where("x is not null and not isnan(x)")
    cells = long.groupBy("since", "column", "x").agg(F.count("*").alias("n"))
    seen = cells.withColumn("fold", F.explode(F.sequence("since", F.lit(folds - 1)))).where(F.col("since") < folds)
    out = [[np.zeros(0) for _ in range(d)] for _ in range(folds)]
    for r in ordered.quantiles(seen, "x", ["fold", "column"], [k / BINS for k in range(1, BINS)], F.col("n")).collect():  # folds by columns
        out[r.fold][r.column] = np.unique(r.q)
    return out


def coded(x: np.ndarray, edges: list[np.ndarray], medians: np.ndarray) -> np.ndarray:
    """Bins of a fold's columns, unknown values as its medians."""
    full = np.where(np.isnan(x), medians, x)
    return np.stack([np.searchsorted(e, full[:, k], side="left") for k, e in enumerate(edges)], 1).astype(np.uint8) if len(edges) else np.zeros((len(x), 0), np.uint8)


def step(trees: list[tuple], codes: np.ndarray) -> np.ndarray:
    """What trees (column, bin, left, right, value) add to the margin of each row."""
    out = np.zeros(len(codes))
    for tree in trees:
        out += tree[4][landed(tree, codes)]
    return out


def landed(tree: tuple, codes: np.ndarray) -> np.ndarray:
    column, cut, left, right, _ = tree
    at = np.zeros(len(codes), np.int64)
    while (inner := column[at] >= 0).any():
        r, a = np.flatnonzero(inner), at[inner]
        at[inner] = np.where(codes[r, column[a]] <= cut[a], left[a], right[a])
    return at


def slopes(loss: str, margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss."""
    if loss == "squared":
        return w * (margin - y), w
    p = 1 / (1 + np.exp(-margin))
    return w * (p - y), w * np.maximum(p * (1 - p), 1e-16)


def best_splits(hist: np.ndarray, penalty: float, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column, bin and gain of the best split of each node; hist[node, column, bin] has gradient, second derivative and rows."""
    left = np.cumsum(hist, axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + penalty)
    gain = score(left) + score(right) - score(whole)
    gain = np.where((left[..., 2] >= leaf) & (right[..., 2] >= leaf), gain, -1.0).reshape(len(hist), -1)
    best = gain.argmax(1)
    return best // hist.shape[2], best % hist.shape[2], gain[np.arange(len(hist)), best]


class Growing:
    """A tree under way: open nodes with their histograms."""

    def __init__(self):
        self.column, self.cut, self.left, self.right, self.value = [-1], [0], [0], [0], [0.0]
        self.open: dict[int, np.ndarray] = {}

    def frozen(self) -> tuple:
        return tuple(np.array(a) for a in (self.column, self.cut, self.left, self.right, self.value))


class Share:
    """The rows of one task, in the order of `since`, so that a fold sees the first ones: bins by fold and column, margins by fold."""

    def __init__(self, y: np.ndarray, w: np.ndarray, since: np.ndarray, codes: np.ndarray, base: np.ndarray, loss: str):
        order = np.argsort(since, kind="stable")
        self.y, self.w, self.loss, self.d = y[order], w[order], loss, codes.shape[2]
        self.seen = np.searchsorted(since[order], np.arange(len(base)), side="right")
        self.codes = [np.ascontiguousarray(codes[order[:n], k].T) for k, n in enumerate(self.seen)]
        self.margin = [np.full(n, base[k]) for k, n in enumerate(self.seen)]

    def begin(self) -> None:
        """Slopes of a round, with all rows at the roots."""
        self.at = [np.zeros(n, np.int32) for n in self.seen]
        self.slopes = [slopes(self.loss, m, self.y[:n], self.w[:n]) for m, n in zip(self.margin, self.seen)]

    def sums(self, fold: int, node: int) -> np.ndarray:
        """By column and bin the slopes and rows of a node."""
        rows = np.flatnonzero(self.at[fold] == node) if node else slice(None)
        g, h = (v[rows] for v in self.slopes[fold])
        out = np.empty((self.d, BINS, 3))
        for c in range(self.d):
            code = self.codes[fold][c][rows]
            for k, v in enumerate((g, h, None)):
                out[c, :, k] = np.bincount(code, v, minlength=BINS)
        return out

    def split(self, fold: int, node: int, column: int, cut: int, left: int, right: int) -> None:
        rows = np.flatnonzero(self.at[fold] == node)
        self.at[fold][rows] = np.where(self.codes[fold][column][rows] <= cut, left, right)

    def move(self, fold: int, tree: tuple) -> None:
        """Add a tree to the margins."""
        self.margin[fold] += step([tree], self.codes[fold].T)

    def end(self, fold: int, tree: tuple) -> None:
        """Add the tree under way, whose nodes the rows are in."""
        self.margin[fold] += tree[4][self.at[fold]]


def grow(share: Share, folds: int, rounds: int, depth: int, rate: float, penalty: float, leaf: int, summed) -> list[list[tuple]]:
    """Further trees of every fold; summed(array) adds the arrays of all tasks, which so come to the same trees."""
    trees: list[list[tuple]] = [[] for _ in range(folds)]
    for _ in range(rounds):
        share.begin()
        growing = [Growing() for _ in range(folds)]
        roots = summed(np.stack([share.sums(k, 0) for k in range(folds)]))
        for t, hist in zip(growing, roots):
            t.open[0] = hist
        for level in range(depth):
            pairs: list[tuple[int, int, int, np.ndarray]] = []
            for k, t in enumerate(growing):
                nodes, t.open = list(t.open.items()), {}
                if not nodes:
                    continue
                column, cut, gain = best_splits(np.stack([h for _, h in nodes]), penalty, leaf)
                for (node, hist), c, b, g in zip(nodes, column.tolist(), cut.tolist(), gain.tolist()):
                    if g <= 1e-12:
                        continue
                    left = hist[c, : b + 1].sum(0)
                    whole = hist[c].sum(0)
                    at = len(t.column)
                    t.column[node], t.cut[node], t.left[node], t.right[node] = c, b, at, at + 1
                    share.split(k, node, c, b, at, at + 1)
                    for s in (left, whole - left):
                        for name, v in (("column", -1), ("cut", 0), ("left", 0), ("right", 0), ("value", -rate * float(s[0] / (s[1] + penalty)))):
                            getattr(t, name).append(v)
                    if level + 1 < depth and whole[2] >= 2 * leaf:
                        less = at if left[2] <= whole[2] - left[2] else at + 1
                        pairs.append((k, less, 2 * at + 1 - less, hist))
            if not pairs:
                break
            got = summed(np.stack([share.sums(k, less) for k, less, _, _ in pairs]))
            for (k, less, more, hist), own in zip(pairs, got):
                growing[k].open[less], growing[k].open[more] = own, hist - own
        for k, t in enumerate(growing):
            trees[k].append(t.frozen())
            share.end(k, trees[k][-1])
    return trees


class Boosted:
    """Base margin, edges, medians and trees by fold."""

    def __init__(self, base, edges, medians, trees, loss):
        self.base, self.edges, self.medians, self.trees, self.loss = base, edges, medians, trees, loss

    def margins(self, x: np.ndarray, fold: int) -> np.ndarray:
        return self.base[fold] + step(self.trees[fold], coded(x, self.edges[fold], self.medians[fold]))


def fit(rows: DataFrame, folds: int, rounds: int, depth: int, rate: float, penalty: float, leaf: int, loss: str = "squared") -> Boosted:
    """Boosted trees of every fold; rows(features, y, weight, since)."""
    first = rows.select(F.size("features").alias("d")).first()
    d = first.d if first else 0
    medians, edges = medians_by_fold(rows, folds, d), edges_by_fold(rows, folds, d)
    sums = rows.groupBy("since").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("y")).alias("s")).collect()
    mean = np.array([sum(r.s for r in sums if r.since <= k) / (sum(r.w for r in sums if r.since <= k) or 1.0) for k in range(folds)])
    share = np.clip(mean, 1e-6, 1 - 1e-6)
    base = mean if loss == "squared" else np.log(share / (1 - share))
    trees: list[list[tuple]] = [[] for _ in range(folds)]
    if not d:
        return Boosted(base, edges, medians, trees, loss)

    def binned(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, d)
            codes = np.stack([coded(x, edges[k], medians[k]) for k in range(folds)], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in codes], pa.binary())], names=["y", "weight", "since", "codes"])

    learn = rows.select("y", "weight", "since", "features").where("y is not null")
    tasks = together.tasks(rows.sparkSession, learn.count())
    table = files.once(learn.mapInArrow(binned, "y double, weight double, since int, codes binary"), "binned").repartition(tasks)

    def job(done: list[list[tuple]], more: int):
        path = files.shared_path(rows.sparkSession, "sums")

        def run(batches):
            context = BarrierTaskContext.get()
            parts = [[np.zeros(0), np.zeros(0), np.zeros(0, np.int32), np.zeros((0, folds, d), np.uint8)]]
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, folds, d)
                parts.append([*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)), codes])
            share = Share(*(np.concatenate(p) for p in zip(*parts)), base, loss)
            del parts
            for k in range(folds):
                for tree in done[k]:
                    share.move(k, tree)
            new = grow(share, folds, more, depth, rate, penalty, leaf, together.Sums(context, path))
            if context.partitionId() == 0:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(new)], pa.binary())], names=["trees"])

        return pickle.loads(table.mapInArrow(run, "trees binary", barrier=True).collect()[0].trees)  # every task has to run, as `first` would not let it

    for at in range(0, rounds, KEEP):
        for mine, new in zip(trees, job(trees, min(KEEP, rounds - at))):
            mine += new
    return Boosted(base, edges, medians, trees, loss)


def predict(df: DataFrame, model: Boosted, fold: str = "fold", features: str = "features", name: str = "predicted") -> DataFrame:
    """df with the value, or the probability of class 1, by the trees of the row's fold."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by rounds and depth

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            x = batch.column(names.index(features)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            of = batch.column(names.index(fold)).to_numpy(zero_copy_only=False)
            out = np.zeros(batch.num_rows)
            for k in np.unique(of):
                out[of == k] = sent.value.margins(x[of == k], k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out if sent.value.loss == "squared" else 1 / (1 + np.exp(-out)))], names=[*names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, {name} double")
