"""Bootstrap of entities: exact draws of N out of N, and one order of rows that serves all draws.

Entities are numbered densely by ranges. A draw's counts come from splitting N over halves of the numbers by binomial
draws, down to a slice of numbers and a multinomial draw inside it. Every split is seeded by its place, so any task finds the counts of
its slice alone, all draws at once, and a draw's counts sum to N. Rows carry the counts of their entity, a byte a draw.

Rows are dealt by ranges of (group, value) and sorted once: places of a range are running sums over its counts, a vector
over draws, and ranges of a group follow one another by their totals, a row a range. Equal values of a group stay in one range.
Totals of ranges come in one job a pass; a job a range would leave one task at work at a time. However many rows share a value, a task
holds LONG of them at most: rows of a longer run are written before its weight is known, and its place comes with the totals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tidewell.operators import ordered
from tidewell.sources import files

#: Entities of a slice; rows that a task works on at a time; rows of one value that it holds at most; parts of a range in which rows of such values come.
SLICE, ROWS, LONG, PARTS = 1_024, 2_048, 16_384, 1 << 32


def counts(n: int, at: int, draws: int, seed: int, slice_: int = SLICE) -> np.ndarray:
    """Counts (draw, entity) of the entities of slice `at` among n, each draw being n entities with replacement."""
    generator = lambda *place: np.random.Generator(np.random.Philox(key=seed * 1_000_003 + hash_of(place)))
    low, high = 0, -(-n // slice_)
    left = np.full(draws, n, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        first, every = (middle - low) * slice_, min(high * slice_, n) - low * slice_
        taken = generator(low, high).binomial(left, first / every)
        if at < middle:
            high, left = middle, taken
        else:
            low, left = middle, left - taken
    size = min((at + 1) * slice_, n) - at * slice_
    return generator(at, at).multinomial(left, np.full(size, 1 / size))


def hash_of(place: tuple[int, int]) -> int:
    x = 0x9E3779B97F4A7C15
    for p in place:
        x = ((x ^ (p + 1)) * 0xBF58476D1CE4E5B9) % (1 << 64)
        x ^= x >> 31
    return x % (1 << 62)


def weighted(df: DataFrame, draws: int, seed: int = 7) -> DataFrame:
    """df with `w`, the counts of its entity as bytes, one a draw; written once.

    Rows go to the task of their entity's slice, which finds the counts itself: a table of counts, 500 bytes an entity that a planner
    takes for a few, would be sent through the driver to each task.
    """
    entities = ordered.row_numbers(df.select("entity").distinct(), "_i", [], F.col("entity"))
    entities = files.once(entities, "entities")
    n, size, spark = entities.count(), SLICE, df.sparkSession
    numbered = df.join(entities.hint("merge"), "entity")  # never broadcast, however well the numbers are packed
    names = [c for c in numbered.columns if c != "_i"]

    def run(batches):
        at, own = -1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column(batch.schema.get_field_index("_i")).to_numpy() - 1
            w = np.empty((len(numbers), draws), np.uint8)
            for place, start, end in _segments(numbers // size):
                if place != at:
                    at, own = place, np.ascontiguousarray(counts(n, int(place), draws, seed, size).astype(np.uint8).T)
                w[start:end] = own[numbers[start:end] % size]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), _bytes(w)], names=[*names, "w"])

    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // size)))
    dealt = numbered.repartition(parts, F.floor((F.col("_i") - 1) / size)).sortWithinPartitions("_i")
    return files.once(dealt.mapInArrow(run, StructType([*(numbered.schema[c] for c in names), StructField("w", BinaryType())])), "weighted")


def _chunks(batches, most: int):
    """At most so many rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield pa.Table.from_batches([batch.slice(start, most)])


def _runs(batches, keys: list[str], most: int, long: int):
    """(rows, kind) so that rows with equal keys, which follow one another, are not parted: kind is "whole" then.

    A run of over `long` rows is not held: its rows come as parts of kind "long", and no rows of kind "end" after them.
    """
    held, open_ = None, None
    same = lambda table, at: np.logical_and.reduce([pc.fill_null(pc.equal(table[k], v), False).to_numpy() for k, v in zip(keys, at)])
    for table in _chunks(batches, most):
        if open_ is not None:
            other = np.flatnonzero(~same(table, open_))
            more = int(other[0]) if len(other) else table.num_rows
            if more:
                yield table.slice(0, more), "long"
            if more == table.num_rows:
                continue
            yield table.slice(0, 0), "end"
            table, open_ = table.slice(more), None
        table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        last = [table[k][table.num_rows - 1] for k in keys]
        other = np.flatnonzero(~same(table, last))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield table.slice(0, cut), "whole"
        held = table.slice(cut)
        if held.num_rows > long:
            yield held, "long"
            held, open_ = None, last
    if open_ is not None:
        yield table.slice(0, 0), "end"
    elif held is not None:
        yield held, "whole"


def _matrix(column, kind, draws: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, draws)


def _bytes(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m)
    return pa.array([row.tobytes() for row in m], pa.binary())


def _segments(keys) -> list[tuple[str, int, int]]:
    """(key, first row, row after the last) of each run of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist()
    return [(keys[s], s, e) for s, e in zip(starts, [*starts[1:], len(keys)])]


def _places(keys, values, w: np.ndarray, before: dict) -> np.ndarray:
    """Twice the weighted mean places of rows sorted by (key, value) in their range, by draw; `before` keeps each key's weight so far."""
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])]))
    ties = np.add.reduceat(w, starts, axis=0, dtype=np.int64)
    upto = np.empty_like(ties)
    for key, first, end in _segments(keys[starts]):
        upto[first:end] = np.cumsum(ties[first:end], axis=0) + before.get(key, 0)
        before[key] = upto[end - 1].copy()
    return np.repeat(2 * upto - ties + 1, np.diff(np.append(starts, len(keys))), axis=0)


def draw_spearman(df: DataFrame, draws: int, seed: int = 7, group: list[str] = ("season", "position"), predicted: str = "predicted") -> DataFrame:
    """(draw, value): macro rank correlation of the resampled rows, with average ranks; groups without rows in a draw are left out."""
    rows = df if "w" in df.columns else weighted(df, draws, seed)
    rows = rows.select(F.to_json(F.struct(*group)).alias("g"), F.col("actual").cast("double").alias("a"), F.col(predicted).cast("double").alias("p"), "w")
    step, most = ROWS, LONG

    def first(batches):
        before: dict = {}
        part, long, of, weight = TaskContext.get().partitionId() * PARTS, 0, None, None
        empty = lambda g, at, vectors: pa.RecordBatch.from_arrays(
            [pa.array(g), pa.array(at, pa.int64()), pa.nulls(len(g), pa.float64()), pa.nulls(len(g), pa.binary()), _bytes(np.stack(vectors).astype(float))], names=["g", "part", "p", "w", "place"]
        )
        for table, kind in _runs(batches, ["g", "a"], step, most):
            if kind == "end":  # the place of the run in its range
                yield empty([of], [part + long], [before.get(of, 0) + (weight + 1) / 2])
                before[of], weight = before.get(of, 0) + weight, None
                continue
            keys, w = np.array(table["g"].to_pylist(), object), _matrix(table["w"], np.uint8, draws)
            if kind == "whole":
                at, place = part, _places(keys, table["a"].to_numpy(), w, before)
            else:
                if weight is None:
                    long, of, weight = long + 1, keys[0], np.zeros(draws, np.int64)
                weight += w.sum(0, dtype=np.int64)
                at, place = part + long, np.zeros(w.shape)
            yield pa.RecordBatch.from_arrays(
                [table["g"].combine_chunks(), pa.array(np.full(len(keys), at, np.int64)), table["p"].combine_chunks(), table["w"].combine_chunks(), _bytes(place.astype(np.uint32))], names=["g", "part", "p", "w", "place"]
            )
        if before:
            yield empty(list(before), np.full(len(before), part), [*before.values()])

    dealt = rows.repartitionByRange("g", "a").sortWithinPartitions("g", "a")
    path, spark = files.shared_path(df.sparkSession, "places"), df.sparkSession
    one = dealt.mapInArrow(first, "g string, part long, p double, w binary, place binary")
    one.write.parquet(path)
    one = spark.read.schema(one.schema).parquet(path)
    totals: dict[str, list] = {}
    for r in one.where("w is null").select("g", "part", "place").collect():  # a row a range and group in it, and one for LONG rows of a value
        totals.setdefault(r.g, []).append((r.part, np.frombuffer(r.place)))
    offset = {}
    for g, parts in totals.items():
        run = np.zeros(draws)
        for part, total in sorted(parts, key=lambda x: x[0]):  # a range comes before its long runs
            if part % PARTS:
                offset[g, part] = offset[g, part - part % PARTS] + total
            else:
                offset[g, part], run = run, run + total
    sent = spark.sparkContext.broadcast(offset)

    def second(batches):
        before: dict = {}
        sums: dict = {}
        at, weight, wx = None, None, None  # the last value so far, of which rows may follow

        def placed(g, weights, wxs):
            """Add what depends on the second place: rows of a value share it."""
            upto = np.cumsum(weights, axis=0) + before.get(g, 0)
            y = (2 * upto - weights + 1) / 2
            wy = weights * y
            sums[g][[0, 3, 4, 5]] += np.stack([weights.sum(0), wy.sum(0), np.einsum("rd,rd->d", wy, y), np.einsum("rd,rd->d", wxs, y)])
            before[g] = upto[-1].copy()

        for table in _chunks(batches, step):
            keys, values, w = np.array(table["g"].to_pylist(), object), table["p"].to_numpy(), _matrix(table["w"], np.uint8, draws)
            parts = table["part"].to_numpy()
            inside = _matrix(table["place"], np.uint32, draws)
            for g, start, end in _segments(keys):
                some, of = np.unique(parts[start:end], return_inverse=True)
                x = inside[start:end] / 2 + np.stack([sent.value[g, p] for p in some.tolist()])[of]
                own = sums.setdefault(g, np.zeros((6, draws)))
                by_row = w[start:end] * x
                own[[1, 2]] += np.stack([by_row.sum(0), np.einsum("rd,rd->d", by_row, x)])
                v = values[start:end]
                starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
                weights, wxs = np.add.reduceat(w[start:end], starts, axis=0, dtype=np.int64), np.add.reduceat(by_row, starts, axis=0)
                if at == (g, v[0]):
                    weights[0] += weight
                    wxs[0] += wx
                elif at is not None:
                    placed(at[0], weight[None], wx[None])
                if len(starts) > 1:
                    placed(g, weights[:-1], wxs[:-1])
                at, weight, wx = (g, v[-1]), weights[-1].copy(), wxs[-1].copy()
        if at is not None:
            placed(at[0], weight[None], wx[None])
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(np.full(len(sums), part, np.int32)), _bytes(np.stack([s.ravel() for s in sums.values()]) if sums else np.zeros((0, 1)))], names=["g", "part", "sums"])

    dealt = one.where("w is not null").repartitionByRange("g", "p").sortWithinPartitions("g", "p").mapInArrow(second, "g string, part int, sums binary")
    ranges: dict[str, list] = {}
    for r in dealt.collect():  # a row a range and group in it, in one job
        ranges.setdefault(r.g, []).append((r.part, np.frombuffer(r.sums).reshape(6, draws)))
    files.dropped(spark, path)  # 2,500 bytes a row
    value, n = np.zeros(draws), np.zeros(draws)
    for parts in ranges.values():
        total, run = np.zeros((6, draws)), np.zeros(draws)
        for _, (w, x, xx, y, yy, xy) in sorted(parts, key=lambda t: t[0]):
            total += w, x, xx, y + run * w, yy + 2 * run * y + run * run * w, xy + run * x
            run = run + w
        w, x, xx, y, yy, xy = total
        some = w > 0
        m = np.where(some, w, 1)
        vx, vy, c = xx / m - (x / m) ** 2, yy / m - (y / m) ** 2, xy / m - x / m * (y / m)
        good = some & (vx > 1e-9) & (vy > 1e-9)
        value += np.where(good, c / np.sqrt(np.where(good, vx * vy, 1)), 0)
        n += some
    out = [(k + 1, float(v)) for k, v in enumerate(value / np.maximum(n, 1))]
    return df.sparkSession.createDataFrame(out, "draw int, value double")  # a row a draw


def draw_auc(df: DataFrame, draws: int, seed: int = 7, score: str = "p") -> DataFrame:
    """(draw, value): ROC AUC of the resampled rows (score, label), 0.5 where a draw has one label."""
    rows = df if "w" in df.columns else weighted(df, draws, seed)
    rows = rows.select(F.col(score).cast("double").alias("p"), F.col("label").cast("int").alias("label"), "w", F.xxhash64("w").alias("_r"))
    step = ROWS

    def area_of(up, down, zeros):
        """Area under runs of values in order, above `zeros` draws of lower ones."""
        below = zeros + np.cumsum(down, axis=0) - down
        return (up * (below + down / 2)).sum(0)

    def run(batches):
        area, ones, zeros, first, last = np.zeros(draws), np.zeros(draws), np.zeros(draws), None, None
        for table in _chunks(batches, step):
            values, w, label = table["p"].to_numpy(), _matrix(table["w"], np.uint8, draws), table["label"].to_numpy()[:, None]
            starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            up, down = (np.add.reduceat(w * kind, starts, axis=0, dtype=float) for kind in (label == 1, label != 1))
            at = values[starts]
            if last is not None and last[0] == at[0]:
                up[0] += last[1]
                down[0] += last[2]
            elif last is not None:
                at, up, down = np.append(last[0], at), np.concatenate([last[1][None], up]), np.concatenate([last[2][None], down])
            last = at[-1], up[-1].copy(), down[-1].copy()
            done = slice(0, -1)
            if first is None and len(at) > 1:  # other ranges may hold rows of the first value and of the last
                first, done = (at[0], up[0].copy(), down[0].copy()), slice(1, -1)
            if first is not None:
                area += area_of(up[done], down[done], zeros)
                ones, zeros = ones + up[done].sum(0), zeros + down[done].sum(0)
        if last is not None:
            ends = [last] if first is None else [first, last]
            sums = [np.concatenate([area, ones, zeros]), *[np.concatenate([up, down, np.zeros(draws)]) for _, up, down in ends]]
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(sums), pa.int32()), pa.array([1, 0, 2][: len(sums)], pa.int32()), pa.array([None, *(float(e[0]) for e in ends)], pa.float64()), _bytes(np.stack(sums))], names=["part", "kind", "p", "sums"]
            )

    dealt = rows.repartitionByRange("p", "_r").select("p", "label", "w").sortWithinPartitions("p").mapInArrow(run, "part int, kind int, p double, sums binary")
    area, ones, zeros = np.zeros(draws), np.zeros(draws), np.zeros(draws)
    value, tied_up, tied_down = None, np.zeros(draws), np.zeros(draws)
    for r in sorted(dealt.collect(), key=lambda r: (r.part, r.kind)):  # three rows a range: its first value, those between, its last
        a, up, down = np.frombuffer(r.sums).reshape(3, draws)
        if r.kind != 1 and r.p == value:
            tied_up, tied_down = tied_up + a, tied_down + up
            continue
        if r.kind == 1 and not (up.any() or down.any()):
            continue
        area, ones, zeros = area + area_of(tied_up[None], tied_down[None], zeros), ones + tied_up, zeros + tied_down
        if r.kind == 1:
            area, ones, zeros = area + a + up * zeros, ones + up, zeros + down
            value, tied_up, tied_down = None, np.zeros(draws), np.zeros(draws)
        else:
            value, tied_up, tied_down = r.p, a, up
    area, ones, zeros = area + area_of(tied_up[None], tied_down[None], zeros), ones + tied_up, zeros + tied_down
    pairs = ones * zeros
    value = np.where(pairs > 0, area / np.where(pairs > 0, pairs, 1), 0.5)
    return df.sparkSession.createDataFrame([(k + 1, float(v)) for k, v in enumerate(value)], "draw int, value double")


def draw_mae(df: DataFrame, draws: int, seed: int = 7, other: str | None = None) -> DataFrame:
    """(draw, value): mean absolute error, or by how much that of the forecast `other` exceeds it in the same draw."""
    error = F.abs(F.col("actual") - F.col("predicted"))
    gain = error if other is None else F.abs(F.col("actual") - F.col(other)) - error
    rows = (df if "w" in df.columns else weighted(df, draws, seed)).select(gain.alias("e"), "w")

    def run(batches):
        total = np.zeros((2, draws))
        for batch in batches:
            if batch.num_rows:
                w = _matrix(batch.column(1), np.uint8, draws).astype(float)
                total += batch.column(0).to_numpy() @ w, w.sum(0)
        yield pa.RecordBatch.from_arrays([_bytes(total.reshape(1, -1))], names=["sums"])

    sums = sum((np.frombuffer(r.sums).reshape(2, draws) for r in rows.mapInArrow(run, "sums binary").collect()), np.zeros((2, draws)))  # a row a task
    return df.sparkSession.createDataFrame([(k + 1, float(v)) for k, v in enumerate(sums[0] / np.maximum(sums[1], 1))], "draw int, value double")


def paired(one: DataFrame, other: DataFrame) -> DataFrame:
    """(draw, value): the gain of `one` over `other` in the same draws."""
    return one.join(other.withColumnRenamed("value", "_other"), "draw").select("draw", (F.col("value") - F.col("_other")).alias("value"))


def interval(per_draw: DataFrame) -> DataFrame:
    """2.5, 50 and 97.5 percentiles over draws (a row a draw)."""
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return per_draw.agg(q.alias("q"), F.count("*").alias("draws")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("high"), "draws")
