"""Feature families compiled from lists of columns: an aggregate a source, whatever the number of columns, and lineage from the plan.

`values` are the columns of a season table (season, entity, team, position, values) and of a weekly one. Each family is
one aggregate and one join for all its columns and lags, so that the plan's depth does not grow with them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import scalars as fn
from tidewell.operators import panel


def trajectories(weekly: DataFrame, values: list[str], late: int = 6) -> DataFrame:
    """Of all values at once: total of the last weeks, weekly slope, late less early mean; weeks without a row count as 0."""
    ends = weekly.groupBy("season").agg(F.greatest(F.max("week"), F.lit(1)).cast("double").alias("n"))
    is_late = F.col("week") > F.col("n") - late
    sums = [s for v in values for s in (F.sum(v).alias(f"t_{v}"), F.sum(F.when(is_late, F.col(v)).otherwise(0.0)).alias(f"l_{v}"), F.sum(F.col("week") * F.col(v)).alias(f"w_{v}"))]
    per = weekly.join(F.broadcast(ends), "season").groupBy("season", "entity").agg(F.max("n").alias("n"), *sums)  # a row a season
    n = F.col("n")
    first, second = n * (n + 1) / 2, n * (n + 1) * (2 * n + 1) / 6
    width = F.least(n, F.lit(float(late)))
    out = []
    for v in values:
        slope = fn.rate(n * F.col(f"w_{v}") - first * F.col(f"t_{v}"), n * second - first * first)
        delta = fn.rate(F.col(f"l_{v}"), width) - fn.rate(F.col(f"t_{v}") - F.col(f"l_{v}"), n - width)
        out += [F.col(f"l_{v}").alias(f"late{late}_{v}"), slope.alias(f"slope_{v}"), delta.alias(f"delta_{v}")]
    return per.select("season", "entity", *out)


def _ahead(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """df a season later, with its columns but the keys renamed."""
    names = [c for c in df.columns if c not in ("season", *keys)]
    return df.select((F.col("season") + 1).alias("season"), *keys, *[F.col(c).alias(prefix + c) for c in names])


def rooms(matrix: DataFrame, values: list[str]) -> DataFrame:
    """Peers of the season's team and position by last season's values: how many, and of each value their total, those above 0, the margin over their mean.

    Sums by group are joined back, so a group of any size is summed before it is shuffled.
    """
    group = ["season", "team", "position"]
    own = {v: F.col(f"lag1_{v}") for v in values}
    sums = [s for v, x in own.items() for s in (F.sum(x).alias(f"s_{v}"), F.sum((x > 0).cast("int")).alias(f"p_{v}"))]
    totals = matrix.groupBy(*group).agg((F.count("*") - 1).alias("room_competitors"), *sums)
    both = matrix.join(totals, group)
    n = F.col("room_competitors")
    columns = {}
    for v, x in own.items():
        others = F.col(f"s_{v}") - x
        columns[f"room_others_{v}"] = others
        columns[f"room_nonzero_{v}"] = F.col(f"p_{v}") - (x > 0).cast("int")
        columns[f"room_margin_{v}"] = x - F.coalesce(F.try_divide(others, F.when(n > 0, n)), F.lit(0.0))
    return both.withColumns(columns).drop(*[f"{k}_{v}" for v in values for k in "sp"])


def matrix(seasons: DataFrame, weekly: DataFrame, values: list[str], rates: dict[str, tuple[str, str]], positions: list[str], lags: int = 3) -> DataFrame:
    """season, entity and the families: lags and flags of availability, rates, trajectories, environment of the team and of the one before, rooms, positions."""
    keys = seasons.select("season", "entity", F.upper("team").alias("team"), "position")
    out = panel.lagged(keys, seasons, values, range(1, lags + 1))
    out = out.withColumns({f"lag{k}_{name}": fn.rate(F.col(f"lag{k}_{a}"), F.col(f"lag{k}_{b}")) for k in range(1, lags + 1) for name, (a, b) in rates.items()})
    trend = _ahead(trajectories(weekly, values), ["entity"], "lag1_")
    totals = seasons.groupBy("season", F.upper("team").alias("team")).agg(*[F.sum(v).alias(v) for v in values], F.lit(1).alias("available"))
    before = _ahead(seasons.select("season", "entity", F.upper("team").alias("team")), ["entity"], "prior_")
    prior = _ahead(totals.withColumnRenamed("team", "prior_team"), ["prior_team"], "prior_team_")
    out = out.join(trend, ["season", "entity"], "left").join(_ahead(totals, ["team"], "team_"), ["season", "team"], "left")
    out = out.join(before, ["season", "entity"], "left").join(prior, ["season", "prior_team"], "left")
    added = [c for c in out.columns if c.startswith(("lag1_late", "lag1_slope", "lag1_delta", "team_", "prior_team_"))]
    out = rooms(out.fillna(0, added), values)
    changed = F.coalesce((F.col("prior_team") != F.col("team")).cast("int"), F.lit(0)).alias("team_changed")
    flags = [(F.col("position") == p).cast("int").alias(f"position_{p}") for p in positions]
    names = [c for c in out.columns if c not in ("season", "entity", "team", "position", "prior_team")]
    return out.select("season", "entity", *names, changed, *flags)


def _tree(flat: list[dict]) -> dict:
    """A plan or expression from its list of nodes, parents first."""
    at = iter(flat)

    def build():
        node = next(at)
        node["nodes"] = [build() for _ in range(node["num-children"])]
        return node

    return build()


def _refs(e: dict):
    if e["class"].endswith(".AttributeReference"):
        yield e["exprId"]["id"]
    for child in e["nodes"]:
        yield from _refs(child)


def _literal(e: dict) -> int | None:
    while e["class"].endswith(".Cast"):
        e = e["nodes"][0]
    return int(e["value"]) if e["class"].endswith(".Literal") and str(e.get("value", "")).lstrip("-").isdigit() else None


def plan_lineage(df: DataFrame) -> dict[str, set[tuple[str, int]]]:
    """By column of df: the (source column, seasons back) that its value comes from, read from the analysed plan.

    Seasons back are what a plan adds to its column `season`: where a subplan gives its rows to season + k, by a literal or by
    an exploded list of lags of which an aggregate picks one, all its columns are k seasons old from there on.
    """
    plan = _tree(json.loads(df._jdf.queryExecution().analyzed().toJSON()))
    names: dict[int, str] = {}

    def lists(node, *fields):
        return [_tree([dict(e) for e in flat]) for f in fields for flat in node.get(f) or [] if isinstance(flat, list)]

    def shift(e: dict):
        """What an expression for `season` adds: a number, the name of a column of lags, or None."""
        e = e["nodes"][0] if e["class"].endswith(".Alias") else e
        if e["class"].endswith((".Add", ".Subtract")):
            sign = 1 if e["class"].endswith(".Add") else -1
            for side in e["nodes"]:
                if (k := _literal(side)) is not None:
                    return sign * k
            ids = [i for i in _refs(e["nodes"][1])]
            return ("lags", ids[0]) if ids else None
        return None

    def picked(e: dict):
        """(id of a column, number) of an equality with a literal inside."""
        if e["class"].endswith((".EqualTo", ".EqualNullSafe")):
            ids, numbers = list(_refs(e)), [k for side in e["nodes"] if (k := _literal(side)) is not None]
            if len(ids) == 1 and numbers:
                yield ids[0], numbers[0]
        for child in e["nodes"]:
            yield from picked(child)

    def walk(node) -> dict[int, set]:
        kind = node["class"].rsplit(".", 1)[-1]
        below: dict[int, set] = {}
        for child in node["nodes"]:
            below |= walk(child)
        if not node["nodes"]:
            out = {}
            for e in lists(node, "output"):
                names[e["exprId"]["id"]] = e["name"]
                out[e["exprId"]["id"]] = {(e["name"], 0, None)}
            return out
        if kind == "Generate":
            refs = set().union(*[below.get(i, set()) for i in _refs(_tree([dict(e) for e in node["generator"]]))] or [set()])
            return below | {e["exprId"]["id"]: set(refs) for e in lists(node, "generatorOutput")}
        if kind not in ("Project", "Aggregate"):
            return below
        out, moved = {}, None
        for e in lists(node, "projectList", "aggregateExpressions"):
            if e["class"].endswith(".AttributeReference"):
                out[e["exprId"]["id"]] = below.get(e["exprId"]["id"], set())
                continue
            if not e["class"].endswith(".Alias"):
                continue
            own = set()
            for i in _refs(e):
                own |= below.get(i, set())
            for column, number in picked(e):
                own = {(n, k + number, None) if lag == column else (n, k, lag) for n, k, lag in own}
            names[e["exprId"]["id"]] = e["name"]
            if e["name"] == "season" and (by := shift(e)) is not None:
                moved = by
            out[e["exprId"]["id"]] = own
        if moved is not None:
            lag = moved[1] if isinstance(moved, tuple) else None
            step = 0 if lag is not None else moved
            out = {i: {(n, k + step, lag if lag is not None else was) for n, k, was in own} for i, own in out.items()}
        return out

    found = walk(plan)
    top = df._jdf.queryExecution().analyzed().output()
    ids = [int(top.apply(i).exprId().id()) for i in range(top.size())]
    return {c: {(n, k) for n, k, _ in found.get(i, set())} for c, i in zip(df.columns, ids)}


def plan_leaks(df: DataFrame, known_before: set[str]) -> DataFrame:
    """(column, source, seasons_back) of df's columns that hold something of the season they serve, but for sources known before it starts."""
    rows = [(c, n, k) for c, found in plan_lineage(df).items() for n, k in sorted(found) if k < 1 and n not in known_before]
    return df.sparkSession.createDataFrame(rows, "column string, source string, seasons_back int")
