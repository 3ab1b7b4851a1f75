"""Operators on entity-by-period panels: scoring, season totals, lags, trajectories, cohorts, labels, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import scalars as fn
from tidewell.operators import ranking

# Points for an event, by column; kicking events count for kickers alone; forbidden parts of feature names.
PROFILE = {
    "passing_yards": 0.04, "passing_tds": 4.0, "passing_interceptions": -2.0, "rushing_yards": 0.1, "rushing_tds": 6.0,
    "receiving_yards": 0.1, "receiving_tds": 6.0, "passing_2pt_conversions": 2.0, "rushing_2pt_conversions": 2.0,
    "receiving_2pt_conversions": 2.0, "fumbles_lost_total": -2.0, "special_teams_tds": 6.0, "fumble_recovery_tds": 6.0,
    "individual_defensive_tds": 6.0, "receptions": 1.0,
    "pat_made": 1.0, "fg_made_0_19": 3.0, "fg_made_20_29": 3.0, "fg_made_30_39": 3.0, "fg_made_40_49": 4.0,
    "fg_made_50_59": 5.0, "fg_made_60_": 6.0, "fg_missed": -1.0,
}
KICKING = ["pat_made", "fg_made_0_19", "fg_made_20_29", "fg_made_30_39", "fg_made_40_49", "fg_made_50_59", "fg_made_60_", "fg_missed"]
FORBIDDEN = [
    "active_roster", "air_yards_share", "cpoe", "depth", "epa", "fantasy", "pacr", "racr", "status", "target_points", "target_share", "wopr",
]


def _weighted(df: DataFrame, points: dict[str, float]) -> Column:
    terms = [F.coalesce(fn.numeric(F.col(c)), F.lit(0.0)) * p for c, p in points.items() if c in df.columns]
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def score_games(df: DataFrame, profile: dict[str, float] | None = None, strict: bool = True) -> DataFrame:
    """Add points_base, points_half, points_full (half and full reception value), kicking and target.

    `profile` gives the points of every event, receptions and kicks included; what it leaves out is as
    in PROFILE. `strict` asks for all events but individual_defensive_tds, else those that df lacks count 0.
    """
    points = {**PROFILE, **(profile or {})}
    missing = ({*points, "position"} - {"individual_defensive_tds"}) - set(df.columns)
    if strict and missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    kicks = _weighted(df, {c: points[c] for c in KICKING})
    base = _weighted(df, {c: p for c, p in points.items() if c not in KICKING and c != "receptions"})
    catch = _weighted(df, {"receptions": points["receptions"]})
    out = df.withColumns({"points_base": base, "points_half": base + 0.5 * catch, "points_full": base + catch, "kicking": kicks})
    target = F.when(F.upper("position").isin("K", "PK"), F.col("points_full") + F.col("kicking")).otherwise(F.col("points_full"))
    return out.withColumn("target", target)


def seasons(games: DataFrame, values: list[str]) -> DataFrame:
    """Entity-season totals (null where all are null), games, weeks, and attributes of the last game.

    A game lies in one week, so weeks are summed first, and neither count needs its rows doubled.
    """
    sums = [F.sum(v).alias(v) for v in values]
    last = F.max_by(F.struct("team", "position"), "game")
    weekly = games.groupBy("season", "entity", "week").agg(*sums, F.count_distinct("game").alias("games"), last.alias("last"))
    got = weekly.groupBy("season", "entity").agg(
        *sums, F.sum("games").alias("games"), F.count("week").alias("weeks"), F.max_by("last", "week").alias("last")
    )
    return got.select("*", F.col("last.team").alias("team"), F.col("last.position").alias("position")).drop("last")


def lagged(targets: DataFrame, source: DataFrame, values: list[str], lags: range) -> DataFrame:
    """Values of source at season - k for each k of `lags`, 0 where absent, and whether there was a row.

    Lags go by season, not by row. One join for all lags: source rows are given to each season that
    looks back on them, then brought side by side.
    """
    ahead = source.select("entity", *values, F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"), "season")
    ahead = ahead.withColumn("season", F.col("season") + F.col("lag"))
    wide = [
        a
        for k in lags
        for a in (
            *[F.max(F.when(F.col("lag") == k, F.col(v))).alias(f"lag{k}_{v}") for v in values],
            F.max((F.col("lag") == k).cast("int")).alias(f"lag{k}_available"),
        )
    ]
    joined = targets.join(ahead.groupBy("entity", "season").agg(*wide), ["entity", "season"], "left")
    return joined.fillna(0, [c for c in joined.columns if c.startswith("lag")])


def trajectory(games: DataFrame, value: str, late: int = 6) -> DataFrame:
    """Per entity-season: total of the last weeks, late less early mean, weekly slope.

    Weeks without a game count as 0: slopes and means are over all weeks 1..W of the season. Only regular games of a
    known entity and week count, where the games say what they are.
    """
    games = games.where(F.upper("season_type") == "REG") if "season_type" in games.columns else games
    games = games.where("entity is not null and week is not null")
    weekly = games.groupBy("season", "entity", "week").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("v"))
    ends = games.groupBy("season").agg(F.greatest(F.max("week"), F.lit(1)).alias("n"))
    per = weekly.join(F.broadcast(ends), "season").groupBy("season", "entity", "n").agg(
        F.sum("v").alias("total"),
        F.sum(F.when(F.col("week") > F.col("n") - late, F.col("v")).otherwise(0.0)).alias("late"),
        F.sum(F.col("week") * F.col("v")).alias("weighted"),
    )
    n = F.col("n").cast("double")
    sw, sww = n * (n + 1) / 2, n * (n + 1) * (2 * n + 1) / 6
    low = n * sww - sw * sw
    width = F.least(n, F.lit(float(late)))
    return per.select(
        "season",
        "entity",
        F.col("late").alias(f"late{late}_{value}"),
        fn.rate(n * F.col("weighted") - sw * F.col("total"), low).alias(f"weekly_slope_{value}"),
        (fn.rate(F.col("late"), width) - fn.rate(F.col("total") - F.col("late"), n - width)).alias(f"late{late}_mean_delta_{value}"),
    )


def group_totals(games: DataFrame, values: list[str]) -> DataFrame:
    """Totals of a season's upper-cased groups, nulls as 0, with a flag that there is one."""
    sums = [F.coalesce(F.sum(v), F.lit(0.0)).alias(f"group_{v}") for v in values]
    return games.groupBy("season", F.upper("team").alias("team")).agg(*sums, F.lit(1).alias("group_available"))


def left_checked(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to a right side that must be unique by key; a repeated key fails the job."""
    n = F.count("*").over(Window.partitionBy(*keys))
    sure = right.withColumn("_n", n).withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("repeated key"))).otherwise(F.lit(True)))
    return left.join(sure.where("_ok").drop("_n", "_ok"), keys, "left")


def crosswalk(df: DataFrame, code: str, pairs: DataFrame, group: list[str]) -> DataFrame:
    """Rows, matched rows and their share by group, after df's code is looked up in pairs(code, entity).

    A code of several entities stands for the first, so no row of df is doubled.
    """
    one = pairs.where("code is not null").groupBy("code").agg(F.min("entity").alias("entity"))
    found = df.join(one, F.col(code) == F.col("code"), "left")
    share = F.round(F.avg(F.col("entity").isNotNull().cast("int")), 6)
    return found.groupBy(*group).agg(F.count("*").alias("n"), F.count("entity").alias("matched"), share.alias("share"))


def roster_cohort(rosters: DataFrame, entrants: DataFrame) -> DataFrame:
    """Rows of target seasons from what was known before: last roster row of the season before, and entrants.

    An entity with both keeps its roster row.
    """
    prior = ranking.first_by(rosters, ["season", "entity"], F.desc("week"), F.desc("team"), F.desc("game"))
    prior = prior.select((F.col("season") + 1).alias("season"), "entity", "team", "position", F.lit("prior_roster").alias("origin"), F.lit(0).alias("o"))
    new = entrants.select("season", "entity", "team", "position", F.lit("entrant").alias("origin"), F.lit(1).alias("o"))
    return ranking.first_by(prior.unionByName(new), ["season", "entity"], F.col("o")).drop("o")


def build_cohort(rosters: DataFrame, entrants: DataFrame, outcomes: DataFrame, current: int, unavailable: list[str]) -> DataFrame:
    """Target rows of all seasons up to `current`, from what was known before each.

    Before `current`: last roster rows of the season before, and entrants of the season. In `current`:
    its own roster's rows alone, with their status and whether it lets them play. outcomes(season, entity,
    outcome) come last: an unknown one counts 0 before `current` and stays unknown in it.
    """
    history = roster_cohort(rosters.where(F.col("season") + 1 < current), entrants.where(F.col("season") < current))
    source = F.when(F.col("origin") == "prior_roster", F.col("season") - 1).otherwise(F.col("season"))
    unknown = F.lit(None).cast("string").alias("status")
    history = history.select("season", "entity", "team", "position", "origin", source.alias("source_season"), F.lit(True).alias("available"), unknown)
    now = ranking.first_by(rosters.where(F.col("season") == current), ["season", "entity"], F.desc("week"), F.desc("team"), F.desc("game"))
    playing = F.coalesce(~F.col("status").isin(unavailable), F.lit(True))
    now = now.select("season", "entity", "team", "position", F.lit("current").alias("origin"), F.col("season").alias("source_season"), playing.alias("available"), "status")
    known = history.unionByName(now).join(outcomes, ["season", "entity"], "left")
    return known.withColumn("outcome", F.when(F.col("season") < current, F.coalesce("outcome", F.lit(0.0))).otherwise(F.col("outcome")))


def check_cohort(cohort: DataFrame, current: int) -> DataFrame:
    """One row a rule of the cohort's times: how many rows break it."""
    season, source, origin = F.col("season"), F.col("source_season"), F.col("origin")
    rules = {
        "prior_roster_is_older": (origin == "prior_roster") & (source >= season),
        "entrants_are_of_the_season": (origin == "entrant") & (source != season),
        "current_is_current": (origin == "current") & ((season != current) | (source != current)),
        "current_alone_in_its_season": (origin != "current") & (season >= current),
        "outcomes_before_current": (season < current) & F.col("outcome").isNull(),
    }
    one = cohort.agg(*[F.count_if(bad).alias(name) for name, bad in rules.items()])
    return one.unpivot([], list(rules), "check", "violations")


def report_history(reports: DataFrame, fields: list[str], non_physical: str = fn.NON_PHYSICAL) -> DataFrame:
    """(season, entity, reported, report_weeks, designations) of regular reports with a physical reason in any field.

    A row counts once a field that gives a physical reason; null and blank fields give none. Who has no such row is left out.
    """
    marks = [fn.physical(F.col(f), non_physical).cast("int") for f in fields]
    rows = reports.where("upper(season_type) = 'REG'").withColumn("_marks", sum(marks[1:], marks[0])).where("_marks > 0")
    history = rows.groupBy("season", "entity").agg(F.count_distinct("week").alias("report_weeks"), F.sum("_marks").alias("designations"))
    return history.select("season", "entity", F.lit(1).alias("reported"), "report_weeks", "designations")


def missed_time(keys: DataFrame, absences: DataFrame, reserve: DataFrame, first: int, last: int) -> DataFrame:
    """Label 1 if a report of absence or a reserve week is known, 0 if not, null outside the window."""
    out = keys.join(absences, ["season", "entity"], "left").join(reserve, ["season", "entity"], "left")
    hit = (F.coalesce("absence_weeks", F.lit(0)) > 0) | (F.coalesce("reserve_weeks", F.lit(0)) > 0)
    return out.withColumn("missed_time", F.when(F.col("season").between(first, last), hit.cast("int")))


def check_lineage(lineage: DataFrame) -> DataFrame:
    """One row a check: columns whose sources are not old enough, or whose names are forbidden."""
    flat = lineage.select("column", F.explode(F.arrays_zip("sources", "source_offsets")).alias("s"))
    source, offset = F.col("s.sources"), F.col("s.source_offsets")
    young = F.when(source.startswith("outcome") & (offset < 1), "outcome_offset").when(source.startswith("report") & (offset < 2), "report_offset")
    bad = flat.withColumn("check", young).where("check is not null").groupBy("check").agg(F.count_distinct("column").alias("violations"))
    names = lineage.where(F.col("column").rlike("|".join(["future|actual|^target_", *FORBIDDEN]))).agg(F.count("*").alias("violations")).select(F.lit("forbidden_name").alias("check"), "violations")
    checks = lineage.sparkSession.createDataFrame([("outcome_offset",), ("report_offset",), ("forbidden_name",)], "check string")
    return checks.join(bad.unionByName(names), "check", "left").fillna(0)


LINEAGE = "column string, sources array<string>, source_offsets array<int>, recipe string, family string"


def lineage_of(spark: SparkSession, recipes: list[tuple[str, list[str], list[int], str, str]]) -> DataFrame:
    """The lineage table of a feature matrix: (column, sources, offsets in seasons, recipe, family), one a declared column."""
    for column, sources, offsets, _, _ in recipes:
        if len(sources) != len(offsets) or any(o < 0 for o in offsets):
            raise ValueError(f"{column}: each source needs an offset of at least 0")
    return spark.createDataFrame(recipes, LINEAGE)


def check_matrix(matrix: DataFrame, lineage: DataFrame, keys: list[str]) -> DataFrame:
    """check_lineage, and rows with a value that is not finite, columns without lineage, and keys with one."""
    columns = [c for c in matrix.columns if c not in keys]
    spark = matrix.sparkSession
    bad = sum((F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False)).cast("int") for c in columns), F.lit(0)) > 0
    finite = matrix.agg(F.count_if(bad).alias("violations")).select(F.lit("not_finite").alias("check"), "violations")
    declared = spark.createDataFrame([(c, c in keys) for c in matrix.columns], "column string, is_key boolean")  # a row a column
    known = declared.join(lineage.select("column", F.lit(True).alias("known")), "column", "left")
    count = lambda name, test: known.agg(F.count_if(test).alias("violations")).select(F.lit(name).alias("check"), "violations")
    no_lineage = count("no_lineage", ~F.col("is_key") & F.col("known").isNull())
    key = count("key_in_matrix", F.col("is_key") & F.col("known").isNotNull())
    return check_lineage(lineage).unionByName(finite).unionByName(no_lineage).unionByName(key)


def leaks(lineage: DataFrame, least_offset: int) -> DataFrame:
    """Rows whose source season is less than `least_offset` seasons before the season they serve."""
    return lineage.where(F.col("season") - F.col("source_season") < least_offset)


def safe_columns(df: DataFrame, keys: list[str], prefixes: tuple[str, ...], outcomes: tuple[str, ...]) -> DataFrame:
    """Keys and columns with an allowed prefix; an outcome that would pass for a feature is an error."""
    kept = [c for c in df.columns if c not in keys and c.startswith(prefixes)]
    bad = [c for c in kept if c.startswith(outcomes)]
    if bad:
        raise ValueError(f"outcomes among the features: {bad}")
    return df.select(*keys, *kept)


def era(df: DataFrame, tier: str, first: int, columns: list[str], recent: list[str]) -> DataFrame:
    """`recent`: seasons from `first` on with the further columns; any other tier: all seasons without them."""
    if tier == "recent":
        return df.where(F.col("season") >= first).select(*columns, *recent)
    return df.select(*columns)
