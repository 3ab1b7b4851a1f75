"""The given tables as a panel: orders are games of an entity (customer) in a week of a season (year)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = {"AUTOMOBILE": "QB", "BUILDING": "RB", "FURNITURE": "WR", "HOUSEHOLD": "TE", "MACHINERY": "K"}
#: Reasons of these tables that are not physical.
NON_PHYSICAL = "not specified|low"
STATUS = {"F": "ACT", "O": "RES", "P": "CUT"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order, with counts from its lines; its team is the nation of the supplier of its lowest line, so that an entity's varies."""
    from tidewell.functions.scalars import mapped

    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("carries"),
        (F.sum("l_extendedprice") / 1000).alias("yards"),
        F.count_if(F.col("l_returnflag") == "R").cast("double").alias("tds"),
        F.count_if(F.col("l_returnflag") == "A").cast("double").alias("receptions"),
        F.count_if(F.col("l_returnflag") == "N").cast("double").alias("fumbles"),
        F.min(F.struct("l_partkey", "l_suppkey", "l_linenumber"))["l_suppkey"].alias("suppkey"),
    )
    nation = table(spark, sf_dir, "nation")
    people = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    teams = table(spark, sf_dir, "supplier").join(nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("supplied")), F.col("s_nationkey") == F.col("k"))
    orders = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(teams.select("s_suppkey", "supplied"), F.col("suppkey") == F.col("s_suppkey"), "left")
    return rows.select(
        F.col("o_custkey").alias("entity"),
        F.year("o_orderdate").alias("season"),
        (F.floor((F.dayofyear("o_orderdate") - 1) / 7) + 1).cast("int").alias("week"),
        F.col("o_orderkey").alias("game"),
        F.when(F.col("o_orderstatus") == "P", "POST").otherwise("REG").alias("season_type"),
        mapped(F.col("c_mktsegment"), SEGMENTS).alias("position"),
        F.coalesce("supplied", "n_name").alias("team"),
        mapped(F.col("o_orderstatus"), STATUS).alias("status"),
        F.substring("o_orderpriority", 3, 20).alias("reason"),
        "o_orderdate",
        "carries", "yards", "tds", "receptions", "fumbles",
    )


GAMES_SQL = """
li AS (SELECT l_orderkey, sum(l_quantity) AS carries, sum(l_extendedprice) / 1000 AS yards,
  CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS tds, CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) AS receptions,
  CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS DOUBLE) AS fumbles,
  min(struct_pack(p := l_partkey, s := l_suppkey, n := l_linenumber)).s AS suppkey FROM lineitem GROUP BY l_orderkey),
games AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS season,
  CAST(floor((dayofyear(o_orderdate) - 1) / 7.0) + 1 AS INTEGER) AS week, o_orderkey AS game,
  CASE WHEN o_orderstatus = 'P' THEN 'POST' ELSE 'REG' END AS season_type,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'QB' WHEN 'BUILDING' THEN 'RB' WHEN 'FURNITURE' THEN 'WR' WHEN 'HOUSEHOLD' THEN 'TE' WHEN 'MACHINERY' THEN 'K' END AS position,
  coalesce(t.supplied, n_name) AS team, CASE o_orderstatus WHEN 'F' THEN 'ACT' WHEN 'O' THEN 'RES' WHEN 'P' THEN 'CUT' END AS status,
  substr(o_orderpriority, 3, 20) AS reason, o_orderdate, carries, yards, tds, receptions, fumbles
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN li ON o_orderkey = l_orderkey
  LEFT JOIN (SELECT s_suppkey, n_name AS supplied FROM supplier JOIN nation ON s_nationkey = n_nationkey) t ON t.s_suppkey = li.suppkey)
"""

#: Columns of games that scores, seasons and rosters come from.
SCORED_FROM = ["entity", "season", "week", "game", "season_type", "position", "team", "status", "carries", "yards", "tds", "receptions", "fumbles"]

#: Events of the scoring profile on these tables.
EVENTS = {"rushing_yards": "yards", "rushing_tds": "tds", "receptions": "receptions", "fumbles_lost_total": "fumbles", "pat_made": "receptions", "fg_made_40_49": "tds", "fg_missed": "fumbles"}


def events(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Games (those of the tables, or `rows` that come from them) with the events that a profile scores."""
    return (games(spark, sf_dir) if rows is None else rows).withColumns({k: F.col(v) for k, v in EVENTS.items() if k != v})


def scored(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    from tidewell.operators.panel import score_games

    return score_games(events(spark, sf_dir, rows), strict=False)


SCORED_SQL = GAMES_SQL + """,
scored AS (SELECT *, base AS points_base, base + 0.5 * coalesce(receptions, 0) AS points_half, base + coalesce(receptions, 0) AS points_full,
  kick AS kicking, base + coalesce(receptions, 0) + CASE WHEN position IN ('K', 'PK') THEN kick ELSE 0 END AS target
  FROM (SELECT *, CAST(0.1 AS DOUBLE) * coalesce(yards, 0) + 6 * coalesce(tds, 0) - 2 * coalesce(fumbles, 0) AS base,
    coalesce(receptions, 0) + 4 * coalesce(tds, 0) - coalesce(fumbles, 0) AS kick FROM games))
"""


def season_points(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    from tidewell.operators.panel import seasons

    return seasons(scored(spark, sf_dir, rows).where("season_type = 'REG'"), ["target", "carries", "yards", "tds", "receptions"])


def season_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """season_points written once, for queries that look at the seasons more than once: games are then summed one time."""
    from tidewell.sources import files

    return files.once(season_points(spark, sf_dir), "seasons")


SEASON_SQL = SCORED_SQL + """,
last_rows AS (SELECT season, entity, team, position FROM scored WHERE season_type = 'REG'
  QUALIFY row_number() OVER (PARTITION BY season, entity ORDER BY week DESC, game DESC) = 1),
seasons AS (SELECT s.*, l.team, l.position FROM (
  SELECT season, entity, sum(target) AS target, sum(carries) AS carries, sum(yards) AS yards, sum(tds) AS tds, sum(receptions) AS receptions,
    count(DISTINCT game) AS games, count(DISTINCT week) AS weeks FROM scored WHERE season_type = 'REG' GROUP BY season, entity) s
  JOIN last_rows l ON s.season = l.season AND s.entity = l.entity)
"""


def forecasts(spark: SparkSession, sf_dir: str, seasons: DataFrame | None = None) -> DataFrame:
    """season, entity, position, predicted (points of the season before), actual; for evaluation. `seasons` is a season_table, if there is one."""
    got = season_table(spark, sf_dir) if seasons is None else seasons
    before = got.select((F.col("season") + 1).alias("season"), "entity", F.col("target").alias("predicted"))
    return got.join(before, ["season", "entity"]).select("season", "entity", "position", "team", F.round("predicted", 6).alias("predicted"), F.round("target", 6).alias("actual"))


FORECAST_SQL = SEASON_SQL + """,
fc AS (SELECT s.season, s.entity, s.position, s.team, round(b.target, 6) AS predicted, round(s.target, 6) AS actual
  FROM seasons s JOIN seasons b ON b.season + 1 = s.season AND b.entity = s.entity)
"""
