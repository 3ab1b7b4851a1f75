"""Queries of the panel operators over the given tables, each with the DuckDB SQL for the same rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import scalars as fn
from tidewell.operators import board, bootstrap, evaluation, evidence, gram, ordered, panel, ranking
from tidewell.plans import fixtures as fx
from tidewell.sources import files

QUERIES, SQL = {}, {}
G = ["season", "position"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def with_(base: str, select: str) -> str:
    return f"WITH {base} {select}"


# ---- sources, filters, projections


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS n, count(CASE WHEN year(o_orderdate) >= 1998 THEN o_orderpriority END) AS with_priority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def src_multi_year(spark: SparkSession, d: str) -> DataFrame:
    """Yearly files of two schemas, the later with a further column, as one table."""
    o = fx.table(spark, d, "orders").withColumn("season", F.year("o_orderdate"))
    early = files.write_periods(o.where("season < 1998").select("o_orderkey", "o_totalprice", "season"), files.shared_path(spark, "early"))
    late = files.write_periods(o.where("season >= 1998").select("o_orderkey", "o_totalprice", "o_orderpriority", "season"), files.shared_path(spark, "late"))
    both = spark.read.parquet(early).unionByName(spark.read.parquet(late), allowMissingColumns=True)
    return both.groupBy("season").agg(F.count("*").alias("n"), F.count("o_orderpriority").alias("with_priority"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_PAYLOAD_SQL = """WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec FROM events),
items AS (SELECT event_id, k, sec, 0 AS i FROM e UNION ALL SELECT event_id, k, sec, 1 FROM e WHERE event_id % 3 = 0)
SELECT event_id, event_id * 10 + i AS item_id, k, strftime(make_timestamp(sec * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS updated FROM items"""


@query(_PAYLOAD_SQL)
def src_json_payload(spark: SparkSession, d: str) -> DataFrame:
    """Nested payloads whose member is an object or an array of objects, with an epoch timestamp as ISO UTC."""
    item = lambda i: F.struct((F.col("event_id") * 10 + i).alias("id"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    at = F.unix_seconds(F.date_trunc("second", "ts")).cast("string").alias("timestamp")
    one, many = F.to_json(F.struct(at, item(0).alias("item"))), F.to_json(F.struct(at, F.array(item(0), item(1)).alias("item")))
    payloads = fx.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, many).otherwise(one).alias("payload"))
    return files.exploded_member(payloads, "payload", "item", "id bigint, k bigint").select(
        "event_id", F.col("member.id").alias("item_id"), F.col("member.k").alias("k"), files.iso_utc(F.get_json_object("payload", "$.timestamp")).alias("updated")
    )


@query("""WITH m AS (SELECT CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS code, min(c_custkey) AS entity FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT event_type, count(*) AS n, count(entity) AS matched, round(avg(CASE WHEN entity IS NULL THEN 0.0 ELSE 1.0 END), 6) AS share FROM events LEFT JOIN m ON user_id = code GROUP BY 1""")
def jn_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """External ids (user_id) to entities through the codes in names, first entity a code; the share that is matched."""
    c = fx.table(spark, d, "customer").where("c_acctbal > 0")
    code = F.regexp_extract("c_name", r"(\d+)$", 1).try_cast("bigint").alias("code")
    return panel.crosswalk(fx.table(spark, d, "events"), "user_id", c.select(code, F.col("c_custkey").alias("entity")), ["event_type"])


@query(with_(fx.SCORED_SQL, "SELECT game, round(points_base, 6) AS points_base, round(points_half, 6) AS points_half, round(points_full, 6) AS points_full, round(kicking, 6) AS kicking, round(target, 6) AS target FROM scored"))
def prj_score_linear(spark: SparkSession, d: str) -> DataFrame:
    cols = ["points_base", "points_half", "points_full", "kicking", "target"]
    return r6(fx.scored(spark, d).select("game", *cols), *cols)


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END AS bal, CAST(s_acctbal < 0 AS INTEGER) AS missing_bal, coalesce(CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END, 0) AS filled FROM supplier")
def prj_missing_flags(spark: SparkSession, d: str) -> DataFrame:
    bal = F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal"))
    return fx.table(spark, d, "supplier").select("s_suppkey", bal.alias("bal"), bal.isNull().cast("int").alias("missing_bal"), F.coalesce(bal, F.lit(0.0)).alias("filled"))


@query("SELECT event_id, CASE WHEN try_cast(props AS DOUBLE) IS NULL THEN 0 ELSE 1 END AS numeric_props, coalesce(try_cast(CAST(value AS VARCHAR) AS DOUBLE), 0) AS v FROM events")
def prj_numeric_coerce(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events")
    return e.select("event_id", fn.numeric(F.col("props")).isNotNull().cast("int").alias("numeric_props"), F.coalesce(fn.numeric(F.col("value")), F.lit(0.0)).alias("v"))


@query("SELECT c_custkey AS entity, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'QB' WHEN 'BUILDING' THEN 'RB' WHEN 'FURNITURE' THEN 'WR' WHEN 'HOUSEHOLD' THEN 'TE' WHEN 'MACHINERY' THEN 'K' END AS position FROM customer")
def prj_position_map(spark: SparkSession, d: str) -> DataFrame:
    """Codes to positions in any case; halfbacks, fullbacks and place kickers join their group, unknown codes are null."""
    raw = fn.mapped(F.col("c_mktsegment"), {"AUTOMOBILE": "qb", "BUILDING": "hb", "FURNITURE": "WR", "HOUSEHOLD": "te", "MACHINERY": "pk"}, F.lit("?"))
    return fx.table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), fn.mapped(F.upper(raw), fn.POSITIONS).alias("position"))


@query("SELECT o_orderkey, round(datediff('day', CAST(o_orderdate AS DATE), make_date(2001, 9, 1)) / 365.2425, 6) AS age FROM orders")
def prj_age_at(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "orders").select("o_orderkey", F.round(fn.age_at(F.lit(2001), F.to_date("o_orderdate")), 6).alias("age"))


@query("SELECT c_custkey AS entity, " + ", ".join(f"CAST(c_mktsegment = '{k}' AS INTEGER) AS position_{v}" for k, v in fx.SEGMENTS.items()) + " FROM customer")
def prj_one_hot(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), *[(F.col("c_mktsegment") == k).cast("int").alias(f"position_{v}") for k, v in fx.SEGMENTS.items()])


@query("SELECT doc_id, CASE WHEN p > -0.001 AND p <= 0.2 THEN 'lower' WHEN p > 0.2 AND p <= 0.35 THEN 'moderate' WHEN p > 0.35 AND p <= 1.001 THEN 'higher' END AS band FROM (SELECT doc_id, least(n_chars / 5000.0, 1.0) AS p FROM documents)")
def prj_risk_band(spark: SparkSession, d: str) -> DataFrame:
    p = F.least(F.col("n_chars") / 5000.0, F.lit(1.0))
    return fx.table(spark, d, "documents").select("doc_id", fn.risk_band(p).alias("band"))


@query(with_(fx.GAMES_SQL, "SELECT season_type, count(*) AS n, sum(carries) AS carries FROM games WHERE season BETWEEN 1996 AND 1999 AND position IN ('QB', 'RB') AND status NOT IN ('CUT') GROUP BY season_type"))
def flt_in_range(spark: SparkSession, d: str) -> DataFrame:
    g = fx.games(spark, d).where(F.col("season").between(1996, 1999) & F.col("position").isin("QB", "RB") & ~F.coalesce(F.col("status").isin("CUT"), F.lit(True)))
    return g.groupBy("season_type").agg(F.count("*").alias("n"), F.sum("carries").alias("carries"))


# ---- joins


@query(with_(fx.SEASON_SQL, """
SELECT t.season, t.entity, round(coalesce(a.target, 0), 6) AS lag1_target, CAST(a.entity IS NOT NULL AS INTEGER) AS lag1_available,
  round(coalesce(b.target, 0), 6) AS lag2_target, CAST(b.entity IS NOT NULL AS INTEGER) AS lag2_available
FROM seasons t LEFT JOIN seasons a ON a.entity = t.entity AND a.season = t.season - 1 LEFT JOIN seasons b ON b.entity = t.entity AND b.season = t.season - 2"""))
def jn_lag(spark: SparkSession, d: str) -> DataFrame:
    s = fx.season_points(spark, d)
    return r6(panel.lagged(s.select("season", "entity"), s, ["target"], range(1, 3)), "lag1_target", "lag2_target")


@query(with_(fx.GAMES_SQL, """, reg AS (SELECT season, entity, count(*) AS games FROM games WHERE season_type = 'REG' GROUP BY 1, 2),
ros AS (SELECT season, entity, count(*) AS roster_weeks FROM games WHERE status = 'CUT' OR week < 10 GROUP BY 1, 2)
SELECT coalesce(a.season, b.season) AS season, coalesce(a.entity, b.entity) AS entity, coalesce(games, 0) AS games, coalesce(roster_weeks, 0) AS roster_weeks
FROM reg a FULL JOIN ros b ON a.season = b.season AND a.entity = b.entity"""))
def jn_full_outer(spark: SparkSession, d: str) -> DataFrame:
    g = fx.games(spark, d)
    reg = g.where("season_type = 'REG'").groupBy("season", "entity").agg(F.count("*").alias("games"))
    ros = g.where("status = 'CUT' or week < 10").groupBy("season", "entity").agg(F.count("*").alias("roster_weeks"))
    return reg.join(ros, ["season", "entity"], "full").fillna(0, ["games", "roster_weeks"])


@query("SELECT event_id, user_id, event_type FROM events WHERE ts = (SELECT max(ts) FROM events WHERE ts <= (SELECT min(ts) + INTERVAL 1 DAY FROM events))")
def jn_asof_snapshot(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events")
    cutoff = e.agg((F.min("ts") + F.expr("interval 1 day")).alias("cutoff"))
    latest = e.crossJoin(F.broadcast(cutoff)).where("ts <= cutoff").agg(F.max("ts").alias("ts"))  # one row each
    return e.join(F.broadcast(latest), "ts").select("event_id", "user_id", "event_type")


@query("SELECT c_custkey AS entity, n_name AS team, c_acctbal AS bal FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def jn_left_checked(spark: SparkSession, d: str) -> DataFrame:
    c = fx.table(spark, d, "customer").withColumnRenamed("c_nationkey", "k")
    n = fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("team"))
    return panel.left_checked(c, n, ["k"]).select(F.col("c_custkey").alias("entity"), "team", F.col("c_acctbal").alias("bal"))


@query("SELECT c_custkey AS entity FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def jn_anti_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Customers that no order names."""
    c, o = fx.table(spark, d, "customer"), fx.table(spark, d, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("entity"))


_TEAM = """, teams AS (SELECT season, upper(team) AS team, coalesce(sum(carries), 0) AS group_carries, round(coalesce(sum(yards), 0), 6) AS group_yards, 1 AS group_available FROM games GROUP BY 1, 2)"""


@query(with_(fx.GAMES_SQL + _TEAM, "SELECT * FROM teams"))
def agg_team_env(spark: SparkSession, d: str) -> DataFrame:
    return r6(panel.group_totals(fx.games(spark, d), ["carries", "yards"]), "group_yards")


@query(with_(fx.SEASON_SQL + _TEAM, "SELECT s.season, s.entity, coalesce(t.group_carries, 0) AS group_carries, coalesce(t.group_available, 0) AS group_available FROM seasons s LEFT JOIN teams t ON t.season + 1 = s.season AND t.team = upper(s.team)"))
def jn_team_env(spark: SparkSession, d: str) -> DataFrame:
    s = fx.season_points(spark, d).select("season", "entity", F.upper("team").alias("team"))
    t = panel.group_totals(fx.games(spark, d), ["carries"]).withColumn("season", F.col("season") + 1)
    return s.join(t, ["season", "team"], "left").fillna(0, ["group_carries", "group_available"]).select("season", "entity", "group_carries", "group_available")


@query(with_(fx.SEASON_SQL + _TEAM, """SELECT s.season, s.entity, p.team AS prior_team, coalesce(t.group_carries, 0) AS prior_group_carries
FROM seasons s LEFT JOIN seasons p ON p.entity = s.entity AND p.season = s.season - 1 LEFT JOIN teams t ON t.season = s.season - 1 AND t.team = upper(p.team)"""))
def jn_two_hop(spark: SparkSession, d: str) -> DataFrame:
    s = fx.season_points(spark, d).select("season", "entity", "team")
    prior = s.select((F.col("season") + 1).alias("season"), "entity", F.col("team").alias("prior_team"))
    t = panel.group_totals(fx.games(spark, d), ["carries"]).select((F.col("season") + 1).alias("season"), F.col("team").alias("up"), F.col("group_carries").alias("prior_group_carries"))
    out = s.drop("team").join(prior, ["season", "entity"], "left").withColumn("up", F.upper("prior_team"))
    return out.join(t, ["season", "up"], "left").drop("up").fillna(0.0, ["prior_group_carries"])


# ---- aggregations


@query(with_(fx.SEASON_SQL, "SELECT season, entity, round(target, 6) AS target, carries, tds, games, weeks, team, position FROM seasons"))
def agg_sum_mincount(spark: SparkSession, d: str) -> DataFrame:
    return r6(fx.season_points(spark, d).select("season", "entity", "target", "carries", "tds", "games", "weeks", "team", "position"), "target")


@query(with_(fx.GAMES_SQL, "SELECT season, entity, count(DISTINCT week) AS weeks, count(DISTINCT CASE WHEN status = 'ACT' THEN week END) AS active_weeks FROM games GROUP BY 1, 2"))
def agg_filtered(spark: SparkSession, d: str) -> DataFrame:
    active = F.count_distinct(F.when(F.col("status") == "ACT", F.col("week")))
    return fx.games(spark, d).groupBy("season", "entity").agg(F.count_distinct("week").alias("weeks"), active.alias("active_weeks"))


@query(with_(fx.GAMES_SQL, "SELECT season, entity, team, status, week FROM games QUALIFY row_number() OVER (PARTITION BY season, entity ORDER BY week DESC, game DESC) = 1"))
def agg_last_row(spark: SparkSession, d: str) -> DataFrame:
    last = F.max_by(F.struct("team", "status", "week"), F.struct("week", "game"))
    return fx.games(spark, d).groupBy("season", "entity").agg(last.alias("l")).select("season", "entity", "l.*")


@query("SELECT o_custkey AS entity, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS first_open FROM orders GROUP BY 1")
def agg_first_nonnull(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))
    o = fx.table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("entity")).agg(F.min_by(v, F.when(v.isNotNull(), F.col("o_orderkey"))).alias("first_open"))


@query(with_(fx.GAMES_SQL, """, weekly AS (SELECT season, entity, week, coalesce(sum(carries), 0) AS v FROM games WHERE season_type = 'REG' AND week IS NOT NULL AND entity IS NOT NULL GROUP BY 1, 2, 3),
ends AS (SELECT season, CAST(greatest(max(week), 1) AS DOUBLE) AS n FROM games WHERE season_type = 'REG' GROUP BY 1),
per AS (SELECT w.season, entity, n, sum(v) AS total, sum(CASE WHEN week > n - 6 THEN v ELSE 0 END) AS late, sum(week * v) AS weighted FROM weekly w JOIN ends e ON w.season = e.season GROUP BY 1, 2, 3)
SELECT season, entity, late AS late6_carries, round((n * weighted - n * (n + 1) / 2 * total) / (n * n * (n + 1) * (2 * n + 1) / 6 - (n * (n + 1) / 2) * (n * (n + 1) / 2)), 6) AS weekly_slope_carries,
  round(late / least(n, 6) - (total - late) / (n - least(n, 6)), 6) AS late6_mean_delta_carries FROM per"""))
def agg_trajectory(spark: SparkSession, d: str) -> DataFrame:
    return r6(panel.trajectory(fx.games(spark, d), "carries"), "weekly_slope_carries", "late6_mean_delta_carries")


_PHYS = "lower(trim(reason)) NOT IN ('not specified', 'low') AND trim(reason) <> ''"


@query(with_(fx.GAMES_SQL, f"SELECT season, entity, count(DISTINCT week) AS absence_weeks FROM games WHERE season_type = 'REG' AND status = 'RES' AND {_PHYS} GROUP BY 1, 2"))
def agg_absence(spark: SparkSession, d: str) -> DataFrame:
    g = fx.games(spark, d).where((F.col("season_type") == "REG") & (F.col("status") == "RES") & fn.physical(F.col("reason"), fx.NON_PHYSICAL))
    return g.groupBy("season", "entity").agg(F.count_distinct("week").alias("absence_weeks"))


@query("SELECT l_returnflag AS g, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1")
def agg_quantile(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "lineitem").withColumn("g", F.col("l_returnflag"))
    got = ordered.quantiles(rows, "l_extendedprice", ["g"], [0.1, 0.5, 0.9])
    return got.select("g", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


@query("SELECT quality, avg(toxic) AS prevalence, count(*) AS n FROM labels GROUP BY 1")
def agg_prevalence(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "labels").groupBy("quality").agg(F.avg("toxic").alias("prevalence"), F.count("*").alias("n"))


# ---- windows


@query("SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY floor(value)) + (count(*) OVER (PARTITION BY event_type, floor(value)) - 1) / 2.0 AS rank_avg FROM events")
def win_rank_avg(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events").withColumn("v", F.floor("value"))
    return ordered.rank_avg(e, "rank_avg", "v", ["event_type"]).select("event_id", "rank_avg")


@query(with_(fx.FORECAST_SQL, "SELECT season, entity, round((rank() OVER (PARTITION BY season, position ORDER BY actual) + (count(*) OVER (PARTITION BY season, position, actual) - 1) / 2.0) / count(actual) OVER (PARTITION BY season, position), 6) AS pct FROM fc"))
def win_rank_pct(spark: SparkSession, d: str) -> DataFrame:
    return r6(ordered.rank_pct(files.once(fx.forecasts(spark, d), "forecasts"), "pct", "actual", G), "pct").select("season", "entity", "pct")


@query(with_(fx.GAMES_SQL, "SELECT season, entity, status, team, game FROM games QUALIFY row_number() OVER (PARTITION BY season, entity ORDER BY CASE status WHEN 'ACT' THEN 0 WHEN 'RES' THEN 1 WHEN 'DEV' THEN 2 WHEN 'E14' THEN 3 WHEN 'SUS' THEN 4 WHEN 'NWT' THEN 5 WHEN 'CUT' THEN 6 WHEN 'RET' THEN 7 ELSE 99 END, team, game) = 1"))
def win_dedup_priority(spark: SparkSession, d: str) -> DataFrame:
    rank = fn.mapped(F.col("status"), fn.STATUS_PRIORITY, F.lit(99))
    return ranking.first_by(fx.games(spark, d), ["season", "entity"], rank, F.col("team"), F.col("game")).select("season", "entity", "status", "team", "game")


@query("SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS duplicate_rows, count(*) AS duplicate_keys FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def win_dup_count(spark: SparkSession, d: str) -> DataFrame:
    return ranking.duplicates(fx.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(with_(fx.SEASON_SQL, """SELECT season, entity, count(*) OVER w - 1 AS competitors, sum(coalesce(carries, 0)) OVER w - coalesce(carries, 0) AS others_total,
  CAST(sum(CAST(coalesce(carries, 0) > 0 AS INTEGER)) OVER w - CAST(coalesce(carries, 0) > 0 AS INTEGER) AS BIGINT) AS nonzero_competitors,
  round(coalesce(carries, 0) - coalesce((sum(coalesce(carries, 0)) OVER w - coalesce(carries, 0)) / nullif(count(*) OVER w - 1, 0), 0), 6) AS margin
FROM seasons WINDOW w AS (PARTITION BY season, upper(team), position)"""))
def win_room(spark: SparkSession, d: str) -> DataFrame:
    got = ranking.room(fx.season_points(spark, d), ["season", F.upper("team"), "position"], "carries")
    return r6(got, "margin").select("season", "entity", "competitors", "others_total", "nonzero_competitors", "margin")


@query(with_(fx.FORECAST_SQL, ", n AS (SELECT *, row_number() OVER (PARTITION BY season, position ORDER BY actual DESC, entity) AS i, count(*) OVER (PARTITION BY season, position) AS c FROM fc) SELECT season, entity, round(actual - max(CASE WHEN i = least(12, c) THEN actual END) OVER (PARTITION BY season, position), 6) AS over_replacement FROM n"))
def win_replacement(spark: SparkSession, d: str) -> DataFrame:
    return r6(ranking.replacement(fx.forecasts(spark, d), G, "actual", F.lit(12)), "over_replacement").select("season", "entity", "over_replacement")


@query(with_(fx.FORECAST_SQL, "SELECT season, entity, round(least(greatest(actual / 1000 - avg(actual / 1000) OVER (PARTITION BY season, position) + 0.5, 0), 1), 6) AS centered FROM fc"))
def win_group_center(spark: SparkSession, d: str) -> DataFrame:
    return fx.forecasts(spark, d).select("season", "entity", F.round(ranking.centered(F.col("actual") / 1000, G), 6).alias("centered"))


@query(with_(fx.GAMES_SQL, "SELECT game, max(week) OVER (PARTITION BY season) AS last_week FROM games"))
def win_max_week(spark: SparkSession, d: str) -> DataFrame:
    g = fx.games(spark, d)
    return g.join(F.broadcast(g.groupBy("season").agg(F.max("week").alias("last_week"))), "season").select("game", "last_week")  # a row a season


@query(with_(fx.FORECAST_SQL, "SELECT season, position, entity, row_number() OVER (PARTITION BY season, position ORDER BY actual DESC, entity) AS place FROM fc QUALIFY place <= 12"))
def top_k_group(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_k(fx.forecasts(spark, d), G, 12, F.desc("actual"), F.col("entity")).select("season", "position", "entity", "place")


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    a = fx.table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return a.unionByName(fx.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("kind")).agg(F.count("*").alias("n")))


# ---- scalar functions


@query(with_(fx.SEASON_SQL, "SELECT season, entity, round(CASE WHEN carries > 0 THEN coalesce(yards, 0) / carries ELSE 0 END, 6) AS yards_per_carry FROM seasons"))
def fn_rate(spark: SparkSession, d: str) -> DataFrame:
    return fx.season_points(spark, d).select("season", "entity", F.round(fn.rate(F.col("yards"), F.col("carries")), 6).alias("yards_per_carry"))


_REASONS = ["Knee", " Not  Injury Related - Resting", "illness", "COVID-19", "Rest", "Resting veteran", "Coach's decision", "Personal", "non-injury", "Illness/Knee", ""]
_REASONS_SQL = ", ".join("'" + r.replace("'", "''") + "'" for r in _REASONS)


@query(f"""SELECT DISTINCT reason, trim(regexp_replace(reason, '\\s+', ' ', 'g')) <> '' AND NOT regexp_full_match(lower(trim(regexp_replace(reason, '\\s+', ' ', 'g'))), '{fn.NON_PHYSICAL.replace("'", "''")}') AS physical
FROM (SELECT substr(o_orderpriority, 3, 20) AS reason FROM orders UNION ALL SELECT unnest([{_REASONS_SQL}]))""")
def fn_physical_mask(spark: SparkSession, d: str) -> DataFrame:
    given = fx.table(spark, d, "orders").select(F.substring("o_orderpriority", 3, 20).alias("reason"))
    listed = given.limit(1).select(F.explode(F.array(*map(F.lit, _REASONS))).alias("reason"))
    return given.unionByName(listed).select("reason", fn.physical(F.col("reason")).alias("physical")).distinct()


@query("""SELECT key, array_to_string(list_filter(regexp_extract_all(lower(regexp_replace(strip_accents(name), '[^\\x00-\\x7F]', '', 'g')), '[a-z0-9]+'), lambda t: t NOT IN ('jr', 'sr', 'ii', 'iii', 'iv')), '') AS norm
FROM (SELECT s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT 1000000 + doc_id, text FROM documents WHERE text IS NOT NULL)""")
def fn_norm_name(spark: SparkSession, d: str) -> DataFrame:
    names = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    more = fx.table(spark, d, "documents").where("text is not null").select((F.col("doc_id") + 1000000).alias("key"), F.col("text").alias("name"))
    return names.unionByName(more).select("key", fn.normal_name(F.col("name")).alias("norm"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'pfr:' || s_name ELSE 'prospect:1999:' || trim(regexp_replace(lower(s_name || '|' || s_suppkey), '[^a-z0-9]+', '-', 'g'), '-') END AS pseudo_id FROM supplier")
def fn_pseudo_id(spark: SparkSession, d: str) -> DataFrame:
    known = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name"))
    return fx.table(spark, d, "supplier").select("s_suppkey", fn.pseudo_id(known, F.lit(1999), F.col("s_name"), F.col("s_suppkey").cast("string")).alias("pseudo_id"))


@query("SELECT event_id, round(ln(q / (1 - q)), 6) AS logit, round(sign(value) * ln(1 + abs(value)), 6) AS signed_log FROM (SELECT *, least(greatest(value / 100, CAST(1e-6 AS DOUBLE)), CAST(1 - 1e-6 AS DOUBLE)) AS q FROM events)")
def fn_logit_clip(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events")
    return e.select("event_id", F.round(fn.logit(F.col("value") / 100), 6).alias("logit"), F.round(fn.signed_log(F.col("value")), 6).alias("signed_log"))


# ---- cohorts, labels, checks


_COHORT_SQL = fx.SEASON_SQL + """, prior AS (SELECT season + 1 AS season, entity, team, position, 'prior_roster' AS origin, season AS source_season, 0 AS o FROM games WHERE season_type = 'REG' AND season + 1 < 2001 QUALIFY row_number() OVER (PARTITION BY season, entity ORDER BY week DESC, team DESC, game DESC) = 1),
firsts AS (SELECT entity, season, team, position FROM games QUALIFY row_number() OVER (PARTITION BY entity ORDER BY season, week, game) = 1),
entrants AS (SELECT season, entity, team, position, 'entrant' AS origin, season AS source_season, 1 AS o FROM firsts WHERE season < 2001),
hist AS (SELECT * EXCLUDE (o), true AS available FROM (SELECT * FROM prior UNION ALL SELECT * FROM entrants) QUALIFY row_number() OVER (PARTITION BY season, entity ORDER BY o) = 1),
now_ AS (SELECT season, entity, team, position, 'current' AS origin, season AS source_season, coalesce(status NOT IN ('RES', 'CUT'), true) AS available FROM games WHERE season_type = 'REG' AND season = 2001 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY week DESC, team DESC, game DESC) = 1),
co AS (SELECT c.*, CASE WHEN c.season < 2001 THEN coalesce(round(s.target, 6), 0) ELSE round(s.target, 6) END AS outcome FROM (SELECT * FROM hist UNION ALL SELECT * FROM now_) c LEFT JOIN seasons s ON s.season = c.season AND s.entity = c.entity)"""


def _cohort(spark: SparkSession, d: str) -> DataFrame:
    g = files.once(fx.games(spark, d), "games")
    entrants = g.groupBy("entity").agg(F.min_by(F.struct("season", "team", "position"), F.struct("season", "week", "game")).alias("f")).select("entity", "f.*")
    outcomes = fx.season_points(spark, d, g).select("season", "entity", F.round("target", 6).alias("outcome"))
    return panel.build_cohort(g.where("season_type = 'REG'"), entrants, outcomes, 2001, ["RES", "CUT"])


@query(with_(_COHORT_SQL, "SELECT season, entity, team, position, origin, source_season, available, outcome FROM co"))
def coh_members(spark: SparkSession, d: str) -> DataFrame:
    """Veterans, entrants (by their first game) and the current roster, with outcomes attached last; coh_build has the rest."""
    return _cohort(spark, d).select("season", "entity", "team", "position", "origin", "source_season", "available", "outcome")


_FAULTY_SQL = """, fy AS (SELECT CASE WHEN entity % 101 = 0 AND origin = 'entrant' THEN 2001 ELSE season END AS season, entity, origin,
  CASE WHEN entity % 97 <> 0 THEN source_season WHEN origin = 'prior_roster' THEN season WHEN origin = 'entrant' THEN season - 1 ELSE 2000 END AS source_season,
  CASE WHEN entity % 97 = 0 AND season < 2001 THEN NULL ELSE outcome END AS outcome FROM co)"""


@query(with_(_COHORT_SQL + _FAULTY_SQL, """SELECT 'prior_roster_is_older' AS "check", count(*) FILTER (WHERE origin = 'prior_roster' AND source_season >= season) AS violations FROM fy
UNION ALL SELECT 'entrants_are_of_the_season', count(*) FILTER (WHERE origin = 'entrant' AND source_season <> season) FROM fy
UNION ALL SELECT 'current_is_current', count(*) FILTER (WHERE origin = 'current' AND (season <> 2001 OR source_season <> 2001)) FROM fy
UNION ALL SELECT 'current_alone_in_its_season', count(*) FILTER (WHERE origin <> 'current' AND season >= 2001) FROM fy
UNION ALL SELECT 'outcomes_before_current', count(*) FILTER (WHERE season < 2001 AND outcome IS NULL) FROM fy"""))
def chk_cohort(spark: SparkSession, d: str) -> DataFrame:
    """The temporal contract of the cohort, a row a rule, with faults planted by entity for each rule."""
    return panel.check_cohort(_faulty(_cohort(spark, d)), 2001)


def _faulty(cohort: DataFrame) -> DataFrame:
    """Every 97th entity breaks a rule: sources of the season itself, late sources, outcomes gone; every 101st claims the current season."""
    fault = F.col("entity") % 97 == 0
    source = F.when(fault & (F.col("origin") == "prior_roster"), F.col("season")).when(fault & (F.col("origin") == "entrant"), F.col("season") - 1).when(fault, 2000).otherwise(F.col("source_season"))
    early = F.when((F.col("entity") % 101 == 0) & (F.col("origin") == "entrant"), 2001).otherwise(F.col("season"))
    outcome = F.when(~(fault & (F.col("season") < 2001)), F.col("outcome"))
    return cohort.withColumn("source_season", source).withColumn("outcome", outcome).withColumn("season", early)


@query(with_(fx.SEASON_SQL, f""", ab AS (SELECT season, entity, count(DISTINCT week) AS absence_weeks FROM games WHERE season_type = 'REG' AND status = 'RES' AND {_PHYS} GROUP BY 1, 2),
re AS (SELECT season, entity, count(DISTINCT week) AS reserve_weeks FROM games WHERE season_type = 'REG' AND status = 'RES' AND tds > 2 GROUP BY 1, 2)
SELECT s.season, s.entity, CASE WHEN s.season BETWEEN 1996 AND 2000 THEN CAST(coalesce(absence_weeks, 0) > 0 OR coalesce(reserve_weeks, 0) > 0 AS INTEGER) END AS missed_time
FROM seasons s LEFT JOIN ab ON ab.season = s.season AND ab.entity = s.entity LEFT JOIN re ON re.season = s.season AND re.entity = s.entity"""))
def lbl_missed_time(spark: SparkSession, d: str) -> DataFrame:
    g = fx.games(spark, d).where("season_type = 'REG' and status = 'RES'")
    weeks = F.count_distinct("week")
    absences = g.where(fn.physical(F.col("reason"), fx.NON_PHYSICAL)).groupBy("season", "entity").agg(weeks.alias("absence_weeks"))
    reserve = g.where("tds > 2").groupBy("season", "entity").agg(weeks.alias("reserve_weeks"))
    keys = fx.season_points(spark, d).select("season", "entity")
    return panel.missed_time(keys, absences, reserve, 1996, 2000).select("season", "entity", "missed_time")


# ---- evaluation

_RANKS = """, rk AS (SELECT *, rank() OVER (PARTITION BY season, position ORDER BY actual) + (count(*) OVER (PARTITION BY season, position, actual) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY season, position ORDER BY predicted) + (count(*) OVER (PARTITION BY season, position, predicted) - 1) / 2.0 AS rp FROM fc)"""


@query(with_(fx.FORECAST_SQL + _RANKS, "SELECT season, position, round(CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rp) > 0 THEN corr(ra, rp) ELSE 0 END, 6) AS spearman, count(*) AS n FROM rk GROUP BY 1, 2"))
def ev_spearman_macro(spark: SparkSession, d: str) -> DataFrame:
    return r6(evaluation.spearman(files.once(fx.forecasts(spark, d), "forecasts")), "spearman")


@query(with_(fx.FORECAST_SQL, """, s AS (SELECT a.season, a.position, sum(sign(b.predicted - a.predicted)) AS s FROM fc a JOIN fc b ON a.season = b.season AND a.position = b.position AND a.actual < b.actual GROUP BY 1, 2),
ta AS (SELECT season, position, sum(c * (c - 1) / 2.0) AS t, sum(c) * (sum(c) - 1) / 2.0 AS p FROM (SELECT season, position, actual, count(*) AS c FROM fc GROUP BY 1, 2, 3) GROUP BY 1, 2),
tp AS (SELECT season, position, sum(c * (c - 1) / 2.0) AS t FROM (SELECT season, position, predicted, count(*) AS c FROM fc GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT ta.season, ta.position, round(coalesce(s.s / nullif(sqrt(CAST((ta.p - ta.t) * (ta.p - tp.t) AS DOUBLE)), 0), 0), 6) AS kendall
FROM ta JOIN tp ON ta.season = tp.season AND ta.position = tp.position LEFT JOIN s ON ta.season = s.season AND ta.position = s.position"""))
def ev_kendall_macro(spark: SparkSession, d: str) -> DataFrame:
    return r6(evaluation.kendall(files.once(fx.forecasts(spark, d), "forecasts")), "kendall")


@query(with_(fx.FORECAST_SQL, """, rk AS (SELECT *, rank() OVER (PARTITION BY season, position ORDER BY actual DESC) + (count(*) OVER (PARTITION BY season, position, actual) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY season, position ORDER BY predicted DESC) + (count(*) OVER (PARTITION BY season, position, predicted) - 1) / 2.0 AS rp FROM fc)
SELECT season, round(avg(abs(actual - predicted)), 6) AS mae, round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse,
  round(1 - avg((actual - predicted) * (actual - predicted)) / var_pop(actual), 6) AS r2, round(avg(abs(ra - rp)), 6) AS rank_mae, round(covar_pop(actual, predicted) / var_pop(predicted), 6) AS slope,
  round(avg(actual) - covar_pop(actual, predicted) / var_pop(predicted) * avg(predicted), 5) AS intercept, count(*) AS n FROM rk GROUP BY season"""))
def ev_regression(spark: SparkSession, d: str) -> DataFrame:
    got = evaluation.regression(files.once(fx.forecasts(spark, d), "forecasts"), ["season"])
    return r6(got, "mae", "rmse", "r2", "rank_mae", "slope").withColumn("intercept", F.round("intercept", 5))


@query(with_(fx.FORECAST_SQL, """, r AS (SELECT *, greatest(actual, 0) AS gain, row_number() OVER (PARTITION BY season, position ORDER BY predicted DESC, entity) AS i, row_number() OVER (PARTITION BY season, position ORDER BY actual DESC, entity) AS j FROM fc),
x AS (SELECT season, position, predicted, avg(gain) * sum(CASE WHEN i <= 12 THEN 1 / log2(i + 1) ELSE 0 END) AS dcg, sum(gain * CASE WHEN j <= 12 THEN 1 / log2(j + 1) ELSE 0 END) AS idcg FROM r GROUP BY 1, 2, 3)
SELECT season, position, round(sum(dcg) / sum(idcg), 6) AS ndcg FROM x GROUP BY 1, 2 HAVING sum(idcg) > 0"""))
def ev_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return r6(evaluation.ndcg(fx.forecasts(spark, d), 12), "ndcg")


_PLACES = """, pl AS (SELECT *, row_number() OVER (PARTITION BY season, position ORDER BY predicted DESC, entity) AS i, row_number() OVER (PARTITION BY season, position ORDER BY actual DESC, entity) AS j, rank() OVER (PARTITION BY season, position ORDER BY actual DESC) AS r, count(*) OVER (PARTITION BY season, position) AS c FROM fc)"""


@query(with_(fx.FORECAST_SQL + _PLACES, "SELECT season, position, sum(CASE WHEN i <= 12 AND j <= 12 THEN 1 ELSE 0 END) / CAST(max(least(12, c)) AS DOUBLE) AS recall FROM pl GROUP BY 1, 2"))
def ev_topk_recall(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.topk_recall(fx.forecasts(spark, d), F.lit(12))


@query(with_(fx.FORECAST_SQL + _PLACES, "SELECT season, position, avg(CASE WHEN r > 24 THEN 1.0 ELSE 0.0 END) AS bust_rate FROM pl WHERE i <= 12 GROUP BY 1, 2"))
def ev_bust_rate(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.bust_rate(fx.forecasts(spark, d), F.lit(12))


_PROB = "pr AS (SELECT l.doc_id, lang, CAST(quality AS BIGINT) AS label, least(floor(CAST(n_chars AS DOUBLE) / 6) / 1000, CAST(1 AS DOUBLE)) AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _prob(spark: SparkSession, d: str) -> DataFrame:
    p = F.least(F.floor(F.col("n_chars") / 6.0) / 1000, F.lit(1.0))
    return fx.table(spark, d, "labels").join(fx.table(spark, d, "documents"), "doc_id").select("doc_id", "lang", F.col("quality").cast("bigint").alias("label"), p.alias("p"))


@query(with_(_PROB, """, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0 AS r FROM pr)
SELECT lang, round((sum(r * label) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0), 6) AS auc, count(*) AS n FROM r GROUP BY 1"""))
def ev_auc(spark: SparkSession, d: str) -> DataFrame:
    return r6(evaluation.auc(_prob(spark, d), ["lang"]), "auc")


_STEPS = """, st AS (SELECT p, CAST(sum(label) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM pr GROUP BY p),
cum AS (SELECT *, sum(pos) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS seen FROM st)"""


@query(with_(_PROB + _STEPS, "SELECT round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision FROM cum"))
def ev_avg_precision(spark: SparkSession, d: str) -> DataFrame:
    return r6(evaluation.average_precision(_prob(spark, d)), "average_precision")


@query(with_(_PROB + _STEPS, "SELECT p, round(tp / (SELECT sum(pos) FROM st), 6) AS tpr, round((seen - tp) / (SELECT sum(n - pos) FROM st), 6) AS fpr FROM cum"))
def ev_roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return r6(evaluation.roc_curve(_prob(spark, d)), "tpr", "fpr")


@query(with_(_PROB, "SELECT round(-avg(CASE WHEN label = 1 THEN ln(q) ELSE ln(1 - q) END), 6) AS log_loss, round(avg((p - label) * (p - label)), 6) AS brier, round(avg(label), 6) AS prevalence FROM (SELECT *, least(greatest(CAST(p AS DOUBLE), CAST(1e-6 AS DOUBLE)), CAST(1 - 1e-6 AS DOUBLE)) AS q FROM pr)"))
def ev_prob_loss(spark: SparkSession, d: str) -> DataFrame:
    return r6(evaluation.prob_loss(_prob(spark, d)), "log_loss", "brier", "prevalence")


@query(with_(fx.FORECAST_SQL, """, h AS (SELECT *, (rank() OVER (PARTITION BY season, position ORDER BY predicted) + (count(*) OVER (PARTITION BY season, position, predicted) - 1) / 2.0) / count(*) OVER (PARTITION BY season, position) AS pct, (entity % 100) / 100.0 AS health FROM fc),
b AS (SELECT *, round(CAST((1 - w) * pct + w * health AS DOUBLE), 9) AS bl, greatest(actual, 0) AS gain FROM h, (SELECT unnest([CAST(0 AS DOUBLE), 0.2, 0.5]) AS w)),
r AS (SELECT *, rank() OVER (PARTITION BY w, season, position ORDER BY actual) + (count(*) OVER (PARTITION BY w, season, position, actual) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY w, season, position ORDER BY bl) + (count(*) OVER (PARTITION BY w, season, position, bl) - 1) / 2.0 AS rp,
  row_number() OVER (PARTITION BY w, season, position ORDER BY bl DESC, entity) AS i, row_number() OVER (PARTITION BY w, season, position ORDER BY actual DESC, entity) AS j, rank() OVER (PARTITION BY w, season, position ORDER BY actual DESC) AS ar, count(*) OVER (PARTITION BY w, season, position) AS c FROM b),
x AS (SELECT w, season, position, bl, avg(gain) * sum(CASE WHEN i <= 12 THEN 1 / log2(i + 1) ELSE 0 END) AS dcg, sum(gain * CASE WHEN j <= 12 THEN 1 / log2(j + 1) ELSE 0 END) AS idcg FROM r GROUP BY 1, 2, 3, 4),
nd AS (SELECT w, season, position, sum(dcg) / sum(idcg) AS ndcg FROM x GROUP BY 1, 2, 3 HAVING sum(idcg) > 0),
pg AS (SELECT w, season, position, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rp) > 0 THEN corr(ra, rp) ELSE 0 END AS s, sum(CASE WHEN i <= 12 AND j <= 12 THEN 1 ELSE 0 END) / CAST(max(least(12, c)) AS DOUBLE) AS recall, avg(CASE WHEN i <= 12 THEN CASE WHEN ar > 24 THEN 1.0 ELSE 0.0 END END) AS bust FROM r GROUP BY 1, 2, 3)
SELECT CAST(pg.w AS DOUBLE) AS weight, round(avg(s), 4) AS spearman, round(avg(ndcg), 4) AS ndcg, round(avg(recall), 4) AS recall, round(avg(bust), 4) AS bust_rate FROM pg LEFT JOIN nd ON pg.w = nd.w AND pg.season = nd.season AND pg.position = nd.position GROUP BY 1"""))
def ev_weight_grid(spark: SparkSession, d: str) -> DataFrame:
    f = files.once(fx.forecasts(spark, d).withColumn("health", (F.col("entity") % 100) / 100.0), "forecasts")
    return evaluation.weight_grid(f, [0.0, 0.2, 0.5]).withColumns({c: F.round(c, 4) for c in ("spearman", "ndcg", "recall", "bust_rate")})


@query(with_(fx.FORECAST_SQL, """, z AS (SELECT avg(CASE WHEN actual <= 60 THEN 1.0 ELSE 0.0 END) AS share FROM fc WHERE season BETWEEN 1997 AND 1999),
n AS (SELECT *, row_number() OVER (PARTITION BY season, position ORDER BY predicted, entity) AS i, count(*) OVER (PARTITION BY season, position) AS c FROM fc WHERE season >= 2000)
SELECT season, entity, CASE WHEN i <= round_even(CAST(share AS DOUBLE) * c, 0) THEN min(predicted) OVER (PARTITION BY season, position) ELSE predicted END AS tied FROM n, z"""))
def ev_tie_bottom(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts of the seasons from 2000 on, tied by the share of low seasons among the three before."""
    f = fx.forecasts(spark, d)
    low = f.where(F.col("season").between(1997, 1999)).agg(F.avg((F.col("actual") <= 60).cast("double"))).first()[0]
    return evaluation.tie_bottom(f.where("season >= 2000"), low or 0.0).select("season", "entity", "tied")


#: Forecasts with few kickers, so that bins of under 20 rows take the whole group's quantiles.
_UNEVEN = fx.FORECAST_SQL.replace("fc AS (SELECT", "fc0 AS (SELECT") + ", fc AS (SELECT * FROM fc0 WHERE position <> 'K' OR (season = 2000 AND entity % 5 = 0))"


def _uneven(spark: SparkSession, d: str) -> DataFrame:
    return fx.forecasts(spark, d).where("position <> 'K' or (season = 2000 and entity % 5 = 0)")


_BANDS = """, cuts AS (SELECT position, quantile_cont(predicted, CAST(1 AS DOUBLE) / 3) AS c1, quantile_cont(predicted, CAST(2 AS DOUBLE) / 3) AS c2 FROM fc GROUP BY 1),
bn AS (SELECT f.*, c1, c2, CASE WHEN predicted <= c1 THEN 0 WHEN predicted <= c2 THEN 1 ELSE 2 END AS bin FROM fc f JOIN cuts c ON f.position = c.position),
own AS (SELECT position, bin, quantile_cont(actual - predicted, 0.1) AS p10, quantile_cont(actual - predicted, 0.5) AS p50, quantile_cont(actual - predicted, 0.9) AS p90, count(*) AS n FROM bn GROUP BY 1, 2),
whole AS (SELECT position, quantile_cont(actual - predicted, 0.1) AS w10, quantile_cont(actual - predicted, 0.5) AS w50, quantile_cont(actual - predicted, 0.9) AS w90, count(*) AS wn FROM fc GROUP BY 1),
bands AS (SELECT position, bin, CASE WHEN n >= 20 THEN p10 ELSE w10 END AS p10, CASE WHEN n >= 20 THEN p50 ELSE w50 END AS p50, CASE WHEN n >= 20 THEN p90 ELSE w90 END AS p90, CASE WHEN n >= 20 THEN n ELSE wn END AS n
  FROM (SELECT position, unnest([0, 1, 2]) AS bin, * EXCLUDE (position) FROM whole) JOIN (SELECT DISTINCT position AS p_ FROM bn) ON position = p_ LEFT JOIN own USING (position, bin))"""


@query(with_(_UNEVEN + _BANDS, "SELECT position, CAST(bin AS INTEGER) AS bin, round(p10, 4) AS p10, round(p50, 4) AS p50, round(p90, 4) AS p90, n FROM bands"))
def ev_resid_intervals(spark: SparkSession, d: str) -> DataFrame:
    got = evaluation.residual_intervals(files.once(_uneven(spark, d), "forecasts")).drop("low", "high")
    return got.withColumns({c: F.round(c, 4) for c in ("p10", "p50", "p90")})


@query(with_(_UNEVEN + _BANDS, "SELECT b.season, b.entity, round(greatest(predicted + p10, 0), 2) AS low, round(predicted + p90, 2) AS high FROM bn b JOIN bands x ON b.position = x.position AND b.bin = x.bin"))
def ev_apply_intervals(spark: SparkSession, d: str) -> DataFrame:
    f = files.once(_uneven(spark, d), "forecasts")
    got = evaluation.apply_intervals(f, evaluation.residual_intervals(f))
    return got.select("season", "entity", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"))


#: Sums that a ridge of two features needs, over all seasons before each; centred by 50 and 40, so that little cancels.
_NULL_FITS = """, nf AS (SELECT s.season, s.position, s.entity, round(s.target, 6) AS y, coalesce(b.target, 0) - 50 AS x1, coalesce(b.carries, 0) - 40 AS x2
  FROM seasons s LEFT JOIN seasons b ON b.season + 1 = s.season AND b.entity = s.entity),
sd AS (SELECT unnest([1, 2, 3, 4, 5]) AS seed),
own AS (SELECT seed, nf.*, row_number() OVER (PARTITION BY seed, season, position ORDER BY entity) AS i FROM nf, sd),
dealt AS (SELECT seed, season, position, y AS p, row_number() OVER (PARTITION BY seed, season, position ORDER BY md5(seed || ':' || entity), entity) AS i FROM nf, sd),
pm AS (SELECT o.*, p FROM own o JOIN dealt d ON o.seed = d.seed AND o.season = d.season AND o.position = d.position AND o.i = d.i),
sm AS (SELECT seed, season, CAST(count(*) AS DOUBLE) AS n, sum(x1) AS a, sum(x2) AS b, sum(p) AS c, sum(x1 * x1) AS aa, sum(x2 * x2) AS bb, sum(x1 * x2) AS ab, sum(x1 * p) AS ac, sum(x2 * p) AS bc FROM pm GROUP BY 1, 2),
up AS (SELECT q.seed, q.season, sum(m.n) AS n, sum(m.a) AS a, sum(m.b) AS b, sum(m.c) AS c, sum(m.aa) AS aa, sum(m.bb) AS bb, sum(m.ab) AS ab, sum(m.ac) AS ac, sum(m.bc) AS bc
  FROM (SELECT DISTINCT seed, season FROM sm) q JOIN sm m ON m.seed = q.seed AND m.season < q.season GROUP BY 1, 2),
vr AS (SELECT *, sqrt(aa / n - (a / n) * (a / n)) AS s1, sqrt(bb / n - (b / n) * (b / n)) AS s2, ab / n - a / n * b / n AS c12, ac / n - a / n * c / n AS c1, bc / n - b / n * c / n AS c2 FROM up
  WHERE season >= (SELECT min(season) + 2 FROM sm)),
eq AS (SELECT *, n + 10 AS e, n * c12 / (s1 * s2) AS f, n * c1 / s1 AS g, n * c2 / s2 AS h FROM vr),
bt AS (SELECT *, (e * g - f * h) / (e * e - f * f) / s1 AS b1, (e * h - f * g) / (e * e - f * f) / s2 AS b2 FROM eq),
pd AS (SELECT pm.seed, pm.season, pm.position, y, round(c / n + b1 * (x1 - a / n) + b2 * (x2 - b / n), 6) AS v FROM pm JOIN bt ON pm.seed = bt.seed AND pm.season = bt.season),
pr AS (SELECT *, rank() OVER (PARTITION BY seed, season, position ORDER BY y) + (count(*) OVER (PARTITION BY seed, season, position, y) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY seed, season, position ORDER BY v) + (count(*) OVER (PARTITION BY seed, season, position, v) - 1) / 2.0 AS rp FROM pd),
pg AS (SELECT seed, season, position, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rp) > 0 THEN corr(ra, rp) ELSE 0 END AS c FROM pr GROUP BY 1, 2, 3)"""


@query(with_(fx.SEASON_SQL + _NULL_FITS, "SELECT CAST(seed AS INTEGER) AS seed, round(avg(c), 4) AS spearman FROM pg GROUP BY 1"))
def ev_permute_null(spark: SparkSession, d: str) -> DataFrame:
    """Macro rank correlation of true points with forecasts refitted in every season on targets shuffled within their groups, for five seeds."""
    s = fx.season_table(spark, d)
    seasons = sorted(r.season for r in s.select("season").distinct().collect())  # a table has few
    rows = panel.lagged(s.select("season", "entity", "position", F.round("target", 6).alias("actual")), s, ["target", "carries"], range(1, 2))
    rows = files.once(rows.withColumn("features", F.array("lag1_target", "lag1_carries")).select("season", "entity", "position", "actual", "features"), "null")
    held = seasons[2:]
    since = sum(((F.col("season") >= x).cast("int") for x in held), F.lit(0))
    dealt = evaluation.permuted(rows, [1, 2, 3, 4, 5])
    wide = dealt.groupBy("season", "entity").agg(*[F.max(F.when(F.col("seed") == k, F.col("permuted"))).alias(f"y{k}") for k in range(1, 6)])
    m = gram.moments(files.once(rows.join(wide, ["season", "entity"]).withColumn("since", since), "dealt"), len(held), [f"y{k}" for k in range(1, 6)])
    fits = {str(k): np.stack([m.ridge(fold, f"y{k}", 10.0) for fold in range(len(held))]) for k in range(1, 6)}
    fold = F.coalesce(*[F.when(F.col("season") == x, k) for k, x in enumerate(held)], F.lit(-1))
    got = gram.predict(rows.withColumn("fold", fold).where("fold >= 0"), fits, m.medians, variant="seed").withColumn("predicted", F.round("predicted", 6))
    per = evaluation.spearman(files.once(got, "null"), ["seed", *G]).groupBy(F.col("seed").cast("int").alias("seed"))
    return per.agg(F.round(F.avg("spearman"), 4).alias("spearman"))


@query()
def ev_cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Intervals over 500 draws of entities: error, macro rank correlation and AUC, and gains on a second forecast in the same draws."""
    f = fx.forecasts(spark, d).withColumns({"flat": F.lit(100.0), "other": F.floor(F.col("predicted") / 50) * 50.0, "label": (F.col("actual") > 60).cast("int")})
    rows, n = bootstrap.weighted(f, 500), 500
    rank, auc = bootstrap.draw_spearman(rows, n), bootstrap.draw_auc(rows, n, score="predicted")
    each = {
        "mae": bootstrap.draw_mae(rows, n),
        "mae_gain": bootstrap.draw_mae(rows, n, other="flat"),
        "spearman": rank,
        "spearman_gain": bootstrap.paired(rank, bootstrap.draw_spearman(rows, n, predicted="other")),
        "auc": auc,
        "auc_gain": bootstrap.paired(auc, bootstrap.draw_auc(rows, n, score="other")),
    }
    return reduce(DataFrame.unionByName, [bootstrap.interval(v).withColumn("statistic", F.lit(k)) for k, v in each.items()])


@query(with_(fx.FORECAST_SQL, ", m AS (SELECT position, avg(abs(actual - predicted)) AS mae FROM fc GROUP BY 1) SELECT position AS candidate, round(mae, 6) AS mae FROM m WHERE -mae >= (SELECT max(-mae) FROM m) - 5 ORDER BY position LIMIT 1"))
def ev_select_tolerance(spark: SparkSession, d: str) -> DataFrame:
    m = fx.forecasts(spark, d).groupBy("position").agg(F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae")).withColumn("score", -F.col("mae"))
    got = evaluation.within_tolerance(m, "score", 5.0, F.col("position"))
    return got.select(F.col("position").alias("candidate"), F.round("mae", 6).alias("mae"))


# ---- evidence

_LONG = "lf AS (SELECT vec_id, label, i AS feature, CAST(embedding[i] AS DOUBLE) AS x, CAST(label = 0 AS BIGINT) AS y FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"


def _features(spark: SparkSession, d: str) -> DataFrame:
    """A row for each element of each vector, however many elements there are."""
    e = fx.table(spark, d, "embeddings").select("vec_id", "label", (F.col("label") == 0).cast("bigint").alias("y"), F.posexplode("embedding").alias("i", "x"))
    return e.select("vec_id", "label", "y", (F.col("i") + 1).cast("bigint").alias("feature"), F.col("x").cast("double").alias("x"))


_FRANK = """, fr AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM lf)"""


def _tail_sql(z: str) -> str:
    """SQL of fn.normal_tail."""
    t = f"(1 / (1 + ({z}) / sqrt(CAST(2 AS DOUBLE)) / 2))"
    poly = repr(fn.ERFC[-1])
    for c in reversed(fn.ERFC[:-1]):
        poly = f"(({poly}) * {t} + CAST({c!r} AS DOUBLE))"
    return f"{t} * exp({poly} - ({z}) * ({z}) / 2) / 2"


_ASSOC = _LONG + _FRANK + """, ft AS (SELECT feature, sum(t * t * t - t) AS ties FROM (SELECT feature, x, CAST(count(*) AS DOUBLE) AS t FROM lf GROUP BY 1, 2) GROUP BY 1),
fu AS (SELECT feature, avg(CASE WHEN y = 1 THEN x END) AS mean_1, avg(CASE WHEN y = 0 THEN x END) AS mean_0, corr(rx, ry) AS spearman, corr(x, y) AS point_biserial,
  CAST(sum(rx * y) - sum(y) * (sum(y) + 1) / 2.0 AS DOUBLE) AS u, CAST(sum(y) AS DOUBLE) AS n1, CAST(count(*) - sum(y) AS DOUBLE) AS n0 FROM fr GROUP BY 1),
fz AS (SELECT fu.*, u / (n1 * n0) AS auc, (greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / sqrt(n1 * n0 / 12 * (n0 + n1 + 1 - ties / ((n0 + n1) * (n0 + n1 - 1)))) AS z FROM fu JOIN ft USING (feature)),
fp AS (SELECT *, least(2 * (""" + _tail_sql("greatest(z, CAST(0 AS DOUBLE))") + """), 1) AS p FROM fz)"""


@query(with_(_ASSOC, """SELECT feature, round(mean_1, 6) AS mean_1, round(mean_0, 6) AS mean_0, round(spearman, 6) AS spearman, round(point_biserial, 6) AS point_biserial, round(auc, 6) AS auc,
  round(greatest(auc, 1 - auc), 6) AS auc_best, CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END AS direction, round(p, 6) AS p FROM fp"""))
def fe_assoc(spark: SparkSession, d: str) -> DataFrame:
    return r6(evidence.association(_features(spark, d)), "mean_1", "mean_0", "spearman", "point_biserial", "auc", "auc_best", "p")


@query(with_(_LONG, """, r AS (SELECT *, (rank() OVER (PARTITION BY feature, label % 3 ORDER BY x) + (count(*) OVER (PARTITION BY feature, label % 3, x) - 1) / 2.0) / count(*) OVER (PARTITION BY feature, label % 3) AS rx,
  (rank() OVER (PARTITION BY feature, label % 3 ORDER BY y) + (count(*) OVER (PARTITION BY feature, label % 3, y) - 1) / 2.0) / count(*) OVER (PARTITION BY feature, label % 3) AS ry FROM lf), sc AS (SELECT feature, round(abs(corr(rx, ry)), 6) AS score FROM r GROUP BY 1)
SELECT feature, score, CAST(row_number() OVER (ORDER BY score DESC, feature) AS INTEGER) AS place FROM sc WHERE score > 0 QUALIFY place <= 20"""))
def fe_fold_select(spark: SparkSession, d: str) -> DataFrame:
    """The 20 features with the strongest rank correlation inside groups."""
    rows = _features(spark, d).withColumn("g", F.col("label") % 3)
    return evidence.top_features(r6(evidence.fold_scores(rows, ["g"]), "score"), 20).select("feature", "score", "place")


@query(with_(_ASSOC, """, n AS (SELECT feature, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, feature) AS raw FROM fp)
SELECT feature, round(p, 6) AS p, round(least(min(raw) OVER (ORDER BY p, feature ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS q FROM n"""))
def fe_bh(spark: SparkSession, d: str) -> DataFrame:
    return r6(evidence.benjamini_hochberg(evidence.association(_features(spark, d)).select("feature", "p")), "p", "q")


@query(with_(_ASSOC, """, sc AS (SELECT feature, round(abs(spearman), 9) AS v, 'spearman' AS method FROM fp UNION ALL SELECT feature, round(greatest(auc, 1 - auc), 9), 'auc' FROM fp UNION ALL SELECT feature, round(abs(point_biserial), 9), 'f_test' FROM fp),
rk AS (SELECT method, feature, row_number() OVER (PARTITION BY method ORDER BY v DESC, feature) AS rank, count(*) OVER (PARTITION BY method) AS d, CASE method WHEN 'auc' THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS w FROM sc)
SELECT feature, round(sum(w / rank), 6) AS reciprocal, CAST(sum(w * (d - rank)) AS DOUBLE) AS borda, CAST(count(*) FILTER (WHERE rank <= 20) AS BIGINT) AS in_top FROM rk GROUP BY 1"""))
def fe_vote(spark: SparkSession, d: str) -> DataFrame:
    """Three rankings against the target vote; the AUC's vote counts double."""
    a = evidence.association(_features(spark, d))
    size = a.select("feature", F.abs("spearman").alias("spearman"), F.col("auc_best").alias("auc"), F.abs("point_biserial").alias("f_test"))
    rows = size.unpivot(["feature"], ["spearman", "auc", "f_test"], "method", "v")
    ranks = rows.withColumn("rank", F.row_number().over(Window.partitionBy("method").orderBy(F.desc(F.round("v", 9)), "feature")))
    return r6(evidence.vote(ranks, {"auc": 2.0}), "reciprocal")


# ---- the board

_BOARD = ", bf AS (SELECT entity, position, team, predicted AS points, round((entity % 100) / 100.0, 2) AS risk FROM fc WHERE season = 2000)"


def _board(spark: SparkSession, d: str) -> DataFrame:
    f = fx.forecasts(spark, d).where("season = 2000")
    return board.build(f.select("entity", "position", "team", F.col("predicted").alias("points"), F.round((F.col("entity") % 100) / 100.0, 2).alias("risk")))


def _half_up(x: str, digits: int) -> str:
    """SQL of Spark's round, which goes by the decimal digits of a number."""
    return f"CAST(round(CAST({x} AS DECIMAL(28, 10)), {digits}) AS DOUBLE)"


_SCORES = f""", k AS (SELECT *, 1 - risk AS health, (rank() OVER (PARTITION BY position ORDER BY points) + (count(*) OVER (PARTITION BY position, points) - 1) / 2.0) / count(*) OVER (PARTITION BY position) AS pct,
  rank() OVER (PARTITION BY position ORDER BY points DESC) AS position_rank, row_number() OVER (PARTITION BY position ORDER BY points DESC, entity) AS i,
  least(CASE position WHEN 'RB' THEN 24 WHEN 'WR' THEN 36 ELSE 12 END, count(*) OVER (PARTITION BY position)) AS cut,
  least(greatest(1 - risk - avg(1 - risk) OVER (PARTITION BY position) + 0.5, 0), 1) AS relative FROM bf),
v AS (SELECT *, {_half_up("points - max(CASE WHEN i = cut THEN points END) OVER (PARTITION BY position)", 2)} AS vorp FROM k),
o AS (SELECT *, {_half_up("greatest(vorp, 0) / max(vorp) OVER ()", 4)} AS overall_value FROM v)"""
_BUILT = _BOARD + _SCORES + f""", bd AS (SELECT entity, position, team, points, round(pct, 6) AS pct, position_rank, {_half_up("100 * (0.8 * pct + 0.2 * health)", 2)} AS draft_score, vorp, overall_value,
  {_half_up("100 * (0.8 * overall_value + 0.2 * relative)", 2)} AS overall_score, CASE WHEN risk <= 0.2 THEN 'lower' WHEN risk <= 0.35 THEN 'moderate' ELSE 'higher' END AS risk_band FROM o)"""


@query(with_(fx.FORECAST_SQL + _BUILT, "SELECT * FROM bd"))
def brd_scores(spark: SparkSession, d: str) -> DataFrame:
    """The figures of one season's board from forecasts alone."""
    return r6(_board(spark, d), "pct")


_ASSEMBLED = _COHORT_SQL + f""", own AS (SELECT entity, position, round(target, 6) AS points FROM seasons WHERE season = 2000),
peer AS (SELECT position, round(avg(points), 4) AS points FROM own GROUP BY 1),
old AS (SELECT entity, round((count(*) FILTER (WHERE status = 'RES') + 1) / CAST(count(*) + 2 AS DOUBLE), 4) AS risk FROM games WHERE season < 2001 GROUP BY 1),
sc AS (SELECT entity, min(reason) AS designation FROM games WHERE season = 2001 AND season_type = 'REG' AND status = 'RES' AND {_PHYS} GROUP BY 1),
bf AS (SELECT c.entity, c.position, c.team, coalesce(own.points, peer.points) AS points, CASE WHEN own.entity IS NULL THEN 'position' ELSE 'history' END AS points_source,
  coalesce(old.risk, 0.5) AS risk, CASE WHEN f.season = 2001 THEN 'yes' ELSE 'no' END AS is_rookie, 2001 - f.season AS years_exp
  FROM co c JOIN firsts f ON f.entity = c.entity LEFT JOIN own ON own.entity = c.entity LEFT JOIN peer ON peer.position = c.position LEFT JOIN old ON old.entity = c.entity
  WHERE c.origin = 'current' AND c.available)""" + _SCORES


@query(with_(_ASSEMBLED, f"""SELECT o.entity, position, team, is_rookie, years_exp, points, points_source, risk, round(pct, 6) AS pct, position_rank, {_half_up("100 * (0.8 * pct + 0.2 * health)", 2)} AS draft_score,
vorp, overall_value, round(relative, 6) AS relative_health, {_half_up("100 * (0.8 * overall_value + 0.2 * relative)", 2)} AS overall_score, CASE WHEN risk <= 0.2 THEN 'lower' WHEN risk <= 0.35 THEN 'moderate' ELSE 'higher' END AS risk_band,
CASE WHEN position = 'K' THEN 'low (kicker)' ELSE 'standard' END AS points_confidence, sc.entity IS NOT NULL AS listed, designation FROM o LEFT JOIN sc ON sc.entity = o.entity"""))
def brd_build(spark: SparkSession, d: str) -> DataFrame:
    """The board of the current roster: forecasts, probabilities, metadata and listings, each candidate covered."""
    g = files.once(fx.games(spark, d), "games")
    current = _cohort(spark, d).where("origin = 'current'").select("entity", "position", "team", "available")
    since = g.groupBy("entity").agg(F.min("season").alias("since"))
    people = current.join(since, "entity").select("*", F.when(F.col("since") == 2001, "yes").otherwise("no").alias("is_rookie"), (2001 - F.col("since")).alias("years_exp")).drop("since")
    own = fx.season_points(spark, d).where("season = 2000").select("entity", "position", F.round("target", 6).alias("own"))
    peer = own.groupBy("position").agg(F.round(F.avg("own"), 4).alias("peer"))
    forecasts = current.select("entity", "position").join(own.drop("position"), "entity", "left").join(peer, "position", "left")
    forecasts = forecasts.select("entity", F.coalesce("own", "peer").alias("points"), F.when(F.col("own").isNull(), "position").otherwise("history").alias("points_source"))
    past = g.where("season < 2001").groupBy("entity").agg(F.round((F.count_if(F.col("status") == "RES") + 1) / (F.count("*") + 2), 4).alias("risk"))
    risks = current.select("entity").join(past, "entity", "left").select("entity", F.coalesce("risk", F.lit(0.5)).alias("risk"))
    hurt = g.where("season = 2001 AND season_type = 'REG' AND status = 'RES'").where(fn.physical(F.col("reason"), fx.NON_PHYSICAL))
    screen = hurt.select("entity", F.col("reason").alias("designation"), F.lit("2001-12-31").alias("status_as_of"))
    got = board.assemble(people, forecasts, risks, screen, "2001-12-31")
    cols = ["entity", "position", "team", "is_rookie", "years_exp", "points", "points_source", "risk", "pct", "position_rank", "draft_score", "vorp", "overall_value"]
    return r6(got.select(*cols, "relative_health", "overall_score", "risk_band", "points_confidence", "listed", "designation"), "pct", "relative_health")


@query(with_(fx.FORECAST_SQL + _BUILT, """, pg AS (SELECT 'ALL' AS page, * FROM bd UNION ALL SELECT position, * FROM bd UNION ALL SELECT 'INJURED', * FROM bd WHERE risk_band = 'higher')
SELECT page, row_number() OVER (PARTITION BY page ORDER BY overall_score DESC, points DESC, entity) AS place, entity, points, overall_score, draft_score FROM pg"""))
def brd_pages(spark: SparkSession, d: str) -> DataFrame:
    return board.pages(_board(spark, d)).select("page", "place", "entity", "points", "overall_score", "draft_score")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Season points of each entity with the season before, the change of team, and the rank share among peers."""
    s = fx.season_points(spark, d)
    out = panel.lagged(s, s, ["target"], range(1, 2))
    before = s.select((F.col("season") + 1).alias("season"), "entity", F.col("team").alias("prior_team"))
    out = out.join(before, ["season", "entity"], "left")
    changed = F.coalesce((F.col("prior_team") != F.col("team")).cast("int"), F.lit(0))
    return out.withColumn("team_changed", changed).withColumn("pct", ranking.rank_pct(F.col("target"), G))
