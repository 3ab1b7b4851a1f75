"""The enriched cohort over the given tables, with its SQL.

Customers are the known people, but every 7th has no code and every 50th shares one. Prospects are customers with an urgent
order in a season (with measures) and customers with a high one or suppliers with a shipment (with a draft place); suppliers,
and customers whose code people do not know, get made ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import scalars as fn
from tidewell.operators import cohort, depth
from tidewell.plans import fixtures as fx
from tidewell.sources import files

QUERIES, SQL = {}, {}
CURRENT, FIRST = 2001, 1996
SPOTS = ["QB", "FB", "WR", "TE", "PK", "LS"]  # LS is no position of the panel


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def people(spark: SparkSession, d: str) -> DataFrame:
    since = fx.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.year(F.min("o_orderdate")).alias("since"))
    key, nation, balance = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")
    code = F.when(key % 7 != 0, F.concat(F.lit("C"), (key - (key % 50 == 1).cast("int")).cast("string")))
    number = F.when(balance >= 0, F.floor(balance / 40) + 1).cast("double")
    return fx.table(spark, d, "customer").join(since, "c_custkey", "left").select(
        key.cast("string").alias("entity"), code.alias("code"), F.col("c_name").alias("name"),
        F.when(nation != 0, F.date_add(F.lit("1960-01-01").cast("date"), (key * 37 % 7000).cast("int"))).alias("birth"),
        F.when(balance >= 0, 65 + nation % 15).cast("double").alias("height"), F.when(nation % 5 != 1, 150 + key % 100).cast("double").alias("weight"),
        F.when(key % 3 != 0, F.col("since")).alias("first_season"), F.when(key % 4 != 0, F.col("since") + key % 2).cast("int").alias("draft_season"),
        (F.floor(number / 32) + 1).cast("double").alias("draft_round"), number.alias("draft_number"),
    )


def sources(spark: SparkSession, d: str) -> list[DataFrame]:
    """Prospects with measures, and prospects of a draft."""
    nation = fx.table(spark, d, "nation").select("n_nationkey", "n_name")
    named = fx.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    yearly = fx.table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("season"), "o_orderpriority").agg(
        F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.count("*").alias("n"), F.min("o_orderkey").alias("k"))
    rows = yearly.join(named, F.col("o_custkey") == F.col("c_custkey"))
    key, n, k = F.col("c_custkey"), F.col("n"), F.col("k")
    who = [
        "season", F.when(key % 13 != 0, F.concat(F.lit("C"), key.cast("string"))).alias("code"), F.col("c_name").alias("name"),
        F.col("n_name").alias("school"), fn.mapped(F.col("c_mktsegment"), fx.SEGMENTS).alias("position"),
    ]
    picked = F.when(k % 3 != 0, k % 320)
    measured = rows.where("o_orderpriority = '1-URGENT'").select(
        *who, F.when(n > 1, F.col("n_name")).alias("team"),
        F.when(key % 9 == 0, "6ft").otherwise(F.concat((5 + key % 2).cast("string"), F.lit("-"), (key % 12).cast("string"))).alias("height_text"),
        F.when(key % 11 == 0, "").otherwise((180 + key % 90).cast("string")).alias("weight_text"),
        (F.col("lo") / 100000).alias("forty"), F.when(n > 1, F.col("hi") / 100000).alias("bench"), n.cast("double").alias("vertical"),
        F.lit(None).cast("double").alias("broad_jump"), F.lit(None).cast("double").alias("cone"), (k % 1000 / 100).alias("shuttle"),
        (F.floor(picked / 32) + 1).cast("double").alias("draft_round"), picked.cast("double").alias("draft_number"),
    )
    place = [(F.floor(k % 224 / 32) + 1).cast("double").alias("draft_round"), (k % 224 + 1).cast("double").alias("draft_number")]
    drafted = rows.where("o_orderpriority = '2-HIGH'").select(*who, F.col("n_name").alias("team"), *place)
    shipped = fx.table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("season")).agg(F.min("l_orderkey").alias("k"))
    makers = fx.table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(shipped, F.col("l_suppkey") == F.col("s_suppkey"))
    spot = F.element_at(F.array(*map(F.lit, SPOTS)), (F.col("s_nationkey") % len(SPOTS) + 1).cast("int"))
    made = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("S"), F.col("s_suppkey").cast("string")))
    makers = makers.select("season", made.alias("code"), F.col("s_name").alias("name"), F.col("n_name").alias("school"), spot.alias("position"), F.lit(None).cast("string").alias("team"), *place)
    return [measured, drafted.unionByName(makers)]


def enriched(spark: SparkSession, d: str, games: DataFrame | None = None, seasons: DataFrame | None = None) -> DataFrame:
    """The cohort; `games` and their season_points, if they are written already."""
    text = F.col("entity").cast("string").alias("entity")
    if games is None:
        games = files.once(fx.games(spark, d).withColumn("entity", text), "games")
    games = games.withColumn("entity", text)
    if seasons is None:
        seasons = files.once(fx.season_points(spark, d, games).select("season", "entity", "target"), "outcomes")
    outcomes = seasons.select("season", text, F.round("target", 6).alias("outcome"))
    return cohort.build(games.where("season_type = 'REG'"), sources(spark, d), people(spark, d), outcomes, CURRENT, ["RES", "CUT"], FIRST)


_FIELDS = ["position", "team", "name", "code", *cohort.PROSPECT]
_SAID = ["height_text", "weight_text", *cohort.MEASURES]
_WHO = """season, CASE WHEN c_custkey % 13 <> 0 THEN 'C' || c_custkey END AS code, c_name AS name, n_name AS school,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'QB' WHEN 'BUILDING' THEN 'RB' WHEN 'FURNITURE' THEN 'WR' WHEN 'HOUSEHOLD' THEN 'TE' WHEN 'MACHINERY' THEN 'K' END AS position"""
_PLACE = "CAST(floor((k % 224) / 32.0) + 1 AS DOUBLE) AS draft_round, CAST(k % 224 + 1 AS DOUBLE) AS draft_number"
_NOTHING = ", ".join(f"CAST(NULL AS {'VARCHAR' if c.endswith('text') else 'DOUBLE'}) AS {c}" for c in _SAID)
_FIRST_KNOWN = ", ".join(f"(min(struct_pack(a := coalesce(draft_number, CAST('inf' AS DOUBLE)), b := place, n := coalesce(name, ''), v := {c})) FILTER (WHERE {c} IS NOT NULL)).v AS {c}" for c in _FIELDS)
_ENRICHED_SQL = fx.SEASON_SQL + f""",
ppl AS (SELECT CAST(c_custkey AS VARCHAR) AS entity, CASE WHEN c_custkey % 7 <> 0 THEN 'C' || (c_custkey - CASE WHEN c_custkey % 50 = 1 THEN 1 ELSE 0 END) END AS code, c_name AS name,
  CASE WHEN c_nationkey <> 0 THEN DATE '1960-01-01' + CAST(c_custkey * 37 % 7000 AS INTEGER) END AS birth,
  CASE WHEN c_acctbal >= 0 THEN CAST(65 + c_nationkey % 15 AS DOUBLE) END AS height, CASE WHEN c_nationkey % 5 <> 1 THEN CAST(150 + c_custkey % 100 AS DOUBLE) END AS weight,
  CASE WHEN c_custkey % 3 <> 0 THEN since END AS first_season, CASE WHEN c_custkey % 4 <> 0 THEN since + c_custkey % 2 END AS draft_season,
  CASE WHEN c_acctbal >= 0 THEN floor((floor(c_acctbal / 40) + 1) / 32) + 1 END AS draft_round, CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal / 40) + 1 END AS draft_number
  FROM customer LEFT JOIN (SELECT o_custkey, CAST(year(min(o_orderdate)) AS INTEGER) AS since FROM orders GROUP BY 1) ON o_custkey = c_custkey),
yearly AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS season, o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n, min(o_orderkey) AS k FROM orders GROUP BY 1, 2, 3),
cu AS (SELECT * FROM yearly JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
com AS (SELECT {_WHO}, CASE WHEN n > 1 THEN n_name END AS team, CASE WHEN c_custkey % 9 = 0 THEN '6ft' ELSE (5 + c_custkey % 2) || '-' || (c_custkey % 12) END AS height_text,
  CASE WHEN c_custkey % 11 = 0 THEN '' ELSE CAST(180 + c_custkey % 90 AS VARCHAR) END AS weight_text, lo / 100000 AS forty, CASE WHEN n > 1 THEN hi / 100000 END AS bench, CAST(n AS DOUBLE) AS vertical,
  CAST(NULL AS DOUBLE) AS broad_jump, CAST(NULL AS DOUBLE) AS cone, (k % 1000) / CAST(100 AS DOUBLE) AS shuttle,
  CASE WHEN k % 3 <> 0 THEN CAST(floor((k % 320) / 32.0) + 1 AS DOUBLE) END AS draft_round, CASE WHEN k % 3 <> 0 THEN CAST(k % 320 AS DOUBLE) END AS draft_number
  FROM cu WHERE o_orderpriority = '1-URGENT' AND season <= {CURRENT}),
drafted AS (SELECT {_WHO}, n_name AS team, {_NOTHING}, {_PLACE} FROM cu WHERE o_orderpriority = '2-HIGH' AND season <= {CURRENT}
  UNION ALL SELECT season, CASE WHEN s_suppkey % 3 <> 0 THEN 'S' || s_suppkey END, s_name, n_name,
  CASE s_nationkey % 6 WHEN 0 THEN 'QB' WHEN 1 THEN 'RB' WHEN 2 THEN 'WR' WHEN 3 THEN 'TE' WHEN 4 THEN 'K' END, NULL, {_NOTHING}, {_PLACE}
  FROM (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS season, min(l_orderkey) AS k FROM lineitem GROUP BY 1, 2) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE season <= {CURRENT}),
codes AS (SELECT code, min(entity) AS entity FROM ppl WHERE code IS NOT NULL GROUP BY 1),
said AS (SELECT r.* REPLACE (coalesce(team, 'UNK') AS team), coalesce(codes.entity, CASE WHEN r.code IS NOT NULL THEN 'pfr:' || r.code
  ELSE 'prospect:' || season || ':' || trim(regexp_replace(lower(name || '|' || school), '[^a-z0-9]+', '-', 'g'), '-') END) AS entity
  FROM (SELECT *, 0 AS place FROM com UNION ALL SELECT *, 1 FROM drafted) r LEFT JOIN codes ON codes.code = r.code WHERE position IS NOT NULL),
pr AS (SELECT season, entity, {_FIRST_KNOWN} FROM said GROUP BY 1, 2),
out_ AS (SELECT season, CAST(entity AS VARCHAR) AS entity, round(target, 6) AS outcome FROM seasons),
reg AS (SELECT season, CAST(entity AS VARCHAR) AS entity, team, position, status, row_number() OVER (PARTITION BY season, entity ORDER BY week DESC, team DESC, game DESC) AS i FROM games WHERE season_type = 'REG'),
cand AS (SELECT season + 1 AS season, entity, team, position, 'prior_roster' AS origin, season AS source_season, true AS available, NULL AS status FROM reg WHERE i = 1 AND season + 1 BETWEEN {FIRST} AND {CURRENT} - 1
  UNION ALL SELECT season, entity, team, position, 'entrant', season, true, NULL FROM pr WHERE season BETWEEN {FIRST} AND {CURRENT} - 1 AND NOT EXISTS (SELECT 1 FROM reg WHERE reg.i = 1 AND reg.season + 1 = pr.season AND reg.entity = pr.entity)
  UNION ALL SELECT season, entity, team, position, 'current', season, coalesce(status NOT IN ('RES', 'CUT'), true), status FROM reg WHERE i = 1 AND season = {CURRENT}),
own AS (SELECT c.*, pr.* EXCLUDE (season, entity, team, position, code), coalesce(pr.code, ppl.code) AS code, ppl.name AS p_name, birth, ppl.height AS p_height, ppl.weight AS p_weight, draft_season,
  ppl.draft_round AS p_round, ppl.draft_number AS p_number, coalesce(first_season, CASE WHEN origin = 'entrant' THEN c.season END) AS since
  FROM cand c LEFT JOIN pr ON pr.season = c.season AND pr.entity = c.entity AND c.origin = 'entrant' LEFT JOIN ppl ON ppl.entity = c.entity),
dated AS (SELECT o.*, {", ".join(f"m.{c} AS m_{c}" for c in _SAID)} FROM own o ASOF LEFT JOIN (SELECT * FROM com WHERE code IS NOT NULL) m ON m.code = o.code AND m.season <= o.season),
full_ AS (SELECT season, entity, coalesce(height_text, m_height_text) AS ht, coalesce(weight_text, m_weight_text) AS wt,
  CASE WHEN draft_season IS NULL OR draft_season <= season THEN coalesce(p_round, draft_round) END AS draft_round, CASE WHEN draft_season IS NULL OR draft_season <= season THEN coalesce(p_number, draft_number) END AS draft_number,
  {", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in cohort.MEASURES)}, * EXCLUDE (season, entity, draft_round, draft_number, {", ".join(cohort.MEASURES)}) FROM dated),
en AS (SELECT f.season, f.entity, f.position, f.team, coalesce(name, p_name) AS name, status, available, origin, source_season, round(date_diff('day', birth, make_date(f.season, 9, 1)) / 365.2425, 6) AS age,
  CASE WHEN since IS NOT NULL THEN greatest(f.season - since, 0) END AS years_exp,
  coalesce(p_height, CASE WHEN regexp_matches(ht, '^\\d+-\\d+$') THEN CAST(CAST(split_part(ht, '-', 1) AS INTEGER) * 12 + CAST(split_part(ht, '-', 2) AS INTEGER) AS DOUBLE) END) AS height, coalesce(p_weight, TRY_CAST(wt AS DOUBLE)) AS weight,
  draft_number, draft_round, CAST(draft_number IS NOT NULL AS INTEGER) AS was_drafted, CAST(coalesce(f.season = since, false) AS INTEGER) AS is_rookie,
  {", ".join(cohort.MEASURES)}, CASE WHEN f.season < {CURRENT} THEN coalesce(o.outcome, 0) END AS outcome, coalesce(b.outcome, 0) AS previous_points
  FROM full_ f LEFT JOIN out_ o ON o.season = f.season AND o.entity = f.entity LEFT JOIN out_ b ON b.season + 1 = f.season AND b.entity = f.entity)"""


@_query(f"WITH {_ENRICHED_SQL} SELECT * FROM en")
def coh_build(spark: SparkSession, d: str, games: DataFrame | None = None, seasons: DataFrame | None = None) -> DataFrame:
    """Veterans, entrants of two sources and the current roster, with body, age, draft, tests, outcome and the outcome before."""
    known = ["age", "years_exp", "height", "weight", "draft_number", "draft_round", "was_drafted", "is_rookie", *cohort.MEASURES]
    cols = ["season", "entity", "position", "team", "name", "status", "available", "origin", "source_season", *known, "outcome", "previous_points"]
    return enriched(spark, d, games, seasons).withColumn("age", F.round("age", 6)).select(*cols)


@_query(f"""WITH {_ENRICHED_SQL} SELECT season, origin, count(*) AS rows, count(*) FILTER (WHERE outcome = 0) AS zero_outcomes,
count(*) FILTER (WHERE entity LIKE 'pfr:%' OR entity LIKE 'prospect:%') AS made_ids FROM en GROUP BY 1, 2""")
def coh_audit(spark: SparkSession, d: str) -> DataFrame:
    return cohort.audit(enriched(spark, d))


_BROKEN_SQL = f""", twice AS (SELECT * FROM en UNION ALL SELECT * FROM en WHERE entity LIKE '%77'),
br AS (SELECT season, entity, CASE WHEN entity LIKE '%13' THEN 'LS' ELSE position END AS position, CASE WHEN entity LIKE '%43' AND origin = 'prior_roster' THEN 'current' ELSE origin END AS origin,
  CASE WHEN entity LIKE '%41' AND origin = 'prior_roster' THEN season WHEN entity LIKE '%42' AND origin = 'entrant' THEN season - 1 ELSE source_season END AS source_season,
  CASE WHEN entity LIKE '%5' AND season = {CURRENT} THEN 1 WHEN entity LIKE '%99' THEN NULL ELSE outcome END AS outcome FROM twice),
kn AS (SELECT *, count(*) OVER (PARTITION BY season, entity, position) AS n FROM br)"""


@_query(f"""WITH {_ENRICHED_SQL}{_BROKEN_SQL} SELECT 'keys_are_unique' AS "check", count(*) FILTER (WHERE n > 1) AS violations FROM kn
UNION ALL SELECT 'position_of_the_panel', count(*) FILTER (WHERE position = 'LS') FROM br
UNION ALL SELECT 'current_outcome_is_unknown', count(*) FILTER (WHERE season = {CURRENT} AND outcome IS NOT NULL) FROM br
UNION ALL SELECT 'earlier_outcome_is_known', count(*) FILTER (WHERE season <> {CURRENT} AND outcome IS NULL) FROM br
UNION ALL SELECT 'prior_roster_is_older', count(*) FILTER (WHERE origin = 'prior_roster' AND source_season >= season) FROM br
UNION ALL SELECT 'entrants_are_of_the_season', count(*) FILTER (WHERE origin = 'entrant' AND source_season <> season) FROM br
UNION ALL SELECT 'current_is_current', count(*) FILTER (WHERE origin = 'current' AND season <> {CURRENT}) FROM br""")
def chk_temporal(spark: SparkSession, d: str) -> DataFrame:
    """The whole contract of the enriched cohort, with faults planted by the ends of ids for each rule."""
    ends = lambda tail: F.col("entity").endswith(tail)
    is_, now = (lambda kind: F.col("origin") == kind), F.col("season") == CURRENT
    whole = files.once(enriched(spark, d).select("season", "entity", "position", "origin", "source_season", "outcome"), "cohort")
    source = F.when(ends("41") & is_("prior_roster"), F.col("season")).when(ends("42") & is_("entrant"), F.col("season") - 1).otherwise(F.col("source_season"))
    broken = whole.unionByName(whole.where(ends("77"))).select(
        "season", "entity", F.when(ends("13"), "LS").otherwise(F.col("position")).alias("position"), F.when(ends("43") & is_("prior_roster"), "current").otherwise(F.col("origin")).alias("origin"),
        source.alias("source_season"), F.when(ends("5") & now, 1.0).when(ends("99"), None).otherwise(F.col("outcome")).alias("outcome"),
    )
    return cohort.contract(broken, CURRENT)


_CHART_SQL = """, de AS (SELECT CAST(year(ts) AS INTEGER) AS season, date_trunc('day', ts) AS seen, user_id AS entity,
  CASE event_type WHEN 'click' THEN 'QB' WHEN 'error' THEN 'FB' WHEN 'purchase' THEN 'WR' WHEN 'signup' THEN 'PK' ELSE 'LS' END AS position,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(floor(value) AS DOUBLE) END AS depth_rank FROM events),
da AS (SELECT * FROM de JOIN (SELECT season, max(seen) AS seen FROM de WHERE seen < make_date(season, 1, 20) + 1 GROUP BY 1) USING (season, seen) WHERE position <> 'LS'),
wk AS (SELECT season, entity, position, CASE WHEN game % 10 = 0 THEN NULL ELSE CAST(1 + game % 5 AS DOUBLE) END AS depth_rank FROM games WHERE week = 1 AND reason IN ('URGENT', 'HIGH', 'MEDIUM')),
ti AS (SELECT season, entity, depth_rank, least(CASE WHEN position = 'WR' THEN ceil(depth_rank / 3) ELSE depth_rank END, CASE WHEN depth_rank IS NOT NULL THEN 3 END) AS depth_tier FROM da
  UNION ALL SELECT season, entity, depth_rank, least(depth_rank, CASE WHEN depth_rank IS NOT NULL THEN 3 END) FROM wk),
tiers AS (SELECT season, entity, depth_rank, depth_tier FROM ti QUALIFY row_number() OVER (PARTITION BY season, entity ORDER BY depth_tier NULLS LAST, depth_rank NULLS LAST) = 1)"""


def tiers(spark: SparkSession, d: str) -> DataFrame:
    """Charts by snapshots (events of a day) and by weeks (games), each read by its own layout."""
    spots = {"click": "QB", "error": "FB", "purchase": "WR", "signup": "PK"}
    snapshots = fx.table(spark, d, "events").select(
        F.year("ts").alias("season"), F.date_trunc("day", "ts").cast("string").alias("at"), F.col("user_id").alias("entity"), fn.mapped(F.col("event_type"), spots, F.lit("LS")).alias("position"),
        F.when(F.col("event_id") % 10 == 0, "-").otherwise(F.floor("value").cast("string")).alias("rank"),
    )
    formation = fn.mapped(F.col("reason"), {"URGENT": "Offense", "HIGH": "Special Teams", "MEDIUM": "Offense"}, F.lit("Defense"))
    rank = F.when(F.col("game") % 10 == 0, "").otherwise((1 + F.col("game") % 5).cast("string"))
    weeks = fx.games(spark, d).select("season", "week", formation.alias("formation"), "position", "entity", rank.alias("rank"))
    return files.by_variant([snapshots, weeks], "at", lambda x: depth.dated(x, 1, 20), depth.weekly)


@_query(f"WITH {fx.GAMES_SQL}{_CHART_SQL} SELECT season, entity, depth_rank, depth_tier FROM tiers")
def win_depth_tier(spark: SparkSession, d: str) -> DataFrame:
    """Rank and tier of the best row of each entity and season, from depth charts of both layouts."""
    return tiers(spark, d)


@_query(f"""WITH {fx.SEASON_SQL}{_CHART_SQL} SELECT s.season, s.entity, s.position, depth_rank, coalesce(depth_tier, 3) AS depth_tier, depth_tier IS NOT NULL AS depth_charted
FROM seasons s LEFT JOIN tiers t ON t.season = s.season AND t.entity = s.entity""")
def jn_depth_tier(spark: SparkSession, d: str) -> DataFrame:
    """Season rows with their tier; those without one are in the lowest."""
    rows = fx.season_points(spark, d).select("season", "entity", "position")
    return depth.with_tiers(rows, tiers(spark, d)).select("season", "entity", "position", "depth_rank", "depth_tier", "depth_charted")
