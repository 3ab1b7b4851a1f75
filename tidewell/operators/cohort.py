"""The cohort with what was known of each candidate by its target season: prospects of several sources, personal
data, body measures, draft, outcomes, and an audit.

Ids are text. Rows without a season, a known position, or (but for prospects, which get a made id) an entity are left out.
Every join has one row a key on its right side, so no candidate is doubled or lost; empty tables give empty columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import scalars as fn
from tidewell.operators import panel
from tidewell.sources import files

#: Tests of the body, by name.
MEASURES = ["forty", "bench", "vertical", "broad_jump", "cone", "shuttle"]
#: What a source of prospects says besides season, code, name, school, position and team; absent columns are unknown.
PROSPECT = {"height_text": "string", "weight_text": "string", **{m: "double" for m in MEASURES}, "draft_round": "double", "draft_number": "double"}
PERSON = ["code", "name", "birth", "height", "weight", "first_season", "draft_season", "draft_round", "draft_number"]


def positioned(df: DataFrame) -> DataFrame:
    """Rows whose position is one of the panel's, in any case, under its code there."""
    return df.withColumn("position", fn.mapped(F.upper("position"), fn.POSITIONS)).where("season is not null and position is not null")


def first_known(df: DataFrame, keys: list[str], columns: list[str], *order: Column) -> DataFrame:
    """One row a key, with the first known value of each column in `order`; equal places go by the value."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(c).alias("v"))))["v"]
    return df.groupBy(*keys).agg(*[first(c).alias(c) for c in columns])


def _by_code(df: DataFrame, right: DataFrame, *spread: str) -> DataFrame:
    """Left join by code to a right side that is unique by it; rows without a code match nothing.

    They should be dealt by `spread`, but Spark folds the constant side of `_deal` away, so they still meet in one task.
    """
    dealt = df.withColumn("_deal", F.when(F.col("code").isNull(), F.xxhash64(*spread)).otherwise(F.lit(0).cast("long")))
    return dealt.join(right.withColumn("_deal", F.lit(0).cast("long")), ["code", "_deal"], "left").drop("_deal")


def one_person(people: DataFrame) -> DataFrame:
    """people(entity, PERSON) with one row an entity: of several, the greatest by all columns in that order."""
    return people.where("entity is not null").groupBy("entity").agg(F.max(F.struct(*PERSON)).alias("p")).select("entity", "p.*")


def prospects(sources: list[DataFrame], people: DataFrame) -> DataFrame:
    """(season, entity, position, team, name, code, PROSPECT) of the entrants that any source names.

    A code that people know stands for its smallest entity. Others get an id made from the code, or without one from season,
    name and school. Where an id has several rows in a season, each column takes its first known value, rows with the lowest
    draft number first, then by source and name. An unknown team is UNK.
    """
    frames = []
    for place, source in enumerate(sources):
        said = [(F.col(c) if c in source.columns else F.lit(None)).cast(t).alias(c) for c, t in PROSPECT.items()]
        frames.append(positioned(source).select(F.col("season").cast("int").alias("season"), "code", "name", "school", "position", F.coalesce("team", F.lit("UNK")).alias("team"), *said, F.lit(place).alias("_place")))
    rows = frames[0]
    for other in frames[1:]:
        rows = rows.unionByName(other)
    codes = people.where("code is not null").groupBy("code").agg(F.min("entity").alias("entity"))
    rows = _by_code(rows, codes, "season", "name", "school")
    rows = rows.withColumn("entity", F.coalesce("entity", fn.pseudo_id(F.trim("code"), F.col("season"), F.col("name"), F.col("school"))))
    far = F.coalesce("draft_number", F.lit(float("inf")))
    columns = ["position", "team", "name", "code", *PROSPECT]
    return first_known(rows, ["season", "entity"], columns, far, F.col("_place"), F.coalesce("name", F.lit("")))


def measures(source: DataFrame) -> DataFrame:
    """(code, measured): body and tests of a code, one struct a season; of several rows of a season the greatest."""
    said = ["height_text", "weight_text", *MEASURES]
    rows = source.where("code is not null and season is not null").select("code", F.col("season").cast("int").alias("season"), *[F.col(c).cast(PROSPECT[c]).alias(c) for c in said])
    yearly = rows.groupBy("code", "season").agg(F.max(F.struct("season", *said)).alias("m"))
    return yearly.groupBy("code").agg(F.collect_list("m").alias("measured"))  # an element a season


def enrich(candidates: DataFrame, people: DataFrame, measured: DataFrame) -> DataFrame:
    """Candidates (season, entity, origin, name, code, PROSPECT) with what was known of them on the first of September.

    Personal data come first, then the prospect's own row, then the last measures under the code up to the target season.
    A draft after the target season is unknown. Without a first season an entrant's is its target season; age and years follow from the target season.
    """
    df = candidates.join(people.select("entity", *[F.col(c).alias(f"p_{c}") for c in PERSON]), "entity", "left")
    df = _by_code(df.withColumn("code", F.coalesce("code", "p_code")), measured, "season", "entity")
    df = df.withColumn("_m", F.array_max(F.filter("measured", lambda m: m["season"] <= F.col("season"))))
    df = df.withColumns({c: F.coalesce(F.col(c), F.col(f"_m.{c}")) for c in ["height_text", "weight_text", *MEASURES]})
    since = F.coalesce("p_first_season", F.when(F.col("origin") == "entrant", F.col("season")))
    drafted = F.coalesce(F.col("p_draft_season") <= F.col("season"), F.lit(True))
    number, round_ = (F.when(drafted, F.coalesce(f"p_{c}", c)) for c in ("draft_number", "draft_round"))
    inches = fn.height_inches(F.col("height_text")).cast("double")
    out = df.withColumns({
        "name": F.coalesce("name", "p_name"), "age": fn.age_at(F.col("season"), F.col("p_birth")),
        "height": F.coalesce(F.col("p_height"), inches), "weight": F.coalesce(F.col("p_weight"), fn.numeric(F.col("weight_text"))),
        "is_rookie": F.coalesce(F.col("season") == since, F.lit(False)).cast("int"), "years_exp": F.when(since.isNotNull(), F.greatest(F.col("season") - since, F.lit(0))),
        "draft_number": number, "draft_round": round_, "was_drafted": number.isNotNull().cast("int"),
    })
    return out.drop("height_text", "weight_text", "measured", "_m", *[f"p_{c}" for c in PERSON])


def with_baseline(cohort: DataFrame, outcomes: DataFrame) -> DataFrame:
    """cohort with the outcome of the season before, 0 where there is none; outcomes must be unique by season and entity."""
    before = outcomes.select((F.col("season") + 1).alias("season"), "entity", F.col("outcome").alias("previous_points"))
    return panel.left_checked(cohort, before, ["season", "entity"]).withColumn("previous_points", F.coalesce("previous_points", F.lit(0.0)))


def build(
    rosters: DataFrame, sources: list[DataFrame], people: DataFrame, outcomes: DataFrame, current: int, unavailable: list[str], first: int, last: int | None = None
) -> DataFrame:
    """Candidates of the seasons first..last (up to `current`), enriched, with outcome and the outcome before.

    rosters(season, entity, week, game, team, position, status); sources as for prospects(), the first one with the
    measures; people as for one_person(); outcomes(season, entity, outcome). Seasons after `last` are left out before
    outcomes are joined, so nothing of them is read into the result.
    """
    last = current if last is None else last
    if not first < current or not first <= last <= current:
        raise ValueError("need first < current and first <= last <= current")
    people = one_person(people)
    until = F.col("season") <= last
    new = files.once(prospects([s.where(until) for s in sources], people), "prospects")
    seen = positioned(rosters.where("entity is not null").where(until & (F.col("season") >= first - 1)))
    base = panel.build_cohort(seen, new.where(F.col("season") >= first), outcomes.where(until), current, unavailable)
    base = base.where(F.col("season").between(first, last)).withColumn("outcome", F.when(F.col("season") < current, F.col("outcome")))
    own = new.drop("position", "team").withColumn("origin", F.lit("entrant"))
    df = enrich(base.join(own, ["season", "entity", "origin"], "left"), people, measures(sources[0]))
    return with_baseline(df, outcomes)


def audit(cohort: DataFrame) -> DataFrame:
    """Rows, outcomes of exactly 0, and made ids of each season and origin."""
    made = F.col("entity").startswith("pfr:") | F.col("entity").startswith("prospect:")
    return cohort.groupBy("season", "origin").agg(F.count("*").alias("rows"), F.count_if(F.col("outcome") == 0).alias("zero_outcomes"), F.count_if(made).alias("made_ids"))


def contract(cohort: DataFrame, current: int) -> DataFrame:
    """One row a rule of the cohort's grain and times: how many rows break it.

    Rows are added up by key first, so a key that many rows share is a few partial sums.
    """
    season, source, origin, outcome = F.col("season"), F.col("source_season"), F.col("origin"), F.col("outcome")
    now = F.coalesce(season == current, F.lit(False))
    rules = {
        "position_of_the_panel": ~F.coalesce(F.col("position").isin(sorted(set(fn.POSITIONS.values()))), F.lit(False)),
        "current_outcome_is_unknown": now & outcome.isNotNull(),
        "earlier_outcome_is_known": ~now & outcome.isNull(),
        "prior_roster_is_older": (origin == "prior_roster") & ~F.coalesce(source < season, F.lit(False)),
        "entrants_are_of_the_season": (origin == "entrant") & ~F.coalesce(source == season, F.lit(False)),
        "current_is_current": (origin == "current") & ~now,
    }
    keyed = cohort.groupBy("season", "entity", "position").agg(F.count("*").alias("_n"), *[F.count_if(bad).alias(name) for name, bad in rules.items()])
    shared = F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("keys_are_unique")
    one = keyed.agg(shared, *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in rules])
    return one.unpivot([], ["keys_are_unique", *rules], "check", "violations")
