"""Venue factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline import vocab

REGRESS = 500.0


def venue(team: Column, date: Column, overrides: dict | None = None) -> Column:
    """The venue label: the home team unless a (team, first date, last date) override holds."""
    out = team
    for (code, first, last), label in (vocab.VENUE_OVERRIDES if overrides is None else overrides).items():
        out = F.when((team == code) & date.between(F.lit(first).cast("date"), F.lit(last).cast("date")), label).otherwise(out)
    return out


def _factor(regress: float) -> Column:
    return ((F.col("K") + regress * F.col("_l")) / (F.col("PA") + regress)) / F.col("_l")


def k_factor(pa: DataFrame, regress: float = REGRESS) -> DataFrame:
    """(venue, PA, K, park_k_factor), highest first, over all of pa. The league total is an aggregate of the venues, one row that every venue meets."""
    by = pa.groupBy(venue(F.col("home_team"), F.to_date("game_date")).alias("venue")).agg(F.count("*").alias("PA"), F.count_if("is_k").alias("K"))
    league = by.agg((F.sum("K") / F.nullif(F.sum("PA"), F.lit(0))).alias("_l"))
    return by.join(F.broadcast(league)).select("venue", "PA", "K", F.when(F.col("_l") > 0, _factor(regress)).alias("park_k_factor")).orderBy(F.desc("park_k_factor"), "venue")


def season_factors(pa: DataFrame, seasons: Sequence[int], regress: float = REGRESS) -> DataFrame:
    """(season, home_team, PA, K, park_k_factor) for each target season from all seasons before it.

    A venue without history is neutral with no plate appearances. A season without games has the teams of the latest season before it (else
    the first one), at the venue where each plays on July 1. Seasons become rows: counts per venue and season meet the targets after
    them, so a target adds rows, not passes over the data.
    """
    dated = pa.select(F.col("home_team"), F.to_date("game_date").alias("game_date"), "is_k").withColumn("from_season", F.year("game_date"))
    dated = dated.withColumn("venue", venue(F.col("home_team"), F.col("game_date")))
    by = dated.groupBy("from_season", "venue").agg(F.count("*").alias("PA"), F.count_if("is_k").alias("K"))
    targets = pa.sparkSession.range(1).select(F.explode(F.array(*[F.lit(int(s)) for s in seasons])).alias("season"))
    past = by.join(F.broadcast(targets), F.col("from_season") < F.col("season"))
    history = past.groupBy("season", "venue").agg(F.sum("PA").alias("PA"), F.sum("K").alias("K"))
    league = past.groupBy("season").agg((F.sum("K") / F.sum("PA")).alias("_l"))
    played = dated.select("from_season", "home_team", "venue").distinct()
    known = played.select("from_season").distinct()
    nearest = targets.join(known).groupBy("season").agg(F.max(F.when(F.col("from_season") <= F.col("season"), F.col("from_season"))).alias("a"), F.min("from_season").alias("b"))
    nearest = nearest.select("season", F.coalesce("a", "b").alias("from_season"))
    places = nearest.join(played, "from_season")
    july = venue(F.col("home_team"), F.make_date("season", F.lit(7), F.lit(1)))
    places = places.select("season", "home_team", F.when(F.col("season") == F.col("from_season"), F.col("venue")).otherwise(july).alias("venue")).distinct()
    out = places.join(history, ["season", "venue"], "left").join(league, "season", "left")
    factor = F.when(F.col("PA").isNotNull() & (F.col("_l") > 0), _factor(regress)).otherwise(1.0)
    return out.select("season", "home_team", F.coalesce("PA", F.lit(0)).alias("PA"), F.coalesce("K", F.lit(0)).alias("K"), factor.alias("park_k_factor"))
