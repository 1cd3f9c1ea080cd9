"""Level 3: level-2 frames joined with the opposing lineup and the venue, under cardinality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.operators import checks

_LINEUP = {"opp_lineup_k": "k_rate_std", "opp_lineup_whiff": "whiff_rate_std", "opp_lineup_swstr": "swstr_rate_std", "opp_lineup_chase": "chase_rate_std"}


def opposing_lineup(starts: DataFrame, batters: DataFrame) -> DataFrame:
    """One row a start: size and mean rates of the initial lineup it faced, and the rate against the pitcher's hand. Nulls are left out of means."""
    checks.require_columns(batters, ("game_pk", "batter", "bat_team", "is_initial_lineup", "k_rate_std"), "batters")
    first = batters.where("is_initial_lineup").select("game_pk", F.col("bat_team").alias("opp_team"), "batter", "k_rate_std", "k_rate_std_vL", "k_rate_std_vR", "whiff_rate_std", "swstr_rate_std", "chase_rate_std")
    both = starts.select("game_pk", "pitcher", "opp_team", "p_throws").join(first, ["game_pk", "opp_team"], "left")
    means = {name: F.avg(c) for name, c in _LINEUP.items()} | {"_l": F.avg("k_rate_std_vL"), "_r": F.avg("k_rate_std_vR")}
    out = both.groupBy("game_pk", "pitcher", "p_throws").agg(F.count("batter").alias("opp_lineup_size"), *[c.alias(n) for n, c in means.items()])
    hand = F.when(F.col("p_throws") == "R", F.col("_r")).when(F.col("p_throws") == "L", F.col("_l"))
    return out.withColumn("opp_lineup_k_vs_hand", hand).drop("_l", "_r", "p_throws")


def with_park(frame: DataFrame, factors: DataFrame, check: bool = True) -> DataFrame:
    if check:
        checks.park_factors(frame, factors)
    return frame.join(factors.select("season", "home_team", "park_k_factor"), ["season", "home_team"], "left")


def pitcher_training(rolling: DataFrame, batters: DataFrame, factors: DataFrame, check: bool = True) -> DataFrame:
    lineup = opposing_lineup(rolling, batters)
    if check:
        checks.one_to_one(rolling, lineup, ("game_pk", "pitcher"))
        checks.lineups(lineup)
    return with_park(rolling.join(lineup, ["game_pk", "pitcher"], "left"), factors, check)


def batter_training(rolling: DataFrame, factors: DataFrame, check: bool = True) -> DataFrame:
    return with_park(rolling, factors, check)
