"""The daily slate: parsed lineups joined with the schedule and with rosters."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.functions import expr as X
from formline.operators import checks
from formline.sources import files, html


class Slate(NamedTuple):
    lineups: DataFrame
    starters: DataFrame


_GAME = ["game_date", "away_team", "home_team", "away_team_id", "home_team_id"]


def attach_schedule(slate: Slate, schedule: DataFrame, check: bool = True) -> Slate:
    """Official game ids, times and states; each starter gets his side's probable pitcher. A game that is not scheduled raises."""
    if check:
        checks.unique_keys(schedule, _GAME, "schedule")
        for df in slate:
            checks.covered(df, schedule, _GAME, what="schedule")
    both = schedule.select(*_GAME, "game_pk", "game_time", "game_status", "away_probable_pitcher_id", "home_probable_pitcher_id")
    probable = F.when(F.col("is_home"), F.col("home_probable_pitcher_id")).otherwise(F.col("away_probable_pitcher_id"))
    lineups, starters = (df.join(both, _GAME, "left") for df in slate)
    drop = ("away_probable_pitcher_id", "home_probable_pitcher_id")
    return Slate(lineups.drop(*drop), starters.withColumn("probable_pitcher_id", probable).drop(*drop))


def ambiguous_keys(rosters: DataFrame) -> DataFrame:
    """(team_id, key) that more than one player of a team has."""
    return rosters.groupBy("team_id", X.name_key("player_name").alias("key")).agg(F.count_distinct("mlb_id").alias("players")).where("players > 1")


def resolve(df: DataFrame, rosters: DataFrame, aliases: DataFrame | None = None, check: bool = True) -> DataFrame:
    """df with mlb_id by team and name key; aliases(team_id, player_name, mlb_id) help where rosters do not. Ambiguous rosters and names left over raise."""
    if check and (found := ambiguous_keys(rosters).limit(5).collect()):
        raise ValueError(f"roster names that are not unique: {[tuple(r)[:2] for r in found]}")
    key = lambda table, name: table.select("team_id", X.name_key("player_name").alias("_key"), F.col("mlb_id").alias(name)).dropDuplicates(["team_id", "_key"])
    out = df.withColumn("_key", X.name_key("player_name")).join(key(rosters, "_a"), ["team_id", "_key"], "left")
    out = out.join(key(aliases, "_b"), ["team_id", "_key"], "left") if aliases is not None else out.withColumn("_b", F.lit(None).cast("long"))
    out = out.withColumn("mlb_id", F.coalesce("_a", "_b")).drop("_a", "_b", "_key")
    if check and (found := out.where("mlb_id is null and player_name is not null").select("team", "player_name").limit(5).collect()):
        raise ValueError(f"players on no roster: {[tuple(r) for r in found]}")
    return out


def build(pages: DataFrame, schedule: DataFrame, active: DataFrame, wider: DataFrame | None = None, aliases: DataFrame | None = None, require_confirmed: bool = False) -> Slate:
    """The resolved slate. If active rosters do not resolve everybody, the wider ones are united with them and tried once more."""
    slate = attach_schedule(Slate(*html.parse_slates(pages)), schedule)
    try:
        out = Slate(*(resolve(df, active, aliases) for df in slate))
    except ValueError:
        if wider is None:
            raise
        both = active.unionByName(wider).dropDuplicates(["team_id", "mlb_id"])
        out = Slate(*(resolve(df, both, aliases) for df in slate))
    checks.slate(*out, require_confirmed)
    return out


def write(slate: Slate, folder: str) -> tuple[str, str]:
    """Two tables named by the slate's date; more than one date, or none, raises."""
    dates = sorted({r[0] for df in slate for r in df.select("game_date").distinct().collect()})
    if len(dates) != 1:
        raise ValueError(f"a slate has one date, not {dates}")
    paths = tuple(f"{folder}/daily_{name}_{dates[0]}.parquet" for name in ("lineups", "starters"))
    for df, path in zip(slate, paths, strict=True):
        files.write(df, path)
    return paths
