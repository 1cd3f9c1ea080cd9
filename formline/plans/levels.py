"""The three levels, and the whole way from season files to training frames."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline import vocab
from formline.operators import checks, games, identity, park, pitches, priors, rolling, training
from formline.sources import files
from formline.sources.files import Paths

PITCHER_STATICS = ("game_pk", "game_date", "season", "pitcher", "player_name", "pitcher_name", "p_throws", "home_team", "away_team", "is_home", "opp_team")
PITCHER_LABELS = ("K", "PA", "Outs", "k_rate")
BATTER_STATICS = ("game_pk", "game_date", "season", "batter", "batter_name", "stand", "bat_team", "home_team", "away_team", "is_home", "opp_team", "is_initial_lineup")


def select_features(df: DataFrame, keep: Sequence[str], keep_raw: bool = False) -> DataFrame:
    """Statics, labels and lagged features alone, unless raw columns are to stay."""
    import re

    return df if keep_raw else df.select(*[c for c in df.columns if c in keep or re.search(vocab.LAGGED_FEATURE, c)])


def pitcher_games(raw: DataFrame, players: DataFrame | None = None, history: DataFrame | None = None, least: int = vocab.LEAST_APPEARANCES) -> DataFrame:
    """Level-1 starts with estimators and names; history has pitches of the season before, for the prior of the first one."""
    prior = priors.hr_fb_before(raw if history is None else raw.unionByName(history, allowMissingColumns=True))
    out = priors.fip(games.pitcher_games(raw, least).join(F.broadcast(prior), "game_date", "left"))
    return identity.pitcher_names(out, players) if players is not None else out


def batter_games(raw: DataFrame, players: DataFrame | None = None, league_prior: float | None = None) -> DataFrame:
    out = games.batter_games(raw)
    if league_prior is not None:
        out = out.withColumn("prior_league_k_rate", F.lit(float(league_prior)))
    return identity.batter_names(out, players) if players is not None else out


def park_factors(raw: DataFrame, history: DataFrame | None, seasons: Sequence[int]) -> DataFrame:
    both = raw if history is None else raw.unionByName(history, allowMissingColumns=True)
    return park.season_factors(pitches.plate_appearances(both), seasons)


def pitcher_rolling(starts: DataFrame, keep_raw: bool = False) -> DataFrame:
    return select_features(rolling.pitcher_features(starts), PITCHER_STATICS + PITCHER_LABELS, keep_raw)


def batter_rolling(batters: DataFrame, keep_raw: bool = False) -> DataFrame:
    return select_features(rolling.batter_features(batters), BATTER_STATICS, keep_raw)


def run_games(spark: SparkSession, paths: Paths, years: Sequence[int], least: int = vocab.LEAST_APPEARANCES, players: DataFrame | None = None, official: dict[int, Sequence[int]] | None = None) -> None:
    """Level 1 to files. official: game ids by season to hold the season files against."""
    raw = files.load_seasons(spark, paths.data, years)
    for year, ids in (official or {}).items():
        checks.season_table(raw.where(F.col("game_year") == year), year, ids)
    before = None
    try:
        before = files.load_seasons(spark, paths.data, [min(years) - 1])
        before.schema  # noqa: B018
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    prior = pitches.plate_appearances(before).agg(F.avg(F.col("is_k").cast("double"))).first()[0] if before is not None else None
    files.write(pitcher_games(raw, players, before, least), paths.artifact("pitcher_games"))
    files.write(games.pitch_type_games(raw, least), paths.artifact("pitch_type_games"))
    files.write(batter_games(raw, players, prior), paths.artifact("batter_games"))
    files.write(park_factors(raw, before, [*years, max(years) + 1]), paths.artifact("park_factors"))


def run_rolling(spark: SparkSession, paths: Paths, keep_raw: bool = False) -> None:
    for name, build in (("pitcher", pitcher_rolling), ("batter", batter_rolling)):
        files.write(build(spark.read.parquet(paths.artifact(f"{name}_games")), keep_raw), paths.artifact(f"{name}_rolling"))


def run_training(spark: SparkSession, paths: Paths) -> None:
    pitchers, batters, factors = (spark.read.parquet(paths.artifact(x)) for x in ("pitcher_rolling", "batter_rolling", "park_factors"))
    files.write(training.pitcher_training(pitchers, batters, factors), paths.artifact("pitcher_training"))
    files.write(training.batter_training(batters, factors), paths.artifact("batter_training"))


def run_all(spark: SparkSession, paths: Paths, years: Sequence[int], least: int = vocab.LEAST_APPEARANCES, players: DataFrame | None = None, official: dict[int, Sequence[int]] | None = None) -> None:
    run_games(spark, paths, years, least, players, official)
    run_rolling(spark, paths)
    run_training(spark, paths)


def main(args: Sequence[str] | None = None) -> None:
    """python -m formline.plans.levels YEAR..."""
    from formline.session import session

    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("years", nargs="+", type=int)
    parser.add_argument("--register", help="CSV of player ids and names")
    parser.add_argument("--schedules", help="folder with a schedule feed YEAR.json of each season, to hold the seasons against")
    parser.add_argument("--players", help="where the player map is kept; made from the register if it is not there")
    parser.add_argument("--refresh", action="store_true", help="make it anew")
    parser.add_argument("--people", help="people feeds whose names complete the register")
    given = parser.parse_args(args)
    spark = session()
    players = None
    if given.register:
        read = lambda: files.register(spark, given.register)
        players = identity.load_player_map(spark, given.players, read, given.refresh) if given.players else identity.player_map(read(), "_place")
        players = identity.complete(players, files.read_people(spark, given.people)) if given.people else players
    official = {y: files.schedule_ids(files.read_schedule(spark, f"{given.schedules}/{y}.json")).first()["games"] for y in given.years} if given.schedules else None
    run_all(spark, Paths.from_environment(), given.years, players=players, official=official)


if __name__ == "__main__":
    main()
