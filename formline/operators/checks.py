"""Validation: every check raises ValueError. Checks of one table share a single aggregate where they can."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline import vocab
from formline.functions import expr as X


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> None:
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"{what} lacks columns {missing}")


def unique_keys(df: DataFrame, keys: Sequence[str], what: str = "table") -> None:
    """No two rows with the same keys."""
    if found := df.groupBy(*keys).count().where("count > 1").limit(5).collect():
        raise ValueError(f"{what} has duplicate keys {list(keys)}: {[tuple(r)[:-1] for r in found]}")


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    unique_keys(left, keys, "left side")
    unique_keys(right, keys, "right side")


def covered(df: DataFrame, dim: DataFrame, keys: Sequence[str], value: str | None = None, what: str = "dimension") -> None:
    """Every key of df is in dim, with a value if one is named."""
    have = dim.where(F.col(value).isNotNull()) if value else dim
    if found := df.select(*keys).distinct().join(have.select(*keys), list(keys), "left_anti").limit(5).collect():
        raise ValueError(f"{what} does not cover {[tuple(r) for r in found]}")


def season_table(df: DataFrame, year: int, official: Iterable[int], least_share: float = 0.98) -> None:
    """Required columns, rows, one year in both date columns, only official games and nearly all of them."""
    require_columns(df, ("game_pk", "game_date", "game_year"), "season")
    seen = df.agg(F.count("*").alias("n"), F.collect_set(F.year("game_date")).alias("dates"), F.collect_set(F.col("game_year").cast("int")).alias("years")).first()
    if not seen["n"]:
        raise ValueError("season is empty")
    if set(seen["dates"]) != {year} or set(seen["years"]) != {year}:
        raise ValueError(f"season {year} has years {sorted(seen['years'])} and dates of {sorted(seen['dates'])}")
    games = sorted(set(official))
    listed = df.sparkSession.createDataFrame([(g,) for g in games], "game_pk long") if games else df.select("game_pk").limit(0)
    mine = df.select(F.col("game_pk").cast("long").alias("game_pk")).distinct()
    if extra := mine.join(listed, "game_pk", "left_anti").limit(5).collect():
        raise ValueError(f"games that are not official: {[r[0] for r in extra]}")
    if (n := mine.count()) < least_share * len(games):
        raise ValueError(f"{n} of {len(games)} official games, less than {least_share:.0%}")


def exclusive_outcomes(df: DataFrame) -> None:
    """Strikes, balls and balls in play add up to pitches."""
    if found := df.where("Pitches <> Strikes + Balls + BIP").limit(5).collect():
        raise ValueError(f"outcomes of a pitch are not exclusive: {found}")


def with_exclusive_outcomes(df: DataFrame) -> DataFrame:
    """df; evaluating a row whose strikes, balls and balls in play do not add up to its pitches raises, without a job of its own."""
    same = F.col("Pitches") == F.col("Strikes") + F.col("Balls") + F.col("BIP")
    what = F.concat_ws(" ", F.lit("outcomes of a pitch are not exclusive: game"), F.col("game_pk").cast("string"))
    return df.withColumn("Pitches", F.when(same, F.col("Pitches")).otherwise(F.raise_error(what).cast("long")))


def exact_seasons(df: DataFrame, seasons: Iterable[int]) -> None:
    have = {r[0] for r in df.select("season").distinct().collect()}
    if have != set(seasons):
        raise ValueError(f"seasons {sorted(have)}, wanted {sorted(set(seasons))}")


def park_factors(frame: DataFrame, factors: DataFrame) -> None:
    """Factor keys are unique, all seasons and teams of frame are there and none is null."""
    unique_keys(factors, ("season", "home_team"), "park factors")
    covered(frame, factors, ("season",), what="park factor seasons")
    covered(frame, factors, ("season", "home_team"), "park_k_factor", "park factors")


def lineups(frame: DataFrame) -> None:
    """Nine batters in every lineup."""
    if found := frame.where("opp_lineup_size is null or opp_lineup_size <> 9").limit(5).collect():
        raise ValueError(f"lineups without nine batters: {[r['game_pk'] for r in found]}")


def usage_totals(starts: DataFrame) -> None:
    """Shares of pitch types against either hand add up to 1 at most; untracked pitches make up the rest."""
    for hand in "LR":
        most = starts.agg(F.max(X.sum_horizontal([f"{t}_usage_v{hand}" for t in vocab.PITCH_TYPES]))).first()[0]
        if most is not None and most > 1 + 1e-9:
            raise ValueError(f"shares of pitches against {hand} add up to {most}")


def no_helpers(names: Iterable[str]) -> None:
    """No column of an artifact is a builder's own."""
    if left := [c for c in names if c.startswith("_")]:
        raise ValueError(f"helper columns are left: {left}")


def pregame_features(names: Sequence[str]) -> None:
    if twice := sorted({n for n in names if list(names).count(n) > 1}):
        raise ValueError(f"features named twice: {twice}")
    if bad := sorted(set(names) & set(vocab.FORBIDDEN_FEATURES)):
        raise ValueError(f"known only after the game: {bad}")


def model_features(df: DataFrame) -> tuple[str, ...]:
    """Numeric and boolean columns that are lagged or approved context, in the frame's order; any other such column that is neither label nor metadata raises."""
    kept, strange = [], []
    for f in df.schema.fields:
        if f.name in vocab.METADATA or f.name in vocab.FORBIDDEN_FEATURES:
            continue
        if not isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            continue
        (kept if f.name in vocab.CONTEXT_FEATURES or re.search(vocab.LAGGED_FEATURE, f.name) else strange).append(f.name)
    if strange:
        raise ValueError(f"columns that no rule admits as features: {strange}")
    pregame_features(kept)
    return tuple(kept)


def slate(lineups_: DataFrame, starters: DataFrame, require_confirmed: bool = False) -> None:
    """Nine orders from 1 to 9 and nine players a team, one resolved starter a team, same teams in both, probable starters agree."""
    sides = lineups_.groupBy("game_pk", "team_id").agg(
        F.count("*").alias("rows"),
        F.count_distinct("batting_order").alias("orders"),
        F.min("batting_order").alias("low"),
        F.max("batting_order").alias("high"),
        F.count_distinct("mlb_id").alias("players"),
        F.count_if(F.col("lineup_status") != "confirmed").alias("open"),
    )
    bad = sides.where("rows <> 9 or orders <> 9 or low <> 1 or high <> 9 or players <> 9" + (" or open > 0" if require_confirmed else "")).limit(5).collect()
    if bad or lineups_.isEmpty():
        raise ValueError(f"lineups are not complete{' and confirmed' if require_confirmed else ''}: {bad}")
    wrong = starters.where("mlb_id is null or (probable_pitcher_id is not null and probable_pitcher_id <> mlb_id)").limit(5).collect()
    if wrong:
        raise ValueError(f"starters are unresolved or not the probable ones: {wrong}")
    unique_keys(starters, ("game_pk", "team_id"), "starters")
    if require_confirmed and not starters.where("lineup_status is null or lineup_status <> 'confirmed'").isEmpty():
        raise ValueError("starters are not confirmed")
    one = starters.select("game_pk", "team_id")
    if not one.exceptAll(sides.select("game_pk", "team_id")).isEmpty() or not sides.select("game_pk", "team_id").exceptAll(one).isEmpty():
        raise ValueError("lineups and starters are not of the same teams")
