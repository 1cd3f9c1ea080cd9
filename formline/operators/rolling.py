"""Level 2: what was known of an entity before a date.

All windows partition by the entity first, so the rolling, season and same-date windows share one exchange and differ in sorts alone.
A second game of a date takes over the first one's values: both see earlier dates only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline import vocab
from formline.functions import expr as X
from formline.operators import checks


def _trailing(entity: str, w: int):
    return Window.partitionBy(entity).orderBy("game_date", "game_pk").rowsBetween(-w, -1)


def rolling_rate(entity: str, num: str, den: str, w: int, least: int = 1) -> Column:
    """Sum of num over sum of den in the w rows before; both need `least` non-null values there."""
    over = _trailing(entity, w)
    enough = (F.count(num).over(over) >= least) & (F.count(den).over(over) >= least)
    return F.when(enough, X.rate(F.sum(num).over(over), F.sum(den).over(over)))


def rolling_mean(entity: str, name: str, w: int, least: int = 1) -> Column:
    over = _trailing(entity, w)
    return F.when(F.count(name).over(over) >= least, F.avg(name).over(over))


def season_rate(entity: str, num: str, den: str) -> Column:
    """Sum of num over sum of den on the season's earlier dates: exclusive of the date and reset by season in one frame."""
    over = Window.partitionBy(entity, "season").orderBy(F.unix_date("game_date")).rangeBetween(Window.unboundedPreceding, -1)
    return X.rate(F.sum(num).over(over), F.sum(den).over(over))


def _first_of_date(df: DataFrame, entity: str, names: Sequence[str]) -> DataFrame:
    over = Window.partitionBy(entity, "game_date").orderBy("game_pk").rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*[c for c in df.columns if c not in names], *[F.first(c).over(over).alias(c) for c in names])


def pitcher_features(
    starts: DataFrame,
    rates: Mapping[str, tuple[str, str]] | None = None,
    means: Sequence[str] | None = None,
    rate_windows: Sequence[int] = vocab.RATE_WINDOWS,
    mean_windows: Sequence[int] = vocab.MEAN_WINDOWS,
    season_to_date: bool = True,
    least: int = 1,
    fip: bool = True,
    check: bool = True,
) -> DataFrame:
    """starts with {rate}_P{w}, {rate}_std, {mean}_P{w}, FIP_P{w} and xFIP_P{w}; statistics whose columns are not there are left out."""
    checks.require_columns(starts, ("pitcher", "game_pk", "game_date"), "starts")
    if check:
        checks.unique_keys(starts, ("pitcher", "game_pk"), "starts")
    df = starts if "season" in starts.columns else starts.withColumn("season", F.year("game_date"))
    new: dict[str, Column] = {}
    for name, (num, den) in (rates or vocab.RATES).items():
        if {num, den} <= set(df.columns):
            new |= {f"{name}_P{w}": rolling_rate("pitcher", num, den, w, least) for w in rate_windows}
            if season_to_date:
                new[f"{name}_std"] = season_rate("pitcher", num, den)
    for name in means if means is not None else vocab.MEANS:
        if name in df.columns:
            new |= {f"{name}_P{w}": rolling_mean("pitcher", name, w, least) for w in mean_windows}
    if fip and {*vocab.FIP_COUNTS, "lg_hr_fb_prior"} <= set(df.columns):
        for w in mean_windows:
            new |= rolling_fip(w, least)
    return _first_of_date(df.select("*", *[c.alias(n) for n, c in new.items()]), "pitcher", list(new))


def rolling_fip(w: int, least: int = 1, least_outs: int = vocab.LEAST_OUTS) -> dict[str, Column]:
    """Estimators over the w starts before, where they have enough outs and the season a constant."""
    over = _trailing("pitcher", w)
    enough = F.lit(True)
    for c in vocab.FIP_COUNTS:
        enough = enough & (F.count(c).over(over) >= least)
    n = {c: F.sum(c).over(over) for c in vocab.FIP_COUNTS}
    innings = n["Outs"] / 3
    constant = X.lookup(F.col("season").cast("int"), vocab.FIP_CONSTANTS)
    good = enough & (n["Outs"] >= least_outs) & constant.isNotNull()
    other = 3 * (n["BB"] + n["HBP"]) - 2 * n["K"]
    return {
        f"FIP_P{w}": F.when(good, (13 * n["HR"] + other) / innings + constant),
        f"xFIP_P{w}": F.when(good, (13 * n["FB"] * F.col("lg_hr_fb_prior") + other) / innings + constant),
    }


def batter_features(
    games: DataFrame,
    windows: Sequence[int] = vocab.RATE_WINDOWS,
    least: int = 1,
    shrink_pa: float | None = 200.0,
    fallback: float | None = None,
    extras: Mapping[str, tuple[str, str]] | None = None,
    check: bool = True,
) -> DataFrame:
    """games with season-to-date strikeout rates (all, by hand, extras), trailing ones, and one shrunk to the league's rate before the date."""
    checks.require_columns(games, ("batter", "game_pk", "game_date", "PA", "K"), "games")
    if check:
        checks.unique_keys(games, ("batter", "game_pk"), "games")
    df = games if "season" in games.columns else games.withColumn("season", F.year("game_date"))
    pairs = {"k_rate_std": ("K", "PA"), "k_rate_std_vL": ("K_vL", "PA_vL"), "k_rate_std_vR": ("K_vR", "PA_vR")}
    pairs |= {f"{name}_std": pair for name, pair in (vocab.BATTER_EXTRAS if extras is None else extras).items()}
    new = {name: season_rate("batter", *pair) for name, pair in pairs.items() if set(pair) <= set(df.columns)}
    new |= {f"k_rate_P{w}": rolling_rate("batter", "K", "PA", w, least) for w in windows}
    if shrink_pa is not None:
        if shrink_pa <= 0:
            raise ValueError("the strength of a prior has to be positive")
        if "prior_league_k_rate" in df.columns:
            if fallback is not None:
                raise ValueError("prior_league_k_rate and a fallback exclude each other")
            sourced = [r[0] for r in df.select("prior_league_k_rate").distinct().limit(2).collect()]
            if len(sourced) != 1:
                raise ValueError("prior_league_k_rate has to have exactly one value")
            fallback = sourced[0]
        # a row a date first, then a running total over those few rows
        daily = df.groupBy("game_date").agg(F.sum("K").alias("k"), F.sum("PA").alias("n"))
        before = Window.orderBy("game_date").rowsBetween(Window.unboundedPreceding, -1)
        league = daily.select("game_date", F.coalesce(X.rate(F.sum("k").over(before), F.sum("n").over(before)), F.lit(fallback).cast("double")).alias("_league"))
        df = df.join(league, "game_date", "left")
        over = Window.partitionBy("batter", "season").orderBy(F.unix_date("game_date")).rangeBetween(Window.unboundedPreceding, -1)
        k, n = (F.coalesce(F.sum(c).over(over), F.lit(0)) for c in ("K", "PA"))
        new["k_rate_std_shrunk"] = (k + shrink_pa * F.col("_league")) / (n + shrink_pa)
    out = _first_of_date(df.select("*", *[c.alias(n) for n, c in new.items()]), "batter", list(new))
    return out.drop("_league")


def season_changes(df: DataFrame, entity: str) -> DataFrame:
    """df with season_changed: whether the row's season differs from that of the entity's row before."""
    over = Window.partitionBy(entity).orderBy("game_date", "game_pk")
    return df.withColumn("season_changed", F.col("season") != F.lag("season").over(over))
