"""Rates known before a date or season, and the estimators that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formline import vocab
from formline.functions import expr as X
from formline.operators import pitches


def _fly_balls(df: DataFrame) -> DataFrame:
    flags = pitches.event_flags(df).withColumns({"is_fb": F.col("bb_type").isin(*vocab.FLY_BALLS), "season": F.year(F.to_date("game_date"))})
    return flags.groupBy("season", "game_date").agg(F.count_if("is_hr").alias("hr"), F.count_if("is_fb").alias("fb"))


def league_hr_fb(df: DataFrame) -> DataFrame:
    """(season, hr_fb) of seasons with fly balls."""
    return _fly_balls(df).groupBy("season").agg(F.sum("hr").alias("hr"), F.sum("fb").alias("fb")).where("fb > 0").select("season", (F.col("hr") / F.col("fb")).alias("hr_fb"))


def hr_fb_before(df: DataFrame, strength: float = 1000.0, fallback: float | None = None) -> DataFrame:
    """(game_date, lg_hr_fb_prior): the season's home runs per fly ball before the date, shrunk to the season before; null in a first season without fallback."""
    if strength < 0:
        raise ValueError("the strength of a prior cannot be negative")
    daily = _fly_balls(df)
    over = Window.partitionBy("season").orderBy("game_date").rowsBetween(Window.unboundedPreceding, -1)
    running = daily.select("season", "game_date", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(c) for c in ("hr", "fb")])
    last = daily.groupBy("season").agg(F.sum("hr").alias("h"), F.sum("fb").alias("f")).select((F.col("season") + 1).alias("season"), X.rate("h", "f").alias("prior"))
    prior = F.coalesce(F.col("prior"), F.lit(fallback).cast("double"))
    return running.join(last, "season", "left").select("game_date", X.rate(F.col("hr") + strength * prior, F.col("fb") + strength).alias("lg_hr_fb_prior"))


def fip(starts: DataFrame, constants: dict[int, float] | None = None, hr_fb_column: str | None = "lg_hr_fb_prior", hr_fb: dict[int, float] | None = None, include_constant: bool = True, least_outs: int = vocab.LEAST_OUTS) -> DataFrame:
    """starts with FIP and xFIP, null below least_outs outs or without a constant for the season. League rates come from a column or, by season, from a dict."""
    if hr_fb is not None and hr_fb_column is not None:
        hr_fb_column = None
    if hr_fb_column is not None and hr_fb_column not in starts.columns:
        raise ValueError(f"no column {hr_fb_column}")
    season = F.col("season").cast("int")
    constant = X.lookup(season, constants or vocab.FIP_CONSTANTS) if include_constant else F.lit(0.0)
    per_fb = F.col(hr_fb_column) if hr_fb_column else X.lookup(season, hr_fb) if hr_fb else F.lit(None).cast("double")
    innings = F.col("Outs") / 3
    other = 3 * (F.col("BB") + F.col("HBP")) - 2 * F.col("K")
    good = (F.col("Outs") > 0) & (F.col("Outs") >= least_outs)
    return starts.withColumns({"FIP": F.when(good, (13 * F.col("HR") + other) / innings + constant), "xFIP": F.when(good, (13 * F.col("FB") * per_fb + other) / innings + constant)})


def calibrated_constants(starts: DataFrame) -> DataFrame:
    """(season, constant): what makes the league's estimator equal its runs per nine innings."""
    s = starts.groupBy("season").agg(*[F.sum(c).alias(c) for c in ("HR", "BB", "HBP", "K", "Outs", "Runs")]).where("Outs > 0")
    innings = F.col("Outs") / 3
    return s.select("season", (9 * F.col("Runs") / innings - (13 * F.col("HR") + 3 * (F.col("BB") + F.col("HBP")) - 2 * F.col("K")) / innings).alias("constant"))


def prior_season_shrunk(starts: DataFrame, strength: float = 200.0, fallback: float | None = None) -> DataFrame:
    """starts with k_rate_std_shrunk: the season's rate before the date, shrunk to the pitcher's last season, else the league's last season, else the fallback."""
    if strength <= 0:
        raise ValueError("the strength of a prior has to be positive")
    df = starts if "season" in starts.columns else starts.withColumn("season", F.year("game_date"))
    own = df.groupBy("pitcher", (F.col("season") + 1).alias("season")).agg(X.rate(F.sum("K"), F.sum("PA")).alias("_own"))
    league = df.groupBy((F.col("season") + 1).alias("season")).agg(X.rate(F.sum("K"), F.sum("PA")).alias("_league"))
    df = df.join(own, ["pitcher", "season"], "left").join(league, "season", "left")
    prior = F.coalesce("_own", "_league", F.lit(fallback).cast("double"))
    over = Window.partitionBy("pitcher", "season").orderBy(F.unix_date("game_date")).rangeBetween(Window.unboundedPreceding, -1)
    k, n = (F.coalesce(F.sum(c).over(over), F.lit(0)) for c in ("K", "PA"))
    return df.withColumn("k_rate_std_shrunk", (k + strength * prior) / (n + strength)).drop("_own", "_league")
