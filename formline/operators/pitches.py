"""Pitch-level columns and plate appearances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline import vocab
from formline.functions import expr as X


def event_flags(df: DataFrame) -> DataFrame:
    """Date cast and eight flags. A null event is no plate appearance; other flags of null stay null."""
    event, text = F.col("events"), F.col("description")
    return df.withColumns(
        {
            "game_date": F.to_date("game_date"),
            "is_pa": event.isNotNull() & ~F.coalesce(event.isin(*vocab.NOT_APPEARANCES), F.lit(False)),
            "is_k": event.isin(*vocab.STRIKEOUTS),
            "is_bb": event.isin(*vocab.WALKS),
            "is_hbp": event == "hit_by_pitch",
            "is_hr": event == "home_run",
            "is_hit": event.isin(*vocab.HITS),
            "is_whiff": text.isin(*vocab.WHIFFS),
            "is_called_strike": text == "called_strike",
        }
    )


def discipline_flags(df: DataFrame) -> DataFrame:
    """Eight flags of swings, zones and contact; a null zone is neither in nor out."""
    inside, outside = F.coalesce(F.col("zone") <= 9, F.lit(False)), F.coalesce(F.col("zone") >= 11, F.lit(False))
    swing, contact = F.coalesce(F.col("description").isin(*vocab.SWINGS), F.lit(False)), F.coalesce(F.col("description").isin(*vocab.CONTACTS), F.lit(False))
    return df.withColumns({"in_zone": inside, "out_zone": outside, "is_swing": swing, "is_contact": contact, "is_chase": outside & swing, "is_zswing": inside & swing, "is_zcontact": inside & contact, "is_ocontact": outside & contact})


def approach_angle() -> Column:
    """Vertical approach angle at the plate in degrees; null where the path has no solution."""
    plate = F.lit(17 / 12)
    root = F.col("vy0") * F.col("vy0") - 2 * F.col("ay") * (50 - plate)
    vy = F.when(root >= 0, -F.sqrt(root))
    time = (vy - F.col("vy0")) / F.nullif(F.col("ay"), F.lit(0.0))
    vz = F.col("vz0") + F.col("az") * time
    return -F.degrees(F.atan(vz / F.nullif(vy, F.lit(0.0))))


def pitch_level(df: DataFrame) -> DataFrame:
    """All flags and the derived columns of a pitch that the builders aggregate."""
    return discipline_flags(event_flags(df)).withColumns(
        {
            "canon_pitch": X.lookup(F.col("pitch_type"), vocab.PITCH_CODES),
            "vaa": approach_angle(),
            "ivb": F.col("pfx_z") * 12,
            "hb": F.col("pfx_x") * 12,
            "is_fb": F.col("bb_type").isin(*vocab.FLY_BALLS),
            "is_gb": F.col("bb_type") == "ground_ball",
            "outs_made": X.outs_of(F.col("events")),
            "runs_made": F.col("post_bat_score") - F.col("bat_score"),
            "xwoba_num": X.xwoba_numerator(),
        }
    )


def plate_appearances(df: DataFrame) -> DataFrame:
    """The last pitch of every plate appearance, whole, with is_k. One aggregate, no sort."""
    mine = event_flags(df).where("is_pa")
    return mine.groupBy("game_pk", "at_bat_number").agg(F.max_by(F.struct(*mine.columns), "pitch_number").alias("p")).select("p.*")


def starter_keys(df: DataFrame) -> DataFrame:
    """(game_pk, pitcher) of each side's first pitcher of the first inning."""
    first = df.where("inning = 1").groupBy("game_pk", "inning_topbot").agg(F.min_by("pitcher", F.struct("at_bat_number", "pitch_number")).alias("pitcher"))
    return first.select("game_pk", "pitcher").distinct()


def of_starters(df: DataFrame) -> DataFrame:
    """The rows of starter_keys() pitchers, in one exchange by game that groups within games can go on with."""
    first = F.struct("at_bat_number", "pitch_number")
    opening = F.col("inning") == 1
    half, game = Window.partitionBy("game_pk", "inning_topbot"), Window.partitionBy("game_pk")
    out = df.repartition("game_pk").withColumn("_first", F.min_by(F.when(opening, F.col("pitcher")), F.when(opening, first)).over(half))
    return out.withColumn("_starters", F.collect_set("_first").over(game)).where(F.array_contains("_starters", F.col("pitcher"))).drop("_first", "_starters")


def batter_k_rate(df: DataFrame, least: int = 0) -> DataFrame:
    """Plate appearances, strikeouts and their ratio by batter, highest ratio first."""
    out = plate_appearances(df).groupBy("batter").agg(F.count("*").alias("PA"), F.count_if("is_k").alias("K"))
    return out.where(F.col("PA") >= least).withColumn("k_rate", X.rate("K", "PA")).orderBy(F.desc_nulls_first("k_rate"), "batter")
