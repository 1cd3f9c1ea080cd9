"""Level 1: one row per game and pitcher, pitch type or batter. Each builder is one aggregate over the pitches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline import vocab
from formline.functions import expr as X
from formline.operators import checks, pitches


def _counts() -> list[Column]:
    flags = {"PA": "is_pa", "K": "is_k", "BB": "is_bb", "HBP": "is_hbp", "HR": "is_hr", "Hits": "is_hit", "Whiffs": "is_whiff", "CS": "is_called_strike"}
    return [F.count("*").alias("Pitches"), *[F.count_if(F.col(f)).alias(n) for n, f in flags.items()]]


def _types() -> list[Column]:
    return [F.count_if(F.col("type") == code).alias(name) for name, code in (("Strikes", "S"), ("Balls", "B"), ("BIP", "X"))]


def arsenal() -> list[Column]:
    """Eleven aggregates for each pitch type, from conditional columns in the same pass."""
    out = []
    for t in vocab.PITCH_TYPES:
        mine = F.col("canon_pitch") == t
        for name, source in zip(vocab.PHYSICS, ("release_speed", "release_spin_rate", "ivb", "hb", "vaa"), strict=True):
            out.append(X.mean_where(mine, source).alias(f"{t}_{name}"))
        out.append((F.count_if(mine) > 0).cast("tinyint").alias(f"throws_{t}"))
        for h in "RL":
            side = F.col("stand") == h
            out.append(F.when(F.count_if(side) > 0, F.count_if(mine & side) / F.count_if(side)).otherwise(0.0).alias(f"{t}_usage_v{h}"))
        den = X.total_where(mine, "woba_denom")
        out.append(X.rate(X.total_where(mine, "woba_value"), den).alias(f"{t}_woba"))
        out.append(X.rate(X.total_where(mine, "xwoba_num"), den).alias(f"{t}_xwoba"))
    return out


def _constant(name: str) -> Column:
    """A column that the key determines; the value at the game's first pitch, whatever order rows come in."""
    return F.min_by(name, F.struct("at_bat_number", "pitch_number")).alias(name)


def pitcher_games(df: DataFrame, least: int = vocab.LEAST_APPEARANCES) -> DataFrame:
    """Starts: counts, pairs, release, arsenal and rates by (game_pk, pitcher), starters with `least` plate appearances or more (0: all)."""
    p = pitches.of_starters(pitches.pitch_level(df))
    in_play = F.col("type") == "X"
    out = p.groupBy("game_pk", "pitcher").agg(
        *map(_constant, ("game_date", "player_name", "home_team", "away_team", "p_throws", "inning_topbot")),
        *_counts(),
        *_types(),
        F.count_if("is_fb").alias("FB"),
        F.count_if("is_gb").alias("GB"),
        X.total("outs_made").cast("long").alias("Outs"),
        X.total("runs_made").cast("long").alias("Runs"),
        *X.discipline_counts(),
        F.avg("release_extension").alias("extension"),
        F.avg("release_pos_x").alias("rel_x"),
        F.avg("release_pos_z").alias("rel_z"),
        F.stddev_samp("release_pos_x").alias("rel_x_sd"),
        F.stddev_samp("release_pos_z").alias("rel_z_sd"),
        X.total_where(in_play, "estimated_ba_using_speedangle").alias("xBA_num"),
        X.known_where(in_play, "estimated_ba_using_speedangle").alias("xBA_den"),
        X.total("woba_value").alias("wOBA_num"),
        X.total("woba_denom").cast("double").alias("wOBA_den"),
        X.total("xwoba_num").alias("xwOBA_num"),
        *arsenal(),
    )
    if least > 0:
        out = out.where(F.col("PA") >= least)
    home = F.col("inning_topbot") == "Top"
    return out.withColumns(
        {
            "season": F.year("game_date"),
            "CSW": F.col("CS") + F.col("Whiffs"),
            "xBA": X.rate("xBA_num", "xBA_den"),
            "wOBA": X.rate("wOBA_num", "wOBA_den"),
            "xwOBA": X.rate("xwOBA_num", "wOBA_den"),
            "is_home": home,
            "opp_team": F.when(home, F.col("away_team")).otherwise(F.col("home_team")),
            "k_rate": F.col("K") / F.greatest("PA", F.lit(1)),
            **X.discipline_rates(),
        }
    ).drop("inning_topbot")


def pitch_type_games(df: DataFrame, least: int = vocab.LEAST_APPEARANCES, check: bool = True) -> DataFrame:
    """Counts, pairs and rates by (game_pk, pitcher, pitch_type). TotalPitches counts all of the starter's pitches, tracked or not."""
    p = pitches.of_starters(pitches.pitch_level(df))
    start = Window.partitionBy("game_pk", "pitcher")
    p = p.withColumns({"TotalPitches": F.count("*").over(start), "_pa": F.count_if("is_pa").over(start)})
    if least > 0:
        p = p.where(F.col("_pa") >= least)
    in_play = F.col("type") == "X"
    pairs = []
    for name, source, mask in (
        ("EV", "launch_speed", in_play), ("LA", "launch_angle", in_play), ("xBA", "estimated_ba_using_speedangle", in_play),
        ("velo", "release_speed", F.lit(True)), ("spin", "release_spin_rate", F.lit(True)), ("ivb", "ivb", F.lit(True)), ("hb", "hb", F.lit(True)), ("vaa", "vaa", F.lit(True)),
    ):
        pairs += [X.total_where(mask, source).alias(f"{name}_num"), X.known_where(mask, source).alias(f"{name}_den")]
    out = p.where("canon_pitch is not null").groupBy("game_pk", "pitcher", F.col("canon_pitch").alias("pitch_type")).agg(
        *map(_constant, ("game_date", "player_name", "home_team", "away_team", "p_throws")),
        F.max("TotalPitches").alias("TotalPitches"),
        *[c for c in _counts()][:4],
        F.count_if("is_whiff").alias("Whiffs"),
        F.count_if("is_called_strike").alias("CS"),
        *_types(),
        F.count_if("is_fb").alias("FB"),
        F.count_if("is_gb").alias("GB"),
        *X.discipline_counts(),
        F.count_if(in_play & (F.col("launch_speed") >= vocab.HARD_HIT)).alias("HardHit"),
        F.count_if(in_play & (F.col("launch_speed_angle") == vocab.BARREL)).alias("Barrels"),
        F.count_if(in_play & (F.col("launch_speed_angle") == vocab.WEAK)).alias("WeakContact"),
        X.total("woba_value").alias("wOBA_num"),
        X.total("woba_denom").cast("double").alias("wOBA_den"),
        X.total("xwoba_num").alias("xwOBA_num"),
        *pairs,
    )
    if check:
        out = checks.with_exclusive_outcomes(out)
    csw = F.col("CS") + F.col("Whiffs")
    ratios = {
        "usage_rate": ("Pitches", "TotalPitches"), "swstr_rate": ("Whiffs", "Pitches"), "whiff_rate": ("Whiffs", "Swings"), "ball_rate": ("Balls", "Pitches"), "csw_rate": (csw, "Pitches"),
        "chase_rate": ("Chases", "OutZone"), "gb_rate": ("GB", "BIP"), "hard_hit_rate": ("HardHit", "EV_den"), "barrel_rate": ("Barrels", "xBA_den"), "weak_contact_rate": ("WeakContact", "xBA_den"),
        "wOBA": ("wOBA_num", "wOBA_den"), "xwOBA": ("xwOBA_num", "wOBA_den"),
        **{f"{n}_mean": (f"{n}_num", f"{n}_den") for n in ("EV", "LA", "xBA", "velo", "spin", "ivb", "hb", "vaa")},
    }
    return out.withColumns({"season": F.year("game_date"), "CSW": csw, **{k: X.rate(*v) for k, v in ratios.items()}})


def batter_games(df: DataFrame) -> DataFrame:
    """Counts, splits by the pitcher's hand and rates by (game_pk, batter); the first nine batters of a side are its initial lineup."""
    p = pitches.discipline_flags(pitches.event_flags(df)).withColumn("bat_team", F.when(F.col("inning_topbot") == "Top", F.col("away_team")).otherwise(F.col("home_team")))
    split = [F.count_if(F.col(flag) & (F.col("p_throws") == h)).alias(f"{n}_v{h}") for h in "LR" for n, flag in (("PA", "is_pa"), ("K", "is_k"))]
    out = p.groupBy("game_pk", "batter").agg(
        *[F.min_by(c, F.struct("at_bat_number", c)).alias(c) for c in ("game_date", "bat_team", "home_team", "away_team")],
        F.mode("stand", deterministic=True).alias("stand"),
        *_counts(),
        F.count_if(F.col("type") == "X").alias("BIP"),
        *X.discipline_counts(),
        *split,
        X.share_sum(X.xwoba_numerator(), F.col("woba_denom")).alias("xwOBA"),
        X.share_sum(F.col("woba_value"), F.col("woba_denom")).alias("wOBA"),
        F.min("at_bat_number").alias("_first"),
    )
    side = Window.partitionBy("game_pk", "bat_team").orderBy("_first", "batter")
    home = F.col("bat_team") == F.col("home_team")
    return out.withColumns(
        {
            "season": F.year("game_date"),
            "CSW": F.col("CS") + F.col("Whiffs"),
            "is_home": home,
            "is_initial_lineup": F.row_number().over(side) <= 9,
            "opp_team": F.when(home, F.col("away_team")).otherwise(F.col("home_team")),
            **X.discipline_rates(),
        }
    ).drop("_first")
