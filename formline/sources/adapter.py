"""The driver's tables as pitches: line items of an order are the pitches of a game. PITCH_SQL says the same to DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line item; order and customer columns come by joins on unique keys."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    q = F.col("l_quantity").cast("int")
    # the narrow tables first: line items, the many, move once, by their game
    df = lines.join(orders.join(customers, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    none = F.lit(None).cast("string")
    played = F.col("l_returnflag") == "N"
    event = (
        F.when(F.col("l_returnflag") == "R", "strikeout")
        .when(F.col("l_returnflag") == "A", "walk")
        .otherwise(F.element_at(F.array(*[F.lit(x) for x in ("home_run", "single", "double", "grounded_into_double_play", "caught_stealing_2b", None, "hit_by_pitch", "field_out", "field_out", "field_out")]).cast("array<string>"), q % 10 + 1))
    )
    foul = played & (q % 10 == 5)
    text = F.when(F.col("l_returnflag") == "R", F.element_at(F.array(*map(F.lit, ("swinging_strike", "foul_tip", "called_strike"))), (F.col("l_partkey") % 3 + 1).cast("int"))).when(F.col("l_returnflag") == "A", "ball").when(foul, "foul").otherwise("hit_into_play")
    kind = F.when((F.col("l_returnflag") == "R") | foul, "S").when(F.col("l_returnflag") == "A", "B").otherwise("X")
    df = df.select(
        F.col("l_orderkey").alias("game_pk"),
        F.to_date("o_orderdate").alias("game_date"),
        F.year("o_orderdate").alias("game_year"),
        F.col("l_suppkey").alias("pitcher"),
        F.col("l_partkey").alias("batter"),
        F.concat(F.lit("Last"), F.col("l_suppkey"), F.lit(", First")).alias("player_name"),
        F.when(q % 2 == 0, "R").otherwise("L").alias("stand"),
        F.when(F.col("l_suppkey") % 3 != 0, "R").otherwise("L").alias("p_throws"),
        F.concat(F.lit("T"), F.col("c_nationkey")).alias("home_team"),
        F.concat(F.lit("T"), (F.col("c_nationkey") + 1 + F.col("l_orderkey") % 24) % 25).alias("away_team"),
        (F.floor((F.col("l_linenumber") - 1) / 3) + 1).cast("int").alias("inning"),
        F.when(F.col("l_linestatus") == "O", "Top").otherwise("Bot").alias("inning_topbot"),
        F.col("l_linenumber").alias("at_bat_number"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("pitch_number"),
        F.when(q == 50, "KN").otherwise(F.element_at(F.array(*map(F.lit, ("FF", "SI", "FC", "SL", "ST", "CU", "CH"))), (F.col("l_linenumber") - 1) % 7 + 1)).alias("pitch_type"),
        kind.alias("type"),
        event.alias("events"),
        text.alias("description"),
        F.when(kind == "X", F.element_at(F.array(*map(F.lit, ("fly_ball", "popup", "ground_ball", "line_drive"))), q % 4 + 1)).otherwise(none).alias("bb_type"),
        (80 + F.col("l_quantity") / 2.5).alias("release_speed"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("release_spin_rate"),
        F.col("l_discount").alias("pfx_x"),
        F.col("l_tax").alias("pfx_z"),
        (-130 - 100 * F.col("l_discount")).alias("vy0"),
        (-5 - 10 * F.col("l_tax")).alias("vz0"),
        (25 + F.col("l_quantity") / 10).alias("ay"),
        F.lit(-15.0).alias("az"),
        (6 + 10 * F.col("l_tax")).alias("release_extension"),
        (10 * F.col("l_discount")).alias("release_pos_x"),
        (5 + F.col("l_tax")).alias("release_pos_z"),
        F.when(kind == "X", 60 + F.col("l_quantity")).alias("launch_speed"),
        F.when(kind == "X", F.col("l_quantity") - 20).alias("launch_angle"),
        F.when(kind == "X", q % 6 + 1).alias("launch_speed_angle"),
        F.when(kind == "X", F.nullif(F.col("l_discount"), F.lit(0.0))).alias("estimated_ba_using_speedangle"),
        F.when(kind == "X", F.nullif(F.col("l_tax"), F.lit(0.0))).alias("estimated_woba_using_speedangle"),
        (10 * F.col("l_discount")).alias("woba_value"),
        F.when(event.isNotNull(), 1).otherwise(0).alias("woba_denom"),
        F.col("l_linenumber").alias("bat_score"),
        (F.col("l_linenumber") + F.when(q % 5 == 0, 1).otherwise(0)).alias("post_bat_score"),
        F.nullif(q % 15, F.lit(0)).alias("zone"),
    )
    return df


PITCH_SQL = """pitch AS (
  SELECT l_orderkey AS game_pk, CAST(o_orderdate AS DATE) AS game_date, CAST(year(o_orderdate) AS INT) AS season, l_suppkey AS pitcher, l_partkey AS batter,
    CASE WHEN q % 2 = 0 THEN 'R' ELSE 'L' END AS stand, CASE WHEN l_suppkey % 3 <> 0 THEN 'R' ELSE 'L' END AS p_throws,
    'T' || c_nationkey AS home_team, 'T' || ((c_nationkey + 1 + l_orderkey % 24) % 25) AS away_team, (l_linenumber - 1) // 3 + 1 AS inning,
    CASE WHEN l_linestatus = 'O' THEN 'Top' ELSE 'Bot' END AS half, l_linenumber AS at_bat_number, l_partkey * 1000000 + l_suppkey AS pitch_number,
    CASE WHEN q = 50 THEN NULL ELSE ['ff','si','fc','sl','st','cu','ch'][(l_linenumber - 1) % 7 + 1] END AS canon,
    CASE WHEN l_returnflag = 'R' OR (l_returnflag = 'N' AND q % 10 = 5) THEN 'S' WHEN l_returnflag = 'A' THEN 'B' ELSE 'X' END AS type,
    CASE l_returnflag WHEN 'R' THEN 'strikeout' WHEN 'A' THEN 'walk' ELSE ['home_run','single','double','grounded_into_double_play','caught_stealing_2b',NULL,'hit_by_pitch','field_out','field_out','field_out'][q % 10 + 1] END AS events,
    CASE WHEN l_returnflag = 'R' THEN ['swinging_strike','foul_tip','called_strike'][l_partkey % 3 + 1] WHEN l_returnflag = 'A' THEN 'ball' WHEN q % 10 = 5 THEN 'foul' ELSE 'hit_into_play' END AS description,
    q, l_quantity, l_extendedprice, l_discount, l_tax, 80 + l_quantity / 2.5 AS velo, l_extendedprice / l_quantity AS spin, l_linenumber, nullif(q % 15, 0) AS zone
  FROM (SELECT *, CAST(l_quantity AS INT) AS q FROM lineitem) l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
flag AS (
  SELECT *, CASE WHEN type = 'X' THEN ['fly_ball','popup','ground_ball','line_drive'][q % 4 + 1] END AS bb_type,
    events IS NOT NULL AND events <> 'caught_stealing_2b' AS is_pa, events = 'strikeout' AS is_k, events = 'walk' AS is_bb, events = 'hit_by_pitch' AS is_hbp, events = 'home_run' AS is_hr,
    events IN ('single', 'double', 'home_run') AS is_hit, description IN ('swinging_strike', 'foul_tip') AS is_whiff, description = 'called_strike' AS is_cs,
    coalesce(zone <= 9, false) AS in_zone, coalesce(zone >= 11, false) AS out_zone, description IN ('swinging_strike', 'foul_tip', 'foul', 'hit_into_play') AS is_swing, description IN ('foul', 'hit_into_play') AS is_contact,
    CASE WHEN events IN ('grounded_into_double_play') THEN 2 WHEN events IN ('strikeout', 'field_out', 'caught_stealing_2b') THEN 1 ELSE 0 END AS outs, CASE WHEN q % 5 = 0 THEN 1 ELSE 0 END AS runs,
    l_discount * 10 AS woba_value, CASE WHEN events IS NOT NULL THEN 1 ELSE 0 END AS woba_denom, coalesce(CASE WHEN type = 'X' THEN nullif(l_tax, 0) END, l_discount * 10) AS xwoba_num,
    CASE WHEN type = 'X' THEN nullif(l_discount, 0) END AS est_ba
  FROM pitch),
starter AS (SELECT DISTINCT game_pk, arg_min(pitcher, (at_bat_number, pitch_number)) AS pitcher FROM pitch WHERE inning = 1 GROUP BY game_pk, half)"""
