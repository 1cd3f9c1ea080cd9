"""All queries outside the llm subpackage, each with the DuckDB SQL that gives the same rows where SQL can say it.

Queries run the library's operators over the driver's tables through sources.adapter. Doubles are rounded to six places, as the engines add in
different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline import vocab
from formline.functions import expr as X
from formline.operators import checks, games, identity, modelling, park, pitches, priors, reliability, rolling, training
from formline.sources import adapter, html
from formline.sources.adapter import PITCH_SQL, table

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, ctes: bool = True):
    """Register a function by its name. ctes: the SQL stands on the pitch views."""

    def add(f):
        _queries[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            if ctes:
                text = f"WITH {PITCH_SQL}{', ' + text[5:] if text.startswith('WITH ') else ' ' + text}"
            _sql[f.__name__] = text
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from formline.plans import feeds  # noqa: F401  registers its own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[(F.round(f.name, places) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def _starts(spark: SparkSession, d: str) -> DataFrame:
    return games.pitcher_games(adapter.pitches(spark, d), 0)


def _counted(spark: SparkSession, d: str) -> DataFrame:
    """Narrow starts of every pitcher, not starters alone: what rolling and reliability queries stand on."""
    p = pitches.pitch_level(adapter.pitches(spark, d))
    out = p.groupBy("game_pk", "pitcher").agg(
        F.min("game_date").alias("game_date"), F.count("*").alias("Pitches"), *[F.count_if(c).alias(n) for n, c in (("PA", "is_pa"), ("K", "is_k"), ("BB", "is_bb"), ("HBP", "is_hbp"), ("HR", "is_hr"), ("FB", "is_fb"), ("Whiffs", "is_whiff"), ("Swings", "is_swing"))],
        F.sum("outs_made").alias("Outs"), F.avg(F.when(F.col("canon_pitch") == "ff", F.col("release_speed"))).alias("ff_velo"),
    )
    return out.withColumn("season", F.year("game_date"))


_COUNTED = """counted AS (
  SELECT game_pk, pitcher, min(game_date) AS game_date, CAST(year(min(game_date)) AS INT) AS season, count(*) AS Pitches, count(*) FILTER (is_pa) AS PA, count(*) FILTER (is_k) AS K, count(*) FILTER (is_bb) AS BB,
    count(*) FILTER (is_hbp) AS HBP, count(*) FILTER (is_hr) AS HR, count(*) FILTER (bb_type IN ('fly_ball', 'popup')) AS FB, count(*) FILTER (is_whiff) AS Whiffs, count(*) FILTER (is_swing) AS Swings,
    CAST(sum(outs) AS BIGINT) AS Outs, avg(velo) FILTER (canon = 'ff') AS ff_velo FROM flag GROUP BY game_pk, pitcher)"""
_ROWS5 = "(PARTITION BY pitcher ORDER BY game_date, game_pk ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
_SEASON = "(PARTITION BY {e}, season ORDER BY game_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"


# --- scans, unions, keep-first, sorts -------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem", ctes=False)
def scan_projection(spark, d):
    from formline.sources import files

    return files.united(spark, [f"{d}/lineitem.parquet"], ["l_orderkey", "l_partkey", "l_quantity"])


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS season, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice > 1000", ctes=False)
def scan_filter_pushdown(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "P") & (F.col("o_totalprice") > 1000)).select("o_orderkey", F.year("o_orderdate").alias("season"), "o_totalprice")


@query("SELECT * FROM customer UNION ALL BY NAME SELECT * FROM supplier", ctes=False)
def union_by_name_relaxed(spark, d):
    from formline.sources import files

    return files.united(spark, [f"{d}/customer.parquet", f"{d}/supplier.parquet"])


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1", ctes=False)
def keep_first_dedupe(spark, d):
    return identity.keep(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1", ctes=False)
def keep_last_dedupe(spark, d):
    return identity.keep(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", last=True)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20", ctes=False)
def top_k(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(20)


@query("SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier", ctes=False)
def key_intersection(spark, d):
    return table(spark, d, "customer").select("c_nationkey").intersect(table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey")))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)", ctes=False)
def uncovered_keys(spark, d):
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT c_custkey, 0.25 < 1 AS small, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS balance FROM customer", ctes=False)
def nan_to_null(spark, d):
    from formline.sources import files

    df = table(spark, d, "customer").select("c_custkey", F.lit(True).alias("small"), F.when(F.col("c_acctbal") < 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("balance"))
    return files.nan_to_null(df)


# --- pitch level ----------------------------------------------------------------------------------------------------------------


@query("SELECT game_pk, at_bat_number, pitch_number, game_date, is_pa, is_k, is_bb, is_hbp, is_hr, is_hit, is_whiff, is_cs AS is_called_strike FROM flag")
def event_flags(spark, d):
    return pitches.event_flags(adapter.pitches(spark, d)).select("game_pk", "at_bat_number", "pitch_number", "game_date", "is_pa", "is_k", "is_bb", "is_hbp", "is_hr", "is_hit", "is_whiff", "is_called_strike")


@query(
    """SELECT game_pk, at_bat_number, pitch_number, in_zone, out_zone, is_swing, is_contact, out_zone AND is_swing AS is_chase, in_zone AND is_swing AS is_zswing, in_zone AND is_contact AS is_zcontact,
    out_zone AND is_contact AS is_ocontact FROM flag"""
)
def discipline_flags(spark, d):
    return pitches.discipline_flags(adapter.pitches(spark, d)).select("game_pk", "at_bat_number", "pitch_number", "in_zone", "out_zone", "is_swing", "is_contact", "is_chase", "is_zswing", "is_zcontact", "is_ocontact")


_RATES_SQL = """SELECT {k}, count(*) FILTER (in_zone) AS InZone, count(*) FILTER (out_zone) AS OutZone, count(*) FILTER (is_swing) AS Swings, count(*) FILTER (out_zone AND is_swing) AS Chases,
    count(*) FILTER (in_zone AND is_swing) AS ZSwings, count(*) FILTER (is_contact) AS Contacts, count(*) FILTER (in_zone AND is_contact) AS ZContacts, count(*) FILTER (out_zone AND is_contact) AS OContacts,
    count(*) FILTER (is_whiff) AS Whiffs, count(*) AS Pitches FROM flag GROUP BY {k}"""


@query(
    "WITH c AS ("
    + _RATES_SQL.format(k="pitcher")
    + """) SELECT pitcher, round(InZone / Pitches, 6) AS zone_rate, round(Swings / Pitches, 6) AS swing_rate, CASE WHEN OutZone > 0 THEN round(Chases / OutZone, 6) END AS chase_rate,
    CASE WHEN InZone > 0 THEN round(ZSwings / InZone, 6) END AS zswing_rate, CASE WHEN Swings > 0 THEN round(Contacts / Swings, 6) END AS contact_rate, CASE WHEN ZSwings > 0 THEN round(ZContacts / ZSwings, 6) END AS zcontact_rate,
    CASE WHEN Chases > 0 THEN round(OContacts / Chases, 6) END AS ocontact_rate, round(Whiffs / Pitches, 6) AS swstr_rate, CASE WHEN Swings > 0 THEN round(Whiffs / Swings, 6) END AS whiff_rate FROM c"""
)
def discipline_rates(spark, d):
    p = pitches.discipline_flags(pitches.event_flags(adapter.pitches(spark, d)))
    c = p.groupBy("pitcher").agg(F.count("*").alias("Pitches"), F.count_if("is_whiff").alias("Whiffs"), *X.discipline_counts())
    return rounded(c.select("pitcher", *[v.alias(k) for k, v in X.discipline_rates().items()]))


@query(
    """SELECT game_pk, at_bat_number, pitch_number, canon AS canon_pitch, CAST(outs AS INT) AS outs_made, CAST(runs AS INT) AS runs_made, round(xwoba_num, 6) AS xwoba_num, round(l_tax * 12, 6) AS ivb, round(l_discount * 12, 6) AS hb,
    bb_type IN ('fly_ball', 'popup') AS is_fb, bb_type = 'ground_ball' AS is_gb FROM flag"""
)
def pitch_level(spark, d):
    return rounded(pitches.pitch_level(adapter.pitches(spark, d)).select("game_pk", "at_bat_number", "pitch_number", "canon_pitch", "outs_made", "runs_made", "xwoba_num", "ivb", "hb", "is_fb", "is_gb"))


@query(
    """SELECT game_pk, at_bat_number, pitch_number, round(-degrees(atan(((-5 - 10 * l_tax) + -15 * (vf - v) / a) / vf)), 5) AS vaa
    FROM (SELECT *, -130 - 100 * l_discount AS v, 25 + l_quantity / 10 AS a, -sqrt((-130 - 100 * l_discount) ** 2 - 2 * (25 + l_quantity / 10) * (50 - 17.0::DOUBLE / 12)) AS vf FROM flag)"""
)
def trajectory_angle(spark, d):
    return rounded(adapter.pitches(spark, d).select("game_pk", "at_bat_number", "pitch_number", pitches.approach_angle().alias("vaa")), 5)


@query("SELECT game_pk, at_bat_number, arg_max(pitch_number, pitch_number) AS pitch_number, arg_max(batter, pitch_number) AS batter, arg_max(events, pitch_number) AS events, arg_max(is_k, pitch_number) AS is_k FROM flag WHERE is_pa GROUP BY game_pk, at_bat_number")
def plate_appearances(spark, d):
    return pitches.plate_appearances(adapter.pitches(spark, d)).select("game_pk", "at_bat_number", "pitch_number", "batter", "events", "is_k")


@query("SELECT game_pk, pitcher FROM starter")
def starter_keys(spark, d):
    return pitches.starter_keys(adapter.pitches(spark, d))


@query("SELECT game_pk, pitcher, count(*) AS n FROM pitch SEMI JOIN starter USING (game_pk, pitcher) GROUP BY ALL")
def starters_semi_join(spark, d):
    p = adapter.pitches(spark, d)
    return p.join(pitches.starter_keys(p), ["game_pk", "pitcher"], "left_semi").groupBy("game_pk", "pitcher").agg(F.count("*").alias("n"))


@query(
    """WITH last AS (SELECT game_pk, at_bat_number, arg_max(batter, pitch_number) AS batter, arg_max(is_k, pitch_number) AS is_k FROM flag WHERE is_pa GROUP BY ALL)
    SELECT batter, count(*) AS PA, count(*) FILTER (is_k) AS K, round(count(*) FILTER (is_k) / count(*), 6) AS k_rate FROM last GROUP BY batter HAVING count(*) >= 3"""
)
def batter_k_rate(spark, d):
    return rounded(pitches.batter_k_rate(adapter.pitches(spark, d), 3))


# --- level 1 --------------------------------------------------------------------------------------------------------------------


@query(
    """SELECT game_pk, pitcher, min(game_date) AS game_date, CAST(year(min(game_date)) AS INT) AS season, count(*) AS Pitches, count(*) FILTER (is_pa) AS PA, count(*) FILTER (is_k) AS K, count(*) FILTER (is_bb) AS BB, count(*) FILTER (is_hbp) AS HBP,
    count(*) FILTER (is_hr) AS HR, count(*) FILTER (is_hit) AS Hits, count(*) FILTER (is_whiff) AS Whiffs, count(*) FILTER (is_cs) AS CS, count(*) FILTER (is_cs) + count(*) FILTER (is_whiff) AS CSW,
    count(*) FILTER (type = 'S') AS Strikes, count(*) FILTER (type = 'B') AS Balls, count(*) FILTER (type = 'X') AS BIP, count(*) FILTER (bb_type IN ('fly_ball', 'popup')) AS FB, count(*) FILTER (bb_type = 'ground_ball') AS GB,
    CAST(sum(outs) AS BIGINT) AS Outs, CAST(sum(runs) AS BIGINT) AS Runs, round(avg(6 + 10 * l_tax), 6) AS extension, round(stddev_samp(10 * l_discount), 6) AS rel_x_sd,
    round(coalesce(sum(est_ba), 0), 6) AS xBA_num, count(est_ba) AS xBA_den, CASE WHEN count(est_ba) > 0 THEN round(sum(est_ba) / count(est_ba), 6) END AS xBA,
    CASE WHEN sum(woba_denom) > 0 THEN round(sum(woba_value) / sum(woba_denom), 6) END AS wOBA, CASE WHEN sum(woba_denom) > 0 THEN round(sum(xwoba_num) / sum(woba_denom), 6) END AS xwOBA,
    round(count(*) FILTER (is_k) / greatest(count(*) FILTER (is_pa), 1), 6) AS k_rate
    FROM flag SEMI JOIN starter USING (game_pk, pitcher) GROUP BY game_pk, pitcher"""
)
def pitcher_starts(spark, d):
    names = "game_pk pitcher game_date season Pitches PA K BB HBP HR Hits Whiffs CS CSW Strikes Balls BIP FB GB Outs Runs extension rel_x_sd xBA_num xBA_den xBA wOBA xwOBA k_rate".split()
    return rounded(_starts(spark, d).select(*names))


#: The approach angle of a pitch of the adapter, in SQL.
_VAA = "(-degrees(atan(((-5 - 10 * l_tax) + -15 * (-sqrt((-130 - 100 * l_discount) ** 2 - 2 * (25 + l_quantity / 10) * (50 - 17.0::DOUBLE / 12)) - (-130 - 100 * l_discount)) / (25 + l_quantity / 10)) / -sqrt((-130 - 100 * l_discount) ** 2 - 2 * (25 + l_quantity / 10) * (50 - 17.0::DOUBLE / 12)))))"


def _arsenal_sql(t: str) -> str:
    usage = lambda h: f"CASE WHEN count(*) FILTER (stand = '{h}') > 0 THEN round(count(*) FILTER (canon = '{t}' AND stand = '{h}') / count(*) FILTER (stand = '{h}'), 6) ELSE 0.0::DOUBLE END AS {t}_usage_v{h}"
    woba = lambda name, c: f"CASE WHEN sum(woba_denom) FILTER (canon = '{t}') > 0 THEN round(sum({c}) FILTER (canon = '{t}') / sum(woba_denom) FILTER (canon = '{t}'), 6) END AS {t}_{name}"
    means = ", ".join(f"round(avg({c}) FILTER (canon = '{t}'), 6) AS {t}_{n}" for n, c in (("velo", "velo"), ("spinrate", "spin"), ("ivb", "l_tax * 12"), ("hb", "l_discount * 12")))
    angle = f"round(avg({_VAA}) FILTER (canon = '{t}'), 6) AS {t}_vaa"
    return f"{means}, {angle}, CAST(count(*) FILTER (canon = '{t}') > 0 AS TINYINT) AS throws_{t}, {usage('R')}, {usage('L')}, {woba('woba', 'woba_value')}, {woba('xwoba', 'xwoba_num')}"


@query("SELECT game_pk, pitcher, " + ", ".join(map(_arsenal_sql, vocab.PITCH_TYPES)) + " FROM flag SEMI JOIN starter USING (game_pk, pitcher) GROUP BY game_pk, pitcher")
def arsenal_wide(spark, d):
    names = [f"{p}{t}{s}" for t in vocab.PITCH_TYPES for p, s in (*(("", f"_{m}") for m in vocab.PHYSICS), ("throws_", ""), ("", "_usage_vR"), ("", "_usage_vL"), ("", "_woba"), ("", "_xwoba"))]
    return rounded(_starts(spark, d).select("game_pk", "pitcher", *names))


_TYPE_COUNTS = {
    "Pitches": "true", "PA": "is_pa", "K": "is_k", "BB": "is_bb", "Whiffs": "is_whiff", "CS": "is_cs", "CSW": "is_cs OR is_whiff", "Strikes": "type = 'S'", "Balls": "type = 'B'", "BIP": "type = 'X'", "FB": "bb_type IN ('fly_ball', 'popup')", "GB": "bb_type = 'ground_ball'",
    "InZone": "in_zone", "OutZone": "out_zone", "Swings": "is_swing", "Chases": "out_zone AND is_swing", "ZSwings": "in_zone AND is_swing", "Contacts": "is_contact", "ZContacts": "in_zone AND is_contact", "OContacts": "out_zone AND is_contact",
    "HardHit": "type = 'X' AND 60 + q >= 95", "Barrels": "type = 'X' AND q % 6 + 1 = 6", "WeakContact": "type = 'X' AND q % 6 + 1 = 1", "EV_den": "type = 'X'", "LA_den": "type = 'X'", "xBA_den": "est_ba IS NOT NULL", "velo_den": "true", "spin_den": "true", "ivb_den": "true", "hb_den": "true", "vaa_den": "true",
}
_TYPE_SUMS = {"wOBA_num": "woba_value", "wOBA_den": "woba_denom", "xwOBA_num": "xwoba_num", "EV_num": "CASE WHEN type = 'X' THEN 60 + l_quantity END", "LA_num": "CASE WHEN type = 'X' THEN l_quantity - 20 END", "xBA_num": "est_ba", "velo_num": "velo", "spin_num": "spin", "ivb_num": "l_tax * 12", "hb_num": "l_discount * 12", "vaa_num": _VAA}
_TYPE_RATIOS = {
    "usage_rate": ("Pitches", "TotalPitches"), "swstr_rate": ("Whiffs", "Pitches"), "whiff_rate": ("Whiffs", "Swings"), "ball_rate": ("Balls", "Pitches"), "csw_rate": ("CSW", "Pitches"), "chase_rate": ("Chases", "OutZone"), "gb_rate": ("GB", "BIP"),
    "hard_hit_rate": ("HardHit", "EV_den"), "barrel_rate": ("Barrels", "xBA_den"), "weak_contact_rate": ("WeakContact", "xBA_den"), "wOBA": ("wOBA_num", "wOBA_den"), "xwOBA": ("xwOBA_num", "wOBA_den"),
}
_TYPE_MEANS = ("EV", "LA", "xBA", "velo", "spin", "ivb", "hb", "vaa")
_TYPES = f"""mine AS (SELECT *, count(*) OVER (PARTITION BY game_pk, pitcher) AS total, count(*) FILTER (is_pa) OVER (PARTITION BY game_pk, pitcher) AS pas FROM flag SEMI JOIN starter USING (game_pk, pitcher)),
  typed AS (SELECT game_pk, pitcher, canon AS pitch_type, min(game_date) AS game_date, CAST(year(min(game_date)) AS INT) AS season, min(home_team) AS home_team, min(away_team) AS away_team, min(p_throws) AS p_throws, 'Last' || pitcher || ', First' AS player_name, max(total) AS TotalPitches, max(pas) AS pas,
    {", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in _TYPE_COUNTS.items())}, {", ".join(f"coalesce(sum({c}), 0)::DOUBLE AS {n}" for n, c in _TYPE_SUMS.items())} FROM mine WHERE canon IS NOT NULL GROUP BY game_pk, pitcher, canon)"""
_RATIO_SQL = ", ".join(f"CASE WHEN {b} > 0 THEN round({a} / {b}, 6) END AS {n}" for n, (a, b) in {**_TYPE_RATIOS, **{f"{m}_mean": (f"{m}_num", f"{m}_den") for m in _TYPE_MEANS if m != "vaa"}}.items())


@query(
    f"""WITH {_TYPES} SELECT game_pk, pitcher, pitch_type, game_date, season, home_team, away_team, p_throws, player_name, TotalPitches, {", ".join(_TYPE_COUNTS)}, {", ".join(f"round({n}, 6) AS {n}" for n in _TYPE_SUMS)},
    {_RATIO_SQL}, CASE WHEN vaa_den > 0 THEN round(vaa_num / vaa_den, 6) END AS vaa_mean FROM typed WHERE pas >= 1"""
)
def pitch_type_games(spark, d):
    return rounded(games.pitch_type_games(adapter.pitches(spark, d), 1))


@query("SELECT game_pk, pitcher, canon AS pitch_type, count(*) FILTER (type IN ('S', 'B', 'X')) AS Pitches FROM flag SEMI JOIN starter USING (game_pk, pitcher) WHERE canon IS NOT NULL GROUP BY ALL")
def mutual_exclusivity_check(spark, d):
    """Pitches of each start and type, held against its outcomes on the way."""
    return checks.with_exclusive_outcomes(games.pitch_type_games(adapter.pitches(spark, d), 0, check=False)).select("game_pk", "pitcher", "pitch_type", "Pitches")


_BATTER = """bat AS (
  SELECT game_pk, batter, min(game_date) AS game_date, CAST(year(min(game_date)) AS INT) AS season, arg_min(CASE WHEN half = 'Top' THEN away_team ELSE home_team END, (at_bat_number, CASE WHEN half = 'Top' THEN away_team ELSE home_team END)) AS bat_team,
    min(home_team) AS home_team, min(away_team) AS away_team, count(*) AS Pitches, count(*) FILTER (is_pa) AS PA, count(*) FILTER (is_k) AS K, count(*) FILTER (is_pa AND p_throws = 'L') AS PA_vL, count(*) FILTER (is_k AND p_throws = 'L') AS K_vL,
    count(*) FILTER (is_pa AND p_throws = 'R') AS PA_vR, count(*) FILTER (is_k AND p_throws = 'R') AS K_vR, count(*) FILTER (is_whiff) AS Whiffs, count(*) FILTER (is_swing) AS Swings, count(*) FILTER (out_zone AND is_swing) AS Chases, count(*) FILTER (out_zone) AS OutZone,
    CASE WHEN sum(woba_denom) > 0 THEN sum(xwoba_num) / sum(woba_denom) END AS xwOBA, min(at_bat_number) AS first_ab, count(*) FILTER (stand = 'R') AS r, count(*) FILTER (stand = 'L') AS l
  FROM flag GROUP BY game_pk, batter),
batter_game AS (SELECT *, row_number() OVER (PARTITION BY game_pk, bat_team ORDER BY first_ab, batter) <= 9 AS is_initial_lineup, CASE WHEN r > l THEN 'R' ELSE 'L' END AS stand FROM bat)"""


@query(f"WITH {_BATTER} SELECT game_pk, batter, game_date, season, bat_team, stand, Pitches, PA, K, PA_vL, K_vL, PA_vR, K_vR, Whiffs, round(xwOBA, 6) AS xwOBA, is_initial_lineup, bat_team = home_team AS is_home, CASE WHEN bat_team = home_team THEN away_team ELSE home_team END AS opp_team FROM batter_game")
def batter_games(spark, d):
    return rounded(games.batter_games(adapter.pitches(spark, d)).select("game_pk", "batter", "game_date", "season", "bat_team", "stand", "Pitches", "PA", "K", "PA_vL", "K_vL", "PA_vR", "K_vR", "Whiffs", "xwOBA", "is_initial_lineup", "is_home", "opp_team"))


@query("WITH m AS (SELECT canon, stand, count(*) AS n FROM pitch WHERE canon IS NOT NULL GROUP BY ALL) SELECT canon AS pitch_type, stand FROM m QUALIFY row_number() OVER (PARTITION BY canon ORDER BY n DESC, stand) = 1")
def mode_hand(spark, d):
    p = adapter.pitches(spark, d).withColumn("pitch_type", X.lookup(F.col("pitch_type"), vocab.PITCH_CODES)).where("pitch_type is not null")
    return p.groupBy("pitch_type").agg(F.mode("stand", deterministic=True).alias("stand"))


# --- level 2 --------------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_COUNTED}, w AS (SELECT *, """
    + ", ".join(f"sum(K) OVER w{w} AS k{w}, sum(PA) OVER w{w} AS n{w}" for w in (5, 10, 20))
    + " FROM counted WINDOW "
    + ", ".join(f"w{w} AS {_ROWS5.format(w=w)}" for w in (5, 10, 20))
    + """), r AS (SELECT *, """
    + ", ".join(f"CASE WHEN n{w} > 0 THEN round(k{w} / n{w}, 6) END AS p{w}" for w in (5, 10, 20))
    + """ FROM w) SELECT game_pk, pitcher, """
    + ", ".join(f"first(p{w}) OVER o AS k_rate_P{w}" for w in (5, 10, 20))
    + " FROM r WINDOW o AS (PARTITION BY pitcher, game_date ORDER BY game_pk)"
)
def rolling_rates(spark, d):
    out = rolling.pitcher_features(_counted(spark, d), {"k_rate": ("K", "PA")}, (), season_to_date=False, fip=False, check=False)
    return rounded(out.select("game_pk", "pitcher", *[f"k_rate_P{w}" for w in (5, 10, 20)]))


@query(f"WITH {_COUNTED}, r AS (SELECT *, round(avg(ff_velo) OVER {_ROWS5.format(w=3)}, 6) AS v FROM counted) SELECT game_pk, pitcher, first(v) OVER (PARTITION BY pitcher, game_date ORDER BY game_pk) AS ff_velo_P3 FROM r")
def rolling_mean_p3(spark, d):
    out = rolling.pitcher_features(_counted(spark, d), {}, ("ff_velo",), mean_windows=(3,), fip=False, check=False)
    return rounded(out.select("game_pk", "pitcher", "ff_velo_P3"))


@query(
    f"""WITH {_COUNTED}, r AS (SELECT *, sum(K) OVER {_ROWS5.format(w=5)} AS k5, sum(PA) OVER {_ROWS5.format(w=5)} AS n5, sum(K) OVER s AS ks, sum(PA) OVER s AS ns FROM counted WINDOW s AS {_SEASON.format(e="pitcher")})
    SELECT game_pk, pitcher, game_date, first(CASE WHEN n5 > 0 THEN round(k5 / n5, 6) END) OVER (PARTITION BY pitcher, game_date ORDER BY game_pk) AS k_rate_P5, CASE WHEN ns > 0 THEN round(ks / ns, 6) END AS k_rate_std FROM r"""
)
def season_to_date(spark, d):
    """Trailing five games and season to date, earlier dates only: the flagship query."""
    out = rolling.pitcher_features(_counted(spark, d), {"k_rate": ("K", "PA")}, (), rate_windows=(5,), fip=False, check=False)
    return rounded(out.select("game_pk", "pitcher", "game_date", "k_rate_P5", "k_rate_std"))


@query(f"WITH {_COUNTED} SELECT game_pk, pitcher, season <> lag(season) OVER (PARTITION BY pitcher ORDER BY game_date, game_pk) AS season_changed FROM counted")
def season_changes(spark, d):
    return rolling.season_changes(_counted(spark, d), "pitcher").select("game_pk", "pitcher", "season_changed")


@query(
    f"""WITH {_BATTER}, d AS (SELECT game_date, sum(K) AS k, sum(PA) AS n FROM batter_game GROUP BY 1), lg AS (SELECT game_date, sum(k) OVER w AS k, sum(n) OVER w AS n FROM d WINDOW w AS (ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    league AS (SELECT game_date, CASE WHEN n > 0 THEN k / n ELSE 0.22::DOUBLE END AS lgk FROM lg),
    r AS (SELECT b.*, lgk, sum(K) OVER s AS ks, sum(PA) OVER s AS ns, sum(K_vL) OVER s AS kl, sum(PA_vL) OVER s AS nl, sum(Whiffs) OVER s AS wh, sum(Swings) OVER s AS sw,
      sum(K) OVER p AS k5, sum(PA) OVER p AS n5 FROM batter_game b JOIN league USING (game_date) WINDOW s AS {_SEASON.format(e="batter")}, p AS (PARTITION BY batter ORDER BY game_date, game_pk ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
    SELECT game_pk, batter, CASE WHEN ns > 0 THEN round(ks / ns, 6) END AS k_rate_std, CASE WHEN nl > 0 THEN round(kl / nl, 6) END AS k_rate_std_vL, CASE WHEN sw > 0 THEN round(wh / sw, 6) END AS whiff_rate_std,
      first(CASE WHEN n5 > 0 THEN round(k5 / n5, 6) END) OVER (PARTITION BY batter, game_date ORDER BY game_pk) AS k_rate_P5, round((coalesce(ks, 0) + 200 * lgk) / (coalesce(ns, 0) + 200), 6) AS k_rate_std_shrunk FROM r"""
)
def batter_shrunk(spark, d):
    out = rolling.batter_features(games.batter_games(adapter.pitches(spark, d)), fallback=0.22, check=False)
    return rounded(out.select("game_pk", "batter", "k_rate_std", "k_rate_std_vL", "whiff_rate_std", "k_rate_P5", "k_rate_std_shrunk"))


_HRFB = """fb AS (SELECT season, game_date, count(*) FILTER (is_hr) AS hr, count(*) FILTER (bb_type IN ('fly_ball', 'popup')) AS fb FROM flag GROUP BY ALL),
  run AS (SELECT season, game_date, coalesce(sum(hr) OVER w, 0) AS hr, coalesce(sum(fb) OVER w, 0) AS fb FROM fb WINDOW w AS (PARTITION BY season ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  yr AS (SELECT season + 1 AS season, sum(hr) / nullif(sum(fb), 0) AS prior FROM fb GROUP BY season),
  prior AS (SELECT game_date, (hr + 1000 * prior) / (fb + 1000) AS p FROM run LEFT JOIN yr USING (season))"""


@query(f"WITH {_HRFB} SELECT game_date, round(p, 6) AS lg_hr_fb_prior FROM prior")
def hr_fb_prior(spark, d):
    return rounded(priors.hr_fb_before(adapter.pitches(spark, d)))


@query("SELECT season, round(count(*) FILTER (is_hr) / count(*) FILTER (bb_type IN ('fly_ball', 'popup')), 6) AS hr_fb FROM flag GROUP BY season HAVING count(*) FILTER (bb_type IN ('fly_ball', 'popup')) > 0")
def league_hr_fb(spark, d):
    return rounded(priors.league_hr_fb(adapter.pitches(spark, d)))


_CONSTANTS = {y: 3.1 + (y - 1995) / 100 for y in range(1995, 2002)}
_CONSTANT_SQL = "(3.1::DOUBLE + (season - 1995)::DOUBLE / 100)"


@query(
    f"""WITH {_COUNTED}, {_HRFB} SELECT game_pk, pitcher, CASE WHEN Outs >= 1 THEN round((13 * HR + 3 * (BB + HBP) - 2 * K) / (Outs / 3) + {_CONSTANT_SQL}, 6) END AS FIP,
    CASE WHEN Outs >= 1 THEN round((13 * FB * p + 3 * (BB + HBP) - 2 * K) / (Outs / 3) + {_CONSTANT_SQL}, 6) END AS xFIP FROM counted LEFT JOIN prior USING (game_date)"""
)
def fip_with_constant(spark, d):
    starts = _counted(spark, d).join(F.broadcast(priors.hr_fb_before(adapter.pitches(spark, d))), "game_date", "left")
    return rounded(priors.fip(starts, _CONSTANTS, least_outs=1).select("game_pk", "pitcher", "FIP", "xFIP"))


@query(f"WITH {_COUNTED}, s AS (SELECT season, sum(HR) AS h, sum(BB) AS b, sum(HBP) AS p, sum(K) AS k, sum(Outs) AS o FROM counted GROUP BY 1) SELECT season, round(9 * o / 2 / (o / 3) - (13 * h + 3 * (b + p) - 2 * k) / (o / 3), 6) AS constant FROM s WHERE o > 0")
def calibrated_constants(spark, d):
    return rounded(priors.calibrated_constants(_counted(spark, d).withColumn("Runs", F.col("Outs") / 2)))


@query(
    f"""WITH {_COUNTED}, own AS (SELECT pitcher, season + 1 AS season, sum(K) / nullif(sum(PA), 0) AS o FROM counted GROUP BY pitcher, season), lg AS (SELECT season + 1 AS season, sum(K) / nullif(sum(PA), 0) AS l FROM counted GROUP BY season)
    SELECT game_pk, c.pitcher, round((coalesce(sum(K) OVER s, 0) + 200 * coalesce(o, l, 0.22::DOUBLE)) / (coalesce(sum(PA) OVER s, 0) + 200), 6) AS k_rate_std_shrunk
    FROM counted c LEFT JOIN own USING (pitcher, season) LEFT JOIN lg USING (season) WINDOW s AS {_SEASON.format(e="pitcher")}"""
)
def prior_season_shrunk(spark, d):
    return rounded(priors.prior_season_shrunk(_counted(spark, d), fallback=0.22).select("game_pk", "pitcher", "k_rate_std_shrunk"))


def _fip_sql(w: int) -> str:
    core = f"(3 * (rBB{w} + rHBP{w}) - 2 * rK{w})"
    good = f"WHEN rOuts{w} >= 9 AND season BETWEEN 2021 AND 2026 THEN"
    constant = "[3.170::DOUBLE, 3.112, 3.255, 3.166, 3.135, 3.099][season - 2020]"
    return f"CASE {good} round((13 * rHR{w} + {core}) / (rOuts{w} / 3) + {constant}, 6) END AS f{w}, CASE {good} round((13 * rFB{w} * 0.1 + {core}) / (rOuts{w} / 3) + {constant}, 6) END AS x{w}"


@query(
    f"""WITH {_COUNTED}, moved AS (SELECT * REPLACE (season + 26 AS season) FROM counted), r AS (SELECT *, {", ".join(f"sum({c}) OVER w{w} AS r{c}{w}" for w in vocab.MEAN_WINDOWS for c in vocab.FIP_COUNTS)} FROM moved
      WINDOW {", ".join(f"w{w} AS {_ROWS5.format(w=w)}" for w in vocab.MEAN_WINDOWS)}), v AS (SELECT *, {", ".join(map(_fip_sql, vocab.MEAN_WINDOWS))} FROM r)
    SELECT game_pk, pitcher, {", ".join(f"first(f{w}) OVER o AS FIP_P{w}, first(x{w}) OVER o AS xFIP_P{w}" for w in vocab.MEAN_WINDOWS)} FROM v WINDOW o AS (PARTITION BY pitcher, game_date ORDER BY game_pk)"""
)
def rolling_fip(spark, d):
    starts = _counted(spark, d).withColumns({"season": F.col("season") + 26, "lg_hr_fb_prior": F.lit(0.1)})
    return rounded(rolling.pitcher_features(starts, {}, (), check=False).select("game_pk", "pitcher", *[f"{n}_P{w}" for w in vocab.MEAN_WINDOWS for n in ("FIP", "xFIP")]))


# --- parks ----------------------------------------------------------------------------------------------------------------------

_PA = "pa AS (SELECT game_pk, at_bat_number, arg_max(home_team, pitch_number) AS home_team, arg_max(season, pitch_number) AS season, arg_max(is_k, pitch_number) AS is_k FROM flag WHERE is_pa GROUP BY game_pk, at_bat_number)"


@query(f"WITH {_PA}, v AS (SELECT home_team AS venue, count(*) AS PA, count(*) FILTER (is_k) AS K FROM pa GROUP BY 1), l AS (SELECT sum(K) / sum(PA) AS l FROM v) SELECT venue, PA, K, round((K + 500 * l) / (PA + 500) / l, 6) AS park_k_factor FROM v, l")
def park_factor(spark, d):
    return rounded(park.k_factor(pitches.plate_appearances(adapter.pitches(spark, d))))


@query(
    f"""WITH {_PA}, s AS (SELECT unnest([1996, 1998, 2001, 2003]) AS season), place AS (SELECT DISTINCT s.season, home_team FROM s JOIN pa ON pa.season = least(s.season, 2001)),
    h AS (SELECT s.season, home_team, count(*) AS PA, count(*) FILTER (is_k) AS K FROM pa JOIN s ON pa.season < s.season GROUP BY ALL), l AS (SELECT season, sum(K) / sum(PA) AS l FROM h GROUP BY season)
    SELECT CAST(season AS INT) AS season, home_team, coalesce(PA, 0) AS PA, coalesce(K, 0) AS K, CASE WHEN PA IS NULL THEN 1.0::DOUBLE ELSE round((K + 500 * l) / (PA + 500) / l, 6) END AS park_k_factor FROM place LEFT JOIN h USING (season, home_team) LEFT JOIN l USING (season)"""
)
def park_factor_prior_seasons(spark, d):
    return rounded(park.season_factors(pitches.plate_appearances(adapter.pitches(spark, d)), [1996, 1998, 2001, 2003]))


@query("SELECT DISTINCT home_team, season, CASE WHEN home_team = 'T3' AND game_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' THEN 'T3_away' ELSE home_team END AS venue FROM pitch")
def venue_override(spark, d):
    p = adapter.pitches(spark, d)
    return p.select("home_team", F.col("game_year").alias("season"), park.venue(F.col("home_team"), F.col("game_date"), {("T3", "1997-01-01", "1997-12-31"): "T3_away"}).alias("venue")).distinct()


# --- level 3, identities --------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_BATTER}, b AS (SELECT *, sum(K) OVER s AS ks, sum(PA) OVER s AS ns, sum(K_vL) OVER s AS kl, sum(PA_vL) OVER s AS nl, sum(K_vR) OVER s AS kr, sum(PA_vR) OVER s AS nr FROM batter_game WINDOW s AS {_SEASON.format(e="batter")}),
    st AS (SELECT game_pk, pitcher, arg_min(half, (at_bat_number, pitch_number)) AS half, min(home_team) AS home_team, min(away_team) AS away_team, min(p_throws) AS p_throws FROM flag SEMI JOIN starter USING (game_pk, pitcher) GROUP BY ALL),
    o AS (SELECT *, CASE WHEN half = 'Top' THEN away_team ELSE home_team END AS opp FROM st),
    j AS (SELECT o.game_pk, o.pitcher, o.p_throws, b.batter, CASE WHEN ns > 0 THEN ks / ns END AS k, CASE WHEN nl > 0 THEN kl / nl END AS vl, CASE WHEN nr > 0 THEN kr / nr END AS vr FROM o LEFT JOIN b ON o.game_pk = b.game_pk AND o.opp = b.bat_team AND b.is_initial_lineup)
    SELECT game_pk, pitcher, count(batter) AS opp_lineup_size, round(avg(k), 6) AS opp_lineup_k, round(CASE p_throws WHEN 'R' THEN avg(vr) ELSE avg(vl) END, 6) AS opp_lineup_k_vs_hand FROM j GROUP BY game_pk, pitcher, p_throws"""
)
def lineup_aggregate(spark, d):
    batters = rolling.batter_features(games.batter_games(adapter.pitches(spark, d)), shrink_pa=None, check=False)
    return rounded(training.opposing_lineup(_starts(spark, d), batters).select("game_pk", "pitcher", "opp_lineup_size", "opp_lineup_k", "opp_lineup_k_vs_hand"))


@query("SELECT o_orderkey, o_custkey, c_name AS customer_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'", ctes=False)
def name_enrichment(spark, d):
    players = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("mlb_id"), F.col("c_name").alias("player_name"))
    return identity.attach_name(table(spark, d, "orders").select("o_orderkey", "o_custkey"), players, "o_custkey", "customer_name", check=False)


@query("SELECT DISTINCT o_custkey AS c FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING' WHERE c_custkey IS NULL", ctes=False)
def unmapped_ids(spark, d):
    named = name_enrichment(spark, d)
    return identity.unmapped(named, "o_custkey", "customer_name").select(F.col("o_custkey").alias("c"))


@query("SELECT DISTINCT pitcher, 'First Last' || pitcher AS pitcher_name FROM pitch")
def name_normalise(spark, d):
    return adapter.pitches(spark, d).select("pitcher", X.first_last("player_name").alias("pitcher_name")).distinct()


@query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '\b(jr|sr|ii|iii|iv)\b\.?', '', 'g'), '[^a-z0-9]+', '', 'g') AS name_key FROM documents
    UNION ALL SELECT -c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'jose' WHEN 1 THEN 'nguyen' WHEN 2 THEN 'hasan' ELSE 'finn' END || 'customer' || substring(c_name, 10) FROM customer""",
    ctes=False,
)
def name_key(spark, d):
    """Keys of whole texts, and of names with marks, ligatures and generation suffixes."""
    names = F.element_at(F.array(*map(F.lit, ("José", "Nguyễn", "Ḥasan", "Ｆｉnn"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    suffix = F.element_at(F.array(*map(F.lit, (" Jr.", ", Sr", " III", " iv."))), (F.col("c_custkey") % 4 + 1).cast("int"))
    customers = table(spark, d, "customer").select((-F.col("c_custkey")).alias("doc_id"), F.concat(names, F.lit(" "), "c_name", suffix).alias("text"))
    return table(spark, d, "documents").select("doc_id", "text").unionByName(customers).select("doc_id", X.name_key("text").alias("name_key"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<a\\s[^>]*href=\"[^\"]')) AS BIGINT) AS n_links FROM pages", ctes=False)
def html_extract(spark, d):
    return html.links(table(spark, d, "pages"))


@query("SELECT user_id, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY user_id", ctes=False)
def json_fields(spark, d):
    e = table(spark, d, "events").select("user_id", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"))


# --- reliability ----------------------------------------------------------------------------------------------------------------

_STATS = {"K": True, "Whiffs": True, "ff_velo": False}
_LONG = f"""{_COUNTED}, long AS (SELECT pitcher AS player, game_date, game_pk, PA AS w, unnest(['K', 'Whiffs', 'ff_velo']) AS stat, unnest([K::DOUBLE, Whiffs::DOUBLE, ff_velo]) AS v FROM counted),
  num AS (SELECT *, row_number() OVER (PARTITION BY stat, player ORDER BY game_date, game_pk) AS rn FROM long WHERE v IS NOT NULL)"""


def _pairs_sql(windows: str) -> str:
    agg = "CASE WHEN stat = 'ff_velo' THEN avg(v) FILTER ({m}) ELSE sum(v) FILTER ({m}) / greatest(sum(w) FILTER ({m}), 1) END"
    return f"""{_LONG}, pairs AS (SELECT stat, win, player, {agg.format(m="rn <= win")} AS a, {agg.format(m="rn > win")} AS b FROM num, (SELECT unnest({windows}) AS win) WHERE rn <= 2 * win GROUP BY stat, win, player HAVING count(*) = 2 * win)"""


def _half_df(spark, d):
    return _counted(spark, d)


@query(f"WITH {_pairs_sql('[10]')}, r AS (SELECT *, rank() OVER (PARTITION BY stat ORDER BY round(a, 9)) + (count(*) OVER (PARTITION BY stat, round(a, 9)) - 1) / 2 AS ra, rank() OVER (PARTITION BY stat ORDER BY round(b, 9)) + (count(*) OVER (PARTITION BY stat, round(b, 9)) - 1) / 2 AS rb FROM pairs) SELECT stat, count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, round(stddev_samp(a) * sqrt(greatest(0, 1 - corr(a, b))), 6) AS sem, round(regr_slope(b, a), 6) AS slope FROM r GROUP BY stat")
def split_half(spark, d):
    return rounded(reliability.split_half(_half_df(spark, d), _STATS, 10, "pitcher", 10))


@query(f"WITH {_pairs_sql('[5, 10, 20]')} SELECT stat, CAST(win AS INT) AS \"window\", count(*) AS n, round(corr(a, b), 6) AS r FROM pairs GROUP BY stat, win")
def stabilization_curve(spark, d):
    return rounded(reliability.stabilization_curve(_half_df(spark, d), _STATS, (5, 10, 20), "pitcher", 10))


@query(
    f"""WITH {_LONG}, y AS (SELECT stat, player, year(game_date) AS s, CASE WHEN stat = 'ff_velo' THEN avg(v) ELSE sum(v) / greatest(sum(w), 1) END AS v FROM num GROUP BY stat, player, year(game_date) HAVING count(*) >= 5)
    SELECT p.stat, count(*) AS n, round(corr(p.v, q.v), 6) AS yoy FROM y p JOIN y q ON p.stat = q.stat AND p.player = q.player AND q.s = p.s + 1 GROUP BY p.stat"""
)
def yoy_correlation(spark, d):
    return rounded(reliability.year_over_year(_half_df(spark, d), _STATS, "pitcher", 10, 5))


@query(
    f"""WITH {_pairs_sql('[10]')}, m AS (SELECT stat, count(*) AS n, avg(a) AS ma, avg(b) AS mb, 2 * var_samp((a + b) / 2) AS msr, var_samp(a - b) / 2 AS mse FROM pairs GROUP BY stat)
    SELECT stat, round((msr - mse) / (msr + mse + 2 * (n * ((ma - mb) ** 2) / 2 - mse) / n), 6) AS icc2 FROM m"""
)
def icc2(spark, d):
    return rounded(reliability.icc2(reliability.half_pairs(_half_df(spark, d), _STATS, [10], "pitcher"), 10))


_DENOM = f"""{_COUNTED}, c AS (SELECT pitcher AS player, K::DOUBLE AS num, PA::DOUBLE AS den, row_number() OVER o AS rn, sum(PA) OVER o AS cs, sum(PA) OVER (PARTITION BY pitcher) AS most FROM counted WINDOW o AS (PARTITION BY pitcher ORDER BY game_date, game_pk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  t AS (SELECT c.*, target FROM c, (SELECT unnest([10, 25, 50, 100]) AS target) WHERE most >= 2 * target),
  i1 AS (SELECT *, min(rn) FILTER (cs >= target) OVER w AS i1, min(cs) FILTER (cs >= target) OVER w AS cs1 FROM t WINDOW w AS (PARTITION BY player, target)),
  i2 AS (SELECT *, min(rn) FILTER (rn > i1 AND cs - cs1 >= target) OVER (PARTITION BY player, target) AS i2 FROM i1),
  pairs AS (SELECT player, target, sum(num) FILTER (rn <= i1) / greatest(sum(den) FILTER (rn <= i1), 1) AS a, sum(num) FILTER (rn > i1 AND rn <= i2) / greatest(sum(den) FILTER (rn > i1 AND rn <= i2), 1) AS b FROM i2 WHERE i2 IS NOT NULL GROUP BY player, target)"""


@query(f"WITH {_DENOM} SELECT 'K' AS stat, 'PA' AS denom, player, CAST(target AS INT) AS target, round(a, 6) AS a, round(b, 6) AS b FROM pairs")
def denominator_buckets(spark, d):
    return rounded(reliability.denominator_pairs(_half_df(spark, d), {("K", "PA"): True}, [10, 25, 50, 100], "pitcher"))


@query(f"WITH {_DENOM} SELECT 'K' AS stat, 'PA' AS denom, CAST(target AS INT) AS target, count(*) AS n, round(corr(a, b), 6) AS r FROM pairs GROUP BY target")
def stabilization_by_denominator(spark, d):
    return rounded(reliability.stabilization_by_denominator(_half_df(spark, d), {("K", "PA"): True}, [10, 25, 50, 100], "pitcher", 10))


@query(
    f"""WITH {_DENOM}, r AS (SELECT target, corr(a, b) AS r FROM pairs GROUP BY target)
    SELECT 'K' AS stat, 'PA' AS denom, CAST(min(target) FILTER (r >= 0.5) AS INT) AS r_50, CAST(min(target) FILTER (r >= 0.7) AS INT) AS r_70, coalesce(bool_or(r >= 0.5), false) AS reliably_estimable FROM r"""
)
def first_crossing(spark, d):
    curve = reliability.stabilization_by_denominator(_half_df(spark, d), {("K", "PA"): True}, [10, 25, 50, 100], "pitcher", 10)
    return reliability.crossings(curve, least=10)


def _specs(specs):
    return {name: (num, den, range(step, last + 1, step)) for name, (num, den, last, step) in specs.items()}


def _study_df(spark, d):
    """Games of every pitcher with all counts of the stabilisation study."""
    p = pitches.pitch_level(adapter.pitches(spark, d))
    balls = [F.count_if(F.col("type") == c).alias(n) for n, c in (("Balls", "B"), ("BIP", "X"))]
    counts = [F.count("*").alias("Pitches"), *[F.count_if(c).alias(n) for n, c in (("PA", "is_pa"), ("K", "is_k"), ("BB", "is_bb"), ("HR", "is_hr"), ("FB", "is_fb"), ("GB", "is_gb"), ("Whiffs", "is_whiff"))]]
    out = p.groupBy("game_pk", "pitcher").agg(F.min("game_date").alias("game_date"), *counts, *balls, *X.discipline_counts(), F.count_if("is_called_strike").alias("_cs"))
    return out.withColumn("CSW", F.col("_cs") + F.col("Whiffs"))


@query()
def pitcher_crossings(spark, d):
    return reliability.study(_study_df(spark, d), _specs(vocab.PITCHER_SPECS), "pitcher")


@query()
def batter_crossings(spark, d):
    return reliability.study(games.batter_games(adapter.pitches(spark, d)), _specs(vocab.BATTER_SPECS), "batter")


@query()
def pitch_type_crossings(spark, d):
    return reliability.study(games.pitch_type_games(adapter.pitches(spark, d), 0, check=False), _specs(vocab.PITCH_TYPE_SPECS), "pitcher", by=["pitch_type"])


@query()
def bootstrap_ci(spark, d):
    pairs = reliability.denominator_pairs(_half_df(spark, d), {("K", "PA"): True}, [10, 25, 50, 100], "pitcher", strict=True)
    return rounded(reliability.bootstrap(pairs))


@query(f"WITH {_pairs_sql('[10]')}, r AS (SELECT stat, corr(a, b) AS r FROM pairs GROUP BY stat) SELECT stat, CASE WHEN r IS NULL THEN 'Unknown' WHEN r >= 0.7 THEN 'Tier 1' WHEN r >= 0.5 THEN 'Tier 2' ELSE 'Tier 3' END AS tier FROM r")
def feature_tier(spark, d):
    return reliability.split_half(_half_df(spark, d), _STATS, 10, "pitcher", 10).select("stat", reliability.tier(F.col("pearson")).alias("tier"))


@query(
    f"""WITH {_pairs_sql('[10]')}, y AS (SELECT stat, player, year(game_date) AS s, CASE WHEN stat = 'ff_velo' THEN avg(v) ELSE sum(v) / greatest(sum(w), 1) END AS v FROM num GROUP BY stat, player, year(game_date) HAVING count(*) >= 5),
    q AS (SELECT p.stat, corr(p.v, q.v) AS yoy FROM y p JOIN y q ON p.stat = q.stat AND p.player = q.player AND q.s = p.s + 1 GROUP BY p.stat),
    k AS (SELECT *, rank() OVER (PARTITION BY stat ORDER BY round(a, 9)) + (count(*) OVER (PARTITION BY stat, round(a, 9)) - 1) / 2 AS ra, rank() OVER (PARTITION BY stat ORDER BY round(b, 9)) + (count(*) OVER (PARTITION BY stat, round(b, 9)) - 1) / 2 AS rb FROM pairs),
    h AS (SELECT stat, count(*) AS n, corr(a, b) AS r, corr(ra, rb) AS rho, regr_slope(b, a) AS slope, stddev_pop(a) AS sd, avg(a) AS ma, avg(b) AS mb, 2 * var_samp((a + b) / 2) AS msr, var_samp(a - b) / 2 AS mse FROM k GROUP BY stat)
    SELECT stat, n, round(r, 6) AS pearson, round(rho, 6) AS spearman, round((msr - mse) / (msr + mse + 2 * (n * ((ma - mb) ** 2) / 2 - mse) / n), 6) AS icc2, round(slope, 6) AS slope, round(sd * sqrt(greatest(0, 1 - r)), 6) AS sem, round(yoy, 6) AS yoy, CASE WHEN yoy IS NULL THEN 'Unknown' WHEN yoy >= 0.7 THEN 'Tier 1' WHEN yoy >= 0.5 THEN 'Tier 2' ELSE 'Tier 3' END AS tier FROM h LEFT JOIN q USING (stat)"""
)
def reliability_table(spark, d):
    return rounded(reliability.reliability_table(_half_df(spark, d), _STATS, 10, "pitcher", 10, 10))


@query(f"WITH {_COUNTED}, p AS (SELECT unnest(['K', 'K', 'PA']) AS a, unnest(['PA', 'Whiffs', 'Whiffs']) AS b, unnest([K, K, PA]) AS x, unnest([PA, Whiffs, Whiffs]) AS y FROM counted) SELECT a, b, count(*) AS n, round(corr(x, y), 6) AS r FROM p GROUP BY a, b")
def correlation_pairs(spark, d):
    return rounded(reliability.correlations(_half_df(spark, d), ["K", "PA", "Whiffs"]))


@query(f"WITH {_COUNTED}, p AS (SELECT K, unnest(['ff_velo', 'PA']) AS \"column\", unnest([ff_velo, PA::DOUBLE]) AS x FROM counted) SELECT \"column\", round(avg((x IS NULL)::INT), 6) AS missing, round((avg(x ** 3) - 3 * avg(x) * avg(x ** 2) + 2 * avg(x) ** 3) / stddev_pop(x) ** 3, 4) AS skew, round(corr(x, K), 6) AS r FROM p GROUP BY 1")
def null_audit(spark, d):
    return rounded(reliability.audit(_half_df(spark, d), ["ff_velo", "PA"], "K")).withColumn("skew", F.round("skew", 4) + 0.0)


_SUMMED = {n: r for n, r in _TYPE_RATIOS.items() if n != "wOBA"}


@query(f"WITH {_TYPES} SELECT pitch_type, CAST(sum(Pitches) AS BIGINT) AS Pitches, " + ", ".join(f"round(sum({a}) / nullif(sum({b}), 0), 6) AS {n}" for n, (a, b) in _SUMMED.items()) + " FROM typed GROUP BY pitch_type")
def pitch_type_summary(spark, d):
    return rounded(reliability.pitch_type_summary(games.pitch_type_games(adapter.pitches(spark, d), 0, check=False)))


# --- modelling ------------------------------------------------------------------------------------------------------------------


def _model_frame(spark, d):
    feats = rolling.pitcher_features(_counted(spark, d), {"k_rate": ("K", "PA"), "whiff_rate": ("Whiffs", "Swings")}, ("ff_velo",), rate_windows=(5, 20), mean_windows=(3,), fip=False, check=False)
    return feats.select("game_pk", "pitcher", "game_date", "season", (F.col("K") / F.greatest("PA", F.lit(1))).alias("k_rate"), "k_rate_P5", "k_rate_P20", "k_rate_std", "whiff_rate_P20", "ff_velo_P3")


_FEATURES = ("k_rate_P5", "k_rate_P20", "k_rate_std", "whiff_rate_P20", "ff_velo_P3")
_SPLIT = f"""{_COUNTED}, dd AS (SELECT game_date, count(*) AS n FROM counted GROUP BY 1), cum AS (SELECT game_date, sum(n) OVER (ORDER BY game_date) AS c, sum(n) OVER () AS t FROM dd),
  cut AS (SELECT min(game_date) FILTER (c > floor(t * 0.70)) AS v, min(game_date) FILTER (c > floor(t * 0.85)) AS s FROM cum),
  tagged AS (SELECT *, K / greatest(PA, 1) AS y, CASE WHEN game_date < v THEN 'train' WHEN game_date < s THEN 'validation' ELSE 'test' END AS split FROM counted, cut)"""


@query(f"WITH {_SPLIT} SELECT split, count(*) AS n, min(game_date) AS first, max(game_date) AS last FROM tagged GROUP BY split")
def chronological_split(spark, d):
    return modelling.chronological_split(_counted(spark, d)).groupBy("split").agg(F.count("*").alias("n"), F.min("game_date").alias("first"), F.max("game_date").alias("last"))


@query(f"WITH {_SPLIT}, m AS (SELECT avg(y) AS p FROM tagged WHERE split = 'train') SELECT split, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) + 0.0 AS r2 FROM tagged, m GROUP BY split")
def mean_baseline_metrics(spark, d):
    df = modelling.chronological_split(_counted(spark, d).withColumn("k_rate", F.col("K") / F.greatest("PA", F.lit(1))))
    return rounded(modelling.metrics(modelling.mean_baseline(df), by=["split"]))


_FOLDS = (("a", "1997-01-01", "1997-01-01", "1998-01-01"), ("b", "1999-01-01", "1999-01-01", "2000-01-01"))


@query(
    f"""WITH {_COUNTED}, f AS (SELECT 'a' AS fold, DATE '1997-01-01' AS b, DATE '1998-01-01' AS c UNION ALL SELECT 'b', DATE '1999-01-01', DATE '2000-01-01')
    SELECT fold, CASE WHEN game_date < b THEN 'train' ELSE 'validation' END AS role, count(*) AS n FROM counted, f WHERE game_date < c GROUP BY ALL"""
)
def research_folds(spark, d):
    return modelling.research_folds(_counted(spark, d), _FOLDS).groupBy("fold", "role").agg(F.count("*").alias("n"))


@query()
def ridge_metrics(spark, d):
    df = modelling.chronological_split(_model_frame(spark, d))
    return rounded(modelling.metrics(modelling.ridge(df, _FEATURES), by=["split"]))


@query()
def boosted_metrics(spark, d):
    df = modelling.chronological_split(_model_frame(spark, d))
    return rounded(modelling.metrics(modelling.boosted(df, _FEATURES), by=["split"]))


@query()
def ablation_summary(spark, d):
    sets = modelling.configurations(_FEATURES, {"whiff": "^whiff", "velo": "^ff_velo"})
    return rounded(modelling.ablation_summary(modelling.ablation(_model_frame(spark, d), sets, _FOLDS)))
