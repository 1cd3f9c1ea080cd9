"""Queries over feeds, registers, lineup pages, joins by name, checks and studies, each with its DuckDB SQL.

Feeds and pages are made from the driver's tables in the form in which the sources give them and then read by the library's operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from formline import vocab
from formline.functions import expr as X
from formline.operators import checks, games, identity, modelling, priors, reliability, rolling, slate, training
from formline.plans import levels
from formline.plans.registry import _BATTER, _CONSTANTS, _COUNTED, _SEASON, _counted, _starts, query, rounded
from formline.sources import adapter, files, html
from formline.sources.adapter import table

_TEAMS = list(vocab.TEAM_IDS.items())
_CODES = "[" + ", ".join(f"'{c}'" for c, _ in _TEAMS) + "]"
_IDS = "[" + ", ".join(str(i) for _, i in _TEAMS) + "]"


def _team(i, what: int):
    """Code (0) or id (1) of the team with a number."""
    return F.element_at(F.array(*[F.lit(t[what]) for t in _TEAMS]), (F.pmod(i, F.lit(len(_TEAMS))) + 1).cast("int"))


# --- feeds ----------------------------------------------------------------------------------------------------------------------


def _schedule_feed(spark, d):
    """A schedule of a game an order as JSON, read with the feed's schema; teams by customer and order, some unknown."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    team = lambda i, pitcher: F.struct(F.struct(F.when(i % 31 == 30, 1).otherwise(_team(i % 31, 1)).cast("long").alias("id")).alias("team"), F.when(pitcher % 3 > 0, F.struct(pitcher.alias("id"))).alias("probablePitcher"))
    game = F.struct(
        F.col("o_orderkey").alias("gamePk"),
        F.when(F.col("o_orderkey") % 5 == 0, "S").otherwise("R").alias("gameType"),
        F.concat(F.col("day").cast("string"), F.lit("T23:05:00Z")).alias("gameDate"),
        F.struct(F.lit("Scheduled").alias("detailedState")).alias("status"),
        F.struct(team(F.col("o_custkey"), F.col("o_orderkey")).alias("away"), team(F.col("o_custkey") + 7, F.col("o_orderkey") + 1).alias("home")).alias("teams"),
    )
    text = F.to_json(F.struct(F.array(F.struct(F.col("day").cast("string").alias("date"), F.array(game).alias("games"))).alias("dates")))
    return o.select(F.from_json(text, files.SCHEDULE).alias("f")).select("f.*")


@query(
    f"""SELECT CAST(o_orderdate AS DATE) AS game_date, o_orderkey AS game_pk, 'Scheduled' AS game_status, {_CODES}[o_custkey % 31 + 1] AS away_team, {_CODES}[(o_custkey + 7) % 31 + 1] AS home_team,
    CAST({_IDS}[o_custkey % 31 + 1] AS BIGINT) AS away_team_id, CAST({_IDS}[(o_custkey + 7) % 31 + 1] AS BIGINT) AS home_team_id, CAST(o_orderdate AS DATE) + INTERVAL 1385 MINUTE AS game_time,
    CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS away_probable_pitcher_id, CASE WHEN (o_orderkey + 1) % 3 > 0 THEN o_orderkey + 1 END AS home_probable_pitcher_id
    FROM orders WHERE o_custkey % 31 < 30 AND (o_custkey + 7) % 31 < 30""",
    ctes=False,
)
def schedule_feed(spark, d):
    return files.schedule(_schedule_feed(spark, d)).withColumn("game_time", F.col("game_time").cast("timestamp_ntz"))


@query("SELECT min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last, CAST(count(*) AS INT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders WHERE o_orderkey % 5 > 0", ctes=False)
def schedule_games(spark, d):
    """Official games of the regular season, as validation takes them."""
    return files.schedule_ids(_schedule_feed(spark, d)).select("first", "last", F.size("games").alias("n"), F.aggregate("games", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def _rosters(spark, d):
    """Roster feeds: the customers of a nation are a team's players, each listed twice."""
    c = table(spark, d, "customer").select(F.struct(F.struct(F.col("c_custkey").alias("id"), F.concat(F.lit("José "), F.col("c_name"), F.lit(" Jr.")).alias("fullName")).alias("person")).alias("p"), _team(F.col("c_nationkey"), 1).cast("long").alias("team_id"))
    text = F.to_json(F.struct("team_id", F.collect_list("p").alias("roster")))
    feed = c.unionByName(c).groupBy("team_id").agg(text.alias("t")).select(F.from_json("t", files.ROSTER).alias("f")).select("f.*")
    return files.rosters(feed)


@query(f"SELECT CAST({_IDS}[c_nationkey + 1] AS BIGINT) AS team_id, c_custkey AS mlb_id, 'José ' || c_name || ' Jr.' AS player_name FROM customer", ctes=False)
def roster_feed(spark, d):
    return _rosters(spark, d)


@query("SELECT s_suppkey AS mlb_id, s_name AS player_name FROM supplier", ctes=False)
def people_feed(spark, d):
    s = table(spark, d, "supplier").select(F.to_json(F.struct(F.array(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("fullName"))).alias("people"))).alias("t"))
    return files.people(s.select(F.from_json("t", files.PEOPLE).alias("f")).select("f.*"))


_PAGE_SIDES = "sides AS (SELECT n_nationkey AS n, unnest([false, true]) AS is_home FROM nation), players AS (SELECT *, unnest(range(1, 10)) AS k FROM sides)"


def _pages(spark, d):
    """A page for each nation: a card of two teams, nine batters each; every third home side is not confirmed yet, every fourth away pitcher not named."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"))

    def plate(name, hand, more=""):
        return F.concat(F.lit(f'<span class="player-nameplate"{more}'), F.lit(">"), F.lit('<a class="player-nameplate-name" href="/p">'), name, F.lit('</a><span class="player-nameplate-stats"><span class="small">('), hand, F.lit(")</span></span></span>"))

    def side(home: bool):
        lines = []
        for k in range(1, 10):
            data = f' data-position="P{k}" data-salary="{3000 + k}"'
            name = F.concat(F.lit(f"{'Home' if home else 'Away'} Batter {k} of "), F.col("n").cast("string"))
            lines.append(F.concat(F.lit(f'<li class="lineup-card-player"><span class="player-nameplate"{data}><span class="small">{k}</span><a class="player-nameplate-name" href="/p/{k}">'), name, F.lit(f'</a><span class="player-nameplate-stats"><span class="small">({"RL"[k % 2]})</span></span></span></li>')))
        body = F.when(F.lit(home) & (F.col("n") % 3 == 0), "lineup-card-body unconfirmed").otherwise("lineup-card-body")
        pitcher = F.when(F.lit(not home) & (F.col("n") % 4 == 0), "TBD").otherwise(F.concat(F.lit("Starter "), F.col("n").cast("string"), F.lit("h" if home else "a")))
        return F.concat(F.lit('<div class="lineup-card"><div class="lineup-card-pitcher">'), plate(pitcher, F.lit("L")), F.lit('</div><div class="'), body, F.lit('"><ul>'), *lines, F.lit("</ul></div></div>"))

    title = lambda i: F.concat(F.lit('<span class="team-nameplate-title" data-abbr="'), _team(i, 0), F.lit('"></span>'))
    page = F.concat(F.lit('<div class="module game-card"><div class="game-card-teams">'), title(F.col("n")), title(F.col("n") + 3), F.lit('</div><div class="game-card-lineups">'), side(False), side(True), F.lit("</div></div>"))
    return n.select(page.alias("html"), F.make_date(F.lit(2025), F.lit(6), (F.col("n") % 28 + 1).cast("int")).alias("game_date"), F.lit("2025-06-01 12:00:00").cast("timestamp").alias("fetched_at"))


_SIDE_TEAMS = f"{_CODES}[(n + CASE WHEN is_home THEN 3 ELSE 0 END) % 30 + 1]"


@query(
    f"""WITH {_PAGE_SIDES} SELECT make_date(2025, 6, n % 28 + 1) AS game_date, {_SIDE_TEAMS} AS team, {_CODES}[(n + CASE WHEN is_home THEN 0 ELSE 3 END) % 30 + 1] AS opponent, is_home, k AS batting_order,
    CASE WHEN is_home THEN 'Home' ELSE 'Away' END || ' Batter ' || k || ' of ' || n AS player_name, CASE WHEN k % 2 = 1 THEN 'L' ELSE 'R' END AS bats, '/p/' || k AS player_path, 'P' || k AS position, 3000 + k AS salary,
    CASE WHEN is_home AND n % 3 = 0 THEN 'projected' ELSE 'confirmed' END AS lineup_status FROM players""",
    ctes=False,
)
def lineup_pages(spark, d):
    return html.parse_slates(_pages(spark, d))[0].select("game_date", "team", "opponent", "is_home", "batting_order", "player_name", "bats", "player_path", "position", "salary", "lineup_status")


@query(
    f"""WITH {_PAGE_SIDES} SELECT make_date(2025, 6, n % 28 + 1) AS game_date, {_SIDE_TEAMS} AS team, is_home, CASE WHEN is_home OR n % 4 > 0 THEN 'Starter ' || n || CASE WHEN is_home THEN 'h' ELSE 'a' END END AS player_name,
    CASE WHEN is_home OR n % 4 > 0 THEN 'L' END AS throws FROM sides""",
    ctes=False,
)
def starter_pages(spark, d):
    return html.parse_slates(_pages(spark, d))[1].select("game_date", "team", "is_home", "player_name", "throws")


# --- registers and joins by name ------------------------------------------------------------------------------------------------


def _register(spark, d):
    """Customers as a register of text: every seventh id is no number, every fifth main name is missing, every eleventh name is blank; ids come twice."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    rows = c.select(
        F.when(F.col("c_custkey") % 7 == 0, "none").otherwise((F.col("c_custkey") % 1000).cast("string")).alias("MLBID"),
        F.when(F.col("c_custkey") % 5 == 0, None).when(F.col("c_custkey") % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("c_name"))).alias("MLBNAME"),
        F.col("c_name").alias("PLAYERNAME"),
        F.col("c_custkey").alias("_place"),
    )
    return identity.player_map(rows, "_place")


_REGISTER = """reg AS (SELECT c_custkey % 1000 AS mlb_id, arg_min(c_name, c_custkey) AS player_name FROM customer WHERE c_custkey % 7 > 0 AND (c_custkey % 5 = 0 OR c_custkey % 11 > 0) GROUP BY 1)"""


@query(f"WITH {_REGISTER} SELECT * FROM reg", ctes=False)
def player_register(spark, d):
    return _register(spark, d)


@query(f"WITH {_REGISTER} SELECT DISTINCT o_custkey AS mlb_id FROM orders WHERE o_custkey NOT IN (SELECT mlb_id FROM reg)", ctes=False)
def register_gaps(spark, d):
    """Ids to ask the people service for; more than 100 in a chunk would raise."""
    gaps = identity.missing_ids(table(spark, d, "orders"), _register(spark, d), "o_custkey")
    sizes = gaps.groupBy("chunk").count().withColumn("ok", F.when(F.col("count") <= 100, True).otherwise(F.raise_error("a chunk has more than 100 ids").cast("boolean")))
    return gaps.join(sizes.where("ok"), "chunk").select("mlb_id")


@query(f"WITH {_REGISTER} SELECT coalesce(s_suppkey, mlb_id) AS mlb_id, coalesce(s_name, player_name) AS player_name FROM reg FULL JOIN supplier ON s_suppkey = mlb_id", ctes=False)
def register_complete(spark, d):
    return identity.complete(_register(spark, d), people_feed(spark, d))


def _listed(spark, d):
    """Lineup rows of the rosters' players, spelt otherwise; every ninth is on no roster but has an alias."""
    c = table(spark, d, "customer")
    return c.select(_team(F.col("c_nationkey"), 1).cast("long").alias("team_id"), _team(F.col("c_nationkey"), 0).alias("team"), F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit("Nick "), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("jose "), F.upper("c_name"))).alias("player_name"))


@query(
    f"""SELECT CAST({_IDS}[c_nationkey + 1] AS BIGINT) AS team_id, {_CODES}[c_nationkey + 1] AS team, CASE WHEN c_custkey % 9 = 0 THEN 'Nick ' || c_custkey ELSE 'jose ' || upper(c_name) END AS player_name, c_custkey AS mlb_id FROM customer""",
    ctes=False,
)
def names_resolved(spark, d):
    aliases = table(spark, d, "customer").where("c_custkey % 9 = 0").select(_team(F.col("c_nationkey"), 1).cast("long").alias("team_id"), F.concat(F.lit("nick "), F.col("c_custkey").cast("string")).alias("player_name"), F.col("c_custkey").alias("mlb_id"))
    return slate.resolve(_listed(spark, d), _rosters(spark, d), aliases).select("team_id", "team", "player_name", "mlb_id")


@query(f"SELECT CAST({_IDS}[c_nationkey + 1] AS BIGINT) AS team_id, 'player' || c_custkey % 40 AS key, count(*) AS players FROM customer GROUP BY ALL HAVING count(*) > 1", ctes=False)
def names_ambiguous(spark, d):
    c = table(spark, d, "customer").select(_team(F.col("c_nationkey"), 1).cast("long").alias("team_id"), F.concat(F.lit("Pláyer "), (F.col("c_custkey") % 40).cast("string"), F.lit(", Sr.")).alias("player_name"), F.col("c_custkey").alias("mlb_id"))
    return slate.ambiguous_keys(c)


@query(
    f"""WITH s AS (SELECT CAST(o_orderdate AS DATE) AS game_date, o_custkey AS c, min(o_orderkey) AS game_pk FROM orders WHERE o_custkey % 31 < 30 AND (o_custkey + 7) % 31 < 30 GROUP BY ALL)
    SELECT game_date, game_pk, is_home, c AS listed, CASE WHEN is_home THEN CASE WHEN (game_pk + 1) % 3 > 0 THEN game_pk + 1 END ELSE CASE WHEN game_pk % 3 > 0 THEN game_pk END END AS probable_pitcher_id
    FROM (SELECT *, unnest([false, true]) AS is_home FROM s) QUALIFY count(*) OVER (PARTITION BY game_date, c % 31, is_home) = 1""",
    ctes=False,
)
def slate_schedule(spark, d):
    """Starters of the days on which two teams meet once, with official ids and their side's probable pitcher."""
    plan = identity.keep(schedule_feed(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("game_pk"), F.col("o_custkey").alias("listed")), "game_pk"), ["game_date", "listed"], "game_pk")
    once = plan.groupBy("game_date", "away_team").count().where("count = 1").drop("count")
    plan = plan.join(once, ["game_date", "away_team"])
    sides = plan.select("game_date", "away_team", "home_team", "away_team_id", "home_team_id", "listed", F.explode(F.array(F.lit(False), F.lit(True))).alias("is_home"))
    out = slate.attach_schedule(slate.Slate(sides, sides), plan.drop("listed"))
    return out.starters.select("game_date", "game_pk", "is_home", "listed", "probable_pitcher_id")


# --- level 3 --------------------------------------------------------------------------------------------------------------------

_PARK = "f AS (SELECT CAST(season AS INT) AS season, home_team, 0.9::DOUBLE + (season % 5)::DOUBLE / 10 AS park_k_factor FROM (SELECT DISTINCT season, home_team FROM pitch))"


def _factors(spark, d):
    p = adapter.pitches(spark, d).select(F.col("game_year").alias("season"), "home_team").distinct()
    return p.withColumn("park_k_factor", 0.9 + (F.col("season") % 5) / 10)


@query(
    f"""WITH {_BATTER}, {_PARK}, b AS (SELECT *, sum(K) OVER s AS ks, sum(PA) OVER s AS ns, sum(Whiffs) OVER s AS wh, sum(Swings) OVER s AS sw, sum(Pitches) OVER s AS np, sum(Chases) OVER s AS ch, sum(OutZone) OVER s AS oz FROM batter_game WINDOW s AS {_SEASON.format(e="batter")}),
    st AS (SELECT game_pk, pitcher, arg_min(half, (at_bat_number, pitch_number)) AS half, min(home_team) AS home_team, min(away_team) AS away_team, CAST(year(min(game_date)) AS INT) AS season FROM flag SEMI JOIN starter USING (game_pk, pitcher) GROUP BY ALL),
    o AS (SELECT *, CASE WHEN half = 'Top' THEN away_team ELSE home_team END AS opp FROM st),
    j AS (SELECT o.game_pk, o.pitcher, o.season, o.home_team, b.batter, CASE WHEN ns > 0 THEN ks / ns END AS k, CASE WHEN sw > 0 THEN wh / sw END AS w, CASE WHEN np > 0 THEN wh / np END AS s, CASE WHEN oz > 0 THEN ch / oz END AS c
      FROM o LEFT JOIN b ON o.game_pk = b.game_pk AND o.opp = b.bat_team AND b.is_initial_lineup)
    SELECT game_pk, pitcher, season, j.home_team, count(batter) AS opp_lineup_size, round(avg(k), 6) AS opp_lineup_k, round(avg(w), 6) AS opp_lineup_whiff, round(avg(s), 6) AS opp_lineup_swstr, round(avg(c), 6) AS opp_lineup_chase, round(any_value(park_k_factor), 6) AS park_k_factor
    FROM j JOIN f USING (season, home_team) GROUP BY game_pk, pitcher, season, j.home_team"""
)
def training_joins(spark, d):
    """Starts with the lineups they faced, one to one, and their venue's factor."""
    batters = rolling.batter_features(games.batter_games(adapter.pitches(spark, d)), shrink_pa=None, check=False)
    starts = _starts(spark, d).withColumn("season", F.year("game_date"))
    lineup = training.opposing_lineup(starts, batters)
    checks.one_to_one(starts, lineup, ("game_pk", "pitcher"))
    out = training.with_park(starts.join(lineup, ["game_pk", "pitcher"], "left"), _factors(spark, d))
    return rounded(out.select("game_pk", "pitcher", "season", "home_team", "opp_lineup_size", "opp_lineup_k", "opp_lineup_whiff", "opp_lineup_swstr", "opp_lineup_chase", "park_k_factor"))


_MODEL_COLUMNS = ("k_rate_P5", "k_rate_P10", "k_rate_P20", "k_rate_std", "whiff_rate_P5", "whiff_rate_P10", "whiff_rate_P20", "whiff_rate_std", "ff_velo_P3", "is_home", "park_k_factor")


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_MODEL_COLUMNS)) + ") t(place, feature)", ctes=False)
def model_features(spark, d):
    """What a model may see of a rolled frame with labels, ids and context."""
    out = rolling.pitcher_features(_counted(spark, d), {"k_rate": ("K", "PA"), "whiff_rate": ("Whiffs", "Swings")}, ("ff_velo",), mean_windows=(3,), fip=False, check=False)
    out = out.withColumns({"k_rate": F.col("K") / F.greatest("PA", F.lit(1)), "is_home": F.lit(True), "park_k_factor": F.lit(1.0), "home_team": F.lit("T1"), "is_initial_lineup": F.lit(True)})
    kept = levels.select_features(out, ("game_pk", "pitcher", "game_date", "season", "K", "PA", "Outs", "k_rate", "is_home", "park_k_factor", "is_initial_lineup", "home_team"))
    names = sorted(checks.model_features(kept), key=lambda n: _MODEL_COLUMNS.index(n) if n in _MODEL_COLUMNS else -1)
    return spark.createDataFrame(list(enumerate(names)), "place int, feature string")


_SET_COLUMNS = ("k_rate_P5", *(f"{s}_rate_{w}" for s in ("whiff", "swstr", "ball", "gb") for w in ("P5", "P10", "P20", "std")), "opp_lineup_whiff", "opp_lineup_swstr", "park_k_factor")


def _sets_sql() -> str:
    """The configurations' columns by patterns over the list of columns."""
    parts = {
        "core": "false", "pitcher_whiff": "c LIKE 'whiff%'", "pitcher_swstr": "c LIKE 'swstr%'", "pitcher_both": "c LIKE 'whiff%' OR c LIKE 'swstr%'", "batter_whiff": "c = 'opp_lineup_whiff'", "batter_swstr": "c = 'opp_lineup_swstr'", "batter_both": "c LIKE 'opp%'",
        "pitcher_ball": "c LIKE 'ball%'", "pitcher_gb": "c LIKE 'gb%'", "preferred_raw": "c LIKE 'swstr%' OR c = 'opp_lineup_whiff' OR c LIKE 'ball%' OR c LIKE 'gb%'", "compact_candidate": "c LIKE '%rate_P20' AND c NOT LIKE 'gb%' OR c LIKE 'opp%'", "all_candidates": "true",
        "whiff_P5": "c = 'whiff_rate_P5'", "whiff_P10": "c = 'whiff_rate_P10'", "whiff_P20": "c = 'whiff_rate_P20'", "whiff_std": "c = 'whiff_rate_std'", "whiff_P5_P10": "c IN ('whiff_rate_P5', 'whiff_rate_P10')",
        "swstr_P5": "c = 'swstr_rate_P5'", "swstr_P10": "c = 'swstr_rate_P10'", "swstr_P20": "c = 'swstr_rate_P20'", "swstr_std": "c = 'swstr_rate_std'", "swstr_P5_P10": "c IN ('swstr_rate_P5', 'swstr_rate_P10')",
        "ball_P5": "c = 'ball_rate_P5'", "ball_P20": "c = 'ball_rate_P20'", "ball_std": "c = 'ball_rate_std'", "whiff_swstr_P20": "c IN ('whiff_rate_P20', 'swstr_rate_P20')",
        "discipline_short": "c IN ('whiff_rate_P5', 'swstr_rate_P5', 'ball_rate_P5')", "discipline_short_long": "c IN ('whiff_rate_P5', 'whiff_rate_P10', 'swstr_rate_P5', 'swstr_rate_P10', 'ball_rate_P5', 'ball_rate_std')",
    }
    columns = "[" + ", ".join(f"'{c}'" for c in _SET_COLUMNS) + "]"
    return " UNION ALL ".join(f"SELECT '{name}' AS configuration, c AS feature FROM (SELECT unnest({columns}) AS c) WHERE c IN ('k_rate_P5', 'park_k_factor') OR {rule}" for name, rule in parts.items())


@query(_sets_sql(), ctes=False)
def ablation_configurations(spark, d):
    found = {**modelling.named_configurations(_SET_COLUMNS, vocab.FEATURE_SETS), **modelling.named_configurations(_SET_COLUMNS, vocab.WINDOW_SETS)}
    return spark.createDataFrame([(name, c) for name, columns in found.items() for c in columns], "configuration string, feature string")


@query("SELECT sha256('" + "' || chr(10) || '".join(_SET_COLUMNS) + "') AS digest", ctes=False)
def feature_digest(spark, d):
    return spark.createDataFrame([(modelling.feature_digest(_SET_COLUMNS),)], "digest string")


@query(
    """WITH s AS (SELECT 'f' || (o_orderkey % 3) AS fold, 'm' || (o_custkey % 2) AS model, CASE o_orderkey % 4 WHEN 0 THEN 'core' ELSE 'c' || (o_orderkey % 4) END AS configuration, o_totalprice AS p FROM orders),
    g AS (SELECT fold, model, configuration, avg(p) AS mae, max(p) AS rmse, min(p) AS r2 FROM s GROUP BY ALL), w AS (SELECT g.*, c.mae - g.mae AS gain FROM g LEFT JOIN (SELECT fold, model, mae FROM g WHERE configuration = 'core') c USING (fold, model))
    SELECT model, configuration, count(DISTINCT fold) AS folds, round(avg(mae), 4) AS mean_mae, round(avg(rmse), 4) AS mean_rmse, round(avg(r2), 4) AS mean_r2, round(avg(gain), 4) AS mean_mae_gain, count(*) FILTER (gain > 0) AS folds_with_gain FROM w GROUP BY ALL""",
    ctes=False,
)
def ablation_gains(spark, d):
    """Scores of folds joined to their core configuration and summed up."""
    o = table(spark, d, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey") % 3).alias("fold"), F.concat(F.lit("m"), F.col("o_custkey") % 2).alias("model"), F.when(F.col("o_orderkey") % 4 == 0, "core").otherwise(F.concat(F.lit("c"), F.col("o_orderkey") % 4)).alias("configuration"), "o_totalprice")
    scores = o.groupBy("fold", "model", "configuration").agg(F.avg("o_totalprice").alias("mae"), F.max("o_totalprice").alias("rmse"), F.min("o_totalprice").alias("r2"))
    return rounded(modelling.ablation_summary(modelling.with_gain(scores)), 4)


@query("SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS day FROM events", ctes=False)
def local_dates(spark, d):
    """Dates of events in New York; the tables' times are UTC."""
    return table(spark, d, "events").select("event_id", X.local_date(F.col("ts").cast("timestamp")).alias("day"))


@query(
    f"""WITH {_COUNTED}, s AS (SELECT season, CASE WHEN Outs >= 1 THEN (13 * HR + 3 * (BB + HBP) - 2 * K) / (Outs / 3) END AS core FROM counted)
    SELECT season, count(core) AS n, round(avg(core), 6) AS core, round(avg(core) + 3.1::DOUBLE + (season - 1995)::DOUBLE / 100, 6) AS whole, round(3.1::DOUBLE + (season - 1995)::DOUBLE / 100, 6) AS least, round(3.1::DOUBLE + (season - 1995)::DOUBLE / 100, 6) AS most FROM s GROUP BY season"""
)
def fip_constant_audit(spark, d):
    """Estimators with their constants joined to those without: the constant is all that tells them apart."""
    starts = _counted(spark, d).withColumn("lg_hr_fb_prior", F.lit(0.1))
    whole = priors.fip(starts, _CONSTANTS, least_outs=1).select("game_pk", "pitcher", "season", "FIP")
    core = priors.fip(starts, include_constant=False, least_outs=1).select("game_pk", "pitcher", F.col("FIP").alias("core"))
    both = whole.join(core, ["game_pk", "pitcher"]).withColumn("diff", F.col("FIP") - F.col("core"))
    return rounded(both.groupBy("season").agg(F.count("core").alias("n"), F.avg("core").alias("core"), F.avg("FIP").alias("whole"), F.min("diff").alias("least"), F.max("diff").alias("most")))


@query()
def reliability_of_all(spark, d):
    """The reliability table of all statistics that the study names. Without SQL: reliability_table is the same operator on three of them."""
    from formline.plans import studies

    return rounded(studies.reliability_table(_starts(spark, d)))


# --- audits ---------------------------------------------------------------------------------------------------------------------


@query(f"WITH {_COUNTED}, t AS (SELECT pitcher, sum(PA) AS n FROM counted GROUP BY 1) SELECT CAST(target AS INT) AS target, count(*) FILTER (n >= target) AS ever, count(*) FILTER (n >= 2 * target) AS twice FROM t, (SELECT unnest(range(25, 1001, 25)) AS target) GROUP BY target")
def qualifiers(spark, d):
    """Pitchers who reach each number of plate appearances, once and twice over."""
    return reliability.qualifiers(_counted(spark, d), "PA", range(25, 1001, 25), "pitcher")


_USED = " + ".join(f"count(*) FILTER (canon = '{t}' AND stand = 'R')" for t in vocab.PITCH_TYPES)


@query(f"SELECT game_pk, pitcher, round(CASE WHEN count(*) FILTER (stand = 'R') > 0 THEN ({_USED}) / count(*) FILTER (stand = 'R') ELSE 0 END, 6) AS usage_vR FROM flag SEMI JOIN starter USING (game_pk, pitcher) GROUP BY game_pk, pitcher")
def usage_totals(spark, d):
    starts = _starts(spark, d)
    checks.usage_totals(starts)
    checks.no_helpers(starts.columns)
    return rounded(starts.select("game_pk", "pitcher", X.sum_horizontal([f"{t}_usage_vR" for t in vocab.PITCH_TYPES]).alias("usage_vR")))


@query(
    f"""WITH {_BATTER}, c AS (SELECT game_pk, pitcher, canon, count(*) AS n, count(*) FILTER (type IN ('S', 'B', 'X')) AS m FROM flag WHERE canon IS NOT NULL GROUP BY ALL),
    l AS (SELECT game_pk, bat_team, count(*) AS n FROM batter_game WHERE is_initial_lineup GROUP BY ALL)
    SELECT unnest(['duplicate keys', 'unique keys', 'exclusive outcomes', 'lineups of nine', 'seasons', 'seasons with another', 'covered keys', 'uncovered keys', 'park without teams', 'season table', 'season table of another year', 'unnamed ids', 'forbidden features', 'few dates', 'overlapping folds', 'mean of nothing']) AS name,
      unnest([(SELECT count(*) > count(DISTINCT o_custkey) FROM orders), (SELECT count(*) > count(DISTINCT o_orderkey) FROM orders), (SELECT bool_or(n <> m) FROM c), (SELECT bool_or(n <> 9) FROM l),
        false, true, (SELECT count(*) > 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)), (SELECT count(*) > 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')),
        true, false, true, (SELECT count(*) > 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')), true, true, true, true]) AS raised"""
)
def checks_report(spark, d):
    """Which checks raise on the driver's tables and on what is wrong with them."""
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    raw = adapter.pitches(spark, d)
    year = raw.agg(F.min("game_year")).first()[0]
    season = raw.where(F.col("game_year") == year)
    official = [r[0] for r in season.select("game_pk").distinct().collect()]
    some = customers.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    lineup = games.batter_games(raw).where("is_initial_lineup").groupBy("game_pk", "bat_team").agg(F.count("*").alias("opp_lineup_size"))
    seasons = _counted(spark, d)
    years = [r[0] for r in seasons.select("season").distinct().collect()]
    tries = {
        "duplicate keys": lambda: checks.unique_keys(orders, ["o_custkey"]),
        "unique keys": lambda: checks.unique_keys(orders, ["o_orderkey"]),
        "exclusive outcomes": lambda: checks.exclusive_outcomes(games.pitch_type_games(raw, 0, check=False)),
        "lineups of nine": lambda: checks.lineups(lineup),
        "seasons": lambda: checks.exact_seasons(seasons, years),
        "seasons with another": lambda: checks.exact_seasons(seasons, [*years, 1900]),
        "covered keys": lambda: checks.covered(orders, customers.select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"]),
        "uncovered keys": lambda: checks.covered(orders, some, ["o_custkey"]),
        "park without teams": lambda: checks.park_factors(_starts(spark, d).withColumn("season", F.year("game_date")), _factors(spark, d).where("home_team <> 'T1'")),
        "season table": lambda: checks.season_table(season, year, official),
        "season table of another year": lambda: checks.season_table(season, year + 1, official),
        "unnamed ids": lambda: identity.require_names(orders.join(some.withColumn("name", F.lit("x")), "o_custkey", "left"), "o_custkey", "name"),
        "forbidden features": lambda: checks.pregame_features(["k_rate_P5", "K"]),
        "few dates": lambda: modelling.chronological_split(seasons.where("false")),
        "overlapping folds": lambda: modelling.research_folds(seasons, [("x", "2000-01-01", "1999-01-01", "2001-01-01")]),
        "mean of nothing": lambda: files.load_seasons(spark, d, []),
    }
    rows = []
    for name, call in tries.items():
        try:
            call()
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "name string, raised boolean")


@query()
def study_summary(spark, d):
    """The pitchers' stabilisation study: first crossings of the median and of both bounds. Resamples are hashed, so tests hold it."""
    from formline.plans import studies
    from formline.plans.registry import _study_df

    return reliability.analyze(reliability.curves(_study_df(spark, d), studies.specs(vocab.PITCHER_SPECS), "pitcher"))
