import hashlib
import json
from datetime import date, datetime

import pytest
from helpers import pitch_frame
from pyspark.sql import functions as F

from formline import vocab
from formline.functions import expr as X
from formline.operators import checks, identity, slate, training
from formline.plans import levels, slates, studies, trainer
from formline.sources import files, html
from formline.sources.files import Paths


def test_names(spark):
    df = spark.createDataFrame([("Doe, Jo",), (" Jo Doe ",), ("Solo,",), (None,), ("D’Arcy-Muñoz Jr.",), ("Zoë  Ibáñez III",), ("Jürgen",)], "n string")
    assert [r[0] for r in df.select(X.first_last("n")).collect()][:4] == ["Jo Doe", "Jo Doe", "Solo,", None]
    assert [r[0] for r in df.select(X.name_key("n")).collect()][4:] == ["darcymunoz", "zoeibanez", "jurgen"]
    codes = spark.createDataFrame([(" sdp",), ("ATL",), (None,)], "c string").select(X.team_code("c")).collect()
    assert [r[0] for r in codes] == ["SD", "ATL", None]
    with pytest.raises(Exception, match="unknown team code"):
        spark.createDataFrame([("XXX",)], "c string").select(X.team_code("c")).collect()


def test_register_and_names(spark, tmp_path):
    (tmp_path / "r.csv").write_text("MLBID,MLBNAME,PLAYERNAME\n5,Ann A,x\n5,Late,x\nbad,No,No\n6,, Bo B \n7,,\n")
    players = identity.player_map(files.register(spark, str(tmp_path / "r.csv")), "_place")
    assert [tuple(r) for r in players.collect()] == [(5, "Ann A"), (6, "Bo B")]
    df = spark.createDataFrame([(5, "A, Ann Marie"), (9, "Z, Zed")], "pitcher int, player_name string")
    got = {r["pitcher"]: r["pitcher_name"] for r in identity.pitcher_names(df, players).collect()}
    assert got == {5: "Ann A", 9: "Zed Z"}
    assert [tuple(r) for r in identity.missing_ids(df, players, "pitcher").collect()] == [(9, 0)]
    more = identity.complete(players, spark.createDataFrame([(9, "Zed Z"), (5, "Ann B")], "mlb_id long, player_name string"))
    assert [tuple(r) for r in more.collect()] == [(5, "Ann B"), (6, "Bo B"), (9, "Zed Z")]
    with pytest.raises(ValueError):
        identity.require_names(identity.attach_name(df, players, "pitcher", "x"), "pitcher", "x")
    with pytest.raises(ValueError):
        identity.attach_name(df, players.unionByName(players), "pitcher", "x")


def lineup_frames(spark, rate=lambda i: 0.1 * i):
    s = spark.createDataFrame([(1, 10, "AWY", "R"), (2, 10, "AWY", "L")], "game_pk long, pitcher long, opp_team string, p_throws string")
    rows = [(g, i, "AWY", i <= 9, rate(i), 0.2, 0.3, None, 0.1, 0.3) for g in (1, 2) for i in range(1, 11)]
    b = spark.createDataFrame(rows, "game_pk long, batter long, bat_team string, is_initial_lineup boolean, k_rate_std double, k_rate_std_vL double, k_rate_std_vR double, whiff_rate_std double, swstr_rate_std double, chase_rate_std double")
    return s, b


def test_lineups(spark):
    s, b = lineup_frames(spark)
    got = {r["game_pk"]: r for r in training.opposing_lineup(s, b).collect()}
    assert got[1]["opp_lineup_size"] == 9 and got[1]["opp_lineup_k"] == pytest.approx(0.5)
    assert got[1]["opp_lineup_k_vs_hand"] == pytest.approx(0.3) and got[2]["opp_lineup_k_vs_hand"] == pytest.approx(0.2)
    assert got[1]["opp_lineup_whiff"] is None
    for bad in (b.where("batter > 3"), b.where("game_pk = 1"), b.where("false")):
        with pytest.raises(ValueError):
            checks.lineups(training.opposing_lineup(s, bad))
    with pytest.raises(ValueError):
        checks.lineups(training.opposing_lineup(s, b).withColumn("opp_lineup_size", F.lit(None).cast("long")))


def test_parks_cover(spark):
    frame = spark.createDataFrame([(2024, "AAA"), (2024, "BBB")], "season int, home_team string")
    park = lambda *rows: spark.createDataFrame(rows, "season int, home_team string, park_k_factor double")
    assert training.with_park(frame, park((2024, "AAA", 1.1), (2024, "BBB", 0.9))).count() == 2
    for bad in ([(2024, "AAA", 1.0)], [(2023, "AAA", 1.0), (2023, "BBB", 1.0)], [(2024, "AAA", 1.0), (2024, "AAA", 1.0), (2024, "BBB", 1.0)], [(2024, "AAA", None), (2024, "BBB", 1.0)]):
        with pytest.raises(ValueError):
            training.with_park(frame, park(*bad))


def test_feature_gate(spark):
    good = spark.createDataFrame([(0.1, True, 3, "x")], "k_rate_P5 double, is_home boolean, K long, p_throws string")
    assert checks.model_features(good) == ("k_rate_P5", "is_home")
    with pytest.raises(ValueError):
        checks.model_features(good.selectExpr("*", "1 as Whiffs"))
    for bad in (["PA"], ["k_rate"], ["k_rate_P5", "k_rate_P5"]):
        with pytest.raises(ValueError):
            checks.pregame_features(bad)
    assert len(vocab.RATES) * 4 + len(vocab.MEANS) * 3 + 6 + len(vocab.CONTEXT_FEATURES) == 256


GUEST, HOST = ("WSN", "WSH", 120), ("COL", "COL", 115)  # code on the page, canonical code, id


def plate(tag_attributes, inner, name, path, hand):
    link = f'<a class="player-nameplate-name" href="{path}">{name}</a>'
    return f'<span class="player-nameplate"{tag_attributes}>{inner}<div>{link}<span class="player-nameplate-stats"><span class="small">({hand})</span></span></div></span>'


def lineup_card(who, confirmed, pitcher):
    lines = [f'<li class="lineup-card-player">{plate(f""" data-position="2B" data-salary="{4100 + 10 * k}" """, f"""<span class="small">{k}</span>""", f"{who} Hitter No{k}", f"/hitter/{k}", "S")}</li>' for k in range(1, 10)]
    status = "lineup-card-body" if confirmed else "lineup-card-body unconfirmed"
    return f'<div class="lineup-card"><div class="lineup-card-pitcher">{plate("", "", pitcher, "/arm", "R")}</div><div class="{status}"><ul>{"".join(lines)}</ul></div></div>'


def page(guest=GUEST[0], guest_arm="Guest Ärm", confirmed=(False, True)):
    titles = "".join(f'<span class="team-nameplate-title" data-abbr="{t}"></span>' for t in (guest, HOST[0]))
    cards = lineup_card("Guest", confirmed[0], guest_arm) + lineup_card("Host", confirmed[1], "Host Arm")
    return f'<html><br><div class="module game-card"><div class="game-card-teams">{titles}</div><div class="game-card-lineups">{cards}</div></div></html>'


def pages(spark, *texts):
    return spark.createDataFrame([(t, date(2023, 8, 9), datetime(2023, 8, 9, 7)) for t in texts], "html string, game_date date, fetched_at timestamp")


def schedule_file(tmp_path, host_probable=6002):
    team = lambda i, probable=None: {"team": {"id": i}, **({"probablePitcher": {"id": probable}} if probable else {})}
    game = lambda pk, kind, guest, host: {"gamePk": pk, "gameType": kind, "gameDate": "2023-08-09T17:35:00Z", "status": {"detailedState": "Pre-Game"}, "teams": {"away": guest, "home": host}}
    games = [game(5511, "R", team(GUEST[2], 6001), team(HOST[2], host_probable)), game(5512, "E", team(9), team(HOST[2]))]
    (tmp_path / "s.json").write_text(json.dumps({"dates": [{"date": "2023-08-09", "games": games}]}))
    return str(tmp_path / "s.json")


def roster(spark, extra=()):
    rows = [(team, first + k, f"{who} Hitter No{k}") for team, first, who in ((GUEST[2], 5100, "Guest"), (HOST[2], 5200, "Host")) for k in range(1, 10)]
    return spark.createDataFrame([*rows, (GUEST[2], 6001, "Guest Arm"), *extra], "team_id long, mlb_id long, player_name string")


HOST_ARM = (HOST[2], 6002, "Host Arm")


def test_parsing(spark):
    lineups, starters = html.parse_slates(pages(spark, page(), page(guest_arm="TBD"), "<p>none</p>", None))
    assert lineups.count() == 36 and starters.count() == 4
    first = lineups.where("team = 'WSH' and batting_order = 1").first()
    assert (first["salary"], first["bats"], first["lineup_status"], first["player_path"], first["is_home"], first["team_id"]) == (4110, "S", "projected", "/hitter/1", False, GUEST[2])
    assert starters.where("player_name is null").count() == 1 and starters.where("throws = 'R'").count() == 3
    with pytest.raises(Exception, match="unknown team code"):
        html.parse_slates(pages(spark, page(guest="QQQ")))[0].collect()


def test_slate(spark, tmp_path):
    feed = files.read_schedule(spark, schedule_file(tmp_path))
    plan = files.schedule(feed)
    assert [r["game_pk"] for r in plan.collect()] == [5511]
    assert files.schedule_ids(feed).first()["games"] == [5511]
    wider = roster(spark, [HOST_ARM])
    built = slate.build(pages(spark, page()), plan, roster(spark), wider)
    ids = {r["team_id"]: (r["mlb_id"], r["probable_pitcher_id"], r["game_pk"]) for r in built.starters.collect()}
    assert ids == {GUEST[2]: (6001, 6001, 5511), HOST[2]: (6002, 6002, 5511)}
    assert built.lineups.where("mlb_id = 5201").first()["player_name"] == "Host Hitter No1"
    paths = slate.write(built, str(tmp_path / "out"))
    assert spark.read.parquet(paths[0]).count() == 18 and paths[0].endswith("daily_lineups_2023-08-09.parquet")
    aliased = slate.build(pages(spark, page()), plan, roster(spark), aliases=spark.createDataFrame([(HOST[2], "Host Arm", 6002)], "team_id long, player_name string, mlb_id long"))
    assert aliased.starters.where("mlb_id = 6002").count() == 1
    with pytest.raises(ValueError):
        slate.build(pages(spark, page()), plan, roster(spark))  # the host's starter is on no roster
    with pytest.raises(ValueError):
        slate.build(pages(spark, page()), plan, wider, require_confirmed=True)
    sure = slate.build(pages(spark, page(confirmed=(True, True))), plan, wider, require_confirmed=True)
    with pytest.raises(ValueError, match="starters are not confirmed"):
        checks.slate(sure.lineups, sure.starters.withColumn("lineup_status", F.lit("projected")), True)
    with pytest.raises(ValueError):
        slate.build(pages(spark, page()), files.schedule(files.read_schedule(spark, schedule_file(tmp_path, 6003))), wider)
    with pytest.raises(ValueError):
        slate.resolve(built.lineups.drop("mlb_id"), wider.unionByName(spark.createDataFrame([(GUEST[2], 1, "GUEST hitter-no1")], "team_id long, mlb_id long, player_name string")))
    with pytest.raises(ValueError):
        slate.build(pages(spark, page(guest="MIA")), plan, wider)


def test_slate_of_files(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "a.html").write_text(page())
    players = {}
    for team, mlb_id, name in (tuple(r) for r in roster(spark, [HOST_ARM]).collect()):
        players.setdefault(team, []).append({"person": {"id": mlb_id, "fullName": name}})
    host = players[HOST[2]].pop()  # aliased instead
    (tmp_path / "active").mkdir()
    for team, some in players.items():
        (tmp_path / "active" / f"{team}.json").write_text(json.dumps({"team_id": team, "roster": some}))
    (tmp_path / "aliases.csv").write_text(f"team_id,player_name,mlb_id\n{HOST[2]},Host Arm,{host['person']['id']}\n")
    paths = slates.run(spark, "2023-08-09", str(tmp_path / "pages"), schedule_file(tmp_path), str(tmp_path / "active"), str(tmp_path / "out"), aliases=str(tmp_path / "aliases.csv"))
    assert [spark.read.parquet(p).count() for p in paths] == [18, 2]
    (tmp_path / "people.json").write_text(json.dumps({"people": [{"id": 5, "fullName": "Some One"}]}))
    assert [tuple(r) for r in files.read_people(spark, str(tmp_path / "people.json")).collect()] == [(5, "Some One")]


def test_levels_end_to_end(spark, tmp_path):
    paths = Paths(str(tmp_path / "data"), str(tmp_path / "out"))
    rows = []
    for g in range(1, 5):
        day = date(2024, 4, g)
        for half, pitcher in (("Top", 1), ("Bot", 2)):
            for i in range(1, 10):
                rows.append({"game_pk": g, "game_date": day, "inning_topbot": half, "pitcher": pitcher, "batter": 100 * pitcher + i, "at_bat_number": i + (50 if half == "Bot" else 0), "events": "strikeout" if (i + g) % 3 == 0 else "field_out", "type": "S" if (i + g) % 3 == 0 else "X", "description": "swinging_strike" if (i + g) % 3 == 0 else "hit_into_play", "woba_denom": 1, "woba_value": 0.1})
    files.write(pitch_frame(spark, *rows), files.season_path(paths.data, 2024))
    with pytest.raises(ValueError, match="not official"):
        levels.run_all(spark, paths, [2024], official={2024: [1, 2, 3]})
    levels.run_all(spark, paths, [2024], official={2024: [1, 2, 3, 4]})
    out = spark.read.parquet(paths.artifact("pitcher_training"))
    assert out.count() == 8 and out.where("k_rate_std is null").count() == 2
    last = out.where("game_pk = 4 and pitcher = 1").first()
    assert last["k_rate_std"] == pytest.approx(1 / 3) and last["opp_lineup_size"] == 9 and last["park_k_factor"] == 1.0
    assert "Whiffs" not in out.columns and checks.model_features(out)
    batters = spark.read.parquet(paths.artifact("batter_training"))
    assert batters.count() == 72 and "is_initial_lineup" in batters.columns
    assert {"k_rate_std", "is_home", "park_k_factor"} <= set(checks.model_features(batters)) and "is_initial_lineup" not in checks.model_features(batters)
    report = trainer.run(spark, paths, "mean")
    assert sum(report["rows"].values()) == 8 and report["cutoffs"]["train_end"] < report["cutoffs"]["validation_start"] <= report["cutoffs"]["validation_end"] < report["cutoffs"]["test_start"]
    stored = json.loads((tmp_path / "out" / "mean_k_rate.json").read_text())
    assert stored["evaluation"] == report and stored["ordered_feature_sha256"] == hashlib.sha256("\n".join(stored["features"]).encode()).hexdigest()
    for model in ("none", "ridge"):  # there is no such model, and here the target does not vary
        with pytest.raises(ValueError):
            trainer.run(spark, paths, model)
    found = studies.run(spark, paths, "pitcher", [2024], n_boot=5)
    assert found.count() == 2 * len(vocab.PITCHER_SPECS) or found.count() == 0
    with pytest.raises(ValueError):
        studies.run(spark, paths, "pitcher", [2023, 2024])
    table = studies.run_reliability(spark, paths, [2024])
    assert {"K", "Whiffs", "xFIP", "ff_velo"} <= {r["stat"] for r in table.collect()} or table.count() == 0  # no player has twenty starts here
    assert (tmp_path / "out" / "reliability" / "by_pitches" / "_SUCCESS").exists()
    some = files.load_seasons(spark, paths.data, [2024], ["pitcher", "not_there"])
    assert some.columns == ["pitcher", "game_pk", "game_date", "game_year"]
