import math
from datetime import date

import pytest
from helpers import pitch_frame

from formline.operators import checks, games, pitches


def test_plate_appearances(spark):
    p = pitch_frame(
        spark,
        {"at_bat_number": 1, "pitch_number": 1}, {"at_bat_number": 1, "pitch_number": 2, "events": "strikeout"}, {"at_bat_number": 2, "events": "caught_stealing_2b"},
        {"at_bat_number": 3, "events": "intent_walk"}, {"at_bat_number": 4, "pitch_number": 1, "events": "wild_pitch"}, {"at_bat_number": 4, "pitch_number": 3, "events": "catcher_interf"},
    )
    got = {r["at_bat_number"]: (r["pitch_number"], r["is_k"]) for r in pitches.plate_appearances(p).collect()}
    assert got == {1: (2, True), 3: (1, False), 4: (3, False)}


def test_flags_with_nulls(spark):
    p = pitch_frame(spark, {"description": "foul_tip", "zone": 12}, {"description": "foul", "zone": 10}, {"description": None, "zone": None, "at_bat_number": 2})
    got = pitches.discipline_flags(pitches.event_flags(p)).collect()
    assert (got[0]["is_whiff"], got[0]["is_swing"], got[0]["is_contact"], got[0]["is_chase"]) == (True, True, False, True)
    assert (got[1]["is_whiff"], got[1]["is_swing"], got[1]["is_contact"], got[1]["in_zone"], got[1]["out_zone"]) == (False, True, True, False, False)
    assert (got[2]["is_pa"], got[2]["is_swing"], got[2]["in_zone"]) == (False, False, False)


def test_approach_angle(spark):
    p = pitch_frame(spark, {}, {"ay": 0.0}, {"vy0": -1.0})
    a, b, c = (r[0] for r in p.select(pitches.approach_angle()).collect())
    vf = -math.sqrt(138.0**2 - 60 * (50 - 17 / 12))
    assert a == pytest.approx(-math.degrees(math.atan((-5 - 15 * (vf + 138) / 30) / vf)))
    assert a < 0 and b is None and c is None


def test_starters_and_counts(spark):
    rows = [
        {"pitcher": 10, "events": "strikeout", "description": "swinging_strike", "woba_denom": 1, "woba_value": 0.0},
        {"pitcher": 10, "at_bat_number": 2, "type": "X", "events": "single", "description": "hit_into_play", "bb_type": "ground_ball", "woba_value": 1.0, "woba_denom": 1, "estimated_woba_using_speedangle": 0.9, "estimated_ba_using_speedangle": 0.3, "stand": "L", "post_bat_score": 2},
        {"pitcher": 10, "at_bat_number": 3, "type": "X", "events": "grounded_into_double_play", "description": "hit_into_play", "woba_denom": 1, "woba_value": 0.0, "pitch_type": "SL", "release_pos_x": 1.0},
        {"pitcher": 10, "at_bat_number": 4, "type": "B", "description": "ball", "events": "caught_stealing_2b", "zone": 13, "pitch_type": "KN"},
        {"pitcher": 11, "at_bat_number": 5, "events": "walk", "type": "B", "description": "ball"},
        {"pitcher": 12, "inning_topbot": "Bot", "at_bat_number": 6, "events": "home_run", "type": "X", "description": "hit_into_play", "bb_type": "fly_ball"},
    ]
    df = pitch_frame(spark, *rows)
    got = {r["pitcher"]: r for r in games.pitcher_games(df, 0).collect()}
    assert set(got) == {10, 12}  # not the reliever
    r = got[10]
    assert (r["Pitches"], r["PA"], r["K"], r["Strikes"], r["Balls"], r["BIP"], r["Outs"], r["Runs"], r["GB"]) == (4, 3, 1, 1, 1, 2, 4, 2, 1)
    assert r["wOBA"] == pytest.approx(1 / 3) and r["xwOBA"] == pytest.approx(0.3) and r["xBA"] == pytest.approx(0.3)
    assert r["ff_usage_vR"] == pytest.approx(1 / 3) and r["ff_usage_vL"] == 1.0 and r["ch_usage_vL"] == 0.0
    assert r["throws_sl"] == 1 and r["throws_ch"] == 0 and r["ch_velo"] is None
    assert r["rel_x_sd"] == pytest.approx(1.0) and r["is_home"] and r["opp_team"] == "AWY" and r["k_rate"] == pytest.approx(1 / 3)
    assert not got[12]["is_home"] and got[12]["opp_team"] == "HOM" and got[12]["rel_x_sd"] is None
    assert games.pitcher_games(df).count() == 0  # fewer than nine plate appearances
    types = {r["pitch_type"]: r for r in games.pitch_type_games(df, 3).collect()}
    assert set(types) == {"ff", "sl"} and types["ff"]["TotalPitches"] == 4 and types["ff"]["usage_rate"] == 0.5
    with pytest.raises(Exception, match="not exclusive"):
        games.pitch_type_games(pitch_frame(spark, {"type": None, "events": "walk"}), 0).collect()


def test_batters(spark):
    rows = [{"batter": 100 + i, "at_bat_number": i + 1, "events": "strikeout" if i % 2 else "walk", "p_throws": "L" if i == 1 else "R"} for i in range(10)]
    got = {r["batter"]: r for r in games.batter_games(pitch_frame(spark, *rows)).collect()}
    assert (got[101]["PA_vL"], got[101]["K_vL"], got[101]["PA_vR"]) == (1, 1, 0)
    assert got[108]["is_initial_lineup"] and not got[109]["is_initial_lineup"]
    assert got[100]["bat_team"] == "AWY" and not got[100]["is_home"] and got[100]["opp_team"] == "HOM" and got[100]["wOBA"] is None


def test_season_check(spark):
    df = pitch_frame(spark, {"game_pk": 100})
    checks.season_table(df, 2024, [100])
    for year, official in ((2024, [200]), (2023, [100]), (2024, [100, *range(300, 400)])):
        with pytest.raises(ValueError):
            checks.season_table(df, year, official)
    with pytest.raises(ValueError):
        checks.season_table(df.limit(0), 2024, [100])


def test_future_pitches_change_nothing(spark):
    df = pitch_frame(spark, {"events": "strikeout"})
    more = df.unionByName(pitch_frame(spark, {"game_pk": 2, "game_date": date(2025, 1, 1), "events": "walk"}))
    assert games.pitcher_games(df, 0).collect() == games.pitcher_games(more, 0).where("game_pk = 1").collect()
