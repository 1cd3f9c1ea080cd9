from datetime import date, timedelta

import pytest
from helpers import GAME, START, frame, pitch_frame
from pyspark.sql import functions as F

from formline.operators import park, priors, rolling

D = date(2024, 4, 1)


def starts(spark, *rows):
    return frame(spark, rows, START)


def by_game(df, name):
    return {r["game_pk"]: r[name] for r in df.collect()}


def test_rates_are_sums_over_sums_of_earlier_dates(spark):
    df = starts(spark, {"game_pk": 1, "K": 8, "PA": 20}, {"game_pk": 2, "game_date": D + timedelta(5), "K": 2, "PA": 30}, {"game_pk": 3, "game_date": D + timedelta(10)})
    out = rolling.pitcher_features(df)
    assert by_game(out, "k_rate_std") == {1: None, 2: 0.4, 3: 0.2}
    assert by_game(out, "k_rate_P5") == {1: None, 2: 0.4, 3: 0.2}
    assert "gb_rate_P5" not in out.columns
    assert by_game(out, "ff_velo_P3") == {1: None, 2: 95.0, 3: 95.0}


def test_games_of_one_date_see_the_same(spark):
    df = starts(spark, {"game_pk": 1, "K": 8, "PA": 40}, {"game_pk": 2, "K": 1, "PA": 10}, {"game_pk": 3, "game_date": D + timedelta(1), "K": 0, "PA": 10}, {"game_pk": 4, "game_date": D + timedelta(1), "K": 9, "PA": 9})
    out = rolling.pitcher_features(df)
    assert by_game(out, "k_rate_P5") == {1: None, 2: None, 3: 9 / 50, 4: 9 / 50}
    assert by_game(out, "k_rate_std") == {1: None, 2: None, 3: 9 / 50, 4: 9 / 50}


def test_fip(spark):
    df = starts(spark, {"game_pk": 1, "K": 5, "HR": 0, "BB": 1, "HBP": 0, "FB": 4}, {"game_pk": 2, "game_date": D + timedelta(5)}, {"game_pk": 3, "game_date": date(2020, 4, 1), "pitcher": 2}, {"game_pk": 4, "game_date": date(2020, 4, 2), "pitcher": 2})
    out = rolling.pitcher_features(df)
    assert by_game(out, "FIP_P3")[2] == pytest.approx((3 - 10) / 5 + 3.166)
    assert by_game(out, "xFIP_P3")[2] == pytest.approx((13 * 4 * 0.1 + 3 - 10) / 5 + 3.166)
    assert by_game(out, "FIP_P3")[4] is None  # no constant for the season
    one = priors.fip(starts(spark, {}, {"game_pk": 2, "Outs": 8}).withColumn("season", F.lit(2024)))
    assert by_game(one, "FIP")[1] == pytest.approx((13 + 6 - 10) / 5 + 3.166) and by_game(one, "FIP")[2] is None


def test_prior_season(spark):
    df = starts(
        spark, {"game_pk": 1, "game_date": date(2023, 5, 1), "K": 10, "PA": 40}, {"game_pk": 2, "K": 4, "PA": 20}, {"game_pk": 3, "game_date": D + timedelta(7)}, {"game_pk": 4, "pitcher": 2, "K": 0, "PA": 0},
    )
    got = by_game(priors.prior_season_shrunk(df, fallback=0.21), "k_rate_std_shrunk")
    assert got[1] == pytest.approx(0.21)
    assert got[2] == pytest.approx(0.25)
    assert got[3] == pytest.approx((4 + 200 * 0.25) / 220)
    assert got[4] == pytest.approx(0.25)  # the league's last season
    later = df.unionByName(starts(spark, {"game_pk": 9, "game_date": date(2025, 6, 1), "K": 20, "PA": 20}))
    assert {k: v for k, v in by_game(priors.prior_season_shrunk(later, fallback=0.21), "k_rate_std_shrunk").items() if k < 9} == got
    with pytest.raises(ValueError):
        priors.prior_season_shrunk(df, strength=0)


def test_batters(spark):
    rows = [{"game_pk": 1, "K": 2, "PA": 4}, {"game_pk": 2, "game_date": D + timedelta(1), "K": 1, "PA": 4}, {"game_pk": 3, "game_date": D + timedelta(2)}, {"game_pk": 4, "game_date": date(2025, 4, 1)}]
    df = frame(spark, rows, GAME)
    out = rolling.batter_features(df, fallback=0.21)
    assert by_game(out, "k_rate_std") == {1: None, 2: 0.5, 3: 0.375, 4: None}
    assert by_game(out, "k_rate_P5")[4] == pytest.approx(4 / 12)  # carries over seasons
    shrunk = by_game(out, "k_rate_std_shrunk")
    assert shrunk[1] == pytest.approx(0.21) and shrunk[2] == pytest.approx((2 + 200 * 0.5) / 204)
    more = rolling.batter_features(df.unionByName(frame(spark, [{"game_pk": 9, "game_date": date(2026, 1, 1), "K": 4}], GAME)), fallback=0.21)
    for name in ("k_rate_std", "k_rate_P10", "k_rate_std_shrunk", "whiff_rate_std"):
        assert {k: v for k, v in by_game(more, name).items() if k < 9} == by_game(out, name)
    sourced = rolling.batter_features(df.withColumn("prior_league_k_rate", F.lit(0.3)))
    assert by_game(sourced, "k_rate_std_shrunk")[1] == pytest.approx(0.3)
    with pytest.raises(ValueError):
        rolling.batter_features(df.withColumn("prior_league_k_rate", F.col("PA") * 0.1 + F.col("game_pk")))
    with pytest.raises(ValueError):
        rolling.batter_features(df.unionByName(df))


def test_hr_fb_before_a_date(spark):
    hr = lambda d, g, e="home_run": {"game_date": d, "game_pk": g, "at_bat_number": g, "events": e, "bb_type": "fly_ball"}
    df = pitch_frame(spark, hr(date(2023, 5, 1), 1), hr(date(2023, 5, 1), 2, "field_out"), hr(date(2024, 5, 1), 3, "field_out"), hr(date(2024, 5, 2), 4))
    got = {r["game_date"]: r["lg_hr_fb_prior"] for r in priors.hr_fb_before(df, 2.0).collect()}
    assert got[date(2023, 5, 1)] is None
    assert got[date(2024, 5, 1)] == pytest.approx(0.5)
    assert got[date(2024, 5, 2)] == pytest.approx((0 + 2 * 0.5) / 3)


def appearances(spark, *rows):
    return spark.createDataFrame([(t, d, k) for t, d, n, ks in rows for k in [True] * ks + [False] * (n - ks)], "home_team string, game_date date, is_k boolean")


def test_parks(spark):
    pa = appearances(spark, ("AAA", date(2023, 5, 1), 100, 60), ("BBB", date(2023, 5, 1), 100, 10), ("AAA", date(2024, 5, 1), 10, 0), ("TB", date(2024, 5, 1), 10, 5), ("TB", date(2025, 5, 1), 10, 5))
    got = {(r["season"], r["home_team"]): r for r in park.season_factors(pa, [2024, 2025, 2026], regress=1e-9).collect()}
    assert got[2024, "AAA"]["park_k_factor"] == pytest.approx(0.6 / 0.35)
    assert got[2024, "TB"]["park_k_factor"] == 1.0 and got[2024, "TB"]["PA"] == 0
    assert got[2025, "TB"]["park_k_factor"] == 1.0  # the override's venue has no history
    assert got[2026, "TB"]["PA"] == 10  # back home, so history of 2024 alone
    assert ("2024", "BBB") not in got and (2026, "AAA") not in got  # teams of the latest season before
    mild = {r["venue"]: r["park_k_factor"] for r in park.k_factor(pa.where("year(game_date) = 2023")).collect()}
    assert 1 < mild["AAA"] < 0.6 / 0.35
