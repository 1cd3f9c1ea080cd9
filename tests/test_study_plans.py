"""The studies at size: what their plans exchange, and pairs and resamples against plain Python."""

import re
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.operators import reliability


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_are_not_exchanged(spark):
    """Draws, resamples times players, used to be joined to their players through an exchange."""
    rng = np.random.default_rng(5)
    rows = [("s", "d", t, p, float(a), float(b)) for t in (10, 20) for p, (a, b) in enumerate(rng.random((40, 2)))]
    pairs = spark.createDataFrame(rows, "stat string, denom string, target int, player long, a double, b double").localCheckpoint()
    boot = reliability.bootstrap(pairs, 30, 20)
    assert "Join" not in plan(boot)
    got = {r["target"]: r for r in boot.collect()}
    draws = [[r[0] for r in spark.range(1, 41).select(F.pmod(F.xxhash64(F.lit(42), F.lit(k), F.col("id").cast("int")), F.lit(40).cast("long")), "id").orderBy("id").collect()] for k in range(1, 31)]
    for t in (10, 20):
        x = np.array([r[4:] for r in rows if r[2] == t])
        want = np.quantile([np.corrcoef(x[d].T)[0, 1] for d in draws], [0.5, 0.025, 0.975])
        assert [got[t][c] for c in ("median", "low", "high")] == pytest.approx(list(want), abs=1e-9) and got[t]["valid"] == 30


def buckets(rows, target):
    out, num, den = [], 0.0, 0.0
    at = target
    total = 0.0
    for d, n in rows:
        total, num, den = total + d, num + n, den + d
        if total >= at:
            out.append(num / max(den, 1))
            num, den, at = 0.0, 0.0, total + target
            if len(out) == 2:
                return tuple(out)
    return None


def test_pairs_with_nulls_and_fractions(spark):
    rng = np.random.default_rng(6)
    rows = []
    for p in (1, 2, 3, None):
        for g in range(40):
            rows.append((p, date(2024, 1, 1) + timedelta(g), g, None if rng.random() < 0.2 else int(rng.integers(0, 4)), None if rng.random() < 0.1 else int(rng.integers(0, 6)), float(rng.random() * 3), float("nan") if g % 7 == 3 else 0.1 * int(rng.integers(0, 30))))
    df = spark.createDataFrame(rows, "player long, game_date date, game_pk int, K long, PA long, x double, w double")
    plan_of = {("K", "PA"): True, ("x", "w"): False, ("x", "PA"): True}
    targets = {("K", "PA"): [5, 12, 30], ("x", "w"): [4, 6, 20], ("x", "PA"): [5, 10]}
    out = reliability.denominator_pairs(df, plan_of, targets, "player")
    got = {(r["stat"], r["denom"], r["player"], r["target"]): (r["a"], r["b"]) for r in out.collect()}
    at, want = {"K": 3, "PA": 4, "x": 5, "w": 6}, {}
    for (s, d), count in plan_of.items():
        for p in (1, 2, 3, None):
            mine = [(r[at[d]], r[at[s]]) for r in rows if r[0] == p and r[at[d]] is not None and r[at[s]] is not None and r[at[d]] == r[at[d]]]
            mine = [(w, x if count else x * w) for w, x in mine]
            want |= {(s, d, p, t): z for t in targets[s, d] if (z := buckets(mine, t))}
    assert got.keys() == want.keys() and any(k[2] is None for k in got)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_rows_of_a_study_move_once(spark):
    """A row for each statistic of a game used to be exchanged, several times over."""
    rows = [(p, p * 100 + g, date(2024, 4, 1) + timedelta(g), 5, p % 4, 3) for p in range(60) for g in range(12)]
    df = spark.createDataFrame(rows, "player long, game_pk long, game_date date, PA long, K long, W long").localCheckpoint()
    specs = {"k": ("K", "PA", range(10, 31, 10)), "w": ("W", "PA", range(10, 31, 10))}
    out = reliability.study(df, specs, "player")
    assert not re.search(r"Exchange hashpartitioning\(stat#\d+, denom#\d+, player", plan(out))
    assert out.count() == 2


def test_curves_read_their_rows_once(spark):
    """study_summary exchanged a row for each statistic of a game, for pairs of both kinds; medians held every row's denominator."""
    rng = np.random.default_rng(7)
    rows = [(p, p * 100 + g, date(2024, 4, 1) + timedelta(g), None if g == 3 else int(rng.integers(1, 9)), p % 4, 3) for p in range(60) for g in range(13)]
    df = spark.createDataFrame(rows, "player long, game_pk long, game_date date, PA long, K long, W long").localCheckpoint()
    out = reliability.curves(df, {"k": ("K", "PA", range(10, 31, 10)), "w": ("W", "PA", range(10, 31, 10))}, "player", n_boot=5)
    assert not re.search(r"Exchange hashpartitioning\(stat#\d+, denom#\d+, player", plan(out))
    got = out.collect()
    assert len(got) == 6 and {r["median_denominator"] for r in got} == {float(np.median([r[3] for r in rows if r[3] is not None]))}
    assert all(r["n_qualified_players"] == len([p for p in range(60) if buckets([(x[3], x[4]) for x in rows if x[0] == p and x[3] is not None], r["target"])]) for r in got)


def test_table_reads_its_rows_once(spark):
    """The reliability table exchanged a row for each statistic of a start, and made the pairs three times."""
    rng = np.random.default_rng(8)
    rows = [(p, date(2022 + g // 8, 4, 1) + timedelta(g), g, 20, int(rng.integers(0, 9)), float(rng.normal()) if rng.random() > 0.2 else (None if p % 2 else float("nan"))) for p in range(30) for g in range(24)]
    df = spark.createDataFrame(rows, "player long, game_date date, game_pk int, PA long, K long, velo double").localCheckpoint()
    out = reliability.reliability_table(df, {"K": True, "velo": False}, 5, "player", 10, 5, 3)
    assert "Exchange hashpartitioning(stat" in plan(out) and not re.search(r"Exchange hashpartitioning\(stat#\d+, player", plan(out))
    got = {r["stat"]: r for r in out.collect()}
    mine = {p: sorted((r for r in rows if r[0] == p), key=lambda r: r[1]) for p in range(30)}
    velo = [[r[5] for r in x if r[5] is not None and r[5] == r[5]] for x in mine.values()]
    halves = np.array([(np.mean(v[:5]), np.mean(v[5:10])) for v in velo if len(v) >= 10])
    assert got["velo"]["n"] == len(halves) and got["velo"]["pearson"] == pytest.approx(np.corrcoef(halves.T)[0, 1])
    years = []
    for x in mine.values():
        by = {y: [r[5] for r in x if r[1].year == y and r[5] is not None and r[5] == r[5]] for y in (2022, 2023, 2024)}
        years += [(np.mean(by[y]), np.mean(by[y + 1])) for y in (2022, 2023) if len(by[y]) >= 3 and len(by[y + 1]) >= 3]
    assert got["velo"]["yoy"] == pytest.approx(np.corrcoef(np.array(years).T)[0, 1])


def test_curves_make_their_games_once(spark):
    """study_summary made the games twice, once for the pairs and once for the medians, each time with all that moves before them."""
    rows = [(p if p < 59 else None, p * 100 + g, date(2024, 4, 1) + timedelta(g), 1 + (p + g) % 8, p % 4, 3) for p in range(60) for g in range(13)]
    df = spark.createDataFrame(rows, "player long, game_pk long, game_date date, PA long, K long, W long").localCheckpoint()
    games = df.groupBy("game_pk", "player").agg(F.min("game_date").alias("game_date"), *[F.sum(c).alias(c) for c in ("PA", "K", "W")])
    out = reliability.curves(games, {"k": ("K", "PA", range(10, 31, 10)), "w": ("W", "PA", range(10, 31, 10))}, "player", n_boot=5)
    got = out.collect()
    final = plan(out).split("== Initial Plan ==")[0]
    assert final.count("Scan ExistingRDD") == 1 and final.count("ReusedExchange") >= 2
    # the one player without an id and the one whose id is 0 stay apart
    players = {p: [(x[3], x[4]) for x in rows if x[0] == p] for p in [*range(59), None]}
    assert {r["n_qualified_players"] for r in got if r["target"] == 10} == {60 - sum(buckets(x, 10) is None for x in players.values())}
    assert {r["median_denominator"] for r in got} == {float(np.median([r[3] for r in rows]))}
