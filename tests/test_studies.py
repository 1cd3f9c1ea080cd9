"""Names, registers, seasons, column sets and the study against plain Python."""

import re
import unicodedata
from datetime import date, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from formline import vocab
from formline.functions import expr as X
from formline.operators import identity, modelling, reliability
from formline.sources import files


def plain_key(name):
    ascii_name = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    return re.sub("[^a-z0-9]+", "", re.sub(r"\b(jr|sr|ii|iii|iv)\b\.?", "", ascii_name))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.text(st.characters(exclude_categories=["Cs"])), st.text("aJr. IViiÑñé́ſﬁ½Ⅳⅷ№ＡＫ℡Ǆ㎏'-"), st.sampled_from(["Nguyễn Văn", "Ḥasan", "Ｆｉｎｎ Jr", "Łukasz", "ﬂood II.", "𝔘wе IV"])), min_size=20, max_size=60))
def test_name_keys(spark, names):
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").coalesce(1).select(X.name_key("n")).collect()]
    assert got == [plain_key(n) for n in names]


def test_player_map_is_kept(spark, tmp_path):
    path, calls = str(tmp_path / "players.parquet"), []

    def register(name):
        def rows():
            calls.append(name)
            return spark.createDataFrame([("7", name, None, 0)], "MLBID string, MLBNAME string, PLAYERNAME string, _place int")

        return rows

    for name, refresh, want in (("a", False, "a"), ("b", False, "a"), ("c", True, "c")):
        assert [tuple(r) for r in identity.load_player_map(spark, path, register(name), refresh).collect()] == [(7, want)]
    assert calls == ["a", "c"]


def test_chunks_of_ids(spark):
    rows = identity.missing_ids(spark.range(1000).withColumnRenamed("id", "p"), spark.range(50).withColumnRenamed("id", "mlb_id"), "p").collect()
    assert sorted(r["mlb_id"] for r in rows) == list(range(50, 1000))
    sizes = np.unique([r["chunk"] for r in rows], return_counts=True)[1]
    assert sizes.max() <= 100


def test_publish_season(spark, tmp_path):
    rows = [(float(g), "2024-05-01", 2024.0, "R" if g < 9 else "S", float("nan")) for g in range(10)]
    df = spark.createDataFrame(rows, "game_pk double, game_date string, game_year double, game_type string, speed double")
    with pytest.raises(ValueError):
        files.publish_season(df, 2024, range(8), str(tmp_path))
    assert not list(tmp_path.iterdir())
    files.publish_season(df, 2024, range(9), str(tmp_path))
    out = files.load_seasons(spark, str(tmp_path), [2024])
    assert dict(out.dtypes) == {"game_pk": "bigint", "game_date": "date", "game_year": "int", "game_type": "string", "speed": "double"}
    assert out.count() == 9 and out.where("speed is not null").count() == 0


def test_configurations():
    names = ["k_rate_P5", "whiff_rate_P5", "whiff_rate_std", "swstr_rate_P20", "opp_lineup_whiff"]
    found = modelling.named_configurations(names, vocab.FEATURE_SETS)
    assert found["core"] == ["k_rate_P5"] and found["pitcher_both"] == ["k_rate_P5", "whiff_rate_P5", "whiff_rate_std", "swstr_rate_P20"]
    assert found["compact_candidate"] == ["k_rate_P5", "swstr_rate_P20", "opp_lineup_whiff"] and found["all_candidates"] == names
    assert len(vocab.FEATURE_SETS) == 12 and len(vocab.WINDOW_SETS) == 17
    with pytest.raises(ValueError):
        modelling.named_configurations(names, vocab.WINDOW_SETS)


def panel(players=60, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(players):
        skill = 0.1 + 0.3 * rng.random()
        for g in range(int(rng.integers(5, 40))):
            n = int(rng.integers(0, 9))
            rows.append((p, p * 1000 + g, date(2024, 4, 1) + timedelta(days=g), n, int(rng.binomial(n, skill))))
    return rows


def plain_pairs(rows, targets, strict):
    out = {}
    for p in sorted({r[0] for r in rows}):
        mine = sorted((r[2], r[1], r[3], r[4]) for r in rows if r[0] == p)
        for t in targets:
            halves, num, den = [], 0, 0
            for _, _, n, k in mine:
                num, den = num + k, den + n
                if den >= t:
                    halves.append((num, den))
                    num = den = 0
                    if len(halves) == 2:
                        break
            if len(halves) == 2:
                out[p, t] = tuple(k / max(n, 1) for k, n in halves)
    return out


def test_buckets_and_resamples(spark):
    rows = panel()
    df = spark.createDataFrame(rows, "player long, game_pk long, game_date date, PA long, K long")
    pairs = reliability.denominator_pairs(df, {("K", "PA"): True}, [5, 20, 60], "player", strict=True)
    got = {(r["player"], r["target"]): (r["a"], r["b"]) for r in pairs.collect()}
    want = plain_pairs(rows, [5, 20, 60], True)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    boot = {r["target"]: r for r in reliability.bootstrap(pairs, 200, 20).collect()}
    rng = np.random.default_rng(1)
    for t in (5, 20):
        x = np.array([v for (_, target), v in want.items() if target == t])
        draws = []
        for _ in range(2000):
            s = x[rng.integers(0, len(x), len(x))]
            draws.append(np.corrcoef(s[:, 0], s[:, 1])[0, 1])
        median, low, high = np.quantile(draws, [0.5, 0.025, 0.975])
        width = high - low
        assert boot[t]["valid"] == 200
        for mine, exact in ((boot[t]["median"], median), (boot[t]["low"], low), (boot[t]["high"], high)):
            assert abs(mine - exact) < 0.2 * width


def test_study(spark):
    df = spark.createDataFrame(panel(80), "player long, game_pk long, game_date date, PA long, K long")
    specs = {"k": ("K", "PA", range(10, 61, 10))}
    curve = reliability.curves(df, specs, "player", n_boot=40, least=20)
    rows = sorted(curve.collect(), key=lambda r: r["target"])
    assert [r["target"] for r in rows] == [10, 20, 30, 40, 50, 60]
    assert all(r["n_qualified_players"] >= s["n_qualified_players"] for r, s in zip(rows, rows[1:], strict=False))
    assert all(r["typical_starts"] == pytest.approx(r["target"] / r["median_denominator"]) for r in rows)
    for s in reliability.analyze(curve).collect():
        over = [r for r in rows if r["median"] is not None and r["median"] >= s["threshold"]]
        assert s["median_crossing"] == (over[0]["target"] if over else None)
        assert s["qualified_at_median_crossing"] == (over[0]["n_qualified_players"] if over else None)
        low = [r for r in rows if r["low"] is not None and r["low"] >= s["threshold"]]
        assert s["reliably_estimable"] == bool(low and low[0]["n_qualified_players"] >= 50)
    few = reliability.qualifiers(df, "PA", [10, 100], "player").collect()
    assert all(r["ever"] >= r["twice"] for r in few) and len(few) == 2
