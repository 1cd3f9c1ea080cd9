from datetime import date, timedelta

import numpy as np
import pytest

from formline.operators import modelling, reliability


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(0)
    rows = []
    for p in range(60):
        skill = rng.normal(0.22, 0.05)
        for g in range(24):
            pa = int(rng.integers(18, 28))
            rows.append((f"p{p}", date(2023, 4, 1) + timedelta(int(g * 30)), g, pa, int(rng.binomial(pa, min(max(skill, 0.05), 0.5))), float(90 + 20 * skill + rng.normal())))
    return rows, spark.createDataFrame(rows, "player_name string, game_date date, game_pk int, PA long, K long, ff_velo double")


def plain_halves(rows, n, rate=True):
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    out = []
    for x in by.values():
        if len(x) >= 2 * n:
            f = (lambda y: sum(r[4] for r in y) / max(sum(r[3] for r in y), 1)) if rate else (lambda y: float(np.mean([r[5] for r in y])))
            out.append((f(x[:n]), f(x[n : 2 * n])))
    return np.array(out)


def test_halves_and_curve(panel):
    rows, df = panel
    stats = {"K": True, "ff_velo": False, "not_there": True}
    curve = {(r["stat"], r["window"]): r for r in reliability.stabilization_curve(df, stats, (3, 8, 12, 13), least=20).collect()}
    assert set(curve) == {(s, w) for s in ("K", "ff_velo") for w in (3, 8, 12)}
    for (s, w), r in curve.items():
        assert r["r"] == pytest.approx(np.corrcoef(plain_halves(rows, w, s == "K").T)[0, 1])
    one = {r["stat"]: r for r in reliability.split_half(df, stats, 8, least=20).collect()}
    x = plain_halves(rows, 8)
    assert one["K"]["pearson"] == pytest.approx(curve["K", 8]["r"]) and one["K"]["slope"] == pytest.approx(np.polyfit(x[:, 0], x[:, 1], 1)[0])
    assert one["K"]["sem"] == pytest.approx(x[:, 0].std(ddof=1) * np.sqrt(1 - one["K"]["pearson"]))
    ranks = np.array([[np.mean(np.flatnonzero(np.sort(c) == v)) for v in c] for c in x.T])
    assert one["K"]["spearman"] == pytest.approx(np.corrcoef(ranks)[0, 1])
    assert reliability.split_half(df, stats, 8, least=61).where("pearson is not null").count() == 0


def test_icc_and_table(panel):
    rows, df = panel
    x = plain_halves(rows, 8)
    n, grand = len(x), x.mean()
    msr = 2 * ((x.mean(axis=1) - grand) ** 2).sum() / (n - 1)
    msc = n * ((x.mean(axis=0) - grand) ** 2).sum()
    mse = ((x - x.mean(axis=1, keepdims=True) - x.mean(axis=0) + grand) ** 2).sum() / (n - 1)
    want = (msr - mse) / (msr + mse + 2 * (msc - mse) / n)
    table = reliability.reliability_table(df, {"K": True, "ff_velo": False}, 8, least=20, least_pairs=10).collect()
    k = next(r for r in table if r["stat"] == "K")
    assert k["icc2"] == pytest.approx(want)
    assert k["sem"] == pytest.approx(x[:, 0].std() * np.sqrt(1 - k["pearson"]))
    assert k["yoy"] is not None and k["tier"].startswith("Tier")


def plain_buckets(rows, target):
    cs, out = np.cumsum([d for _, d in rows]), None
    if cs[-1] >= 2 * target:
        i1 = int(np.argmax(cs >= target))
        later = [k for k in range(i1 + 1, len(rows)) if cs[k] - cs[i1] >= target]
        if later:
            i2 = later[0]
            f = lambda part: sum(a for a, _ in part) / max(sum(d for _, d in part), 1)
            out = f(rows[: i1 + 1]), f(rows[i1 + 1 : i2 + 1])
    return out


def test_denominators(spark):
    rng = np.random.default_rng(2)
    rows = [(f"p{p}", date(2023, 1, 1) + timedelta(g), g, int(rng.integers(0, 5)), int(rng.integers(0, 9)) if rng.random() > 0.2 else 0) for p in range(20) for g in range(30)]
    df = spark.createDataFrame(rows, "player_name string, game_date date, game_pk int, num long, den long")
    got = {(r["player"], r["target"]): (r["a"], r["b"]) for r in reliability.denominator_pairs(df, {("num", "den"): True}, [5, 20, 40, 80]).collect()}
    want = {}
    for p in range(20):
        mine = [(r[3], r[4]) for r in rows if r[0] == f"p{p}"]
        want |= {(f"p{p}", t): x for t in (5, 20, 40, 80) if (x := plain_buckets(mine, t))}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_bootstrap(spark):
    rng = np.random.default_rng(3)
    x = rng.multivariate_normal([0, 0], [[1, 0.6], [0.6, 1]], 400)
    df = spark.createDataFrame([("s", "d", 10, f"p{i}", float(a), float(b)) for i, (a, b) in enumerate(x)], "stat string, denom string, target int, player string, a double, b double")
    r = reliability.bootstrap(df, 300).first()
    se = (1 - 0.6**2) / 20
    assert r["valid"] == 300 and abs(r["median"] - np.corrcoef(x.T)[0, 1]) < se
    assert 2.5 * se < r["high"] - r["low"] < 6 * se
    again = reliability.bootstrap(df, 300).first()
    assert [again[c] for c in ("median", "low", "high")] == pytest.approx([r[c] for c in ("median", "low", "high")], abs=1e-12)
    assert reliability.bootstrap(df.limit(5), 50).first()["median"] is None


def test_constants_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(reliability.pearson("a", "b")).first()[0] is None
    assert df.limit(1).agg(reliability.pearson("a", "b")).first()[0] is None


def frame(spark, n=300):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 2))
    y = np.clip(0.25 + 0.05 * x[:, 0] - 0.02 * x[:, 1] + rng.normal(scale=0.02, size=n), 0, 1)
    rows = [(date(2023, 1, 1) + timedelta(int(i // 2)), float(a) if i % 17 else None, float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))]
    return rows, spark.createDataFrame(rows, "game_date date, a double, b double, k_rate double")


def test_split(spark):
    rows, df = frame(spark)
    parts = {r["split"]: r for r in modelling.chronological_split(df).groupBy("split").agg({"game_date": "max", "*": "count"}).collect()}
    assert {k: r["count(1)"] for k, r in parts.items()} == {"train": 210, "validation": 44, "test": 46}
    for bad in (df.limit(2), df.where("game_date <= '2023-01-02'")):
        with pytest.raises(ValueError):
            modelling.chronological_split(bad)
    with pytest.raises(ValueError):
        modelling.research_folds(df, [("x", "2024-02-01", "2024-01-01", "2024-03-01")])


def test_ridge_is_the_closed_form(spark):
    rows, df = frame(spark)
    tagged = modelling.chronological_split(df)
    got = [(r["game_date"], r["k_rate"], r["prediction"]) for r in modelling.ridge(tagged, ["a", "b"], alpha=50.0).collect()]
    train = [r for r in tagged.collect() if r["split"] == "train"]
    med = np.median([r["a"] for r in train if r["a"] is not None])
    design = lambda rs: np.array([[med if r["a"] is None else r["a"], r["b"]] for r in rs])
    x, y = design(train), np.array([r["k_rate"] for r in train])
    mu, sd = x.mean(axis=0), x.std(axis=0)
    z = (x - mu) / sd
    w = np.linalg.solve(z.T @ z + 50 * np.eye(2), z.T @ (y - y.mean()))
    everyone = tagged.collect()
    want = {(r["game_date"], r["k_rate"]): p for r, p in zip(everyone, np.clip(y.mean() + (design(everyone) - mu) / sd @ w, 0, 1), strict=True)}
    assert max(abs(want[d, t] - p) for d, t, p in got) < 1e-9
    scores = {r["split"]: r for r in modelling.metrics(modelling.ridge(tagged, ["a", "b"]), by=["split"]).collect()}
    assert scores["test"]["r2"] > 0.5
    mean = {r["split"]: r for r in modelling.metrics(modelling.mean_baseline(tagged), by=["split"]).collect()}
    assert abs(mean["train"]["r2"]) < 1e-9 and mean["test"]["mae"] > scores["test"]["mae"]


def test_ablation(spark):
    _, df = frame(spark)
    sets = modelling.configurations(["a", "b"], {"second": "^b$"})
    assert sets == {"core": ["a"], "core+second": ["a", "b"], "all": ["a", "b"]}
    folds = (("one", "2023-04-01", "2023-04-01", "2023-05-01"),)
    out = modelling.ablation_summary(modelling.ablation(df, sets, folds, trees=4)).collect()
    for model in ("ridge", "boosted"):
        best = next(r for r in out if r["model"] == model and r["configuration"] == "all")
        assert best["mean_mae_gain"] > 0 and best["folds_with_gain"] == 1
    with pytest.raises(ValueError):
        modelling.configurations(["a"], {"none": "^z"})
    with pytest.raises(ValueError):
        modelling.research_folds(df, (("bad", "2023-05-01", "2023-04-01", "2023-06-01"),))
