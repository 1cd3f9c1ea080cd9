"""Queries that do the whole job where an older one of the registry is cut: against plain Python."""

import re
import unicodedata
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor

from formline import vocab
from formline.functions import expr as X
from formline.operators import boosting, modelling, reliability
from formline.plans import registry


def plain_key(text):
    ascii_name = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii").lower()
    return re.sub(r"[^a-z0-9]+", "", re.sub(r"\b(jr|sr|ii|iii|iv)\b\.?", "", ascii_name))


def test_name_key_of_whole_texts(spark):
    rows = [(1, "word " * 20 + "José Peña Jr. the end"), (2, "Ken Griffey Jr."), (3, "II. Kapitel\nvom Häuschen IV"), (4, ""), (5, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["name_key"] for r in df.select("doc_id", X.name_key("text").alias("name_key")).collect()}
    assert got == {i: None if t is None else plain_key(t) for i, t in rows}


def test_boosting_goes_on_after_small_gains(spark):
    """Every tree after the first gains less than 1e-4 of squared error, where Spark's own stop would end the fit."""
    assert modelling.best_round([3.0, 2.0, 2.5, 2.4], 2) == 2
    assert modelling.best_round([3.0, 2.0, 2.5, 1.0], 3) is None
    signs = [((i >> 0) & 1, (i >> 1) & 1, (i >> 2) & 1) for i in range(240)]
    rows = [(*map(float, s), 0.3 + 0.02 * sum(s), ("train", "validation", "test")[i // 8 % 3]) for i, s in enumerate(signs)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k_rate double, split string")
    out = modelling.boosted(df, ["a", "b", "c"], trees=24, rate=0.3, depth=1, patience=6)
    scores = {r["split"]: r for r in modelling.metrics(out, by=["split"]).collect()}
    assert scores["test"]["rmse"] < 0.004


def test_study_goes_on_to_targets_of_its_own(spark):
    """60 players of 200 games that a rate of their own tells apart at 400 only, next to one without enough of a denominator."""
    rng = np.random.default_rng(5)
    rows = []
    for player in range(60):
        skill = rng.normal(0.3, 0.03)
        rows += [("ff" if g % 2 else "si", player, date(2024, 1, 1) + timedelta(g), g, int(rng.binomial(10, skill)), 10, 2) for g in range(200)]
    df = spark.createDataFrame(rows, "pitch_type string, pitcher int, game_date date, game_pk int, K int, PA int, FB int")
    goals = (25, 100, 400, 1000)
    out = {r["stat"] + "/" + r["denom"]: r for r in reliability.study(df, {"k": ("K", "PA", goals), "fb": ("K", "FB", (10, 200))}, "pitcher").collect()}
    rate = {p: np.array([r[4] for r in rows if r[1] == p]) for p in range(60)}
    r = {t: np.corrcoef([[x[: -(-t // 10)].sum(), x[-(-t // 10) : 2 * -(-t // 10)].sum()] for x in rate.values()], rowvar=False)[0, 1] for t in goals}
    assert r[100] < 0.5 and out["K/PA"]["r_50"] == next(t for t in goals if r[t] >= 0.5) > 100
    assert set(out) == {"K/PA", "K/FB"}
    pairs = reliability.denominator_pairs(df, {("K", "PA"): True, ("K", "FB"): True}, {("K", "PA"): goals, ("K", "FB"): (10, 200)}, "pitcher", by=["pitch_type"])
    assert {tuple(x) for x in pairs.select("pitch_type", "denom", "target").distinct().collect()} == {(t, d, g) for t in ("ff", "si") for d, g in (("PA", 25), ("PA", 100), ("PA", 400), ("FB", 10))}


def test_registered_study_has_all_specs(spark):
    """At sf0.01 every pitcher of the tables reaches targets above 100."""
    out = reliability.denominator_pairs(registry._study_df(spark, "/root/testdata/sf0.01"), {("K", "PA"): True}, {("K", "PA"): range(25, 1001, 25)}, "pitcher")
    assert out.agg({"target": "max"}).first()[0] > 100
    assert len(registry._specs(vocab.PITCHER_SPECS)) == 9 and len(vocab.PITCH_TYPE_SPECS) == 12


def test_boosting_is_sparks_in_one_stage(spark):
    """Trees used to be fitted by Spark's jobs, some five a tree. They are the same trees, and more of them take no more jobs."""
    rng = np.random.default_rng(3)
    a, b, c = rng.random(3000), rng.integers(0, 9, 3000), rng.normal(size=3000)
    y = 0.25 + 0.1 * np.sin(6 * a) + 0.02 * b * (c > 0) + rng.normal(scale=0.05, size=3000)
    rows = [("train" if i < 2000 else "validation" if i < 2500 else "test", None if i % 17 == 0 else float(a[i]), int(b[i]), float(c[i]), float(y[i])) for i in range(3000)]
    df = spark.createDataFrame(rows, "split string, a double, b int, c double, k_rate double").localCheckpoint()
    data = modelling._assembled(*modelling._filled(df, ["a", "b", "c"], True))
    model = GBTRegressor(featuresCol="_features", labelCol="k_rate", maxIter=12, stepSize=0.3, maxDepth=4).fit(data.where("split = 'train'"))
    want = [min(max(r["prediction"], 0.0), 1.0) for r in model.transform(data).collect()]
    jobs = {}
    for trees in (2, 12):
        spark.sparkContext.setJobGroup(f"boosted {trees}", "")
        out = modelling.boosted(df, ["a", "b", "c"], trees=trees, rate=0.3, depth=4, patience=None)
        jobs[trees] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boosted {trees}"))
    assert [r["prediction"] for r in out.collect()] == pytest.approx(want, abs=1e-12)
    assert jobs[2] == jobs[12]
    errors = model.evaluateEachIteration(data.where("split = 'validation'"), "squared")
    best = modelling.best_round(errors, 2)
    short = modelling.boosted(df, ["a", "b", "c"], trees=12, rate=0.3, depth=4, patience=2)
    whole = modelling.boosted(df, ["a", "b", "c"], trees=best, rate=0.3, depth=4, patience=None)
    assert best and [r["prediction"] for r in short.collect()] == pytest.approx([r["prediction"] for r in whole.collect()], abs=1e-12)


def test_boosting_over_tasks_is_that_of_one(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [("train" if i % 3 else "validation", float(x), float(z), float(x * z)) for i, (x, z) in enumerate(rng.random((900, 2)))]
    df = spark.createDataFrame(rows, "split string, a double, b double, k_rate double").localCheckpoint()
    one = [r["prediction"] for r in modelling.boosted(df, ["a", "b"], trees=20, patience=5).collect()]
    monkeypatch.setattr(boosting, "TASK_ROWS", 300)
    assert [r["prediction"] for r in modelling.boosted(df, ["a", "b"], trees=20, patience=5).collect()] == pytest.approx(one, abs=1e-12)
