"""Chronological splits, baselines and ablations."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline import vocab
from formline.operators import boosting
from formline.operators.boosting import best_round  # noqa: F401  its callers find it here

TARGET = "k_rate"


def chronological_split(df: DataFrame, train: float = 0.70, validation: float = 0.85) -> DataFrame:
    """df with split: train, validation or test, by dates. A boundary date goes to the later part as a whole. Errors as ValueError for fewer than three rows or dates."""
    daily = df.groupBy("game_date").agg(F.count("*").alias("n"))
    before = Window.orderBy("game_date").rowsBetween(Window.unboundedPreceding, 0)
    upto = daily.select("game_date", F.sum("n").over(before).alias("cum"), F.sum("n").over(Window.partitionBy()).alias("total"))
    cuts = upto.agg(F.count("*").alias("dates"), F.max("total").alias("rows"), *[F.min(F.when(F.col("cum") > F.floor(F.col("total") * share), F.col("game_date"))).alias(name) for name, share in (("v", train), ("t", validation))], F.min("game_date").alias("first")).first()
    if cuts["rows"] is None or cuts["rows"] < 3 or cuts["dates"] < 3:
        raise ValueError("a split needs three rows and three dates")
    if not cuts["first"] < cuts["v"] < cuts["t"]:
        raise ValueError("a part of the split is empty")
    return df.withColumn("split", F.when(F.col("game_date") < F.lit(cuts["v"]), "train").when(F.col("game_date") < F.lit(cuts["t"]), "validation").otherwise("test"))


# Research folds as (name, training before, validation from, validation before).
FOLDS = (("2023_h2", "2023-07-01", "2023-07-01", "2024-01-01"), ("2024_h1", "2024-01-01", "2024-01-01", "2024-07-01"), ("2024_h2", "2024-07-01", "2024-07-01", "2025-01-01"))


def research_folds(df: DataFrame, folds: Sequence[tuple[str, str, str, str]] = FOLDS) -> DataFrame:
    """A row for each fold and role (train, validation) that a row of df has in it. Folds whose training reaches into validation raise."""
    for name, train_end, start, end in folds:
        if not train_end <= start < end:
            raise ValueError(f"fold {name} overlaps")
    spec = F.array(*[F.struct(F.lit(n).alias("fold"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b"), F.lit(c).cast("date").alias("c")) for n, a, b, c in folds])
    out = df.select("*", F.explode(spec).alias("_f"))
    role = F.when(F.col("game_date") < F.col("_f.a"), "train").when((F.col("game_date") >= F.col("_f.b")) & (F.col("game_date") < F.col("_f.c")), "validation")
    return out.withColumns({"fold": F.col("_f.fold"), "role": role}).where("role is not null").drop("_f")


def clip(p: Column) -> Column:
    """A prediction of a rate, between 0 and 1."""
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def metrics(df: DataFrame, prediction: str = "prediction", target: str = TARGET, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mae, rmse, r2); r2 is null for a constant target."""
    e = F.col(target) - F.col(prediction)
    sse, sst = F.sum(e * e), F.var_pop(target) * F.count(F.lit(1))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(sst > 1e-12, 1 - sse / sst).alias("r2"))


def mean_baseline(df: DataFrame, target: str = TARGET) -> DataFrame:
    """df with prediction: the mean target of its training rows, one row broadcast."""
    mean = df.where("split = 'train'").agg(clip(F.avg(target)).alias("prediction"))
    return df.join(F.broadcast(mean))


def _medians(df: DataFrame, features: Sequence[str]) -> dict[str, float | None]:
    """The training rows' exact medians."""
    return df.where("split = 'train'").agg(*[F.percentile(F.col(c).cast("double"), 0.5).alias(c) for c in features]).first().asDict()


def _filled(df: DataFrame, features: Sequence[str], indicators: bool = False, medians: Mapping[str, float | None] | None = None) -> tuple[DataFrame, list[str]]:
    """df with nulls of features replaced by the training rows' exact medians (0 without any), and 0/1 columns for what was missing if asked for."""
    medians = medians or _medians(df, features)
    fill = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0 if medians[c] is None else float(medians[c]))) for c in features}
    names = [f"_x{i}" for i in range(len(features))]
    new = {n: fill[c] for n, c in zip(names, features, strict=True)}
    if indicators:
        new |= {f"_m{i}": F.col(c).isNull().cast("double") for i, c in enumerate(features)}
    return df.withColumns(new), list(new)


def _assembled(df: DataFrame, names: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=names, outputCol="_features").transform(df)


def ridge(df: DataFrame, features: Sequence[str], target: str = TARGET, alpha: float = 1.0) -> DataFrame:
    """df with prediction of a ridge regression on standardised features, fitted on the training rows.

    The penalty alpha * |w|^2 on population-standardised features, in terms of Spark's objective: the target is scaled by its deviation
    inside the solver and features here by the sample deviation.
    """
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.regression import LinearRegression

    filled, names = _filled(df, features)
    data = _assembled(filled, names)
    train = data.where("split = 'train'")
    n, sd = train.agg(F.count("*"), F.stddev_pop(target)).first()
    if not n or not sd:
        raise ValueError("training rows have no spread in the target")
    scaler = StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True, withStd=True).fit(train)
    model = LinearRegression(featuresCol="_scaled", labelCol=target, regParam=alpha * (n - 1) / n**2 * sd, elasticNetParam=0.0, standardization=False, solver="normal").fit(scaler.transform(train))
    out = model.transform(scaler.transform(data)).withColumn("prediction", clip(F.col("prediction")))
    return out.drop("_features", "_scaled", *names)


def best_round(errors: Sequence[float], patience: int) -> int | None:
    """The number of trees with the least error before `patience` rounds without a smaller one; None if the errors end sooner."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        if i - best >= patience:
            return best + 1
    return None


def boosted(df: DataFrame, features: Sequence[str], target: str = TARGET, trees: int = 5000, rate: float = 0.03, depth: int = 5, patience: int | None = 200) -> DataFrame:
    """df with prediction of boosted trees, cut where the squared error of the validation rows is least. Nulls become medians with indicators, as the trees take none.

    Trees are added until `patience` rounds bring no smaller error, or up to all `trees`. Without patience all `trees` are fitted and taken, and no
    validation rows are wanted.
    """
    mine = ["train"] if patience is None else ["train", "validation"]
    rows = df.where(F.col("split").isin(mine)).select("split", F.col(target).cast("double").alias("_y"), *features).where("_y is not null").persist()
    try:
        medians = _medians(rows, features)
        filled, names = _filled(rows, features, True, medians)
        parts = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count("*").alias("n")).collect()}
        if not parts.get("train"):
            raise ValueError("no training rows")
        cuts = boosting.thresholds(filled.where("split = 'train'"), names, parts["train"])
        made = boosting.fit(boosting.cells(filled, names, "_y", cuts), sum(parts.values()), cuts, trees, rate, depth, patience)
    finally:
        rows.unpersist()
    filled, names = _filled(df, features, True, medians)
    return boosting.scored(filled, names, cuts, made).withColumn("prediction", clip(F.col("prediction"))).drop(*names)


def configurations(names: Sequence[str], families: Mapping[str, str]) -> dict[str, list[str]]:
    """Column sets for an ablation: core (no family's columns), core with each family, all. Families are regular expressions; one that matches nothing raises."""
    import re

    mine = {f: [n for n in names if re.search(p, n)] for f, p in families.items()}
    if empty := [f for f, x in mine.items() if not x]:
        raise ValueError(f"families without columns: {empty}")
    core = [n for n in names if not any(n in x for x in mine.values())]
    return {"core": core, **{f"core+{f}": [n for n in names if n in core or n in x] for f, x in mine.items()}, "all": list(names)}


def named_configurations(names: Sequence[str], sets: Mapping[str, Sequence[str] | None]) -> dict[str, list[str]]:
    """Column sets by name, from tables like vocab.FEATURE_SETS: the core (no family's columns) and, of each family named, the columns with one of the endings
    named behind it, or all. None stands for all columns. A set beside the core that adds nothing raises, if it names endings."""
    mine = {f: [n for n in names if n == p or n.startswith(p)] for f, p in vocab.FAMILIES.items()}
    core = [n for n in names if not any(n in x for x in mine.values())]
    out = {}
    for name, parts in sets.items():
        if parts is None:
            out[name] = list(names)
            continue
        out[name] = list(core)
        for family, *endings in map(str.split, parts):
            added = [n for n in mine[family] if not endings or n.endswith(tuple(endings))]
            if endings and not added and sets is vocab.WINDOW_SETS:
                raise ValueError(f"configuration {name} selects no columns of {family}")
            out[name] += added
    return out


def feature_digest(names: Sequence[str]) -> str:
    """SHA-256 of the feature names in order, a line each."""
    return hashlib.sha256("\n".join(names).encode()).hexdigest()


def with_gain(scores: DataFrame) -> DataFrame:
    """scores(fold, model, configuration, mae, ...) with mae_gain against the fold's and model's core configuration."""
    core = scores.where("configuration = 'core'").select("fold", "model", F.col("mae").alias("_core"))
    return scores.join(core, ["fold", "model"], "left").withColumn("mae_gain", F.col("_core") - F.col("mae")).drop("_core")


def ablation_summary(scores: DataFrame) -> DataFrame:
    """Means over folds by model and configuration, and in how many folds there is a gain; largest mean gain first."""
    out = scores.groupBy("model", "configuration").agg(F.count_distinct("fold").alias("folds"), *[F.avg(c).alias(f"mean_{c}") for c in ("mae", "rmse", "r2", "mae_gain")], F.count_if(F.col("mae_gain") > 0).alias("folds_with_gain"))
    return out.orderBy(F.desc_nulls_last("mean_mae_gain"), "model", "configuration")


def ablation(df: DataFrame, sets: Mapping[str, Sequence[str]], folds=FOLDS, target: str = TARGET, alpha: float = 1.0, trees: int = 0) -> DataFrame:
    """(fold, model, configuration, n, mae, rmse, r2, mae_gain) of ridge, mean and, if there are to be trees, boosted models for every fold and column set. A fit is a job
    of its own; their scores are rows."""
    tagged, parts = research_folds(df, folds), []
    for fold, *_ in folds:
        mine = tagged.where(F.col("fold") == fold).withColumn("split", F.when(F.col("role") == "train", "train").otherwise("test")).drop("fold", "role").persist()
        try:
            for name, columns in sets.items():
                fitted = {"ridge": ridge(mine, columns, target, alpha), "mean": mean_baseline(mine, target)}
                if trees:
                    fitted["boosted"] = boosted(mine, columns, target, trees, patience=None)
                for model, out in fitted.items():
                    row = metrics(out.where("split = 'test'"), target=target).first()
                    parts.append((fold, model, name, row["n"], row["mae"], row["rmse"], row["r2"]))
        finally:
            mine.unpersist()
    if not parts or any(p[3] == 0 or math.isnan(p[4] or 0.0) for p in parts):
        raise ValueError("a fold has no validation rows")
    scores = df.sparkSession.createDataFrame(parts, "fold string, model string, configuration string, n long, mae double, rmse double, r2 double")
    return with_gain(scores)
