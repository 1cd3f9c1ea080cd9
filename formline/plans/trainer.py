"""Train a model on the training frame and report on it: python -m formline.plans.trainer --model boosted|ridge|mean."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.operators import checks, modelling
from formline.sources import files
from formline.sources.files import Paths

MODELS = ("boosted", "ridge", "mean")


def load_frame(spark: SparkSession, paths: Paths) -> tuple[DataFrame, tuple[str, ...]]:
    """Rows of the pitchers' training frame that have a target and a date, and the features that a model may see. A frame that is not there raises."""
    frame = spark.read.parquet(paths.artifact("pitcher_training"))
    return frame.where(F.col(modelling.TARGET).isNotNull() & F.col("game_date").isNotNull()).withColumn("game_date", F.col("game_date").cast("date")), checks.model_features(frame)


def predicted(split: DataFrame, features: Sequence[str], model: str) -> DataFrame:
    if model not in MODELS:
        raise ValueError(f"no model {model}, but {MODELS}")
    if model == "mean":
        return modelling.mean_baseline(split)
    return (modelling.boosted if model == "boosted" else modelling.ridge)(split, features)


def evaluate(frame: DataFrame, features: Sequence[str], model: str) -> dict:
    """Rows, boundary dates and scores of the parts of a chronological split."""
    split = modelling.chronological_split(frame)
    rows = predicted(split, features, model).groupBy("split").agg(F.count("*").alias("rows"), F.min("game_date").alias("first"), F.max("game_date").alias("last"))
    parts = {r["split"]: r for r in rows.collect()}
    scores = {r["split"]: {k: r[k] for k in ("mae", "rmse", "r2")} for r in modelling.metrics(predicted(split, features, model), by=["split"]).collect()}
    return {
        "model": model,
        "features": len(features),
        "rows": {p: parts[p]["rows"] for p in ("train", "validation", "test")},
        "cutoffs": {"train_end": str(parts["train"]["last"]), "validation_start": str(parts["validation"]["first"]), "validation_end": str(parts["validation"]["last"]), "test_start": str(parts["test"]["first"])},
        "validation": scores["validation"],
        "test": scores["test"],
    }


def run(spark: SparkSession, paths: Paths, model: str) -> dict:
    """The report, stored with the features, their order's digest and the model's name beside it."""
    frame, features = load_frame(spark, paths)
    report = evaluate(frame, features, model)
    files.write_json({"features": list(features), "ordered_feature_sha256": modelling.feature_digest(features), "evaluation": report}, f"{paths.output}/{model}_k_rate.json")
    return report


def main(args: Sequence[str] | None = None) -> None:
    from formline.session import session

    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--model", choices=MODELS, default="boosted")
    print(json.dumps(run(session(), Paths.from_environment(), parser.parse_args(args).model), indent=2))


if __name__ == "__main__":
    main()
