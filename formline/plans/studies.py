"""The studies to files: python -m formline.plans.studies pitcher|batter|pitch_type|reliability."""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline import vocab
from formline.operators import checks, reliability
from formline.sources import files
from formline.sources.files import Paths

#: Population: level-1 artifact, whose games, statistics, what is studied apart.
POPULATIONS = {
    "pitcher": ("pitcher_games", "pitcher", vocab.PITCHER_SPECS, ()),
    "batter": ("batter_games", "batter", vocab.BATTER_SPECS, ()),
    "pitch_type": ("pitch_type_games", "pitcher", vocab.PITCH_TYPE_SPECS, ("pitch_type",)),
}
SEASONS = (2021, 2022, 2023, 2024)


def specs(table: Mapping[str, tuple[str, str, int, int]]) -> dict[str, tuple[str, str, range]]:
    """A table of vocab with its targets written out."""
    return {name: (num, den, range(step, last + 1, step)) for name, (num, den, last, step) in table.items()}


def development_frame(df: DataFrame, seasons: Sequence[int] = SEASONS) -> DataFrame:
    """The rows of the study's seasons, all of which have to be there."""
    out = df.where(F.col("season").isin(*seasons))
    checks.exact_seasons(out, seasons)
    return out


def reliability_table(starts: DataFrame, window: int = 10) -> DataFrame:
    """One row for each of the study's statistics that the starts have."""
    return reliability.reliability_table(starts, dict.fromkeys(vocab.RATE_STATS, True) | dict.fromkeys(vocab.MEAN_STATS, False), window, "pitcher")


def run_reliability(spark: SparkSession, paths: Paths, seasons: Sequence[int] = SEASONS) -> DataFrame:
    """Writes the table of all statistics, their curves over starts and those over appearances and pitches, and returns the table."""
    frame = development_frame(spark.read.parquet(paths.artifact("pitcher_games")), seasons)
    place = f"{paths.output}/reliability"
    stats = dict.fromkeys(vocab.RATE_STATS, True) | dict.fromkeys(vocab.MEAN_STATS, False)
    table = reliability_table(frame)
    files.write_csv(table, f"{place}/table")
    files.write_csv(reliability.stabilization_curve(frame, stats, player="pitcher"), f"{place}/by_starts")
    files.write_csv(reliability.stabilization_by_denominator(frame, vocab.PA_PLAN, range(25, 1001, 25), "pitcher"), f"{place}/by_appearances")
    files.write_csv(reliability.stabilization_by_denominator(frame, vocab.PITCH_PLAN, range(100, 5001, 100), "pitcher"), f"{place}/by_pitches")
    return table


def run(spark: SparkSession, paths: Paths, population: str, seasons: Sequence[int] = SEASONS, n_boot: int = 300) -> DataFrame:
    """Writes the curves with their intervals and the summary as CSV and returns the summary."""
    artifact, player, table, by = POPULATIONS[population]
    frame = development_frame(spark.read.parquet(paths.artifact(artifact)), seasons)
    place = f"{paths.output}/stabilization/{population}"
    files.write(reliability.curves(frame, specs(table), player, by, n_boot), f"{place}_curve.parquet")
    curve = spark.read.parquet(f"{place}_curve.parquet")
    summary = reliability.analyze(curve, by).withColumn("population", F.lit(population))
    files.write_csv(curve, f"{place}_curve")
    files.write_csv(curve.select(*by, "stat", "denom", "target", "median", "low", "high", "valid"), f"{place}_bootstrap_ci")
    files.write_csv(summary, f"{place}_summary")
    return summary


def main(args: Sequence[str] | None = None) -> None:
    from formline.session import session

    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("study", choices=[*POPULATIONS, "reliability"])
    spark, paths, study = session(), Paths.from_environment(), parser.parse_args(args).study
    (run_reliability(spark, paths) if study == "reliability" else run(spark, paths, study)).show(200, truncate=False)


if __name__ == "__main__":
    main()
