"""Files in and out: season files, registers, feeds, artifacts."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline import vocab
from formline.functions import expr as X
from formline.operators import checks


@dataclass(frozen=True)
class Paths:
    """Where things are; environment variables override the defaults below `data`."""

    data: str = "data"
    output: str = "output"

    @classmethod
    def from_environment(cls) -> Paths:
        return cls(os.environ.get("FORMLINE_DATA", "data"), os.environ.get("FORMLINE_OUTPUT", "output"))

    def artifact(self, name: str) -> str:
        return f"{self.output}/{name}.parquet"


def season_path(root: str, year: int) -> str:
    return f"{root}/{year}/statcast_{year}_regular.parquet"


def load_seasons(spark: SparkSession, root: str, years: Sequence[int], columns: Sequence[str] | None = None) -> DataFrame:
    """Season files united by name: columns that a file lacks are null, ones that no file has are left out, types widen. Only what is asked for is read, and the keys that validation wants."""
    if not years:
        raise ValueError("no seasons")
    return united(spark, [season_path(root, year) for year in years], None if columns is None else [*columns, "game_pk", "game_date", "game_year"])


def united(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet tables united by name, see load_seasons()."""
    frames = []
    for path in paths:
        df = spark.read.parquet(path)
        frames.append(df if columns is None else df.select(*[c for c in dict.fromkeys(columns) if c in df.columns]))
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def publish_season(df: DataFrame, year: int, official: Sequence[int], root: str) -> str:
    """A fetched season to its file: NaN to null, keys cast, regular games alone, held against the official games before anything is written."""
    df = nan_to_null(df).withColumns({"game_date": F.col("game_date").cast("date"), "game_year": F.col("game_year").cast("int"), "game_pk": F.col("game_pk").cast("long")})
    if "game_type" in df.columns:
        df = df.where("game_type = 'R'")
    checks.season_table(df, year, official)
    path = season_path(root, year)
    write(df, path)
    return path


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of float columns becomes null, as everything behind expects."""
    return df.withColumns({f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)) for f in df.schema.fields if f.dataType.typeName() in ("double", "float")})


def write(df: DataFrame, path: str) -> None:
    """The whole table, published at once by Spark's commit protocol."""
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(value: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True, default=str) + "\n")


def register(spark: SparkSession, path: str) -> DataFrame:
    """A player register from CSV, all columns as text, with the place of each row."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).withColumn("_place", F.monotonically_increasing_id())


def schedule_ids(feed: DataFrame, kind: str = "R") -> DataFrame:
    """(first, last, games) of a schedule feed of nested dates and games; no games of the kind raise on reading the single row."""
    games = feed.select(F.explode("dates").alias("d")).select(F.col("d.date").alias("date"), F.explode("d.games").alias("g")).where(F.col("g.gameType") == kind)
    out = games.agg(F.min(F.to_date("date")).alias("first"), F.max(F.to_date("date")).alias("last"), F.sort_array(F.collect_set(F.col("g.gamePk").cast("long"))).alias("games"))
    return out.withColumn("games", F.when(F.size("games") == 0, F.raise_error("the schedule has no such games")).otherwise(F.col("games")))


SCHEDULE = "dates array<struct<date:string,games:array<struct<gamePk:bigint,gameType:string,gameDate:string,status:struct<detailedState:string>,teams:struct<away:struct<team:struct<id:bigint>,probablePitcher:struct<id:bigint>>,home:struct<team:struct<id:bigint>,probablePitcher:struct<id:bigint>>>>>>>"


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEDULE).option("multiLine", True).json(path)


def schedule(feed: DataFrame) -> DataFrame:
    """Flat schedule rows of games between known teams, with game times in UTC and probable pitchers where there are any."""
    code = {i: c for c, i in vocab.TEAM_IDS.items()}
    g = feed.select(F.explode("dates").alias("d")).select(F.to_date("d.date").alias("game_date"), F.explode("d.games").alias("g"))
    out = g.select(
        F.col("g.gamePk").alias("game_pk"),
        "game_date",
        F.to_timestamp("g.gameDate").alias("game_time"),
        F.col("g.status.detailedState").alias("game_status"),
        *[X.lookup(F.col(f"g.teams.{side}.team.id").cast("int"), code).alias(f"{side}_team") for side in ("away", "home")],
        *[F.col(f"g.teams.{side}.team.id").alias(f"{side}_team_id") for side in ("away", "home")],
        *[F.col(f"g.teams.{side}.probablePitcher.id").alias(f"{side}_probable_pitcher_id") for side in ("away", "home")],
    )
    return out.where("away_team is not null and home_team is not null")


ROSTER = "team_id bigint, roster array<struct<person:struct<id:bigint,fullName:string>>>"
PEOPLE = "people array<struct<id:bigint,fullName:string>>"


def read_rosters(spark: SparkSession, path: str) -> DataFrame:
    return rosters(spark.read.schema(ROSTER).option("multiLine", True).json(path))


def rosters(feed: DataFrame) -> DataFrame:
    """(team_id, mlb_id, player_name), once for each team and player, from feeds {team_id, roster: [{person: {id, fullName}}]}."""
    rows = feed.select("team_id", F.explode("roster").alias("r")).select("team_id", F.col("r.person.id").alias("mlb_id"), F.col("r.person.fullName").alias("player_name"))
    return rows.groupBy("team_id", "mlb_id").agg(F.min("player_name").alias("player_name"))


def read_people(spark: SparkSession, path: str) -> DataFrame:
    return people(spark.read.schema(PEOPLE).option("multiLine", True).json(path))


def people(feed: DataFrame) -> DataFrame:
    """(mlb_id, player_name) of people feeds."""
    return feed.select(F.explode("people").alias("p")).select(F.col("p.id").alias("mlb_id"), F.col("p.fullName").alias("player_name"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of whole text files."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("html"))
