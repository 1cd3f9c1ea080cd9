"""Player identities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formline.functions import expr as X
from formline.operators import checks


def player_map(register: DataFrame, order: str | None = None) -> DataFrame:
    """(mlb_id, player_name) from a register with MLBID, MLBNAME, PLAYERNAME as text; bad ids and blank names go, the first row of an id in file order stays."""
    place = F.col(order) if order else F.monotonically_increasing_id()
    rows = register.select(F.expr("try_cast(MLBID as bigint)").alias("mlb_id"), F.trim(F.coalesce(F.col("MLBNAME").cast("string"), F.col("PLAYERNAME").cast("string"))).alias("player_name"), place.alias("_at"))
    rows = rows.where("mlb_id is not null and player_name is not null and player_name <> ''")
    return keep(rows, ["mlb_id"], "_at").drop("_at").orderBy("mlb_id")


def load_player_map(spark: SparkSession, path: str, register: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The player map stored at path; made from the register's rows and stored first where there is none, or on refresh."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if refresh or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        player_map(register(), "_place").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def keep(df: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """One row of each key: the first by order, or the last."""
    over = Window.partitionBy(*keys).orderBy(F.desc(order) if last else F.asc(order))
    return df.withColumn("_rn", F.row_number().over(over)).where("_rn = 1").drop("_rn")


def attach_name(df: DataFrame, players: DataFrame, id_column: str, name: str, check: bool = True) -> DataFrame:
    """df with the name of id_column, null where players has none; ids are compared in df's type."""
    if check:
        checks.unique_keys(players, ("mlb_id",), "players")
    side = players.select(F.col("mlb_id").cast(df.schema[id_column].dataType).alias(id_column), F.col("player_name").alias(name))
    return df.drop(name).join(side, id_column, "left")


def pitcher_names(df: DataFrame, players: DataFrame, check: bool = True) -> DataFrame:
    """pitcher_name: the register's spelling, else the feed's "Last, First" turned round."""
    return attach_name(df, players, "pitcher", "pitcher_name", check).withColumn("pitcher_name", F.coalesce("pitcher_name", X.first_last("player_name")))


def batter_names(df: DataFrame, players: DataFrame, check: bool = True) -> DataFrame:
    return attach_name(df, players, "batter", "batter_name", check)


def unmapped(df: DataFrame, id_column: str, name_column: str) -> DataFrame:
    """Ids that have no name."""
    return df.where(F.col(name_column).isNull() | (F.trim(name_column) == "")).select(id_column).distinct().orderBy(id_column)


def require_names(df: DataFrame, id_column: str, name_column: str) -> None:
    if found := unmapped(df, id_column, name_column).limit(5).collect():
        raise ValueError(f"players without name: {[r[0] for r in found]}")


def missing_ids(df: DataFrame, players: DataFrame, id_column: str) -> DataFrame:
    """Ids of df that players lacks, in chunks of 100 at most, as the people service takes them: (mlb_id, chunk). Chunks are numbered with gaps, no task sees all ids."""
    ids = df.select(F.col(id_column).cast("long").alias("mlb_id")).where("mlb_id is not null").distinct().join(players.select("mlb_id"), "mlb_id", "left_anti")
    return ids.repartitionByRange("mlb_id").sortWithinPartitions("mlb_id").withColumn("chunk", F.floor(F.monotonically_increasing_id() / 100))


def complete(players: DataFrame, people: DataFrame) -> DataFrame:
    """players with rows of people (mlb_id, player_name) added; the later spelling of an id stays."""
    both = players.select("mlb_id", "player_name", F.lit(0).alias("_at")).unionByName(people.select("mlb_id", "player_name", F.lit(1).alias("_at")))
    return keep(both, ["mlb_id"], "_at", last=True).drop("_at").orderBy("mlb_id")
