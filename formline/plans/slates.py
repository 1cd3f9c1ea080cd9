"""The daily slate from files: python -m formline.plans.slates 2025-06-01 --pages DIR --schedule FILE --active DIR --out DIR."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from formline.functions import expr as X
from formline.operators import slate
from formline.sources import files


def run(spark: SparkSession, day: str | None, pages: str, schedule: str, active: str, out: str, wider: str | None = None, aliases: str | None = None, confirmed: bool = False) -> tuple[str, str]:
    """Lineups and starters of a day, today's in New York if none is given, in two tables; their paths. aliases: CSV of team_id, player_name, mlb_id."""
    day = day or str(spark.range(1).select(X.local_date(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))).first()[0])
    read = files.read_pages(spark, pages).select("html", F.lit(day).cast("date").alias("game_date"), F.current_timestamp().alias("fetched_at"))
    plan = files.schedule(files.read_schedule(spark, schedule)).where(F.col("game_date") == F.lit(day).cast("date"))
    other = spark.read.option("header", True).schema("team_id bigint, player_name string, mlb_id bigint").csv(aliases) if aliases else None
    built = slate.build(read, plan, files.read_rosters(spark, active), files.read_rosters(spark, wider) if wider else None, other, confirmed)
    return slate.write(built, out)


def main(args: Sequence[str] | None = None) -> None:
    from formline.session import session

    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("day", nargs="?")
    for name in ("pages", "schedule", "active", "out"):
        parser.add_argument(f"--{name}", required=True)
    for name in ("wider", "aliases"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--confirmed", action="store_true", help="no projected lineups")
    print(*run(session(), **vars(parser.parse_args(args))), sep="\n")


if __name__ == "__main__":
    main()
