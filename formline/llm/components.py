"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import materialize, release, scratch_tables


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node of its component.

    Alternating stars: in one round every node hands its larger neighbours, then its smaller ones, over to the smallest node that it
    knows; the rows stay one star per component in the end, and rounds grow with the logarithm of the longest path. A node's neighbours are never
    gathered: their minimum is an aggregate, joined back. Each round is stored, so a lost executor costs one round, and the table of the
    round before is deleted. A node with very many edges is one key of an aggregate with partial sums and of a join, which adaptive execution splits.
    """
    spark, made = edges.sparkSession, []

    def stored(df: DataFrame) -> DataFrame:
        """df as a table; the one of the round before is deleted."""
        old, made[:] = list(made), []
        with scratch_tables(made):
            out = materialize(df, name)
        release(spark, old)
        return out

    now = stored(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while True:
        # large star: neighbours above u, and u itself, to the smallest neighbour of u (or u)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below u, and u itself, to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last = sign
