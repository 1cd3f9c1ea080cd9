"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key. Within a source, rows stand in key order, cut into 4,096 key ranges; sums
per (source, range) give each range's offset by a prefix sum over at most 4,096 rows a source. Only the one range of a
source in which its budget ends needs an exact running sum over its rows; all others are wholly in or wholly out.
So a source that holds a third of all rows is never gathered; the text is not shuffled unless there are more than BROADCAST_SOURCES sources.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formline.llm.common import WORD, documents, materialize, n_words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = 7
#: Sources whose budgets are broadcast at most, a row of some 100 bytes each; beyond, rows meet them by a shuffled join.
BROADCAST_SOURCES = 100_000
_HEX_DIGITS = 3  # 16 ** 3 key ranges


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target): sources by code point, null last, take the weights in turn.

    All targets together are share * all sizes; a target stops at most * source_size and what it leaves is shared again by weight.
    That fixed point is found at once: in ascending order of limit / weight, the sources before the first one whose
    proportional share stays below its limit are full, and the rest share what is left by weight.
    The windows run over one row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    turn = F.element_at(F.array(*map(F.lit, map(float, weights))), ((rank - 1) % len(weights) + 1).cast("int"))
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full_first = Window.orderBy("fills_at", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.col("source_size").cast("double")).over(all_rows)
    df = sizes.select("source", "source_size", turn.alias("w"), (total * share).alias("all_targets"))
    df = df.withColumn("limit", F.col("source_size") * F.lit(most)).withColumn("fills_at", F.col("limit") / F.col("w"))
    df = df.withColumn("w_all", F.sum("w").over(all_rows))
    left = F.col("all_targets") - F.coalesce(F.sum("limit").over(full_first), F.lit(0.0))
    weight_left = F.col("w_all") - F.coalesce(F.sum("w").over(full_first), F.lit(0.0))
    df = df.withColumn("level", left / weight_left)
    # the first source that its share does not fill sets the level for itself and all after it
    level = F.min_by(F.when(F.col("level") <= F.col("fills_at"), F.col("level")), F.when(F.col("level") <= F.col("fills_at"), F.col("fills_at"))).over(all_rows)
    return df.withColumn("level", level).select("source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("w"), F.col("limit"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, size: str | None = None) -> DataFrame:
    """docs with size, source_size, target, epochs and taken.

    taken is epochs * size and, for rows before the point where the source's budget ends, once more the size; the row in which it
    ends adds just what is missing, so a source's taken words add up to its target rounded down. size names a column that
    has the sizes already. Nulls: a null text has size 0, a null source is a source of its own that comes last, rows with a null doc_id
    are hashed by size. Ties and repeated rows: rows with equal doc_id stand together, by size; equal rows are interchangeable.
    Columns of docs named like a result column or like _m_* give way to the result. An empty table gives an empty result.
    """
    base = docs.drop("source_size", "target", "epochs", "taken", *([] if size == "size" else ["size"]))
    base = base.withColumn("size", F.col(size) if size else n_words(F.col("text")))
    # rows without doc_id are spread by size
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("size").cast("string"))), F.lit(str(seed)))
    base = base.withColumn("_m_key", F.md5(key.cast("binary"))).withColumn("_m_range", F.conv(F.substring("_m_key", 1, _HEX_DIGITS), 16, 10).cast("int"))
    ranges = base.groupBy("source", "_m_range").agg(F.sum("size").alias("n"))
    sizes = source_targets(ranges.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, most)
    sizes = sizes.withColumn("budget", F.floor("target"))
    sizes = sizes.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0))
    sizes = sizes.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    up_to = Window.partitionBy("source").orderBy("_m_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0)))
    ends = ranges.alias("r").join(sizes.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    # the range in which the rest ends: the last one that starts at or below it
    ends = ends.where(F.col("before") <= F.col("rest")).groupBy("s.source", "source_size", "target", "epochs", "rest").agg(F.max("_m_range").alias("_m_end"), F.max("before").alias("_m_before"))
    ends = ends.select(F.col("source").alias("_m_source"), "source_size", "target", "epochs", F.col("rest").alias("_m_rest"), "_m_end", "_m_before")
    ends = materialize(ends, "op9-budgets")
    few = ends.count() <= BROADCAST_SOURCES
    rows = base.join(F.broadcast(ends) if few else ends, F.col("source").eqNullSafe(F.col("_m_source")))
    cut = rows.where(F.col("_m_range") == F.col("_m_end"))
    whole = rows.where(F.col("_m_range") != F.col("_m_end")).withColumn("_m_last", F.when(F.col("_m_range") < F.col("_m_end"), F.col("size")).otherwise(0))
    order = Window.partitionBy("_m_source").orderBy("_m_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_m_rest") - F.col("_m_before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    cut = cut.withColumn("_m_last", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    out = whole.unionByName(cut).withColumn("taken", F.col("epochs") * F.col("size") + F.col("_m_last"))
    return out.drop(*[c for c in out.columns if c.startswith("_m_")])


def emit(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of docs, whole and with all its columns, whatever their names, as often as mix() takes its words.

    The row in which a source's budget ends is there once more if the budget takes half of its words or more. Rows without words are there
    as often as whole epochs ask for. Nulls, ties and empty tables: as in mix().
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    mixed = mix(docs.select(row, "doc_id", "source", n_words(F.col("text")).alias("size")), weights, share, most, seed, "size")
    part = F.col("taken") - F.col("epochs") * F.col("size")
    copies = F.col("epochs") + F.when((part > 0) & (2 * part >= F.col("size")), 1).otherwise(0)
    return mixed.where(copies > 0).select("row", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the mix, see mix(): doc_id, size, source_size, target, taken."""
    sized = materialize(documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("size")), "op9-sizes")
    return mix(sized, size="size").select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null:' || len(regexp_extract_all(coalesce(text, ''), '{WORD}'))) || ':{SEED}') AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM d GROUP BY source),
f AS (SELECT *, source_size * 2.0::DOUBLE AS lim, source_size * 2.0::DOUBLE / w AS fills_at, 1.5::DOUBLE * sum(source_size::DOUBLE) OVER () AS all_targets, sum(w) OVER () AS w_all FROM s),
l AS (
  SELECT *, (all_targets - coalesce(sum(lim) OVER o, 0)) / (w_all - coalesce(sum(w) OVER o, 0)) AS lev
  FROM f WINDOW o AS (ORDER BY fills_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(lim, coalesce((SELECT arg_min(lev, fills_at) FROM l WHERE lev <= fills_at) * w, lim)) AS target FROM l),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
r AS (
  SELECT doc_id, size, source_size, target, epochs, CAST(floor(target) AS BIGINT) - epochs * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM r
"""
