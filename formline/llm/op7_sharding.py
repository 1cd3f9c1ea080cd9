"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, with DataFrame functions only.

The ring has 4,096 cells. Each shard owns 64 virtual nodes on it, and a row belongs to the cell its doc_id hashes to and at
home to the owner of the first virtual node at or after that cell. Loads are bounded exactly: the n rows leave each of k shards
floor(n / k) or ceil(n / k) places. Rows at home take places first, in clockwise order of cells; rows that find their
shard full continue clockwise to the next virtual nodes whose shards have room. Only the counts of the 4,096 cells
come to the driver, a bound that does not depend on the data; it turns them into runs (cell, first rank, shard, first slot),
and each row finds its run by its rank within its cell. So no shard is ever gathered in one task, slots are gapless without a
window over a shard, and copies of one text are as spread as any rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formline.llm.common import documents, literal_rows, materialize

SHARDS = 16
VIRTUAL_NODES = 64
_HEX_DIGITS = 3
CELLS = 16**_HEX_DIGITS


def ring(shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes, clockwise. A cell has one at most: a later one moves on to the next free cell."""
    if shards * virtual_nodes > CELLS:
        raise ValueError(f"{shards} shards of {virtual_nodes} virtual nodes do not fit on {CELLS} cells")
    taken: dict[int, int] = {}
    for v in range(virtual_nodes):
        for s in range(shards):
            cell = int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:_HEX_DIGITS], 16)
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = s
    return sorted(taken.items())


def fill(counts: dict[int, int], shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES) -> list[dict]:
    """Rows in each cell to the runs that say where they go: cell, first rank (from 0), shard and the slot of the run's first row."""
    nodes = ring(shards, virtual_nodes)
    n = sum(counts.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    load = [0] * shards
    home, at = {}, 0
    for cell in range(CELLS):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        home[cell] = at % len(nodes)
    runs = []

    def put(cell: int, rank: int, shard: int, most: int) -> int:
        if k := min(most, room[shard] - load[shard]):
            runs.append({"cell": cell, "rank": rank, "shard": shard, "slot": load[shard]})
            load[shard] += k
        return k

    over = []
    for cell in sorted(counts):
        k = put(cell, 0, nodes[home[cell]][1], counts[cell])
        if k < counts[cell]:
            over.append((cell, k))
    for cell, k in over:
        node = home[cell]
        while k < counts[cell]:
            node = (node + 1) % len(nodes)
            k += put(cell, k, nodes[node][1], counts[cell] - k)
    return runs


def cell_of(doc_id: Column, *instead: Column) -> Column:
    """The cell of a doc_id; of a null one that of what stands instead of it."""
    none = F.concat_ws(":", F.lit("null"), *[F.coalesce(c.cast("string"), F.lit("")) for c in instead])
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), none).cast("binary")), 1, _HEX_DIGITS), 16, 10).cast("int")


def shard(df: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """df with shard (int, from 0) and slot (long, gapless from 0 in each shard). Row counts of shards differ by one at most.

    df is read twice and has to give the same rows both times. Order within a cell: doc_id, then size and text_crc32 where df has
    them. Repeated rows take neighbouring places in any order. A null doc_id hashes as such, with size and text_crc32. An empty table gives an empty result.
    Columns of df named shard, slot or _r_* are replaced.
    """
    ties = [c for c in ("size", "text_crc32") if c in df.columns]
    base = df.drop("shard", "slot").withColumn("_r_cell", cell_of(F.col("doc_id"), *map(F.col, ties)))
    counts = {r[0]: r[1] for r in base.groupBy("_r_cell").count().collect()}  # CELLS rows at most
    base = base.withColumn("_r_rank", F.row_number().over(Window.partitionBy("_r_cell").orderBy("doc_id", *ties)).cast("long") - 1)
    runs = literal_rows(df.sparkSession, fill(counts, shards, virtual_nodes), "cell int, rank long, shard int, slot long")
    # a cell's runs in one row: one match a row of df, and a table of CELLS rows at most
    runs = runs.groupBy(F.col("cell").alias("_r_cell")).agg(F.array_sort(F.collect_list(F.struct("rank", "shard", "slot"))).alias("_r_runs"))
    out = base.join(F.broadcast(runs), "_r_cell")
    out = out.withColumn("_r_run", F.element_at(F.filter("_r_runs", lambda x: x["rank"] <= F.col("_r_rank")), -1))
    out = out.withColumns({"shard": F.col("_r_run.shard"), "slot": F.col("_r_run.slot") + F.col("_r_rank") - F.col("_r_run.rank")})
    return out.drop("_r_cell", "_r_rank", "_r_runs", "_r_run")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law `rows`: doc_id, size, text_crc32, law, shard, slot, grown_shard (null). A null text has size 1 and crc 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard(materialize(docs, "op7-sizes"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
