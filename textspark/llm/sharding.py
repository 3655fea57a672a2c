"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring has ``CELLS`` cells. Each shard holds virtual nodes at hashed cells; a
key belongs to the first node clockwise from its cell. A shard takes no more
than its bound; what a full shard cannot take continues clockwise to the next
node of a shard with room. The bound of all shards sums to the row count, so
shard sizes are at most one apart.

Only the row count of each cell reaches the driver: ``CELLS`` numbers, however
large the table is. The walk round the ring there gives, for each cell, ranges
of ranks within the cell and the shard and first slot of each range. A row
finds its range by its rank in its cell: the rows of the cell in earlier parts
of the table, and its place among those of its own part. A cell is ranked part
by part, so that one key with a third of all rows is no hot spot. What is
shuffled are row keys and sizes, never texts.
"""

from __future__ import annotations

from bisect import bisect_left

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import saved, sized

CELLS = 1 << 14
VIRTUAL_NODES = 128
#: Parts of the table by which the rows of a cell are ranked.
PARTS_OF_CELL = 256
#: Counts of cells by part that may be broadcast (16 bytes each); beyond that they are joined in a shuffle.
PARTS = 100_000


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in clockwise order; adding a shard adds nodes and moves none."""
    return sorted((xxhash.xxh64_intdigest(f"{s}:{v}".encode()) % cells, s) for s in range(shards) for v in range(virtual_nodes))


def walk(counts: dict[int, int], shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot) for the rows counted in each cell.

    Cells are served clockwise from cell 0. Rows that a full shard cannot take
    go on to the next node clockwise whose shard has room.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    taken = [0] * shards
    nodes = ring(shards, virtual_nodes, cells)
    at = [c for c, _ in nodes]
    out = []
    for cell in sorted(counts):
        rank, left, k = 0, counts[cell], bisect_left(at, cell)
        while left:
            shard = nodes[k % len(nodes)][1]
            n = min(left, room[shard])
            if n:
                out.append((cell, rank, rank + n, shard, taken[shard]))
                room[shard] -= n
                taken[shard] += n
                rank += n
                left -= n
            k += 1
    return out


def shard(documents: DataFrame, shards: int = 16, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """One row for each row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``rows``: row counts of the shards are at most one apart. ``size`` is
    the text's UTF-8 bytes plus 1; a null text has size 1 and a null
    text_crc32. A null doc_id has a cell like any key; rows that repeat a
    doc_id share its cell. ``slot`` counts from 0 without gaps in each shard.
    Rows of a cell follow each other by part of the table, then by a hash of
    the doc_id, doc_id, text_crc32 and size. Other columns are not read. An
    empty table gives an empty result.
    """
    cell = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(CELLS)).cast("int")
    rows = saved(documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        cell.alias("cell"), F.pmod(F.spark_partition_id(), F.lit(PARTS_OF_CELL)).alias("part"),
    ), "keys")
    parts = rows.groupBy("cell", "part").agg(F.count("*").alias("n"))
    parts = saved(parts.withColumn("before", F.sum("n").over(Window.partitionBy("cell").orderBy("part")) - F.col("n")), "parts")
    counts = {r.cell: r.n for r in parts.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    schema = T.StructType([T.StructField(c, T.LongType() if c not in ("cell", "shard") else T.IntegerType(), False) for c in ("cell", "low", "high", "shard", "slot0")])
    ranges = documents.sparkSession.createDataFrame(walk(counts, shards, virtual_nodes), schema)
    order = Window.partitionBy("cell", "part").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("row", F.row_number().over(order).cast("long") - 1).join(sized(parts.drop("n"), PARTS), ["cell", "part"]).withColumn("rank", F.col("row") + F.col("before"))
    found = ranked.join(F.broadcast(ranges), "cell").where("rank >= low and rank < high")
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot0") + F.col("rank") - F.col("low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
