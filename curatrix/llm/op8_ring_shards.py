"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (the `bytes` law).

Each shard owns VNODES points on a ring of hashes; a row belongs to the first point at or after the
hash of its id. Shards take at most (1 + SLACK) times the mean bytes; what overflows a full shard
goes on clockwise to the next point whose shard has room. Adding a shard moves the arcs of its own
points and the overflow that follows from them, and little else.

The ring is cut at all points, and into equal parts between them, so every cell belongs to one point.
One aggregation gives the bytes of each cell; walking the cells clockwise settles, on a table whose size
is the number of cells and not of rows, at which byte of which cell one shard ends and the next begins.
Rows then find their place from a running sum inside their own cell. How finely the ring is cut follows
the number of rows (about ROWS_PER_CELL a cell, until MAX_CELLS are made, so what the driver sees is
bounded), and changes no row's shard: bytes are dealt in ring order whatever the cells.

Defined results
- a null or empty text has size 16; a null id stands where the hash of its size and checksum is, so
  that many of them spread over the ring;
- rows that share an id keep together, ordered by size and checksum; rows equal in all three are
  interchangeable; a text of any length is one row of that size, and a shard may exceed the bound by its last row;
- equal texts under different ids are spread like any other rows;
- an empty table gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_place, mix64, staged, table

SHARDS = 40
VNODES = 128
SLACK = 0.0001
ROWS_PER_CELL = 20_000
MIN_CELLS = 1 << 12
MAX_CELLS = 1 << 20
#: A cell's number is its equal part of the ring, shifted by this, and how many points of the part lie before it.
_WITHIN = 20
OVERHEAD = 16

#: Ring positions are whole numbers below this.
_RING_BITS = 52


def ring_points(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all virtual nodes in order, and the shard of each."""
    shard = np.repeat(np.arange(shards, dtype=np.uint64), vnodes)
    node = np.tile(np.arange(vnodes, dtype=np.uint64), shards)
    at = (mix64(mix64(shard + np.uint64(1)) + node) >> np.uint64(64 - _RING_BITS)).astype(np.int64)
    order = np.lexsort((shard, at))
    return at[order], shard[order].astype(np.int64)


def flow(cells: list[tuple[int, int]], cell_bits: int, shards: int, vnodes: int, slack: float) -> list[tuple[int, int, int]]:
    """(cell, byte offset, shard) for every stretch of every cell, from the bytes of each cell.

    First every arc fills its own shard up to the bound, clockwise; then what is left over goes on
    clockwise from where it stands to the next points whose shards have room.
    """
    total = sum(b for _, b in cells)
    bound = -(-total // shards) if not slack else int(total / shards * (1 + slack)) + 1
    room = [bound] * shards
    points, owner = ring_points(shards, vnodes)
    first = np.searchsorted(points, np.arange(1 << cell_bits) << (_RING_BITS - cell_bits)).tolist()
    olist = owner.tolist()
    out, over = [], []
    for cell, size in sorted(cells):
        i = (first[cell >> _WITHIN] + (cell & ((1 << _WITHIN) - 1))) % len(olist)
        own = olist[i]
        fits = min(size, room[own])
        if fits:
            out.append((cell, 0, own))
            room[own] -= fits
        if fits < size:
            over.append((cell, fits, size, i))
    following = list(range(len(olist)))  # the next point that may have room, with path halving

    def next_free(i: int) -> int:
        seen = []
        while room[olist[i]] <= 0:
            seen.append(i)
            i = following[i] if following[i] != i else (i + 1) % len(olist)
        for j in seen:
            following[j] = i
        return i

    for cell, at, size, i in over:
        while at < size:
            i = next_free(i)
            take = min(size - at, room[olist[i]])
            out.append((cell, at, olist[i]))
            room[olist[i]] -= take
            at += take
    return sorted(out)


def place(row_id, size, crc):
    """A row's place on the ring."""
    h = F.when(row_id.isNotNull(), F.xxhash64(row_id)).otherwise(F.xxhash64(size, crc))
    return F.shiftrightunsigned(h, 64 - _RING_BITS)


def _cell(rows: DataFrame, bits: int, shards: int, vnodes: int) -> DataFrame:
    """rows with the cell of each: its equal part of the ring, and how many of that part's points lie before the row."""
    points, shift = ring_points(shards, vnodes)[0], _RING_BITS - bits
    parts, starts = np.unique(points >> shift, return_index=True)
    inside = [(int(p), x.tolist()) for p, x in zip(parts, np.split(points, starts[1:]), strict=True)]
    # One number for each virtual node.
    known = F.broadcast(rows.sparkSession.createDataFrame(inside, "part bigint, points array<bigint>"))
    before = F.coalesce(F.size(F.filter("points", lambda p: p < F.col("at"))), F.lit(0))
    found = rows.withColumn("part", F.shiftright("at", shift)).join(known, "part", "left")
    return found.withColumn("cell", F.shiftleft("part", _WITHIN) + before).drop("part", "points")


def assign(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, vnodes: int = VNODES, slack: float = SLACK,
    rows_per_cell: int = ROWS_PER_CELL, max_cells: int = MAX_CELLS,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row for each row of docs."""
    flat, name = by_place(docs)
    body = F.encode(F.coalesce(F.col(name[text]), F.lit("")), "UTF-8")
    facts = flat.select(F.col(name[doc_id]).alias("id"), (F.length(body) + OVERHEAD).cast("bigint").alias("size"), F.crc32(body).alias("crc"))
    rows = staged(facts.withColumn("at", place(F.col("id"), F.col("size"), F.col("crc"))), "shard-rows")
    spark = docs.sparkSession
    n = rows.count()
    bits = max(MIN_CELLS.bit_length() - 1, min((n // rows_per_cell).bit_length(), max_cells.bit_length() - 1))
    rows = _cell(rows, bits, shards, vnodes)
    sizes = [(r[0], r[1]) for r in rows.groupBy("cell").agg(F.sum("size")).toLocalIterator()]
    cuts = flow(sizes, bits, shards, vnodes, slack)
    by_cell: dict[int, list] = {}
    for cell, at, shard in cuts:
        by_cell.setdefault(cell, []).append((at, shard))
    # At most one stretch for each cell and one more for each shard and wrap: bounded like the cells.
    plan = spark.createDataFrame(list(by_cell.items()), "cell bigint, cuts array<struct<start:bigint,shard:int>>")
    order = [F.col("at"), F.col("id").asc_nulls_first(), F.col("size"), F.col("crc")]
    before = F.sum("size").over(Window.partitionBy("cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    shard = F.aggregate("cuts", F.lit(-1), lambda a, c: F.when(c["start"] <= F.col("before"), c["shard"]).otherwise(a))
    placed = (
        rows.withColumn("before", F.coalesce(before, F.lit(0)))
        .join(F.broadcast(plan), "cell")
        .withColumn("shard", shard)
        .withColumn("n", F.row_number().over(Window.partitionBy("cell", "shard").orderBy(*order)))
        .select("id", "size", "crc", "cell", "shard", "n")
    )
    placed = staged(placed, "shard-places")
    counts = sorted((r[1], r[0], r[2]) for r in placed.groupBy("cell", "shard").count().toLocalIterator())
    base, offsets, last = 0, [], None
    for s, cell, k in counts:
        base = 0 if s != last else base
        offsets.append((cell, s, base))
        base, last = base + k, s
    starts = spark.createDataFrame(offsets, "cell bigint, shard int, base bigint")
    return placed.join(F.broadcast(starts), ["cell", "shard"]).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("base") + F.col("n") - 1).cast("bigint").alias("slot")
    )


def op8_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents in shards 0 to 39 under the `bytes` law."""
    out = assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
