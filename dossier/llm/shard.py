"""Sharding along a Hilbert curve, with DataFrame functions alone.

Language, source and length are quantised to 4 bits each, the cell's place on the three-dimensional Hilbert curve orders
the rows, and runs of that order are cut into shards, so that a file holds a compact box of metadata and can be skipped by
any of the three. Law `rows`: shard sizes differ by one row at most. Ranks come from four levels of counts (curve cell, one
of 4096 hash prefixes within the cell, longer prefix within that, row within the longer prefix), so no task sees more than
4096 rows of a cell, or a prefix's own. Rows are told apart by a hash of doc_id and length; rows alike in both, and in
metadata, share one longest prefix.

Defined results: a null or empty text has size 8 and checksum 0; null metadata fall into fixed cells; repeated rows get
slots of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS, DIMS, SHARDS = 4, 3, 24
#: Hex digits of the first prefix.
COARSE = 3


def rotate(x: int, by: int) -> int:
    by %= DIMS
    return ((x << by) | (x >> (DIMS - by))) & ((1 << DIMS) - 1)


def gray_rank(x: int) -> int:
    out = 0
    while x:
        out ^= x
        x >>= 1
    return out


def entry(w: int) -> int:
    """Where the curve enters its w-th child cube."""
    e = 2 * ((w - 1) // 2) if w else 0
    return e ^ (e >> 1)


def direction(w: int) -> int:
    """The axis along which the curve crosses its w-th child cube."""
    x = w if w % 2 else max(w - 1, 0)
    return (x ^ (x + 1)).bit_length() - 1 if w else 0


def transitions() -> dict[str, list[int]]:
    """For each (entry, direction, octant): the child's number and the state within it."""
    child, state = [], []
    for s in range((1 << DIMS) * DIMS):
        e, d = divmod(s, DIMS)
        for octant in range(1 << DIMS):
            w = gray_rank(rotate(octant ^ e, -(d + 1)))
            child.append(w)
            state.append((e ^ rotate(entry(w), d + 1)) * DIMS + (d + direction(w) % DIMS + 1) % DIMS)
    return {"child": child, "state": state}


def hilbert(*dims: Column) -> Column:
    """The index on the curve of a cell whose coordinates have BITS bits each."""
    table = transitions()
    child, state = (F.array(*map(F.lit, table[k])) for k in ("child", "state"))
    octants = F.array(
        *(sum((((F.shiftright(x.cast("int"), b) % 2) * (1 << k)) for k, x in enumerate(dims)), F.lit(0))
          for b in reversed(range(BITS)))
    )

    def step(acc, octant):
        at = acc["state"] * (1 << DIMS) + octant
        return F.struct(
            F.get(state, at).alias("state"), (acc["index"] * (1 << DIMS) + F.get(child, at)).alias("index")
        )

    start = F.struct(F.lit(0).alias("state"), F.lit(0).alias("index"))
    return F.aggregate(octants, start, step, lambda acc: acc["index"])


def hashed_cell(col: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 1), 16, 10).cast("int")


def length_cell(n: Column) -> Column:
    """The bit length of n, from 3 bits up."""
    return F.least(F.lit(15), F.greatest(F.lit(0), F.length(F.bin(F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)))) - 3))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("n_chars").cast("string"), F.lit("")))
    meta = [
        hilbert(hashed_cell(F.col("lang")), hashed_cell(F.col("source")), length_cell(F.col("n_chars"))).alias("cell"),
        F.md5(key).alias("mixed"),
    ]
    rows = docs.count()
    # Hex digits of the longer prefix: one of the fullest cell has some hundred rows, whatever the table's size.
    digits = COARSE + (max(1, math.ceil(math.log(rows / 1024, 16)) - COARSE) if rows > 1024 else 1)
    coarse, prefix = (F.substring("mixed", 1, k) for k in (COARSE, digits))
    counts = docs.select(*meta).groupBy("cell", coarse.alias("coarse"), prefix.alias("prefix")).agg(F.count("*").alias("n"))
    by_coarse = counts.groupBy("cell", "coarse").agg(F.sum("n").alias("n"))
    by_cell = by_coarse.groupBy("cell").agg(F.sum("n").alias("n"))

    def before(df, order, *within):
        w = (Window.partitionBy(*within) if within else Window).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")

    # The curve has 4096 cells, so the window without partitions sorts that many rows at most.
    starts = before(by_cell, "cell").withColumnRenamed("before", "cell_start")
    starts = before(by_coarse, "coarse", "cell").withColumnRenamed("before", "coarse_start").join(starts, "cell")
    starts = before(counts, "prefix", "cell", "coarse").join(starts, ["cell", "coarse"]).select(
        "cell", "prefix", (F.col("before") + F.col("coarse_start") + F.col("cell_start")).alias("start")
    )
    placed = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), *meta
    ).withColumn("prefix", prefix)
    order = Window.partitionBy("cell", "prefix").orderBy("mixed", "doc_id", "crc", "size")
    ranked = placed.withColumn("within", F.row_number().over(order) - 1).join(starts, ["cell", "prefix"])
    rank = F.col("start") + F.col("within")
    number = F.expr(f"(rank * {shards}L) div {max(rows, 1)}L")
    return ranked.withColumn("rank", rank.cast("long")).withColumn("number", number).select(
        "doc_id", "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("number").cast("int").alias("shard"),
        (F.col("rank") - F.expr(f"(number * {rows}L + {shards - 1}L) div {shards}L")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
