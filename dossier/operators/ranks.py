"""Places of rows in a sorted table, however many rows a group has: a range shuffle, counts by partition, prefix sums.

No task sees more than a partition of the sorted rows; equal rows are dealt to several partitions too. The only window runs
over one row for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.sources.shared import written

#: monotonically_increasing_id has the partition above this bit and the place in it below.
PLACE_BITS = 33


def positions(df: DataFrame, *keys: str | Column, name: str = "position") -> DataFrame:
    """The rows, with `name`: the place (from 0) in the order of `keys`; rows alike in all keys follow in any order.

    The sorted rows are written to the shared folder, so that counts and places come from one and the same layout. Null keys
    come first where a key says nothing else; an empty table gives no rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, "_salt")
    dealt = written(salted.drop("_salt").sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    dealt = dealt.withColumn("_part", F.shiftright("_at", PLACE_BITS))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    starts = F.broadcast(counts.select("_part", before.alias("_before")))  # a row for each partition
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + F.col("_before")
    return dealt.join(starts, "_part").withColumn(name, place).drop("_part", "_at", "_before")


def selected(df: DataFrame, by: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """by, n, mean, max and, for each name, the value at that rank (from 0; a column over `_rows`, the group's size).

    Exact for any values: the group's rows lie side by side in the sorted table, so a rank is a place, found by a join with
    the few places asked for."""
    placed = positions(df.where(F.col(value).isNotNull()).select(by, value), by, value)
    groups = placed.groupBy(by).agg(
        F.min("position").alias("_start"), F.count("*").alias("_rows"), F.avg(value).alias("mean"), F.max(value).alias("max")
    )
    asked = F.array(*(F.struct(F.lit(k).alias("name"), (F.col("_start") + r).alias("position")) for k, r in ranks.items()))
    wanted = groups.select(F.explode(asked).alias("x")).select("x.name", "x.position")
    found = placed.join(wanted, "position").groupBy(by).agg(
        *(F.max(F.when(F.col("name") == k, F.col(value))).alias(k) for k in ranks)
    )
    same = groups[by].eqNullSafe(found[by])
    return groups.join(found, same).select(groups[by], F.col("_rows").alias("n"), *ranks, "mean", groups["max"])
