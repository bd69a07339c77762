"""Places and ranks in sorted tables: groups that span partitions, ties, nulls, empty tables, continuous values."""

import duckdb
from pyspark.sql import functions as F

from dossier.operators import ranks, records


def test_positions_of_one_group(spark):
    df = spark.range(40_000).select(F.lit("one").alias("g"), (F.col("id") * 7919 % 40_000).alias("v"))
    rows = ranks.positions(df, "g", "v").where("position <> v")
    assert rows.count() == 0
    parts = ranks.positions(df, "g", "v").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1


def test_positions_of_equal_and_null_rows(spark):
    df = spark.createDataFrame([(None, 1)] * 50 + [("a", None)] * 3 + [("a", 2)] * 200, "g string, v int")
    got = ranks.positions(df, "g", "v").orderBy("position").collect()
    assert [r.position for r in got] == list(range(253))
    assert [(r.g, r.v) for r in got] == [(None, 1)] * 50 + [("a", None)] * 3 + [("a", 2)] * 200
    assert ranks.positions(df.limit(0), "g", "v").count() == 0


def test_percentiles_of_continuous_values(spark, tmp_path):
    # One group of 300,000 distinct doubles, a small one, a group of nulls alone, and a group that is null.
    df = spark.range(300_000).select(F.lit("big").alias("g"), F.sqrt(F.col("id") * 7 + 1).alias("v"))
    df = df.union(spark.createDataFrame([("b", 2.5), ("b", 1.25), ("n", None), (None, 4.0)], "g string, v double"))
    df.write.parquet(str(tmp_path / "t"))
    got = records.percentiles(spark.read.parquet(str(tmp_path / "t")), "g", "v", [0, 50, 95, 100])
    want = duckdb.sql(f"""
      WITH t AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY g) AS n
       FROM '{tmp_path}/t/*.parquet' WHERE v IS NOT NULL)
      SELECT g, max(v) FILTER (WHERE k = 0), max(v) FILTER (WHERE k = round_even(0.5 * (n - 1), 0)),
       max(v) FILTER (WHERE k = round_even(0.95 * (n - 1), 0)), max(v) FILTER (WHERE k = n - 1), max(v) FROM t GROUP BY g""").fetchall()
    assert sorted([(r.g, r.p0, r.p50, r.p95, r.p100, r.max) for r in got.collect()], key=str) == sorted(want, key=str)
