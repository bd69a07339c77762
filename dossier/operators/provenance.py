"""Provenance of results: the chain from each to what it was made from, and the first link of it that doesn't hold.

Nodes (id, kind, digest) are results, adapters, base snapshots, prompts, inputs; edges (child, parent, expected) say what a node
was made from and which digest that had then. A recursive common table expression walks from all results at once, one join a
level, and stops at a link that is broken: the parent isn't there, or its digest is another now.

Defined results: of several broken links the nearest is named, of those the one with the smallest child, then parent; a null
digest equals a null one; a walk of more than MOST_LEVELS levels (a circle) ends there as `too_deep`; a result without edges holds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_LEVELS = 32

WALK = """
WITH RECURSIVE walk(result, node, depth, child, broken) AS (
 SELECT id, id, 0, CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {nodes} WHERE kind = '{kind}'
 UNION ALL
 SELECT w.result, e.parent, w.depth + 1, e.child, CASE WHEN NOT coalesce(n.there, FALSE) THEN 'missing'
  WHEN n.digest IS DISTINCT FROM e.expected THEN 'changed' WHEN w.depth + 1 > {most} THEN 'too_deep' END
 FROM walk w JOIN {edges} e ON e.child = w.node LEFT JOIN {there} n ON n.id = e.parent WHERE w.broken IS NULL)
SELECT result, node, depth, child, broken FROM walk"""


def walk(nodes: DataFrame, edges: DataFrame, kind: str = "result", most: int = MOST_LEVELS) -> DataFrame:
    """result, node, depth, child, broken: every link of every result's chain up to its first broken one."""
    spark, tag = nodes.sparkSession, uuid.uuid4().hex
    views = {"nodes": nodes, "edges": edges, "there": nodes.withColumn("there", F.lit(True))}
    for name, df in views.items():
        df.createOrReplaceTempView(f"{name}_{tag}")
    spark.conf.set("spark.sql.cteRecursionRowLimit", -1)  # rows grow with the results, levels have a bound of their own
    return spark.sql(WALK.format(kind=kind, most=most, **{n: f"{n}_{tag}" for n in views}))


def first_broken(nodes: DataFrame, edges: DataFrame, kind: str = "result", most: int = MOST_LEVELS) -> DataFrame:
    """result, n_links, depth, child, parent, reason of the first broken link; nulls where the chain holds."""
    steps = walk(nodes, edges, kind, most)
    bad = F.when(F.col("broken").isNotNull(), F.struct("depth", "child", F.col("node").alias("parent"), F.col("broken").alias("reason")))
    return steps.groupBy("result").agg(F.count_if(F.col("depth") > 0).alias("n_links"), F.min(bad).alias("b")).select("result", "n_links", "b.*")


def require_provenance(report: DataFrame, nodes: DataFrame, edges: DataFrame, result: str) -> DataFrame:
    """The report's rows; reading them fails, within the same plan, at a row whose result's chain is broken or unknown."""
    state = first_broken(nodes, edges).select(F.col("result").alias("_result"), "reason", "child", "parent")
    link = F.concat(F.lit("provenance of "), result, F.lit(": "), F.coalesce("child", F.lit("?")), F.lit(" -> "), F.coalesce("parent", F.lit("?")), F.lit(" is "),
                    F.coalesce("reason", F.lit("unknown")))
    broken = F.col("_result").isNull() | F.col("reason").isNotNull()
    checked = report.join(state, report[result] == F.col("_result"), "left")
    return checked.where(F.when(broken, F.raise_error(link).cast("boolean")).otherwise(True)).select(*report.columns)
