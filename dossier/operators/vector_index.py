"""An inverted-file index over vectors: cells around centroids, a table partitioned by cell, searches that read few cells.

Centroids are fitted by k-means to unit vectors of a bounded sample (SAMPLE rows, those of smallest hash); every vector is then
assigned to its nearest one and written under `cell=…`. The header keeps, for each cell, its centroid, its number of vectors
and the widest angle between the centroid and one of them.

A search asks the header which cells are near a query, reads those alone (partition pruning), and meets queries and vectors in
tiles of at most TILE of each, so a cell that holds a third of all vectors is many tasks. With `exact`, a second pass reads
those other cells that may hold a better vector than the k-th found: an angle of a to the centroid and a widest angle of w
leave no cosine above cos(a - w). So the answer is that of a full scan, whatever the first pass found.

Defined results: vectors that are null, zero, of another length than the first cell's centroid or not finite are not indexed;
scores are cosines in double precision, rounded to six digits, ties go to the smaller id; a query with such a vector finds
nothing; fewer than k vectors give fewer rows; an empty table makes an index without cells, which answers nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.sources.shared import written

SAMPLE, TILE, DIGITS = 50_000, 8192, 6
#: What rounding may add to a bound of cosines.
MARGIN = 2e-6


def usable(vector: str) -> Column:
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(vector, lambda c: c != 0)


def units(vectors: pa.Array) -> np.ndarray:
    """Rows as unit vectors in double precision; a list of equal lengths is taken for granted."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(vectors), -1)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


@dataclass
class VectorIndex:
    """An index in `path`: `cells` (its header) and `vectors`, partitioned by cell; `key` is the id's column."""

    spark: SparkSession
    path: str
    key: str = "vec_id"

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", cells: int | None = None,
              sample: int = SAMPLE, seed: int = 11) -> VectorIndex:
        """`cells` is the square root of the number of vectors if it isn't given."""
        self = cls(rows.sparkSession, path, key)
        good = rows.where(usable(vector)).withColumn("embedding", F.col(vector))
        shape = good.agg(F.count("*").alias("n"), F.min_by(F.size("embedding"), F.xxhash64(key)).alias("dims")).first()
        good = good.where(F.size("embedding") == (shape.dims or 0))
        unit = F.transform("embedding", lambda c: c.cast("double"))
        drawn = good.orderBy(F.xxhash64(F.lit(seed), key)).limit(sample).select(array_to_vector(unit).alias("features"))
        k = cells or max(1, math.isqrt(shape.n))
        if shape.n:
            model = KMeans(k=k, seed=seed, maxIter=10, distanceMeasure="cosine").fit(drawn)
            centroids = np.array([c for c in map(np.asarray, model.clusterCenters()) if np.isfinite(c).all() and c.any()])
            centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
        else:
            centroids = np.empty((0, 0))
        shared = self.spark.sparkContext.broadcast(centroids)  # cells x dimensions

        def assign(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                if batch.num_rows:
                    scores = units(batch.column("embedding")) @ shared.value.T
                    own = scores.argmax(axis=1)
                    near = pa.array(scores[np.arange(len(own)), own])
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), near], names=[*batch.schema.names, "cell", "nearness"])

        kept = good.drop(vector) if vector != "embedding" else good
        types = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes)
        placed = kept.mapInArrow(assign, f"{types}, cell int, nearness double")
        # A cell's rows are dealt to several files by a hash of the id, so that none is one task's work.
        dealt = placed.repartition(F.col("cell"), F.pmod(F.xxhash64(key), F.lit(8)))
        dealt.write.partitionBy("cell").parquet(f"{path}/vectors")
        stored = self.spark.read.schema(f"{types}, nearness double, cell int").parquet(f"{path}/vectors")
        header = stored.groupBy("cell").agg(F.count("*").alias("n"), F.min("nearness").alias("least"))
        named = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        named.join(header, "cell").coalesce(1).write.parquet(f"{path}/cells")
        return self

    def header(self) -> pd.DataFrame:
        """A row for each cell that holds vectors: cell, centroid, n, least (cosine to the centroid)."""
        return self.spark.read.parquet(f"{self.path}/cells").toPandas().sort_values("cell", ignore_index=True)

    def vectors(self, cells: list[int] | None = None) -> DataFrame:
        """The indexed rows, of all cells or of the given ones alone; files of other cells aren't opened."""
        rows = self.spark.read.parquet(f"{self.path}/vectors")
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def search(self, queries: DataFrame, k: int, probes: int, exact: bool = False, keep: Column | None = None) -> DataFrame:
        """query_id, the index's key, score, rank (from 1): the k nearest vectors of each query (query_id, q and, if wished,
        product or sections, which rows must equal or be among). `probes`: cells read for each query; `keep`: a condition
        on the index's rows, pushed to their scan."""
        own = queries.where(usable("q")).withColumn("q", F.transform("q", lambda c: c.cast("double")))
        header = self.header()
        if header.empty:
            none = [F.lit(None).cast(t).alias(c) for c, t in ((self.key, "long"), ("score", "double"), ("rank", "long"))]
            return own.select("query_id", *none).limit(0)
        own = own.where(F.size("q") == len(header.centroid[0]))
        found = self._ranked(self._met(self._wanted(own, header, probes, None), header, keep, k), k)
        if not exact:
            return found
        # The k-th score decides which other cells may still hold something better.
        worst = found.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
        again = own.join(worst, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
        more = self._met(self._wanted(again, header, probes, "least"), header, keep, k)
        return self._ranked(found.select("query_id", self.key, "score").unionByName(more), k)

    def _wanted(self, queries: DataFrame, header: pd.DataFrame, probes: int, least: str | None) -> DataFrame:
        """The queries, a row for each cell to be read: the nearest `probes`, or, where `least` is named, the others that may
        hold a cosine of that much."""
        cells, centroids = header.cell.to_numpy(), np.stack(header.centroid)
        reach = np.arccos(np.clip(header["least"].to_numpy(), -1, 1))
        shared = self.spark.sparkContext.broadcast((cells, centroids, reach))

        def run(batches: Iterator[pa.RecordBatch]):
            cells, centroids, reach = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                scores = units(batch.column("q")) @ centroids.T
                order = np.argsort(-scores, axis=1, kind="stable")
                if least is None:
                    lists = [cells[row[:probes]] for row in order]
                else:
                    best = np.cos(np.maximum(0.0, np.arccos(np.clip(scores, -1, 1)) - reach))
                    floor = batch.column(least).to_numpy()
                    lists = [cells[row[probes:][best[i, row[probes:]] >= floor[i] - MARGIN]] for i, row in enumerate(order)]
                wanted = pa.array([x.tolist() for x in lists], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, wanted], names=[*batch.schema.names, "cells"])

        types = ", ".join(f"`{c}` {t}" for c, t in queries.dtypes)
        return queries.mapInArrow(run, f"{types}, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells")

    def _met(self, wanted: DataFrame, header: pd.DataFrame, keep: Column | None, k: int) -> DataFrame:
        """query_id, key, score of the k best of each tile."""
        asked = wanted.groupBy("cell").agg(F.count("*").alias("n")).toPandas()  # a row for each cell at most
        sizes = header.merge(asked, on="cell", suffixes=("", "_asked"))
        parts = self.spark.createDataFrame(
            [(int(c), -(-int(n) // TILE), -(-int(m) // TILE)) for c, n, m in zip(sizes.cell, sizes.n, sizes.n_asked, strict=True)],
            "cell int, of_rows int, of_queries int",
        )
        rows = self.vectors([int(c) for c in sizes.cell])
        rows = (rows if keep is None else rows.where(keep)).join(F.broadcast(parts), "cell")
        asked_ = wanted.join(F.broadcast(parts), "cell")
        # Each part of a cell's vectors meets each part of its queries once.
        rows = rows.withColumn("a", F.pmod(F.xxhash64(self.key), "of_rows").cast("int"))
        rows = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("of_queries") - 1))).drop("of_rows", "of_queries", "nearness")
        asked_ = asked_.withColumn("b", F.pmod(F.xxhash64("query_id"), "of_queries").cast("int"))
        asked_ = asked_.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("of_rows") - 1))).drop("of_rows", "of_queries")
        key, types = self.key, dict([*rows.dtypes, *wanted.dtypes])
        by_product = "product" in wanted.columns
        by_section = "sections" in wanted.columns

        def tile(vectors: pa.Table, queries: pa.Table) -> pa.Table:
            names = ["query_id", key, "score"]
            kinds = [queries.schema.field("query_id").type, vectors.schema.field(key).type, pa.float64()]
            out: list[list] = [[], [], []]
            if len(vectors) and len(queries):
                v, q = (t.column(c).combine_chunks() for t, c in ((vectors, "embedding"), (queries, "q")))
                v = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
                q = q.flatten().to_numpy(zero_copy_only=False).reshape(len(queries), -1)
                ids = np.array(vectors.column(key).to_pylist())
                names_ = np.array(vectors.column("product").to_pylist(), object) if by_product else None
                places = np.array(vectors.column("section").to_pylist(), object) if by_section else None
                norms = (v * v).sum(axis=1)
                asked = queries.to_pylist()
                for i, row in enumerate(asked):
                    scores = np.round(v @ q[i] / np.sqrt(norms * (q[i] @ q[i])), DIGITS)
                    ok = np.ones(len(ids), bool)
                    if by_product and row["product"] is not None:
                        ok &= names_ == row["product"]
                    if by_section and row["sections"] is not None:
                        ok &= np.isin(places.astype(float), [float(s) for s in row["sections"] if s is not None])
                    at = np.flatnonzero(ok)
                    if len(at) > k:  # what is below the k-th score isn't sorted
                        at = at[~(scores[at] < -np.partition(-scores[at], k - 1)[k - 1])]
                    at = at[np.lexsort((ids[at], -scores[at]))[:k]]
                    out[0] += [row["query_id"]] * len(at)
                    out[1] += ids[at].tolist()
                    out[2] += scores[at].tolist()
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

        tiles = ["cell", "a", "b"]
        return rows.groupBy(*tiles).cogroup(asked_.groupBy(*tiles)).applyInArrow(
            tile, f"query_id {types['query_id']}, {key} {types[key]}, score double"
        )

    def _ranked(self, found: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), self.key))
        return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)

    def probes_for(self, queries: DataFrame, k: int, recall: float) -> int:
        """The least power of two of cells at which these queries (a bounded sample) find that share of their true neighbours."""
        n_cells = len(self.header())
        # The full scan is written, so that it is done once, not for each number of cells.
        truth = written(self.search(queries, k, n_cells), "truth")
        probes = 1
        while probes < n_cells:
            if recall_at(self.search(queries, k, probes), truth, self.key) >= recall:
                break
            probes *= 2
        return min(probes, max(1, n_cells))


def recall_at(found: DataFrame, truth: DataFrame, key: str) -> float:
    """The share of true (query_id, key) pairs that were found; 1.0 where there are none."""
    both = truth.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    row = both.agg(F.count("hit").alias("hit"), F.count("*").alias("n")).first()
    return row.hit / row.n if row.n else 1.0
