"""Whitening of embeddings with Spark's distributed BlockMatrix.

1. A vector c becomes whole numbers x = floor(64 c) + 1000000. Equal x count once in the fit: n vectors, sums S by dimension,
   both exact.
2. Rows are centred exactly: n x - S is a whole number, and (n x - S) / n rounds once. Centred rows are numbered without gaps
   (places of a written table and counts of its partitions) and become an IndexedRowMatrix, then a BlockMatrix of blocks of
   ROWS rows, all within the JVM.
3. The scatter is the product of the transposed BlockMatrix with itself, the middle dimension cut into splits of SPLIT blocks, so that
   no task gathers more than those. It has the square of the dimensions' number and is all that reaches the driver.
4. There, eigh gives components; the whitening matrix, one column for each, is a BlockMatrix too, and a second product
   projects the rows of the fit (to measure how far their covariance is from the identity) and all rows.

Defined results: null vectors and those with null or non-finite components are left out, and so are empty ones, which have no
component; vectors of another length are another table, fitted by itself; entries beyond 2**40 either way count as that bound
(64 c stays within a long); a component without variance (its eigenvalue isn't above its rounding error) has a null `whitened`
and no part in `identity_error`, which is null if no component has any; `explained` is null if nothing varies; a deviation
beyond a long is null; repeated rows give repeated rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure, written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Rows and columns of a block, and blocks of rows that one task of the scatter holds.
ROWS, COLUMNS, SPLIT = 1024, 1024, 32
BOUND = 2.0**40
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id and x of the rows that remain."""
    good = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    bounded = lambda c: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), c.cast("double")))
    x = F.transform("embedding", lambda c: F.floor(SCALE * bounded(c)).cast("long") + OFFSET)
    usable = F.col("embedding").isNotNull() & F.coalesce(good, F.lit(False)) & (F.size("embedding") > 0)
    return vectors.where(usable).select("vec_id", x.alias("x"))


def sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of rows of `fit` and the exact sum of each dimension of x; a partial sum for each batch goes to the shuffle."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(-1, dims)
                totals = x.sum(axis=0, dtype=object) if np.abs(x).max() > 2**50 else x.sum(axis=0).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(dims), pa.int32()), pa.array([str(t) for t in totals]), pa.array([len(x)] * dims, pa.int64())],
                    names=["dim", "total", "rows"],
                )

    parts = fit.select("x").mapInArrow(run, "dim int, total string, rows long")
    found = parts.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("s"), F.sum("rows").alias("n")).collect()
    by_dim = {r.dim: int(r.s) for r in found}
    return (found[0].n if found else 0), [by_dim[k] for k in range(dims)] if found else []


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n x - S, as longs where all of them fit, as Python's whole numbers otherwise."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, s))
    kind = np.int64 if most < 2**62 else object
    return x.astype(kind) * n - np.array(s, kind)


def centred_rows(rows: DataFrame, n: int, s: list[int]) -> DataFrame:
    """The columns but x, `deviation`, and `row`: the centred row as doubles."""
    dims, kept = len(s), [c for c in rows.columns if c != "x"]

    def run(batches):
        for batch in batches:
            own = centred(batch.column("x").flatten().to_numpy().reshape(-1, dims), n, s)
            small = own.dtype != object and (not own.size or dims * int(np.abs(own).max()) ** 2 < 2**63)
            squares = (own * own).sum(axis=1).tolist() if small else [sum(int(v) ** 2 for v in r) for r in own]
            row = (own / n).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in kept),
                    pa.array([q if q < 2**63 else None for q in squares], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * dims, pa.int32()), pa.array(row.ravel())),
                ],
                names=[*kept, "deviation", "row"],
            )

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in kept), "deviation long", "row array<double>"]))


def indexed(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Rows with a gapless `index`, written, and their number: the place within a partition after those of the partitions before."""
    table = written(rows.withColumn("_at", F.monotonically_increasing_id()), name)
    table = table.withColumn("_part", F.shiftright("_at", 33))
    counts = sorted((r._part, r.n) for r in table.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one for each partition
    starts = np.cumsum([0, *(n for _, n in counts)])
    before = table.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(counts, starts, strict=False)], "_part long, _before long")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    return table.join(F.broadcast(before), "_part").withColumn("index", place).drop("_at", "_part", "_before"), int(starts[-1])


def block_matrix(rows: DataFrame, n: int, dims: int) -> BlockMatrix:
    """`index` and `row` as a BlockMatrix; they stay in the JVM."""
    vectors = rows.select("index", array_to_vector("row").alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, dims).toBlockMatrix(ROWS, COLUMNS)


def product(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a b; the middle dimension is dealt to `splits` tasks for each block of the result, whose parts are then added."""
    made = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, COLUMNS, COLUMNS)


def scatter(matrix: BlockMatrix, n: int) -> np.ndarray:
    """The transposed matrix times the matrix, in the driver."""
    return product(matrix.transpose(), matrix, max(1, -(-n // (ROWS * SPLIT)))).toLocalMatrix().toArray()


def projected(rows: DataFrame, n: int, weights: np.ndarray) -> DataFrame:
    """index and y: rows times the weights (dimensions x components)."""
    sc, (dims, k) = rows.sparkSession.sparkContext, weights.shape
    cut = [(i, j) for i in range(0, dims, COLUMNS) for j in range(0, k, COLUMNS)]
    parts = [((i // COLUMNS, j // COLUMNS), weights[i : i + COLUMNS, j : j + COLUMNS]) for i, j in cut]
    blocks = [(at, DenseMatrix(*w.shape, w.ravel("F"))) for at, w in parts]
    right = BlockMatrix(sc.parallelize(blocks, 1), COLUMNS, COLUMNS, dims, k)
    made = product(block_matrix(rows, n, dims), right, 1).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", made._java_matrix_wrapper._java_model)
    return found.select("index", vector_to_array("vector").alias("y"))


def fitted(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues by falling size, unit eigenvectors as columns, and the covariance's trace."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:components]
    return values[order], vectors[:, order], float(np.trace(covariance))


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining vector and component."""
    spark = configure(vectors.sparkSession)
    rows = written(whole(vectors), "whole")
    out = spark.createDataFrame([], OUT)
    for length in sorted(r.dims for r in rows.select(F.size("x").alias("dims")).distinct().collect()):
        out = out.unionByName(_of_length(rows.where(F.size("x") == length), length, components))
    return out


def _of_length(rows: DataFrame, dims: int, components: int) -> DataFrame:
    fit = written(rows.select("x").distinct(), "fit")
    n, s = sums(fit, dims)
    fit, _ = indexed(centred_rows(fit, n, s).select("row"), "centred")
    values, axes, trace = fitted(scatter(block_matrix(fit, n, dims), n) / n, components)
    varies = values > max(trace, 0.0) * dims * np.finfo(float).eps
    weights = np.where(varies, axes / np.sqrt(np.where(varies, values, 1.0)), 0.0)
    error = None
    if varies.any():
        y = written(projected(fit, n, weights), "projected")
        means = np.array(y.select(*(F.avg(F.col("y")[k]) for k in range(len(values)))).first(), float)
        around = y.select("index", F.transform("y", lambda v, k: v - F.array(*map(F.lit, means.tolist()))[k]).alias("row"))
        covariance = scatter(block_matrix(around, n, len(values)), n) / n
        error = float(np.abs(covariance - np.eye(len(values)))[np.ix_(varies, varies)].max())
    every, n_rows = indexed(centred_rows(rows, n, s), "rows")
    found = every.select("index", "vec_id", "deviation").join(projected(every, n_rows, weights), "index")
    share = [float(v / trace) if trace > 0 else None for v in values]
    of = F.array(*(F.struct(F.lit(k + 1).alias("component"), F.lit(share[k]).cast("double").alias("explained"),
                            F.lit(bool(varies[k])).alias("varies")) for k in range(len(values))))
    return found.select("*", F.explode(of).alias("c")).select(
        "vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation",
        F.when(F.col("c.varies"), F.col("y")[F.col("c.component") - 1]).alias("whitened"), "c.explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
