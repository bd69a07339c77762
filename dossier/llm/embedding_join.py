"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within a squared distance of 2 - 2c. After a fixed random rotation a vector is cut into
blocks; of two linked vectors, at least one block pair lies within the share of that budget which its dimensions have.
Each block is range-joined on its own: the signs of its first `g` coordinates name a cell, a vector is at home in one
cell and a guest in every other cell within the block's radius, and home rows meet guests in the cell's task, where the
block's distance picks candidates, and the cosine of the whole vectors in double precision decides. A pair that several
blocks propose counts in the first of them alone, so partial counts add up to exact numbers of links.

`g` grows with the logarithm of the number of vectors, so that a cell holds about CELL of them, and full cells are cut
into parts of their home rows. Equal vectors are one class with a count, so copies never meet. Tasks return a row for each
home vector and a spanning forest of their links, never all pairs.

Defined results: null or zero vectors and those with null or non-finite components link with nothing; vectors of
different lengths never link; repeated rows of one vec_id count as vectors of their own and share one node; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

COSINE, BLOCK_DIMS = 0.95, 16
#: Vectors for which a cell is meant, home rows of one task, and a margin over rounding in single precision.
CELL, HOME, MARGIN = 16_384, 16_384, 1e-5
#: Rows and columns of one tile of distances, which stays in a core's cache.
TILE = (128, 4096)


@lru_cache
def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_edges(dims: int) -> list[tuple[int, int]]:
    n = max(1, round(dims / BLOCK_DIMS))
    edges = [round(k * dims / n) for k in range(n + 1)]
    return list(zip(edges, edges[1:], strict=False))


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # no overflow in the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def budget(cosine: float, width: int, dims: int) -> float:
    return (2 - 2 * cosine) * width / dims + MARGIN


def placed(batches, cosine: float, bits: int, guests: bool = True):
    """Rows (dims, block, cell, home) of each vector: its own cell of each block, and those near enough (if asked for)."""
    for batch in batches:
        vectors = batch.column("embedding")
        sizes = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy()
        for dims in np.unique(sizes):
            rows = np.flatnonzero(sizes == dims)
            starts = vectors.offsets.to_numpy()[rows] - vectors.offsets[0].as_py()
            own = unit(flat[starts[:, None] + np.arange(dims)]) @ rotation(int(dims))
            out: list[tuple[np.ndarray, ...]] = []
            for block, (a, b) in enumerate(block_edges(int(dims))):
                g = min(bits, b - a)
                x = own[:, a : a + g]
                cell = (x >= 0) @ (1 << np.arange(g)) if g else np.zeros(len(rows), np.int64)
                out.append((rows, np.full(len(rows), block), cell, np.ones(len(rows), bool)))
                for flips in range(1, 1 << g) if guests else ():
                    which = (flips >> np.arange(g)) & 1 == 1
                    near = np.flatnonzero((x[:, which] ** 2).sum(axis=1) <= budget(cosine, b - a, int(dims)) + MARGIN)
                    out.append((rows[near], np.full(len(near), block), cell[near] ^ flips, np.zeros(len(near), bool)))
            row, block, cell, home = (np.concatenate(c) for c in zip(*out, strict=True))
            if not guests:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), dims), pa.int32()), pa.array(block, pa.int32()), pa.array(cell, pa.int32())],
                    names=["dims", "block", "cell"],
                )
                continue
            for at in range(0, len(row), 20_000):
                s = slice(at, at + 20_000)
                take = batch.take(pa.array(row[s]))
                yield pa.RecordBatch.from_arrays(
                    [take.column("vec_id"), take.column("copies"), take.column("embedding"),
                     pa.array(np.full(len(row[s]), dims), pa.int32()), pa.array(block[s], pa.int32()),
                     pa.array(cell[s], pa.int32()), pa.array(home[s])],
                    names=["vec_id", "copies", "embedding", "dims", "block", "cell", "home"],
                )


class Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def met(table: pa.Table, cosine: float) -> pa.Table:
    """Of one part of a cell: (vec_id, other, n): n linked vectors of vec_id found here, or a link with `other`."""
    ids, copies = table.column("vec_id").to_numpy(), table.column("copies").to_numpy()
    home = np.flatnonzero(table.column("home").to_numpy(zero_copy_only=False))
    dims, block = table.column("dims")[0].as_py(), table.column("block")[0].as_py()
    raw = table.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, dims)
    exact = unit(raw)
    turned = exact @ rotation(dims)
    edges = block_edges(dims)
    a, b = edges[block]
    x = turned[:, a:b].astype(np.float32)
    # Squared distances as one product: (x, |x|^2, 1) . (-2y, 1, |y|^2).
    square, one = (x * x).sum(axis=1, keepdims=True), np.ones((len(x), 1), np.float32)
    left, right = np.hstack([x, square, one]), np.hstack([-2 * x, one, square]).T.copy()
    # Proposed by single precision with room for its error; which block a pair counts in is decided in double precision.
    forest, rows, reach = Forest(), [], np.float32(budget(cosine, b - a, dims) + MARGIN)
    for at in range(0, len(home), TILE[0]):
        own = home[at : at + TILE[0]]
        near = [
            (i, j + to)
            for to in range(0, len(x), TILE[1])
            for i, j in [np.nonzero(left[own] @ right[:, to : to + TILE[1]] <= reach)]
        ]
        i, j = (np.concatenate(c) for c in zip(*near, strict=True))
        i = own[i]
        i, j = i[ids[i] != ids[j]], j[ids[i] != ids[j]]
        if not len(i):
            continue
        linked = np.einsum("ij,ij->i", exact[i], exact[j]) >= cosine
        i, j = i[linked], j[linked]
        first = np.ones(len(i), bool)
        for c, d in edges[: block + 1]:
            inside = ((turned[i, c:d] - turned[j, c:d]) ** 2).sum(axis=1) <= budget(cosine, d - c, dims)
            first &= inside if c == a else ~inside
        i, j = i[first], j[first]
        found, counts = np.unique(i, return_inverse=True)
        sums = np.bincount(counts, copies[j], len(found)).astype(np.int64) if len(found) else []
        rows += [(int(ids[k]), None, int(n)) for k, n in zip(found, sums, strict=True)]
        rows += [(int(p), int(q), 0) for p, q in zip(ids[i], ids[j], strict=True) if p < q and forest.join(int(p), int(q))]
        rows += [(int(q), int(p), 0) for p, q in zip(ids[i], ids[j], strict=True) if p > q and forest.join(int(p), int(q))]
    return pa.Table.from_arrays(
        [pa.array(list(c), pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))],
        names=["vec_id", "other", "n"],
    )


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    # -0.0 equals 0.0; one id for equal vectors, which keeps copies out of the join.
    rows = vectors.select("vec_id", F.transform("embedding", lambda x: x + F.lit(0).cast("float")).alias("embedding"),
                          F.coalesce(usable, F.lit(False)).alias("usable"))
    key = F.when(F.col("usable"), F.sha2(F.to_json(F.struct("embedding")).cast("binary"), 256))
    rows = written(rows.withColumn("key", key), "vectors")
    classes = (
        rows.where("usable and vec_id is not null").groupBy("key")
        .agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    )
    classes = written(classes, "classes")
    n = classes.count()
    bits = min(BLOCK_DIMS, max(0, math.ceil(math.log2(max(1, n) / CELL))))
    # Two classes may share an id only if a vec_id is repeated with other vectors; they then are one node.
    schema = f"vec_id long, copies long, embedding {dict(classes.dtypes)['embedding']}, dims int, block int, cell int, home boolean"
    spread = classes.select(F.col("class_id").alias("vec_id"), "copies", "embedding").mapInArrow(
        lambda batches: placed(batches, cosine, bits), schema
    )
    homes = classes.select("embedding").mapInArrow(
        lambda batches: placed(batches, cosine, bits, guests=False), "dims int, block int, cell int"
    )
    full = homes.groupBy("dims", "block", "cell").agg(F.ceil(F.count("*") / HOME).cast("int").alias("parts"))
    own = F.when(F.col("home"), F.array(F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")))
    dealt = spread.join(full, ["dims", "block", "cell"]).withColumn("own", own).withColumn(
        # A home row is at home in one part of its cell and a guest in the others.
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    ).withColumn("home", F.col("home") & (F.col("part") == F.try_element_at("own", F.lit(1))))
    dealt = dealt.select("vec_id", "copies", "embedding", "dims", "block", "cell", "part", "home")
    found = dealt.groupBy("dims", "block", "cell", "part").applyInArrow(
        lambda table: met(table, cosine), "vec_id long, other long, n long"
    )
    found = written(found, "found")
    counts = found.where("other is null").groupBy(F.col("vec_id").alias("class_id")).agg(F.sum("n").alias("others"))
    joined = components(found.where("other is not null"), "vec_id", "other").withColumnRenamed("id", "class_id")
    classed = classes.drop("embedding").join(counts, "class_id", "left").join(joined, "class_id", "left").select(
        "key", F.coalesce("component_id", "class_id").alias("class_component"),
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"),
    )
    component = F.when(F.col("usable"), F.col("class_component")).otherwise(F.col("vec_id"))
    return rows.drop("embedding").join(classed, "key", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


ORACLE = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM v WHERE e IS NOT NULL AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.95),
r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
m AS (SELECT u, min(v) AS v FROM r GROUP BY u),
c AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(m.v, e.vec_id)) AS component_id,
 e.vec_id = least(e.vec_id, coalesce(m.v, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN m ON m.u = e.vec_id LEFT JOIN c ON c.u = e.vec_id
"""
