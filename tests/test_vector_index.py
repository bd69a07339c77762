"""The vector index against a full scan: recall, exact answers, filters, files read, hot cells, odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.operators import vector_index
from dossier.operators.vector_index import VectorIndex, recall_at


def drawn(n=1500, dims=12, centres=30, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    return c[rng.integers(0, centres, n)] + rng.normal(scale=0.25, size=(n, dims))


@pytest.fixture(scope="module")
def vectors():
    return drawn()


@pytest.fixture(scope="module")
def rows(spark, vectors):
    return spark.createDataFrame([(k, v.tolist(), k % 3, k % 5) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, product int, section int")


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    return VectorIndex.build(rows, str(tmp_path_factory.mktemp("index") / "i"))


def asked(spark, vectors, ids, **more):
    return spark.createDataFrame([(k, vectors[k].tolist()) for k in ids], "query_id long, q array<double>").withColumns(more)


def plain(vectors, q, k, ok=lambda i: True):
    scores = np.round(vectors @ q / np.sqrt((vectors * vectors).sum(1) * (q @ q)), 6)
    at = [i for i in np.lexsort((np.arange(len(vectors)), -scores)) if ok(i)][:k]
    return [(i, scores[i]) for i in at]


def by_query(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_every_vector_is_in_the_cell_of_its_nearest_centroid(index, vectors):
    header = index.header()
    assert header.n.sum() == len(vectors)
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    best = header.cell.to_numpy()[(units @ np.stack(header.centroid).T).argmax(axis=1)]
    assert {r.vec_id: r.cell for r in index.vectors().select("vec_id", "cell").collect()} == dict(enumerate(best))


def test_exact_search_equals_a_full_scan(spark, index, vectors):
    ids = range(0, 1500, 50)
    want = {k: plain(vectors, vectors[k], 10) for k in ids}
    assert by_query(index.search(asked(spark, vectors, ids), 10, 1, exact=True)) == want  # one cell first, then what bounds leave
    assert by_query(index.search(asked(spark, vectors, ids), 10, len(index.header()))) == want


def test_recall_and_the_files_that_are_read(spark, index, vectors):
    queries = asked(spark, vectors, range(0, 1500, 50))
    probes = index.probes_for(queries, 10, 0.95)
    found, truth = index.search(queries, 10, probes), index.search(queries, 10, 1, exact=True)
    assert recall_at(found, truth, "vec_id") >= 0.95 and probes < len(index.header()) / 2
    one = index.search(asked(spark, vectors, [100]), 10, probes)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan
    cells = [int(c) for c in index.header().cell[:probes]]
    read = index.vectors(cells).select(F.input_file_name().alias("f")).distinct().count()
    assert read < index.vectors().select(F.input_file_name().alias("f")).distinct().count()


def test_products_and_sections(spark, index, vectors):
    ids = [0, 301, 750]
    queries = asked(spark, vectors, ids, product=F.lit(1), sections=F.array(F.lit(2), F.lit(4)))
    want = {k: plain(vectors, vectors[k], 5, lambda i: i % 3 == 1 and i % 5 in (2, 4)) for k in ids}
    assert by_query(index.search(queries, 5, 2, exact=True)) == want
    either = asked(spark, vectors, ids, product=F.lit(None).cast("int"), sections=F.lit(None).cast("array<int>"))
    assert by_query(index.search(either, 5, 2, exact=True)) == {k: plain(vectors, vectors[k], 5) for k in ids}
    kept = index.search(asked(spark, vectors, ids), 5, 2, exact=True, keep=F.col("section") == 3)
    assert by_query(kept) == {k: plain(vectors, vectors[k], 5, lambda i: i % 5 == 3) for k in ids}


def test_a_hot_cell_is_many_tiles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "TILE", 16)
    v = drawn(300, 6, 4)
    v[:120] = v[0]  # copies
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    index = VectorIndex.build(rows, str(tmp_path / "i"), cells=4)
    ids = range(0, 300, 5)
    assert by_query(index.search(asked(spark, v, ids), 7, 1, exact=True)) == {k: plain(v, v[k], 7) for k in ids}


def test_odd_vectors(spark, tmp_path):
    good = [[1.0, 0.0], [0.0, 2.0], [3.0, 3.0]]
    odd = [None, [0.0, 0.0], [math.nan, 1.0], [math.inf, 1.0], [1.0, None]]
    rows = spark.createDataFrame(list(enumerate(good + odd)), "vec_id long, embedding array<double>")
    index = VectorIndex.build(rows, str(tmp_path / "i"), cells=2)
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 1.0, 1.0])], "query_id long, q array<double>")
    assert [v for v, _ in by_query(index.search(queries, 9, 1, exact=True))[1]] == [0, 2, 1]
    assert set(by_query(index.search(queries, 9, 1, exact=True))) == {1}
    none = VectorIndex.build(rows.limit(0), str(tmp_path / "none"))
    assert none.search(queries, 3, 1, exact=True).count() == 0


def test_the_full_scan_is_done_once(spark, index, vectors, monkeypatch):
    """Every number of cells that is tried is held against one written full scan."""
    made, scans, search, written = [], [], VectorIndex.search, vector_index.written
    monkeypatch.setattr(vector_index, "written", lambda df, name: made.append(name) or written(df, name))
    monkeypatch.setattr(VectorIndex, "search", lambda self, queries, k, probes, *a, **b: scans.append(probes) or search(self, queries, k, probes, *a, **b))
    index.probes_for(asked(spark, vectors, range(0, 1500, 100)), 10, 0.95)
    assert made == ["truth"] and scans[0] == len(index.header()) and scans[1] == 1


def test_equal_scores_go_to_the_smaller_id(spark, tmp_path):
    """More equal scores than are asked for: what is cut off before sorting must not be one of them."""
    rows = spark.createDataFrame([(k, [1.0, float(k % 2)]) for k in range(60)], "vec_id long, embedding array<double>")
    found = VectorIndex.build(rows, str(tmp_path / "i"), cells=2).search(spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, q array<double>"), 5, 2)
    assert [r[0] for r in by_query(found)[7]] == [0, 2, 4, 6, 8]
