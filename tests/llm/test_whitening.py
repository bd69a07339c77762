"""Whitening against numpy, on repeated, unusable and degenerate vectors, and with a scatter cut into many products."""

import math

import numpy as np
import pytest

from dossier.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, index int, row string"


def given(spark, vectors):
    rows = [(k, None if v is None else [None if c is None else float(c) for c in v], 1, "r") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(vectors, components=16):
    """n, deviations, whitened values and shares of the variance, by numpy; rows are vectors."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = ((fit * n - s) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    own = x * n - s
    return n, [int(d) for d in (own * own).sum(axis=1)], (own / n).astype(float) @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def check(df, ids, vectors, components=16):
    n, deviations, want, shares = plain(vectors, components)
    rows = df.collect()
    k = min(components, len(vectors[0]))
    assert len(rows) == len(ids) * k and {r.n for r in rows} == {n} and {r.component for r in rows} == set(range(1, k + 1))
    at = {v: i for i, v in enumerate(ids)}
    got = np.zeros((len(ids), k))
    for r in rows:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviations[at[r.vec_id]]
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() < 1e-7


def drawn(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dims)) * np.linspace(1, 3, dims)


def test_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 16)
    monkeypatch.setattr(whitening, "SPLIT", 2)  # seven products of two blocks each, added
    vectors = drawn(220, 20)
    check(whitening.whitened(given(spark, vectors)), range(220), vectors)


def test_copies_count_once_and_unusable_rows_go(spark):
    vectors = [*drawn(40, 5), *[drawn(1, 5, 2)[0]] * 60]
    bad = [None, [], [1, None, 1, 1, 1], [1, 2, 3, 4, math.nan], [1, 2, 3, 4, math.inf], [1, 2, 3, 4, -math.inf]]
    df = given(spark, [*vectors, *bad])
    check(whitening.whitened(df), range(100), vectors)
    check(whitening.whitened(df, 3), range(100), vectors, 3)
    assert whitening.whitened(df.limit(0)).count() == 0


def test_columns_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "COLUMNS", 3)
    monkeypatch.setattr(whitening, "ROWS", 7)
    vectors = drawn(50, 8)
    check(whitening.whitened(given(spark, vectors), 5), range(50), vectors, 5)


def test_other_lengths_are_other_tables(spark):
    a, b = drawn(30, 4), drawn(25, 3, 5)
    rows = whitening.whitened(given(spark, [*a, *b]))
    check(rows.where("vec_id < 30"), range(30), a)
    check(rows.where("vec_id >= 30"), range(30, 55), b)


def test_no_variance(spark):
    one = whitening.whitened(given(spark, [[0.5, 1.5]] * 3)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 6
    flat = [[k % 7, 2.0, 5.0] for k in range(20)]  # one dimension of three varies
    rows = whitening.whitened(given(spark, flat)).collect()
    assert {r.component for r in rows if r.whitened is not None} == {1} and len(rows) == 60
    assert all(r.identity_error < 1e-9 for r in rows) and rows[0].n == 7


def test_vast_entries(spark):
    vectors = [[3e38, 1.0], [-3e38, 2.0], [1e6, 3.0], [5.0, 4.0]]
    rows = whitening.whitened(given(spark, vectors)).collect()
    assert len(rows) == 8 and all(math.isfinite(r.whitened) for r in rows if r.component == 1)
    assert {r.whitened for r in rows if r.component == 2} == {None}  # below the rounding of the first
    assert {r.deviation for r in rows if r.vec_id < 2} == {None}  # beyond a long


def test_registered_query(spark, sf_dir):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pydict()
    check(queries.queries()["op12_whitening"](spark, sf_dir), table["vec_id"], table["embedding"])
