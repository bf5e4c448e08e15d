"""Whitening by TSQR against the eigenvectors of the covariance; odd vectors."""

import math

import numpy as np
import pytest

from cortexloom.llm import queries, whitening

WIDE = "vec_id long, embedding array<double>, component string, n string, deviation int, whitened int, vector string, part int, width int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "c", "n", 1, 2, "v", 3, 4) for i, v in rows], WIDE).repartition(parts)


def by_covariance(vectors):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    deviation = ((n * x - s) ** 2).sum(1)
    centre = ((n * x - s) / n).astype(float)
    e, v = np.linalg.eigh(centre.T @ centre / n)
    order = np.argsort(-e)
    return deviation.tolist(), centre, e[order], v[:, order]


def check(rows, usable, k):
    """rows: the result; usable: vectors by id."""
    ids = list(usable)
    deviation, centre, e, v = by_covariance([usable[i] for i in ids])
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(got) == set(ids) and all(sorted(c) == list(range(1, k + 1)) for c in got.values())
    white = np.array([[got[i][c]["whitened"] for c in range(1, k + 1)] for i in ids])
    want = centre @ v[:, :k] / np.sqrt(e[:k])
    sign = np.sign((white * want).sum(0))
    np.testing.assert_allclose(white, want * sign, atol=1e-6)
    assert [got[i][1]["deviation"] for i in ids] == deviation and all(r["n"] == len(ids) for r in rows)
    np.testing.assert_allclose([got[ids[0]][c]["explained"] for c in range(1, k + 1)], e[:k] / e.sum(), rtol=1e-9)
    errors = {r["identity_error"] for r in rows}
    cov = white.T @ white / len(ids) - np.outer(white.mean(0), white.mean(0))
    assert len(errors) == 1 and errors.pop() == pytest.approx(np.abs(cov - np.eye(k)).max(), abs=1e-9) and np.abs(cov - np.eye(k)).max() < 1e-4


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_equals_the_covariance(spark, parts):
    rng = np.random.default_rng(parts)
    x = rng.normal(size=(300, 6)) * [5, 4, 3, 2, 1, 0.5] @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    usable = {i: v.tolist() for i, v in enumerate(x)}
    check(whitening.whiten(table(spark, usable.items(), parts)).collect(), usable, 6)
    check(whitening.whiten(table(spark, usable.items(), parts), components=2).collect(), usable, 2)


def test_vectors_that_take_no_part(spark):
    """Null, empty, null and non-finite entries, other lengths, entries without an integer; equal rows take part each."""
    rng = np.random.default_rng(9)
    usable = {i: v.tolist() for i, v in enumerate(rng.normal(size=(50, 3)) * 10)}
    usable[50] = usable[0]
    odd = [None, [], [1.0, None, 2.0], [1.0, math.nan, 2.0], [math.inf, 0.0, 0.0], [1.0, 2.0], [1.0] * 5, [1e300, 0.0, 0.0], [-(2.0**60), 0.0, 0.0]]
    rows = list(usable.items()) + [(100 + i, v) for i, v in enumerate(odd)]
    got = whitening.whiten(table(spark, rows)).collect()
    check(got, usable, 3)
    none = list(usable.items()) + [(None, usable[3]), (7, usable[4])]
    more = whitening.whiten(table(spark, none)).collect()
    assert len(more) == 53 * 3 and sum(r["vec_id"] is None for r in more) == 3 and sum(r["vec_id"] == 7 for r in more) == 6


def test_large_entries(spark):
    """Sums and deviations beyond 64 bits: exact sums; no deviation where it does not fit."""
    rng = np.random.default_rng(2)
    usable = {i: (v * 1e13).tolist() for i, v in enumerate(rng.integers(-9, 10, (40, 2)).astype(float))}
    n, sums = whitening.exact_sums(table(spark, usable.items()).selectExpr("embedding as vector"))
    assert n == 40 and sums == [sum(math.floor(64 * v[k]) + 1_000_000 for v in usable.values()) for k in range(2)]
    got = whitening.whiten(table(spark, usable.items())).collect()
    assert len(got) == 80 and all(r["deviation"] is None and abs(r["whitened"]) < 10 and r["identity_error"] < 1e-9 for r in got)


def test_components_without_spread(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=30) * 20
    rows = [(i, [float(v), float(v), 7.0]) for i, v in enumerate(a)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 30 and got[0]["explained"] == pytest.approx(1)
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect() == []
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).collect() == []


def test_query(spark, sf_dir):
    usable = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    check(queries.op13_whitened_embeddings(spark, sf_dir).collect(), usable, 32)
