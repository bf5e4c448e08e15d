"""Registered queries read whole tables: 2,000 variants at sf0.01."""

import numpy as np
import pytest

from cortexloom.operators import ld
from cortexloom.plans import analytic
from cortexloom.plans.surrogate import Study


@pytest.fixture(scope="module")
def wide(sf_dir):
    return sf_dir.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def dosages(spark, wide):
    """Dosages of the called variants in order, and their numbers."""
    calls = Study(spark, wide).geno.toPandas()
    z = np.zeros((2000, 1500))
    z[calls["variant"], calls["iid"]] = calls["dosage"]
    own = np.flatnonzero(z.any(axis=1))
    assert own.max() > 1900
    return z[own], own


def test_ld_scores_of_all_variants(spark, wide, dosages):
    z, own = dosages
    got = {r["snp"]: r["ldscore"] for r in analytic.ld_scores(spark, wide).collect()}
    assert set(got) == {f"rs{v}" for v in own}
    for b in (0, 17, 39):
        k = own // 50 == b
        want = ld.ld_score(ld.correlation(z[k]), z.shape[1])
        assert [got[f"rs{v}"] for v in own[k]] == pytest.approx(want, abs=1e-5)


def test_ld_prune_of_all_variants(spark, wide, dosages):
    z, own = dosages
    got = {r["snp"] for r in analytic.ld_prune(spark, wide).collect()}
    frame = spark.createDataFrame([(str(v // 500 % 22 + 1), int(v), f"rs{v}", x.tolist()) for v, x in zip(own, z)], "contig string, pos int, snp string, dosages array<double>")
    assert got == {r["snp"] for r in ld.ld_prune(frame, 0.3, 20).collect()} and len(got) > 1000


def test_prune_calls_is_prune(spark):
    rng = np.random.default_rng(4)
    base = rng.binomial(2, 0.3, (6, 80))
    z = np.array([np.where(rng.random(80) < 0.2, rng.binomial(2, 0.3, 80), base[i // 5]) for i in range(30)], float)
    z[3, :4] = np.nan
    dense = spark.createDataFrame([("1", i, f"rs{i}", z[i].tolist()) for i in range(30)], "contig string, pos int, snp string, dosages array<double>")
    calls = spark.createDataFrame([("1", i, f"rs{i}", j, None if np.isnan(z[i, j]) else int(z[i, j])) for i in range(30) for j in range(80) if z[i, j] != 0], "contig string, pos int, snp string, iid int, dosage int")
    got, want = ({r["snp"] for r in x.collect()} for x in (ld.ld_prune_calls(calls, 80, 0.3, 4), ld.ld_prune(dense, 0.3, 4)))
    assert got == want and 0 < len(got) < 30


def test_component_statistics_of_all_variants(spark, wide, dosages):
    assert analytic._component_stats(Study(spark, wide))[0].count() == len(dosages[1])


def test_loco_over_all_contigs(spark, wide):
    got = analytic.loco_predictions(spark, wide).collect()
    assert {r["contig"] for r in got} == {"1", "2", "3", "4"} and all(len(r["pred"]) == 2 for r in got) and len({(r["iid"], r["contig"]) for r in got}) == len(got) == 4 * 1500


def test_conditional_test_of_all_variants(spark, wide, dosages):
    z, own = dosages
    got = {r["variant"]: r["beta"] for r in analytic.conditional_test(spark, wide).collect()}
    assert set(got) == set(own.tolist()) - {1, 2}
    subjects = Study(spark, wide).subjects.toPandas().sort_values("iid")
    y, given = np.stack(subjects["y"].to_numpy()), [z[own == v][0] for v in (1, 2)]
    for v in (0, 61, 1999):
        full = np.column_stack([np.ones(len(y)), *given, z[own == v][0]])
        assert got[v] == pytest.approx(np.linalg.lstsq(full, y, rcond=None)[0][-1], rel=1e-6)


def test_association_of_all_variants(spark, wide, dosages):
    z, own = dosages
    got = {r["variant"]: r for r in analytic.gwas_all(spark, wide).collect()}
    assert set(got) == set(own.tolist())
    subjects = Study(spark, wide).subjects.toPandas().sort_values("iid")
    x, y = np.stack(subjects["x"].to_numpy()), np.stack(subjects["y"].to_numpy())
    m = np.eye(len(x)) - x @ np.linalg.solve(x.T @ x, x.T)
    gr, r = z @ m, m @ y
    left = (gr * gr).sum(axis=1)
    beta = gr @ r / left[:, None]
    se = np.sqrt(((r * r).sum(axis=0) - beta**2 * left[:, None]) / (len(x) - 3) / left[:, None])
    assert np.stack([got[v]["beta"] for v in own]) == pytest.approx(beta, rel=1e-6)
    assert np.stack([got[v]["standard_error"] for v in own]) == pytest.approx(se, rel=1e-6)
