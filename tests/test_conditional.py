"""Pruning by ranges, and set tests conditioned on each set's own loci, against refitted null models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cortexloom.operators import ld, linear, rare
from cortexloom.plans import analytic
from cortexloom.plans.surrogate import Study


def greedy(z, pos, r2, width):
    """Names (rows) that stay, in the order of position."""
    kept = []
    for i in np.lexsort((np.arange(len(z)), pos)):
        near = [k for k in kept if pos[i] - pos[k] <= width]
        if not near or not (ld.correlation(z[[i, *near]])[0, 1:] ** 2 > r2).any():
            kept.append(i)
    return set(kept)


@pytest.mark.parametrize("width", [1, 3, 10, 1000])
def test_pruning_hands_on_from_range_to_range(spark, width):
    """Chains of linked variants over several ranges, equal positions, missing dosages, two contigs, constant variants."""
    rng = np.random.default_rng(width)
    chain = [rng.binomial(2, 0.4, 60)]
    for _ in range(39):
        chain.append(np.where(rng.random(60) < 0.25, rng.binomial(2, 0.4, 60), chain[-1]))
    z = np.array(chain, float)
    z[5, :3], z[7] = np.nan, 0
    pos = np.sort(rng.integers(0, 60, 40))
    rows = [(c, int(pos[i]), f"v{i:02d}", j, None if np.isnan(z[i, j]) else int(z[i, j])) for c in ("1", "X") for i in range(40) for j in range(60) if z[i, j] != 0]
    calls = spark.createDataFrame(rows, "contig string, pos int, snp string, iid int, dosage int").repartition(3)
    got = {(r["contig"], r["snp"]) for r in ld.ld_prune_calls(calls, 60, 0.3, width).collect()}
    want = {f"v{i:02d}" for i in greedy(z, pos, 0.3, width) if z[i].any()}
    assert got == {(c, v) for c in ("1", "X") for v in want}
    assert ld.ld_prune_calls(calls.limit(0), 60, 0.3, width).count() == 0


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(6)
    n = 400
    z = rng.binomial(2, np.repeat([0.02, 0.3], [10, 4])[:, None], (14, n)).astype(float)
    z[13] = z[12]  # a condition twice
    x = np.column_stack([np.ones(n), rng.normal(size=n)])
    y = rng.normal(size=(n, 2)) + z[10][:, None] + 0.7 * z[1][:, None]
    subjects = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(n)], "iid int, x array<double>, y array<double>")
    geno = spark.createDataFrame([(v, i, int(z[v, i])) for v in range(14) for i in range(n) if z[v, i]], "variant long, iid int, dosage int")
    return z, x, y, subjects, geno


def members(spark, z, x, resid, sets):
    u = x @ rare.half_projection(x.T @ x)
    rows = [(name, "m", v, float(z[v].mean() / 2), int(z[v].sum()), (z[v] @ resid).tolist(), (z[v] @ u).tolist(), [float(5 + v)]) for name, own in sets.items() for v in own]
    return spark.createDataFrame(rows, "set_name string, mask string, variant long, maf double, mac long, score array<double>, proj array<double>, annot array<double>")


def test_conditional_sets_equal_refitted_models(spark, study):
    z, x, y, subjects, geno = study
    n, bases = len(x), np.array([[1.0, 0.0], [0.5, 1.0]])
    given = {"a": [10, 12, 13], "b": [11, 3], "c": []}
    sets = {"a": [0, 1, 2, 3, 4], "b": [3, 4, 5, 6, 7, 8, 9], "c": [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]}
    resid = y - x @ np.linalg.solve(x.T @ x, x.T @ y)
    table = members(spark, z, x, resid, sets)
    own = members(spark, z, x, resid, {k: v for k, v in given.items() if v}).select("set_name", "variant", "score", "proj")
    inner, df = resid.T @ resid, n - 2
    plain = np.einsum("vi,ij,vj->v", bases, inner, bases) / df
    got = {(r["set_name"], r["index"]): r for r in rare.set_tests(table, None, bases, plain, calls=geno, given=own.unionAll(own), inner=inner, df=df).collect()}
    for name in sets:
        wide = np.column_stack([x, *(z[c] for c in given[name] if c != 13)])  # 13 is 12 again
        again = y - wide @ np.linalg.solve(wide.T @ wide, wide.T @ y)
        spread = np.einsum("vi,ij,vj->v", bases, again.T @ again, bases) / (n - wide.shape[1])
        tested = [v for v in sets[name] if v not in given[name]]
        want = rare.set_tests(members(spark, z, wide, again, {name: tested}), None, bases, spread, calls=geno).collect()
        assert len(want) == 2
        for r in want:
            mine = got[name, r["index"]]
            assert mine["n_variants"] == len(tested) == r["n_variants"] and mine["cmac"] == r["cmac"]
            for c in ("burden_effect", "burden_se", "burden_p", "skat_p", "staar_o"):
                assert (mine[c] is None) == (r[c] is None) and (r[c] is None or mine[c] == pytest.approx(r[c], rel=1e-6, nan_ok=True))
    assert len(got) == 6


def test_conditional_null_imputes_the_mean(spark, study):
    z, x, y, subjects, geno = study
    missing = geno.where("variant = 10").unionByName(spark.createDataFrame([(10, int(np.flatnonzero(z[10] == 0)[0]), None)], geno.schema))
    got = rare.conditional_null(subjects, missing, [10]).orderBy("iid").collect()
    want = z[10].copy()
    want[np.flatnonzero(z[10] == 0)[0]] = z[10].sum() / (len(x) - 1)
    assert [r["x"][2] for r in got] == pytest.approx(want)
    assert rare.conditional_null(subjects, geno, []).count() == len(x)


def test_query_equals_brute_force(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    s = Study(spark, sf_dir)
    got = {}
    for r in analytic.conditional_sets(spark, sf_dir).collect():
        got[r["VARIANT_SET"], r["MASK"], r["INDEX"]] = r
    null = linear.residuals(s.subjects)
    known = {r["variant"]: (r["contig"], r["pos"]) for r in analytic.known_loci(s, null).collect()}
    people = sorted(s.subjects.collect(), key=lambda r: r["iid"])
    x, y = (np.array([r[c] for r in people]) for c in ("x", "y"))
    at = {r["iid"]: k for k, r in enumerate(people)}
    z = {}
    for r in s.geno.collect():
        z.setdefault(r["variant"], np.zeros(len(people)))[at[r["iid"]]] = r["dosage"]
    tested = analytic._mask_members(s, analytic._tested_variants(s)[0]).groupBy("set_name", "mask").agg(F.collect_list("variant").alias("v")).collect()
    genes = {r["set_name"]: r for r in s.genes.collect()}
    checked = 0
    for r in tested:
        g = genes[r["set_name"]]
        given = [v for v, (c, p) in known.items() if c == g["contig"] and g["start"] - 40 <= p < g["end"] + 40]
        own = [v for v in r["v"] if v not in given]
        wide = np.column_stack([x, *(z[v] for v in given)])
        load = np.sum([z[v] for v in own], axis=0) if own else 0
        if len(own) < 2:
            assert (r["set_name"], r["mask"], 1) not in got
            continue
        q = np.linalg.qr(wide)[0]
        rest, resid = load - q @ (q.T @ load), y - q @ (q.T @ y)
        chi = (rest @ resid) ** 2 / (rest @ rest) / ((resid**2).sum(axis=0) / (len(x) - wide.shape[1]))
        for v in range(2):
            assert got[r["set_name"], r["mask"], v + 1]["Burden(1,1)"] == pytest.approx(float(analytic.stats.chi2_sf(chi[v])), rel=1e-5, abs=1e-12)
            checked += bool(given)
    assert checked > 5 and len(known) > 2
