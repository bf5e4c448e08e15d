"""Set tests from members that carry their calls, in few batches, against the tests of single sets; windows that points name."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cortexloom.functions import stats
from cortexloom.operators import intervals, linear, nulls, permutations, rare, variants
from cortexloom.plans.surrogate import Study


@pytest.fixture(scope="module")
def study(spark):
    """Calls of 40 variants, subjects, members of overlapping sets of 1 to 12 variants, some without notes."""
    rng = np.random.default_rng(8)
    n, m = 700, 40
    z = rng.binomial(2, np.repeat([0.004, 0.12], m // 2)[:, None], (m, n)).astype(float)
    z[5] = 0
    x = np.column_stack([np.ones(n), rng.normal(size=n)])
    y = rng.normal(size=(n, 2)) + 0.2 * z[:3].sum(axis=0)[:, None]
    resid = y - x @ np.linalg.solve(x.T @ x, x.T @ y)
    geno = spark.createDataFrame([(int(v), int(i), int(z[v, i])) for v, i in zip(*np.nonzero(z))], "variant long, iid long, dosage int")
    subjects = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(n)], "iid long, x array<double>, y array<double>")
    half = rare.half_projection(x.T @ x)
    sets = {f"S{k}": sorted(rng.choice(m, 1 + k % 12, replace=False).tolist()) for k in range(50)}
    rows = [(s, mask, v, float(z[v].mean() / 2), int(z[v].sum()), (z[v] @ resid).tolist(), (z[v] @ x @ half).tolist(), None if mask == "b" and v % 3 == 0 else [5.0 + v, 9.0]) for s, own in sets.items() for mask in "ab" for v in own]
    members = spark.createDataFrame(rows, "set_name string, mask string, variant long, maf double, mac long, score array<double>, proj array<double>, annot array<double>").repartition(3)
    return z, x, resid, geno, subjects, sets, members, pd.DataFrame(rows, columns=members.columns)


@pytest.mark.parametrize("gathered", [50, 10**6])
def test_stacked_sets_are_single_sets(spark, study, gathered, monkeypatch):
    z, x, resid, geno, _, sets, members, table = study
    monkeypatch.setattr(rare, "GATHERED_CALLS", gathered)
    monkeypatch.setattr(rare, "SET_CELLS", 100)
    bases, variance = np.array([[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]]), np.array([1.0, 0.6, 1.1])
    null = {"4_4": ([np.array([0.1, 3.0])] * 3, 50)}
    got = {(r["set_name"], r["mask"], r["index"]): r for r in rare.set_tests(members, None, bases, variance, calls=geno, null=null).collect()}
    checked = set()
    for (name, mask), own in table.groupby(["set_name", "mask"]):
        own = own.sort_values("variant")
        g, cmac = z[own["variant"]], int(own["mac"].sum())
        if len(own) < 2 or cmac < 2:
            assert (name, mask, 1) not in got
            continue
        proj, annot = np.stack(own["proj"]), np.stack(own["annot"]) if own["annot"].notna().all() else None
        want, groups = rare.test_set(np.stack(own["score"]), g @ g.T - proj @ proj.T, own["maf"].to_numpy(), cmac, annot, bases, variance, ("burden", "skat", "staar"), null)
        for v in range(3):
            r = got.pop((name, mask, v + 1))
            assert r["n_variants"] == len(own) and r["cmac"] == cmac
            for c in ("burden_effect", "burden_se", "burden_p", "skat_p", "staar_o", *(f"staar_{k}" for k in rare.GROUPS)):
                assert (r[c] is None) == np.isnan(want[c][v]) and (r[c] is None or r[c] == pytest.approx(want[c][v], rel=1e-4))
            for k in rare.GROUPS:
                assert r[k] == (None if groups[k] is None else pytest.approx(groups[k][:, v], rel=1e-4, nan_ok=True))
        checked.add((cmac > 100, cmac > 500 and annot is not None))
    assert not got and checked == {(False, False), (True, False), (True, True)}


def test_no_row_is_made_for_a_call(spark, study):
    """Only rows of members, with arrays, are dealt to sets: the plan makes no row for a call after they are gathered by variant."""
    *_, geno, _, _, members, _ = study
    plan = rare.set_tests(members, None, np.eye(2), np.ones(2), calls=geno)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "iids" in plan and plan.index("collect_list") > plan.index("RepartitionByExpression")


def test_rows_of_variants(spark, study):
    z, x, resid, geno, subjects, *_ = study
    null = linear.residuals(subjects)
    qc = {r["variant"]: r for r in variants.variant_qc(geno, len(x)).collect()}
    scores, proj = ({r["variant"]: r[1] for r in f.collect()} for f in (rare.scores(geno, null), rare.projections(geno, null, x.T @ x)))
    for r in rare.variant_rows(geno, null, x.T @ x, len(x)).collect():
        one = qc.pop(r["variant"])
        assert (r["maf"], r["mac"]) == (one["maf"], one["mac"]) and r["score"] == pytest.approx(scores[r["variant"]]) and r["proj"] == pytest.approx(proj[r["variant"]])
        assert dict(zip(r["iids"], r["dosages"])) == {int(i): z[r["variant"], i] for i in np.flatnonzero(z[r["variant"]])}
    assert not qc


def test_permuted_clusters_by_places(spark, study):
    z, x, resid, geno, subjects, _, members, _ = study
    null, kept = linear.residuals(subjects), members.where("set_name < 'S3'").drop("score")
    some = null.where("iid % 50 <> 0")  # carriers without a null model count in products alone
    order = lambda df: sorted(map(tuple, df.select("sample_id", "set_name", "mask", "size").collect()))
    want = order(nulls.permuted_clusters(kept, geno, some, np.eye(2), np.ones(2), 4, 0.4))
    for most in (None, 0):
        side = permutations.Side(some.select("iid", "resid"), ["resid"], most, index=False)
        rows = rare.variant_rows(geno, null.select("iid", "x", "resid").join(side.placed.select("iid", "place"), "iid", "left"), x.T @ x, len(x))
        if most is None:
            assert order(nulls.permuted_clusters(kept, rows, some, np.eye(2), np.ones(2), 4, 0.4, side=side)) == want and len(want) > 50 and any(r[3] for r in want)
    full = permutations.Side(null.select("iid", "resid"), ["resid"], 0, index=False)
    rows = rare.variant_rows(geno, null.select("iid", "x", "resid").join(full.placed.select("iid", "place"), "iid"), x.T @ x, len(x))
    assert order(nulls.permuted_clusters(kept, rows, null, np.eye(2), np.ones(2), 2, 0.4, side=full)) == order(nulls.permuted_clusters(kept, geno, null, np.eye(2), np.ones(2), 2, 0.4))


def test_saddlepoints_of_rows():
    rng = np.random.default_rng(2)
    lam, q = rng.gamma(1, 2, (30, 6)), rng.gamma(3, 5, (30, 4))
    lam[3], q[5, 1], q[6, 0] = 0, np.nan, 0
    got = stats.saddlepoint_rows(q, lam)
    for k in range(30):
        assert got[k] == pytest.approx(stats.saddlepoint(q[k], lam[k]), rel=1e-6, nan_ok=True)


@pytest.mark.parametrize("length, step", [(20, None), (7, 3), (5, 5), (4, 9)])
def test_points_name_their_windows(spark, length, step):
    rng = np.random.default_rng(length)
    points = spark.createDataFrame([(str(c), int(p)) for c in range(4) for p in rng.integers(0, 60 if c else 6, 50)], "contig string, pos int")
    summary = variants.range_summary(points)
    got = intervals.window_members(points, summary, length, step)
    want = intervals.interval_join(points, intervals.sliding_windows(summary, length, step))
    assert sorted(map(tuple, got.select("contig", "pos", "set_name", "start", "end").collect())) == sorted(map(tuple, want.select("contig", "pos", "set_name", "start", "end").collect()))


def test_windows_are_not_joined(spark, sf_dir):
    """No list of windows, whose number grows with the positions, is broadcast or joined."""
    from cortexloom.plans import analytic, relational

    for query in (analytic.sliding_window_tests, relational.sliding_windows):
        assert "_bucket" not in query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert analytic.sliding_window_tests(spark, sf_dir).where(F.col("n_variants") > 20).count() == 0 and Study(spark, sf_dir).n > 0


def test_products_by_blocks_of_subjects():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    z = rng.binomial(2, 0.3, (7, 500)).astype(float)
    z[2], rows = 0, [np.flatnonzero(v) for v in z]
    table = pa.table({"set_name": ["a", "a", "a", "b", "c", "c", "c"], "mask": ["m"] * 7, "iids": [rng.permutation(r) * 7 for r in rows], "dosages": [np.zeros(0)] * 7})
    table = table.set_column(3, "dosages", pa.array([z[k][np.asarray(i, int) // 7] for k, i in enumerate(table["iids"].to_pylist())]))
    sets = rare.CalledSets(table, np.array([0, 3, 4, 7]))
    for k, own in enumerate((slice(0, 3), slice(3, 4), slice(4, 7))):
        for subjects in (4096, 64):
            assert sets.products(k, subjects) == pytest.approx(z[own] @ z[own].T)
