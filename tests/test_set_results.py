"""Results of set tests by name, and the chains of bootstrap and permutation to cluster sizes, against plain twins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cortexloom.functions import stats
from cortexloom.operators import linear, nulls, rare


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(3)
    z = rng.binomial(2, 0.12, (9, 900)) * (rng.random((9, 900)) < 0.9)
    y = rng.normal(size=(900, 2)) + 0.25 * z[:3].sum(axis=0)[:, None]
    x = np.column_stack([np.ones(900), rng.normal(size=900)])
    geno = spark.createDataFrame([(int(v), int(i), int(z[v, i])) for v, i in zip(*np.nonzero(z))], "variant long, iid long, dosage int")
    subjects = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(900)], "iid long, x array<double>, y array<double>")
    return z, x, y, geno, subjects


def members_of(spark, z, x, resid, annot, sets):
    half = rare.half_projection(x.T @ x)
    maf = z.mean(axis=1) / 2
    rows = [(s, "m", int(v), float(maf[v]), int(z[v].sum()), (z[v] @ resid).tolist(), (z[v] @ x @ half).tolist(), annot[v].tolist()) for s, own in sets.items() for v in own]
    return spark.createDataFrame(rows, "set_name string, mask string, variant long, maf double, mac long, score array<double>, proj array<double>, annot array<double>")


def test_all_p_values_of_a_set(spark, study):
    z, x, y, geno, subjects = study
    m = np.eye(900) - x @ np.linalg.solve(x.T @ x, x.T)
    resid, bases = m @ y, np.array([[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]])
    variance = np.einsum("vi,ij,vj->v", bases, resid.T @ resid, bases) / (900 - 2)
    annot = np.random.default_rng(1).uniform(1, 30, (9, 2))
    sets = {"a": [0, 1, 2, 3], "b": [4, 5, 6, 7, 8], "one": [1]}
    got = rare.set_tests(members_of(spark, z, x, resid, annot, sets), None, bases, variance, calls=geno)
    wide = {(r["VARIANT_SET"], r["INDEX"]): r.asDict() for r in rare.named(got, ["A", "B"]).collect()}
    assert set(wide) == {(s, i) for s in "ab" for i in (1, 2, 3)}
    for s in "ab":
        own = sets[s]
        g, cov = z[own], z[own] @ m @ z[own].T
        score, maf = g @ resid, g.mean(axis=1) / 2
        every = []
        for density, base in (("1,25", stats.beta_pdf(maf, 1, 25)), ("1,1", np.ones(len(own)))):
            for test in ("Burden", "SKAT"):
                ps = []
                for k, name in ((None, ""), (0, "-A"), (1, "-B")):
                    extra = 1.0 if k is None else 1 - 10 ** (-annot[own, k] / 10)
                    w = base * (extra if test == "Burden" else np.sqrt(extra))
                    if test == "Burden":
                        p = stats.chi2_sf((w @ score @ bases.T) ** 2 / variance / (w @ cov @ w))
                    else:
                        q = ((w[:, None] * score @ bases.T) ** 2).sum(axis=0) / variance
                        p = np.array([stats.saddlepoint(float(v), np.linalg.eigvalsh(w[:, None] * cov * w)) for v in q])
                    ps.append(p)
                    assert [wide[s, i][f"{test}({density}){name}"] for i in (1, 2, 3)] == pytest.approx(p, rel=1e-6)
                assert [wide[s, i][f"STAAR-{test}({density})"] for i in (1, 2, 3)] == pytest.approx(stats.cauchy_combination(np.stack(ps)), rel=1e-6)
                every += ps
        assert [wide[s, i]["STAAR-O"] for i in (1, 2, 3)] == pytest.approx(stats.cauchy_combination(np.stack(every)), rel=1e-6)
    assert rare.named(got, staar_only=True).columns == ["INDEX", "VARIANT_SET", "MASK", "N_VARIANTS", "CMAC", "STAAR-O"]
    table = rare.burden_table(got).where("VARIANT_SET = 'a' and INDEX = 1").first()
    w = np.ones(4)
    assert table["Burden_effect"] == pytest.approx((w @ (z[:4] @ resid))[0] / (w @ (z[:4] @ m @ z[:4].T) @ w))
    few = rare.set_tests(members_of(spark, z, x, resid, annot, sets), None, bases, variance, max_p=1e-4, calls=geno)
    least = {k: min(v for n, v in r.items() if "(" in n or n == "STAAR-O") for k, r in wide.items()}
    kept = {(r["set_name"], r["index"]) for r in few.collect()}
    assert {k for k, v in least.items() if v <= 1e-4} <= kept
    only = rare.set_tests(members_of(spark, z, x, resid, annot, sets), None, bases, variance, ("burden",), calls=geno)
    assert only.where("skat_1_25 is not null or staar_o is not null and not isnan(staar_o)").count() == 0


def test_set_products_are_band_products(spark, study):
    z, _, _, geno, _ = study
    where = spark.createDataFrame([(v, "1", v) for v in range(9)], "variant long, contig string, pos int")
    band = {(r["i"], r["j"]): r["value"] for r in rare.banded_ld(geno, where, 20).collect()}
    own = {v: k for k, v in enumerate(range(9))}
    got = rare.set_products(geno.toPandas(), own, subjects=64)
    assert got == pytest.approx(z @ z.T) and all(got[i, j] == v for (i, j), v in band.items())


def test_bootstrap_chain(spark, study):
    z, x, y, geno, subjects = study
    bases = np.random.default_rng(4).normal(size=(12, 2))
    frame = spark.createDataFrame([(v, b.tolist()) for v, b in enumerate(bases)], "voxel int, b array<double>")
    for at_once, side in ((2, None), (3, None), (2, 0)):
        got = {(r["sample_id"], r["variant"]): r["size"] for r in nulls.bootstrap_clusters(geno, subjects, frame, 3, 0.2, at_once=at_once, most_side=side).collect()}
        draws = nulls.wild_bootstrap(linear.residuals(subjects).select("iid", "resid"), 3)
        want = {}
        for k in range(3):
            yb = np.array([r["resid"] for r in draws.where(F.col("sample_id") == k).orderBy("iid").collect()])
            m = np.eye(900) - x @ np.linalg.solve(x.T @ x, x.T)
            gr, r = z @ m, m @ yb
            left = (gr * gr).sum(axis=1)
            beta = gr @ r / left[:, None]
            se = np.sqrt(((r * r).sum(axis=0) - beta**2 * left[:, None]) / (900 - 3) / left[:, None])
            sigma = r.T @ r / 900
            scale = ((se**2 + beta**2 / 900) / np.diag(sigma)).mean(axis=1)
            bv = beta @ bases.T
            zv = bv / np.sqrt(scale[:, None] * np.einsum("vi,ij,vj->v", bases, sigma, bases) - bv**2 / 900)
            for v, n in enumerate((stats.chi2_sf(zv**2) <= 0.2).sum(axis=1)):
                want[k, v] = n
        assert got == want and sum(want.values()) > 0


def test_permutation_chain(spark, study):
    z, x, y, geno, subjects = study
    m = np.eye(900) - x @ np.linalg.solve(x.T @ x, x.T)
    resid, bases = m @ y, np.eye(2)
    variance = (resid**2).sum(axis=0) / 898
    annot = np.full((9, 1), 10.0)
    sets = {"a": [0, 1, 2, 3], "b": [4, 5, 6, 7, 8]}
    members = members_of(spark, z, x, resid, annot, sets)
    null = linear.residuals(subjects)
    got, joined = ({(r["sample_id"], r["set_name"]): r["size"] for r in nulls.permuted_clusters(members.drop("score"), geno, null, bases, variance, 2, 0.9, most_side=side).collect()} for side in (None, 0))
    assert got == joined
    drawn = nulls.permuted_rows(null, 2)
    for k in range(2):
        own = np.array([r["resid"] for r in drawn.where(F.col("sample_id") == k).orderBy("iid").collect()])
        again = rare.set_tests(members_of(spark, z, x, own, annot, sets), None, bases, variance, calls=geno)
        for r in again.groupBy("set_name").agg(F.count_if(F.expr("staar_o <= 0.9")).alias("n")).collect():
            assert got[k, r["set_name"]] == r["n"]
    assert len(got) == 4


def test_plans_do_not_grow_with_replicates(spark, study):
    z, x, y, geno, subjects = study
    frame = spark.createDataFrame([(0, [1.0, 0.0])], "voxel int, b array<double>")
    m = np.eye(900) - x @ np.linalg.solve(x.T @ x, x.T)
    members = members_of(spark, z, x, m @ y, np.full((9, 1), 10.0), {"a": [0, 1]}).drop("score")
    size = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    for side in (None, 0):
        few, many = (size(nulls.bootstrap_clusters(geno, subjects, frame, k, 0.2, most_side=side)) for k in (2, 200))
        assert few == many
        few, many = (size(nulls.permuted_clusters(members, geno, linear.residuals(subjects), np.eye(2), np.ones(2), k, 0.2, most_side=side)) for k in (2, 200))
        assert few == many


def test_bootstrap_takes_missing_calls_as_the_mean(spark, study):
    z, x, y, geno, subjects = study
    gone = geno.withColumn("dosage", F.when(F.col("iid") % 11 == 0, None).otherwise(F.col("dosage")))
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.3, 0.6])], "voxel int, b array<double>")
    got = {(r["sample_id"], r["variant"]): r["size"] for r in nulls.bootstrap_clusters(gone, subjects, frame, 8, 0.5).collect()}
    joined = {(r["sample_id"], r["variant"]): r["size"] for r in nulls.bootstrap_clusters(gone, subjects, frame, 8, 0.5, most_side=0).collect()}
    assert got == joined and len(got) == 72 and 0 < sum(got.values()) < 144


def test_sets_are_handed_over_whole_and_together(spark, monkeypatch):
    """Many sets, one of several batches, one without calls, ids beyond doubles: the rows of each as a cogroup gives them, in few batches."""
    import os

    import pandas as pd

    monkeypatch.setattr(rare, "GATHERED", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        big = 2**60 + 1
        members = spark.createDataFrame([(f"S{k}", m, big + k, [float(k)]) for k in range(60) for m in ("a", "b")], "set_name string, mask string, variant long, proj array<double>")
        joined = spark.createDataFrame([(f"S{k}", m, big + k, i) for k in range(59) for m in ("a", "b") for i in range(2000 if k == 7 else 5)], "set_j string, mask_j string, variant long, iid long").repartition(7)

        def run(key, left, right):
            assert set(left["set_name"]) == {key[0]} and set(right["mask_j"]) <= {key[1]}
            same = len(right) == 0 or set(right["variant"]) == set(left["variant"])
            return pd.DataFrame({"set_name": key[0], "mask": key[1], "n": [len(right)], "total": int(right["iid"].sum()), "variant": left["variant"], "same": same, "pid": os.getpid()})

        got = rare.by_set(members, joined, run, "set_name string, mask string, n long, total long, variant long, same boolean, pid long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 120 and all(r["same"] for r in got)
    assert {(r["set_name"], r["mask"]): (r["n"], r["total"], r["variant"]) for r in got} == {(f"S{k}", m): (n, n * (n - 1) // 2, big + k) for k in range(60) for m in ("a", "b") for n in [0 if k == 59 else 2000 if k == 7 else 5]}


@pytest.mark.parametrize("side", [None, 0])
def test_bootstrap_takes_calls_by_batches(spark, study, side):
    """Variants whose calls span many batches, in one task: the sizes are those of whole variants."""
    *_, geno, subjects = study
    frame = spark.createDataFrame([(v, [float(np.cos(v)), float(np.sin(v))]) for v in range(4)], "voxel int, b array<double>")
    want = {(r["sample_id"], r["variant"]): r["size"] for r in nulls.bootstrap_clusters(geno, subjects, frame, 4, 0.3, at_once=3, shards=1, most_side=side).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = nulls.bootstrap_clusters(geno, subjects, frame, 4, 0.3, at_once=3, shards=1, most_side=side)
        rows = made.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == len(want) and {(r["sample_id"], r["variant"]): r["size"] for r in rows} == want and len(set(want.values())) > 1
    assert "FlatMapGroups" not in made._jdf.queryExecution().toString()  # no task takes all calls of a shard at once
