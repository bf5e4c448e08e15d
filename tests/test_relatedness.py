"""Both levels of the stacked ridge against a dense twin, with small parts; association with the predictions taken off."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cortexloom.operators import linear, relatedness
from cortexloom.plans.surrogate import Study

N, BLOCKS, SIZE = 90, 6, 5


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(12)
    z = rng.binomial(2, 0.3, (BLOCKS * SIZE, N)).astype(float)
    x = np.column_stack([np.ones(N), rng.normal(size=N)])
    y = z.T @ rng.normal(size=(len(z), 2)) * 0.3 + rng.normal(size=(N, 2))
    null = spark.createDataFrame([(1000 + i, x[i].tolist(), y[i].tolist()) for i in range(N)], "iid long, x array<double>, y array<double>")
    return z, linear.residuals(null).select("iid", "x", "resid"), null


def dense(z, x, y, fold, contig_of):
    """ldr, contig -> predictions of all subjects."""
    feats, names = [], []
    for b in range(BLOCKS):
        own = z[b * SIZE : (b + 1) * SIZE]
        own = own - own @ x @ np.linalg.inv(x.T @ x) @ x.T
        own = own / own.std(axis=1, keepdims=True)
        for h in relatedness.LEVEL0:
            pred = np.zeros_like(y)
            for k in range(5):
                out, rest = fold == k, fold != k
                beta = np.linalg.solve(own[:, rest] @ own[:, rest].T + len(z) * (1 - h) / h * np.eye(SIZE), own[:, rest] @ y[rest])
                pred[out] = own[:, out].T @ beta
            feats.append(pred)
            names.append(contig_of(b))
    feats, names, got = np.array(feats), np.array(names), {}
    for r in range(y.shape[1]):
        f = feats[:, :, r] / feats[:, :, r].std(axis=1, keepdims=True)
        errors = []
        for h in relatedness.LEVEL1:
            lam, e = 5 * BLOCKS * (1 - h) / h, 0
            for k in range(5):
                out, rest = fold == k, fold != k
                beta = np.linalg.solve(f[:, rest] @ f[:, rest].T + lam * np.eye(len(f)), f[:, rest] @ y[rest, r])
                e += ((y[out, r] - f[:, out].T @ beta) ** 2).sum()
            errors.append((e, lam))
        lam = min(errors)[1]
        for c in sorted(set(names)):
            keep = names != c
            got[r, c] = f[keep].T @ np.linalg.solve(f[keep] @ f[keep].T + lam * np.eye(keep.sum()), f[keep] @ y[:, r])
    return got


@pytest.mark.parametrize("side", [relatedness.SIDE_BYTES, 1])
def test_both_levels(spark, study, side, monkeypatch):
    """Parts of seven subjects, rows of products in several pieces; components one at a time, too."""
    monkeypatch.setattr(relatedness, "ROWS", 4)
    z, null, _ = study
    arranged = relatedness.arrange(null, part=7)
    people = arranged.toPandas().sort_values("row")
    assert people["row"].tolist() == list(range(N)) and (np.diff(people["fold"]) >= 0).all() and people["at"].max() == 6
    resid, x = np.stack(people["resid"].to_numpy()), np.stack(people["x"].to_numpy())
    scale = resid.std(axis=0)
    people["y"] = list(resid / scale)
    order = people["iid"].to_numpy() - 1000
    zz = z[:, order]
    calls = spark.createDataFrame([(v // SIZE, str(v // SIZE % 3 + 1), f"rs{v}", i, int(zz[v, i])) for v in range(len(z)) for i in range(N) if zz[v, i]], "block int, contig string, snp string, iid int, dosage int")
    features = relatedness.level0(calls, people, len(z), calls=True, part=7, most_side=side)
    assert features.agg(F.max(F.size("preds"))).first()[0] == 7
    preds = relatedness.level1(features, relatedness.targets(arranged, scale), scale, sums=2)
    want = dense(zz, x, resid / scale, people["fold"].to_numpy(), lambda b: str(b % 3 + 1))
    got = {(r["iid"], r["contig"]): r["pred"] for r in relatedness.by_subject(preds, arranged).collect()}
    assert len(got) == 3 * N
    for k, iid in enumerate(people["iid"].tolist()):
        for c in "123":
            assert got[iid, c] == pytest.approx([want[r, c][k] * scale[r] for r in range(2)], rel=1e-7, abs=1e-9)


def test_subjects_out_of_order_raise(spark, study):
    _, null, _ = study
    people = relatedness.arrange(null).toPandas().sort_values("row", ascending=False)
    people["y"] = people["resid"]
    with pytest.raises(ValueError, match="order of their folds"):
        relatedness.level0(spark.createDataFrame([], "block int, contig string, snp string, iid int, dosage int"), people, 1, calls=True)


def test_association_takes_the_predictions_off(spark, study):
    z, _, null = study
    rng = np.random.default_rng(1)
    off = rng.normal(size=(2, N, 2))
    loco = spark.createDataFrame([(1000 + i, str(c + 1), off[c, i].tolist()) for c in range(2) for i in range(N)], "iid long, contig string, pred array<double>")
    geno = spark.createDataFrame([(v, 1000 + i, int(z[v, i]), str(v % 2 + 1)) for v in range(4) for i in range(N) if z[v, i]], "variant int, iid long, dosage int, contig string")
    got = {r["variant"]: r for r in linear.gwas_loco(geno, null, loco, ["1", "2"]).collect()}
    people = null.toPandas().sort_values("iid")
    x, y = np.stack(people["x"].to_numpy()), np.stack(people["y"].to_numpy())
    for v in range(4):
        full = np.column_stack([x, z[v]])
        assert got[v]["contig"] == str(v % 2 + 1) and got[v]["beta"] == pytest.approx(np.linalg.lstsq(full, y - off[v % 2], rcond=None)[0][-1])


@pytest.mark.parametrize("size", [13, None])
def test_from_calls_alone(spark, study, size, monkeypatch):
    """The same without any dense block, with calls that lack a dosage, in chunks that cross folds, and sums in several pieces."""
    monkeypatch.setattr(relatedness, "PIECE", 50)
    monkeypatch.setattr(relatedness, "level0", None)
    z, null, _ = study
    arranged = relatedness.arrange(null)
    people = arranged.toPandas().sort_values("row")
    resid, x = np.stack(people["resid"].to_numpy()), np.stack(people["x"].to_numpy())
    scale = resid.std(axis=0)
    zz = z[:, people["iid"].to_numpy() - 1000]
    lacking = {(v, int(np.flatnonzero(zz[v])[0])) for v in range(0, len(z), 4)}
    calls = [(v // SIZE, str(v // SIZE % 3 + 1), f"rs{v}", int(people["iid"].iloc[i]), None if (v, i) in lacking else int(zz[v, i])) for v in range(len(z)) for i in range(N) if zz[v, i]]
    for v, i in lacking:
        zz[v, i] = np.nan
    zz = np.where(np.isnan(zz), np.nanmean(zz, axis=1, keepdims=True), zz)
    frame = spark.createDataFrame(calls, "block int, contig string, variant string, iid long, dosage int")
    want = dense(zz, x, resid / scale, people["fold"].to_numpy(), lambda b: str(b % 3 + 1))
    got = {(r["iid"], r["contig"]): r["pred"] for r in relatedness.called_loco(frame, arranged, scale, len(z), len(calls), size=size).collect()}
    assert len(got) == 3 * N
    for k, iid in enumerate(people["iid"].tolist()):
        for c in "123":
            assert got[iid, c] == pytest.approx([want[r, c][k] * scale[r] for r in range(2)], rel=1e-7, abs=1e-9)


def test_association_reads_the_calls_once(spark, study):
    """One plan for all contigs, whatever their number; covariates, missing dosages and subjects without a prediction count by contig."""
    z, _, null = study
    off = np.random.default_rng(2).normal(size=(3, N, 2))
    loco = spark.createDataFrame([(1000 + i, str(c), off[c, i].tolist()) for c in range(3) for i in range(N - c)], "iid long, contig string, pred array<double>")
    geno = spark.createDataFrame([(v, 1000 + i, None if (v + i) % 9 == 0 else int(z[v, i]), str(v % 3)) for v in range(9) for i in range(N) if z[v, i]], "variant int, iid long, dosage int, contig string")
    got = linear.gwas_loco(geno, null, loco, ["0", "1", "2"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD [variant") + plan.count("LocalRelation [variant") == 1
    people = null.toPandas().sort_values("iid")
    x, y = np.stack(people["x"].to_numpy()), np.stack(people["y"].to_numpy())
    got = {r["variant"]: r for r in got.collect()}
    for v in range(9):
        c, n = v % 3, N - v % 3
        d = np.array([np.nan if z[v, i] and (v + i) % 9 == 0 else z[v, i] for i in range(n)])
        d = np.where(np.isnan(d), np.nanmean(d), d)
        full = np.column_stack([x[:n], d])
        beta, rss = np.linalg.lstsq(full, (y - off[c])[:n], rcond=None)[:2]
        se = np.sqrt(rss / (n - 3) * np.linalg.inv(full.T @ full)[-1, -1])
        assert got[v]["contig"] == str(c) and got[v]["beta"] == pytest.approx(beta[-1]) and got[v]["standard_error"] == pytest.approx(se)
    with pytest.raises(ValueError, match="no predictions"):
        linear.gwas_loco(geno, null, loco, ["0", "7"])


def test_systems_are_solved_in_turns(spark, study, monkeypatch):
    """The driver holds vectors of a few systems at a time, never of all: the same predictions."""
    plain = linear.residuals(Study(spark, "/root/testdata/sf0.001").plain_subjects)
    s = Study(spark, "/root/testdata/sf0.001")
    arranged = relatedness.arrange(plain)
    calls = s.geno.join(s.variants.select("variant", (F.col("variant") % 3 + 1).cast("string").alias("contig")), "variant").withColumn("block", (F.col("contig").cast("int") * 10 + F.floor(F.col("variant") / 50)).cast("int"))
    asked, times = [], relatedness._Features.times
    monkeypatch.setattr(relatedness._Features, "times", lambda self, v, out_of: asked.append(v.shape[1]) or times(self, v, out_of))

    def made():
        asked.clear()
        got = relatedness.called_loco(calls, arranged, np.array([1.0, 2.0]), 200, calls.count())
        return {(r["iid"], r["contig"]): r["pred"] for r in got.collect()}

    want, before = made(), max(asked)
    monkeypatch.setattr(relatedness, "SOLVED", 1)
    got = made()
    assert before > 1 and max(asked) == 1 and got.keys() == want.keys() and len(want) > 300
    assert np.array([got[k] for k in sorted(want)]) == pytest.approx(np.array([want[k] for k in sorted(want)]), rel=1e-6, abs=1e-6)
