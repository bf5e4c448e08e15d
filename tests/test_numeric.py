"""Numeric operators against plain twins: smoothing, enhancement of maps, drawn sets, bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cortexloom.operators import images, nulls, variants


def plain_weights(coords, bw, i):
    """Weights of one voxel by the definition: a dense kernel over all voxels, a ridge, small weights dropped."""
    n, d = coords.shape
    t = np.column_stack([np.ones(n), coords - coords[i]])
    u = (coords - coords[i]) / bw
    kernel = np.where(np.abs(u) < 4, np.exp(-(u**2) / 2) / np.sqrt(2 * np.pi), 0) / bw
    k = np.diag(kernel.prod(axis=1))
    w = (np.linalg.inv(t.T @ k @ t + 1e-6 * np.eye(d + 1)) @ t.T @ k)[0]
    return np.where(np.abs(w) > 1 / n, w, 0)


def voxels_of(spark, coords):
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(coords)], "voxel int, xyz array<double>")


@pytest.mark.parametrize("shape, bw", [((6, 6, 6), 1.0), ((7, 5, 4), 0.6), ((30, 30), 0.9), ((400,), 0.5), ((6, 6, 6), np.array([0.8, 0.6, 1.0]))])
def test_smoothing_weights(spark, shape, bw, monkeypatch):
    monkeypatch.setattr(images, "PAIRS", 5000)
    coords = np.argwhere(np.ones(shape)).astype(float)
    want = np.array([plain_weights(coords, bw, i) for i in range(len(coords))])
    table = images.smoothing_table(voxels_of(spark, coords), [bw, 0.3])
    dense = np.zeros_like(want)
    for r in table.where("bw = 0").collect():
        assert dense[r["voxel"], r["near"]] == 0
        dense[r["voxel"], r["near"]] = r["w"]
    assert dense == pytest.approx(want, abs=1e-10)
    assert (0 in images.sparse_bandwidths(table, len(coords), 2)) == ((want != 0).sum() / len(coords) <= len(coords) // 10)
    if shape == (6, 6, 6) and np.isscalar(bw):
        assert (want < 0).sum() > 100  # negative weights stay


def test_wide_bandwidths_are_left_out(spark):
    coords = np.argwhere(np.ones((4, 4, 4))).astype(float)
    assert images.sparse_bandwidths(images.smoothing_table(voxels_of(spark, coords), [3.0, 0.2]), 64, 2) == [1]


@pytest.mark.parametrize("held", [256 << 20, 20_000])
def test_choice_of_bandwidth(spark, held, monkeypatch):
    """All candidates in one pass, or a pass for each range of voxels."""
    monkeypatch.setattr(images, "WEIGHT_BYTES", held)
    rng = np.random.default_rng(2)
    coords = np.argwhere(np.ones((15, 15))).astype(float)
    signal = np.sin(coords[:, 0] / 3) + np.cos(coords[:, 1] / 4)
    y = signal + rng.normal(0, 0.3, (20, 225))
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(y)], "iid long, voxels array<double>")
    best, scores = images.choose_bandwidth(frame, voxels_of(spark, coords))
    want = {}
    for bw in images.bandwidths(225, 2):
        s = np.array([plain_weights(coords, bw, i) for i in range(225)])
        if (s != 0).sum() / 225 <= 22:
            want[bw] = ((y - y @ s.T) ** 2).sum(axis=1).mean() / (1 - np.trace(s) / 225 + 1e-10) ** 2
    assert dict(scores) == pytest.approx(want) and best == min(want, key=want.get)
    s = np.array([plain_weights(coords, best, i) for i in range(225)])
    got = {r["iid"]: r["voxels"] for r in images.smooth(frame, images.smoothing_table(voxels_of(spark, coords), [9.0, best]), 225, 1).collect()}
    assert np.array([got[i] for i in range(20)]) == pytest.approx(y @ s.T)


def plain_tfce(coords, p, dh=0.1):
    """Flood fill at each threshold."""
    place = {tuple(c): i for i, c in enumerate(coords.tolist())}
    logp, out = -np.log10(np.maximum(p, 1e-300)), np.zeros(len(p))
    for t in np.arange(max(logp.min(), 0.001), logp.max(), dh):
        seen = set()
        for i in range(len(p)):
            if logp[i] < t or i in seen:
                continue
            stack, comp = [i], {i}
            while stack:
                c = coords[stack.pop()]
                for s in np.vstack([np.eye(len(c), dtype=int), -np.eye(len(c), dtype=int)]):
                    j = place.get(tuple((c + s).tolist()))
                    if j is not None and j not in comp and logp[j] >= t:
                        comp.add(j)
                        stack.append(j)
            seen |= comp
            out[list(comp)] += len(comp) ** 0.5 * t**2 * dh
    return out


@pytest.mark.parametrize("seed", range(8))
def test_tfce_by_thresholds(seed):
    rng = np.random.default_rng(seed)
    coords = np.argwhere(rng.random((5, 4, 6)) < 0.8)
    p = np.where(rng.random(len(coords)) < 0.3, 10.0 ** -rng.integers(0, 9, len(coords)), rng.random(len(coords)))
    at = np.sort(rng.permutation(len(coords))[: rng.integers(1, len(coords) + 1)])
    got = nulls.tfce_scores(nulls.grid_neighbours(coords), at, -np.log10(p[at]))
    assert got == pytest.approx(plain_tfce(coords[at], p[at]))


def test_tfce_summaries(spark):
    rng = np.random.default_rng(5)
    coords = np.argwhere(np.ones((4, 4, 4)))
    grid = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(coords)], "voxel int, xyz array<long>")
    p = 10.0 ** -(rng.random((30, 64)) ** 4 * 8)
    p[3, 5], p[4, :] = np.nan, 1.0
    rows = [(f"g{k}", "m", v + 1, float(p[k, v])) for k in range(30) for v in range(64)] + [("none", "m", 1, None)]
    frame = spark.createDataFrame(rows, "set_name string, mask string, index int, p double").repartition(5)
    got = {r["set_name"]: r for r in nulls.tfce(frame, grid, ["set_name", "mask"], 1e-3, 0.5).collect()}
    assert len(got) == 31 and got["none"]["n_sig_voxels"] == 0 and got["none"]["max_tfce"] == 0
    for k in range(30):
        own = np.flatnonzero(~np.isnan(p[k]))
        score = plain_tfce(coords[own], p[k][own])
        hit = (p[k][own] < 1e-3) & (score >= 0.5)
        r = got[f"g{k}"]
        assert r["max_tfce"] == pytest.approx(score.max()) and r["most_sig_p"] == pytest.approx(p[k][own].min()) and r["n_sig_voxels"] == hit.sum()
        sizes = [int(x) for x in r["voxels_in_each_cluster"].split(",") if x]
        assert sum(sizes) == hit.sum() and len(sizes) == r["n_clusters"]


def test_bins_of_counts(spark):
    values = [1, 2, 3, 5, 6, 7, 8, 100, 101, 500, 501, 9999]
    frame = spark.createDataFrame([(v,) for v in values], "cmac long")
    assert {r["bin"]: r["n_sets"] for r in variants.bin_histogram(frame).collect()} == {"2_2": 1, "3_3": 1, "5_5": 1, "6_7": 2, "8_9": 1, "61_100": 1, "101_500": 2, "501": 2}
    assert frame.where(variants.cmac_bin(F.col("cmac")).isNull()).count() == 5
