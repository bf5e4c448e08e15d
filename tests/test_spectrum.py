"""Components of wide images against the full eigenproblem."""

import numpy as np
import pytest

from cortexloom.operators import linear, spectrum
from cortexloom.plans.surrogate import Study


def frame(spark, x, parts=3):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "iid int, voxels array<double>").repartition(parts)


def check(found, x, k, rel=1e-6):
    bases, values = found
    c = x - x.mean(axis=0)
    want, vectors = np.linalg.eigh(c.T @ c)
    assert values == pytest.approx(want[::-1][:k], rel=rel, abs=rel * want[-1])
    assert bases.T @ bases == pytest.approx(np.eye(k), abs=1e-8)
    residual = c.T @ (c @ bases) - bases * values
    assert np.linalg.norm(residual, axis=0).max() < 1e-5 * want[-1]


def test_images_of_the_tables(spark, sf_dir):
    images = Study(spark, sf_dir.replace("0.001", "0.01")).images
    x = np.array([r["voxels"] for r in images.collect()])
    check(linear.principal_components(images, 10), x, 10)
    s = spectrum.ImageSpectrum(images)
    assert s.trace == pytest.approx(((x - x.mean(axis=0)) ** 2).sum()) and s.n == len(x)


@pytest.mark.parametrize("state", [1, spectrum.STATE_BYTES])
def test_more_voxels_than_images(spark, state, monkeypatch):
    """1,500 voxels, close eigenvalues, with and without restarts; products in several parts of the shuffle."""
    monkeypatch.setattr(spectrum, "STATE_BYTES", state)
    monkeypatch.setattr(spectrum, "PART_BYTES", 1 << 15)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 30)) * np.linspace(9, 3, 30) @ rng.normal(size=(30, 1500)) + rng.normal(size=(80, 1500)) + 5
    check(linear.principal_components(frame(spark, x), 6), x, 6)


def test_rank_below_what_is_asked(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 25))
    bases, values = linear.principal_components(frame(spark, x), 8)
    assert bases.shape == (25, 8) and (values[3:] < 1e-8 * values[0]).all()
    check((bases[:, :3], values[:3]), x, 3)
    same = np.ones((5, 4))
    assert linear.principal_components(frame(spark, same), 2)[1] == pytest.approx([0, 0])


def test_odd_images(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [3.0, 5.0])], "iid int, voxels array<double>")
    s = spectrum.ImageSpectrum(rows)
    assert (s.n, s.width, s.trace) == (2, 2, pytest.approx(6.5))
    with pytest.raises(ValueError):
        spectrum.ImageSpectrum(rows.limit(0))
    uneven = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "iid int, voxels array<double>")
    with pytest.raises(Exception, match="without 2 voxels|without 1 voxels"):
        spectrum.ImageSpectrum(uneven)
