import math

import numpy as np
import pytest

from cortexloom.functions import stats


@pytest.mark.parametrize("q, lam, p", [
    (6, [4, 3, 2, 1], 0.6329193), (5, [4, 3, 2, 1], 0.7069172), (10, [4, 3, 2, 1], 0.38244247), (60, [4, 3, 2, 1], 0.0004239342),
    (600, [4, 3, 2, 1], 6.531105e-34), (0.1, [4, 3, 2, 1], 0.9997457), (0.0001, [4, 3, 2, 1], 1.0), (6, [3, 2, 1], 0.36787944),
])
def test_saddlepoint(q, lam, p):
    assert stats.saddlepoint(q, lam) == pytest.approx(p, rel=2e-3)


def one_tail(q, lam):
    """The tail at one value, step by step."""
    lam = np.sort(lam)[::-1]
    scale = lam[0]
    q, lam = (q if q > 0 else 1e-4) / scale, lam / scale
    low, high = -0.01 if q > lam.sum() else -len(lam) / (2 * q), 0.499995
    for _ in range(30):
        x = (low + high) / 2
        if sum(v / (1 - 2 * v * x) for v in lam) > q:
            high = x
        else:
            low = x
    x = (low + high) / 2
    inner = 2 * (x * q + 0.5 * sum(math.log(1 - 2 * v * x) for v in lam))
    if abs(x) < 1e-4 or inner <= 0:
        return float(stats.moment_match(q * scale, lam * scale))
    w, v = math.copysign(math.sqrt(inner), x), x * math.sqrt(sum(2 * v * v / (1 - 2 * v * x) ** 2 for v in lam))
    return 0.5 * math.erfc((w + math.log(v / w) / w) / math.sqrt(2))


def test_saddlepoint_of_many_values(monkeypatch):
    rng = np.random.default_rng(2)
    for k in range(25):
        lam = np.where(rng.random(rng.integers(1, 12)) < 0.2, 0, rng.gamma(1, 3, 1))
        q = np.r_[rng.gamma(2, lam.sum() + 0.1, 20), 0.0, -3.0, lam.sum(), np.nan]
        monkeypatch.setattr(stats, "SADDLE_CELLS", 1 if k % 2 else 50)
        got = stats.saddlepoint(q, lam)
        want = [one_tail(float(v), lam) if v == v and lam.max() > 0 else math.nan for v in q]
        assert got == pytest.approx(want, rel=1e-9, nan_ok=True)
    assert stats.saddlepoint(np.zeros((2, 3)), [1.0]).shape == (2, 3) and math.isnan(stats.saddlepoint(1.0, []))


def test_tails_of_set_spectra(spark, sf_dir):
    from cortexloom.plans import analytic

    rows = analytic.skat_tails(spark, sf_dir.replace("0.001", "0.01")).collect()
    assert len(rows) > 100 and {r["weights"] for r in rows} == {"1,25", "1,1"}
    for r in rows[::7]:
        assert r["p"] == pytest.approx(one_tail(r["q"], np.array(r["eigenvalues"])), rel=1e-9)


def test_cauchy_combination():
    assert stats.cauchy_combination([0.5, 0.01, 0.1]) == pytest.approx(0.02729619, rel=1e-6)
    assert stats.cauchy_combination([0.5, 0.01, 0.1], [1, 2, 3]) == pytest.approx(0.02614868, rel=1e-6)
    assert stats.cauchy_combination([0.5, 1e-17, 0.1]) == pytest.approx(3e-17, rel=1e-6)
    assert stats.cauchy_combination([0.0, 0.5]) == 0 and stats.cauchy_combination([1.0, 0.5]) == 1
    assert math.isnan(stats.cauchy_combination([0.0, 1.0])) and math.isnan(stats.cauchy_combination([np.nan, 0.5]))
    with pytest.raises(ValueError):
        stats.cauchy_combination([0.5], [-1])
    with pytest.raises(ValueError):
        stats.cauchy_combination([1.5])


def test_tails():
    assert stats.chi2_sf(3.841458820694124) == pytest.approx(0.05)
    assert stats.chi2_isf(0.05) == pytest.approx(3.841458820694124)
    assert stats.chi2_isf(1.91e-10) == pytest.approx(40.6, rel=1e-2)
    assert stats.norm_ppf(0.975) == pytest.approx(1.959963984540054)
    assert stats.t_sf2(2.0, 10) == pytest.approx(0.07338803, rel=1e-6)
    assert stats.chi2_sf(5.0, 3) == pytest.approx(0.17179714, rel=1e-6)
    assert stats.beta_pdf(0.01, 1, 25) == pytest.approx(25 * 0.99**24)


def test_hwe_exact():
    assert stats.hwe_exact(10, 0, 0) == 1
    whole = sum(p for p in [stats.hwe_exact(0, 0, 0)])
    assert whole == 1
    assert stats.hwe_exact(50, 0, 50) < 1e-20
    assert stats.hwe_exact(25, 50, 25, mid=False) == pytest.approx(1.0)
