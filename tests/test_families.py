"""Likelihood fits of the distribution families against direct likelihoods, and the family that is recognised."""

import math

import numpy as np
import pytest

from tablewright.functions.probability import gamma_shape
from tablewright.operators.distribution import FAMILIES, LOCATIONS, fit_families, identify_distribution


def mean_log(family, x, location, scale, shape):
    """Mean log-likelihood of a row, straight from the density."""
    y = (x - location) / scale
    if family == "normal":
        return np.mean(-(y**2) / 2 - math.log(scale * math.sqrt(2 * math.pi)))
    if family == "uniform":
        return -math.log(scale) if y.min() > -1e-9 and y.max() < 1 + 1e-9 else -math.inf
    if family == "exponential":
        return np.mean(-y) - math.log(scale) if y.min() > -1e-9 else -math.inf
    if y.min() <= 0:
        return -math.inf
    if family == "lognormal":
        return np.mean(-np.log(y * scale * shape * math.sqrt(2 * math.pi)) - np.log(y) ** 2 / (2 * shape**2))
    return np.mean((shape - 1) * np.log(y) - y - math.log(scale) - math.lgamma(shape))


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(6)
    data = {
        "normal": rng.normal(50, 4, 3000), "uniform": rng.uniform(-3, 8, 3000), "exponential": rng.exponential(7, 3000) + 100,
        "lognormal": rng.lognormal(1, 0.8, 3000), "gamma": rng.gamma(3, 2, 3000),
    }
    rows = [(*(float(v[i]) for v in data.values()), 5.0, None) for i in range(3000)]
    names = [*data, "same", "none"]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(4).cache(), data


@pytest.mark.parametrize("shape", [0.05, 0.5, 1.0, 3.7, 80.0, 5000.0])
def test_gamma_shape_solves_its_equation(shape):
    step = 1e-4 * shape
    psi = (math.lgamma(shape + step) - math.lgamma(shape - step)) / (2 * step)
    assert gamma_shape(math.log(shape) - psi) == pytest.approx(shape, rel=2e-3)


def test_fits_are_the_likeliest(samples):
    df, data = samples
    fits = fit_families(df).collect()
    assert {r["column"] for r in fits} == set(data) and len(fits) == len(FAMILIES) * len(data)
    for r in fits:
        x, found = data[r["column"]], (r["location"], r["scale"], r["shape"])
        best = mean_log(r["family"], x, *found)
        assert r["likelihood"] == pytest.approx(best, abs=1e-7)
        for scale in (0.98, 1.02):
            assert mean_log(r["family"], x, found[0], found[1] * scale, found[2]) <= best + 1e-9
            if found[2] is not None:
                assert mean_log(r["family"], x, found[0], found[1], found[2] * scale) <= best + 1e-9
        if r["family"] in ("lognormal", "gamma"):
            width = x.max() - x.min()
            starts = [x.min() - share * width for share in LOCATIONS]
            assert min(abs(found[0] - s) for s in starts) < 1e-9 * width
            others = [np.log(x - s) for s in starts]
            if r["family"] == "lognormal":
                assert best >= max(-y.mean() - math.log(y.std()) - math.log(2 * math.pi) / 2 - 0.5 for y in others) - 1e-9


def test_families_win_on_their_own_samples(samples):
    df, data = samples
    got = {r["column"]: r["distribution_type"] for r in identify_distribution(df).collect()}
    assert {c: got[c] for c in ("normal", "uniform", "lognormal", "gamma")} == {c: c for c in ("normal", "uniform", "lognormal", "gamma")}
    # An exponential sample is a gamma sample of shape 1.
    assert got["exponential"] in ("exponential", "gamma") and got["same"] == got["none"] == "unknown"
    likely = {(r["column"], r["family"]): r["likelihood"] for r in fit_families(df).collect()}
    assert all(max(FAMILIES, key=lambda f: likely[c, f]) == c for c in ("normal", "uniform", "lognormal"))


def test_no_values_and_infinite_ones(spark):
    df = spark.createDataFrame([(1.0,), (math.inf,), (2.0,), (None,)], "x double")
    assert fit_families(df.limit(0)).collect() == [] and fit_families(df.filter("x = 1")).collect() == []
    assert {r["column"] for r in identify_distribution(df).collect()} == {"x"}
