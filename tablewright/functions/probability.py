"""Distribution functions as Column arithmetic; the incomplete gamma function needs a vectorised UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The published Chebyshev coefficients of the complementary error function
# (fractional error below 1.2e-7 everywhere), constant term first.
ERFC_COEFFICIENTS = [
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
]


def erfc(x: Column) -> Column:
    t = F.lit(1.0) / (F.lit(1.0) + F.abs(x) / 2)
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = F.lit(c) + t * poly
    tail = t * F.exp(-x * x + poly)
    return F.when(x >= 0, tail).otherwise(F.lit(2.0) - tail)


def normal_cdf(x: Column) -> Column:
    return erfc(-x / F.lit(2.0**0.5)) / 2


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation of the rows where both are present; null where one of them is constant."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def skew_z(n: Column, skewness: Column) -> Column:
    """D'Agostino's transformed skewness."""
    y = skewness * F.sqrt((n + 1) * (n + 3) / (F.lit(6.0) * (n - 2)))
    beta = F.lit(3.0) * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.lit(-1.0) + F.sqrt(F.lit(2.0) * (beta - 1))
    delta = F.lit(1.0) / F.sqrt(F.log(w2) / 2)
    alpha = F.sqrt(F.lit(2.0) / (w2 - 1))
    return delta * F.asinh(F.when(y == 0, 1.0).otherwise(y) / alpha)


def kurtosis_z(n: Column, excess: Column) -> Column:
    """Anscombe and Glynn's transformed kurtosis."""
    mean = F.lit(3.0) * (n - 1) / (n + 1)
    var = F.lit(24.0) * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (excess + 3 - mean) / F.sqrt(var)
    skew = (
        F.lit(6.0) * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
        * F.sqrt(F.lit(6.0) * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    )
    a = F.lit(6.0) + F.lit(8.0) / skew * (F.lit(2.0) / skew + F.sqrt(F.lit(1.0) + F.lit(4.0) / (skew * skew)))
    d = F.lit(1.0) + x * F.sqrt(F.lit(2.0) / (a - 4))
    root = F.signum(d) * F.pow((F.lit(1.0) - F.lit(2.0) / a) / F.abs(d), F.lit(1.0 / 3))
    return (F.lit(1.0) - F.lit(2.0) / (9 * a) - root) / F.sqrt(F.lit(2.0) / (9 * a))


def normality_p(n: Column, skewness: Column, excess: Column) -> Column:
    """p value of the omnibus K2 test; NULL below eight values."""
    z1, z2 = skew_z(n, skewness), kurtosis_z(n, excess)
    return F.when(n >= 8, F.exp(-(z1 * z1 + z2 * z2) / 2))


def gamma_p(shape: float, x):
    """Regularised lower incomplete gamma function of a numpy array: series below shape + 1, else continued fraction."""
    import math

    import numpy as np

    x = np.maximum(np.asarray(x, dtype=float), 0.0)
    out = np.zeros_like(x)
    log_front = lambda v: -v + shape * np.log(v) - math.lgamma(shape)
    low = (x > 0) & (x < shape + 1)
    if low.any():
        v = x[low]
        term = total = np.full_like(v, 1.0 / shape)
        k = shape
        while np.any(np.abs(term) > 1e-14 * np.abs(total)):
            k += 1
            term = term * v / k
            total = total + term
        out[low] = total * np.exp(log_front(v))
    high = x >= shape + 1
    if high.any():
        v = x[high]
        b = v + 1 - shape
        c, d = np.full_like(v, 1e300), 1.0 / b
        h = d
        for i in range(1, 500):
            a = -i * (i - shape)
            b = b + 2
            d = 1.0 / (a * d + b)
            c = b + a / c
            h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-14):
                break
        out[high] = 1.0 - np.exp(log_front(v)) * h
    return out


def digamma(x: Column) -> Column:
    """The logarithmic derivative of the gamma function of a positive number: ten steps up, then the asymptotic series."""
    value = x.cast("double")
    y = value + 10
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6)
    return series - sum((1 / (value + i) for i in range(1, 10)), 1 / value)


def gamma_shape(gap: float, steps: int = 6) -> float:
    """The likeliest shape of a gamma sample from log(mean) - mean(log), by Newton steps on its reciprocal.

    Six steps from the start value settle all digits that matter.
    """
    import math

    def slopes(k: float) -> tuple[float, float]:
        y = k + 10
        first = math.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6)
        second = 1 / y + 1 / (2 * y**2) + 1 / (6 * y**3) - 1 / (30 * y**5) + 1 / (42 * y**7)
        return first - sum(1 / (k + i) for i in range(10)), second + sum(1 / (k + i) ** 2 for i in range(10))

    gap = max(gap, 1e-12)
    k = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
    for _ in range(steps):
        psi, slope = slopes(k)
        k = 1 / (1 / k + (math.log(k) - psi - gap) / (k * k * (1 / k - slope)))
    return k
