"""The split into three clusters and its silhouette against brute force over all pairs of cuts."""

import itertools
import math

import numpy as np
import pytest

from tablewright.operators.clusters import best_cuts, cluster_tendency, prefix_sums


def brute_cuts(x):
    """The cuts of least squared error over the distinct values."""
    values = np.unique(x)

    def error(part):
        return ((part - part.mean()) ** 2).sum()

    def cost(a, b):
        return sum(error(x[m]) for m in (x <= values[a], (x > values[a]) & (x <= values[b]), x > values[b]))

    costs = {ab: cost(*ab) for ab in itertools.combinations(range(len(values) - 1), 2)}
    limit = min(costs.values()) + 1e-9 * error(x)
    return next(ab for ab, c in costs.items() if c <= limit)


def brute_tendency(x):
    values = np.unique(x)
    if len(x) < 10 or len(values) < 2:
        return 0.0
    a, b = brute_cuts(x) if len(values) > 2 else (0, 1)
    label = np.where(x <= values[a], 1, np.where(x <= values[b], 2, 3))
    scores = []
    for i, v in enumerate(x):
        own = label == label[i]
        if own.sum() == 1:
            scores.append(0.0)
            continue
        far = np.abs(x - v)
        inside = far[own].sum() / (own.sum() - 1)
        other = min(far[label == k].mean() for k in set(label) - {label[i]})
        scores.append((other - inside) / max(other, inside) if max(other, inside) else 0.0)
    return max(0.0, float(np.mean(scores)))


def shapes():
    rng = np.random.default_rng(4)
    hot = np.where(rng.random(150) < 0.4, 5.0, rng.normal(0, 3, 150).round(2))
    return {
        "blobs": np.concatenate([rng.normal(m, 0.3, 45) for m in (0, 4, 11)]),
        "plain": rng.uniform(-1, 1, 150),
        "skewed": rng.lognormal(0, 2, 150),
        "hot": hot,
        "far": np.concatenate([rng.normal(1e9, 1, 100), [1e9 + 5000] * 7]),
        "few": rng.integers(0, 4, 150).astype(float),
        "even": np.arange(100.0) * 0.1,
        "three": np.array([1.0, 2.0, 9.0] * 20),
        "wide": np.array([*(10.0**k for k in range(-10, 40)), 3.0, 3.0]),
    }


@pytest.fixture(scope="module")
def table(spark):
    made = shapes() | {"two": np.array([3.0] * 9 + [8.0]), "one": np.array([4.0] * 30), "short": np.arange(9.0), "none": np.array([])}
    rows = [tuple(float(v[i]) if i < len(v) else (None if i % 2 else float("nan")) for v in made.values()) for i in range(170)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in made)).repartition(5).cache(), made


@pytest.mark.parametrize("cells,bucket_rows", [(1 << 20, None), (64, 40)])
def test_split_and_silhouette(table, cells, bucket_rows):
    df, made = table
    got = {r["column"]: r["cluster_tendency"] for r in cluster_tendency(df, bucket_rows=bucket_rows, cells=cells).collect()}
    assert got == pytest.approx({c: brute_tendency(v) for c, v in made.items()}, abs=1e-6)
    names = list(shapes())
    values, totals = prefix_sums(df, names, bucket_rows)
    cuts = best_cuts(values, {r["column"]: r["distinct"] for r in totals.collect()}, cells)
    assert cuts == {c: brute_cuts(made[c]) for c in names}


def test_positions_and_sums(table):
    df, made = table
    values, _ = prefix_sums(df, ["hot"], 20)
    rows = sorted(values.collect(), key=lambda r: r["i"])
    assert [r["i"] for r in rows] == list(range(len(np.unique(made["hot"]))))
    assert rows[-1]["count"] == 150 and rows[-1]["total"] == pytest.approx(0, abs=1e-9)
    assert np.cumsum([r["n"] for r in rows]).tolist() == [r["count"] for r in rows]


def test_infinite_values_and_empty_tables(spark):
    x = [1.0, 1.2, 5.0, 5.1, 9.0, 9.2, 1.1, 5.3, 9.1, 9.3]
    df = spark.createDataFrame([(v,) for v in [*x, math.inf, -math.inf, None]], "x double")
    assert cluster_tendency(df).first()[1] == pytest.approx(brute_tendency(np.array(x)))
    assert cluster_tendency(df.limit(0)).collect() == [("x", 0.0)]
    assert cluster_tendency(df.selectExpr("cast(x as string) x")).collect() == []
    with pytest.raises(ValueError):
        cluster_tendency(df, k=4)
