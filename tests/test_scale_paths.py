"""The paths taken on large data give the same rows as the short ones, and as brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import features, joins, ordering, strings, vectors
from tablewright.operators.distribution import autocorr_lag1, ks_statistics, spatial_correlation
from tablewright.operators.impute import fit_iterative, impute_knn
from tablewright.operators.power import even_quantiles, fit_power
from tablewright.operators.profile import correlation_matrix, kde
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.sample import balance_oversample, balance_undersample, hash_head, shuffle_rows


@pytest.fixture(scope="module")
def skewed(spark):
    """20,000 rows; a third of them share one value."""
    rng = np.random.default_rng(1)
    x = np.where(rng.random(20000) < 0.33, 7.0, np.round(rng.lognormal(2, 1.5, 20000), 3))
    rows = [(i, float(v), None if i % 9 == 0 else float(v) * 2) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, x double, y double").repartition(7).cache(), x


def test_quantiles_match_numpy(skewed):
    df, x = skewed
    probs = [0.0, 0.01, 0.25, 0.33, 0.5, 0.75, 0.99, 1.0]
    for settle in (10, 2_000_000):
        got = exact_quantiles(df, ["x"], probs, settle_rows=settle)["x"]
        assert [got[p] for p in probs] == pytest.approx(np.quantile(x, probs).tolist(), rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]) == {"x": {0.5: None}}


def test_even_quantiles(skewed):
    df, x = skewed
    want = np.quantile(x, np.linspace(0, 1, 1000))
    for rows in (500, None):
        assert even_quantiles(df, ["x"], 1000, rows)["x"] == pytest.approx(want.tolist(), rel=1e-9)


def test_buckets_do_not_change_order_statistics(skewed):
    df, x = skewed
    columns = ["column", "value", "n", "below", "total"]
    one, many = (ordering.sorted_counts(df, ["x", "y"], r).select(columns) for r in (None, 300))
    assert one.exceptAll(many).count() == 0 and one.count() == many.count()
    for fn in (spatial_correlation, ks_statistics):
        a, b = (sorted(map(tuple, fn(df, ["x", "y"], bucket_rows=r).collect())) for r in (None, 300))
        assert [v for row in a for v in row[1:]] == pytest.approx([v for row in b for v in row[1:]])
    a, b = (autocorr_lag1(df, "id", ["x"], r).first()[1] for r in (None, 300))
    assert a == pytest.approx(b) and a == pytest.approx(abs(np.corrcoef(x[1:], x[:-1])[0, 1]))


def test_spatial_correlation_brute_force(spark):
    values = [1.0, 1.0, 1.0, 1.0, 2.0, 2.5, 9.0, 9.0, 30.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    near = [np.mean(sorted(abs(v - w) for j, w in enumerate(values) if i != j)[:3]) for i, v in enumerate(values)]
    assert spatial_correlation(df, ["x"]).first()[1] == pytest.approx(1 - np.mean(near) / np.std(values))


@pytest.mark.parametrize("sizes", [{"cell_donors": 0, "cell_rows": 30}, {"block_rows": 64}])
@pytest.mark.parametrize("mode", [vectors.ANY, vectors.OTHER, vectors.LATER])
def test_nearest_rows_by_cells_and_blocks(spark, mode, sizes):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(c, 0.5, (100, 3)) for c in (0, 5, 20)] + [np.ones((150, 3))])
    donors = spark.createDataFrame([(i, p.tolist(), 1) for i, p in enumerate(points)], "item bigint, vec array<double>, n bigint")
    queries = donors.select(F.col("item").alias("q"), "vec")
    got = {}
    for r in vectors.nearest_rows(queries, donors, 4, mode, **sizes).collect():
        got.setdefault(r["q"], set()).add(r["item"])
    for q, p in enumerate(points):
        d = ((points - p) ** 2).sum(1)
        allowed = [i for i in range(len(points)) if mode == vectors.ANY or (i != q if mode == vectors.OTHER else i > q)]
        want = set(sorted(allowed, key=lambda i: (d[i], i))[:4])
        assert got.get(q, set()) == want


@pytest.mark.parametrize("sizes", [{}, {"max_cells": 40, "part_rows": 7}, {"max_cells": 3}])
def test_knn_brute_force(spark, sizes):
    rng = np.random.default_rng(5)
    data = rng.normal(0, 3, (120, 3))
    data[rng.random(data.shape) < 0.2] = np.nan
    data[:10] = data[0]
    rows = [(i, *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    got = {r["id"]: r for r in impute_knn(df, ["a", "b", "c"], **sizes).collect()}
    for i, r in enumerate(data):
        for c, name in enumerate("abc"):
            if not math.isnan(r[c]):
                assert got[i][name] == r[c]
                continue
            found = []
            for other in data:
                both = ~np.isnan(r) & ~np.isnan(other)
                if not math.isnan(other[c]) and both.any():
                    found.append((3 / both.sum() * ((r - other)[both] ** 2).sum(), other[c]))
            want = np.mean([v for _, v in sorted(found, key=lambda x: (round(x[0], 9), x[1]))[:5]]) if found else np.nanmean(data[:, c])
            assert got[i][name] == pytest.approx(want)


def test_chained_regressions_row_by_row(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(0, 1, (400, 1))
    data = np.hstack([base + rng.normal(0, 0.1, (400, 1)) * k + 50 for k in (1, 2, 3)])
    holes = rng.random(data.shape) < 0.15
    holed = np.where(holes, np.nan, data)
    rows = [tuple(None if math.isnan(v) else float(v) for v in r) for r in holed]
    df = spark.createDataFrame(rows, "a double, b double, c double").withColumn("id", F.monotonically_increasing_id())
    done = fit_iterative(df, ["a", "b", "c"]).transform(df).orderBy("id").collect()
    got = np.array([[r["a"], r["b"], r["c"]] for r in done])
    assert np.allclose(got[~holes], data[~holes])
    # The regressions must beat the column mean by far on such related columns.
    mean_error = np.abs(np.where(holes, np.nanmean(holed, axis=0) - data, 0)).sum()
    assert np.abs(np.where(holes, got - data, 0)).sum() < 0.5 * mean_error


def test_yeo_johnson_maximises_likelihood(spark):
    x = np.random.default_rng(9).lognormal(0, 0.8, 3000) - 0.5

    def likelihood(lam):
        pos = x >= 0
        y = np.empty_like(x)
        y[pos] = ((x[pos] + 1) ** lam - 1) / lam
        y[~pos] = -((1 - x[~pos]) ** (2 - lam) - 1) / (2 - lam)
        return -len(x) / 2 * np.log(y.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    model = fit_power(spark.createDataFrame([(float(v),) for v in x], "x double"), "yeo-johnson", ["x"])
    lam = model.params["x"][0]
    assert all(likelihood(lam) >= likelihood(lam + step) for step in (-1e-3, -1e-4, 1e-4, 1e-3))


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 0.95])
def test_similar_texts_brute_force(spark, threshold):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    words += ["the quick brown fox " * k + w for k in (1, 3, 9) for w in words[:8]]
    words = sorted(set(words))
    left, right = words[::2] + words[:10], words[1::2] + words[:10]

    def table(rows):
        return spark.createDataFrame([(w,) for w in sorted(set(rows))], "text string")

    def score(a, b):
        size = len(a) + len(b)
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return 1.0 if size == 0 else round(200 * row[-1] / size) / 100

    def _next(row, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(out[j], row[j + 1]))
        return out

    got = {(r["a"], r["b"]): r["s"] for r in strings.similar_texts(table(left), table(right), threshold).collect()}
    want = {(a, b): s for a in set(left) for b in set(right) if (s := score(a, b)) >= threshold - 1e-9}
    assert got == want


def test_similar_texts_leaves_few_candidates(spark):
    """Addresses that differ in a few digits: no match is lost, each candidate comes once, and most pairs are never looked at."""
    rng = random.Random(17)
    hosts = ["www.one", "m.one", "blog.two", "ünï.three", "数据.four"]
    texts = sorted({f"https://{rng.choice(hosts)}.example.org/{rng.choice(['en', 'de'])}/{rng.randint(1, 99999)}.html?page={rng.randint(1, 3)}" for _ in range(700)})
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    want = {(a, b) for a in texts for b in texts if round(200 * strings._common_length(a, b) / (len(a) + len(b))) >= 95}
    assert {(r.a, r.b) for r in strings.similar_texts(df, df, 0.95).collect()} == want
    known = df.select("text", F.lit(3).alias("sides"), F.monotonically_increasing_id().alias("id"))
    near = strings._near_pairs(known, 0.95 - strings.ROUNDING).collect()
    assert len(near) == len(set(near)) and len(near) < 2 * len(want) and len(near) < len(texts) ** 2 / 40


def test_fuzzy_match_columns_brute_force(spark):
    rng = random.Random(13)
    rows = [(i, "".join(rng.choice("xyz") for _ in range(5)), rng.choice(["red", "rod", "green"])) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, name string, kind string")
    for threshold in (0.6, 0.9):
        got = {(r["id_1"], r["id_2"]) for r in strings.fuzzy_match(df, df, ["name", "kind"], threshold).collect()}
        score = lambda a, b: round(200 * strings._common_length(a, b) / (len(a) + len(b))) / 100
        want = {(a[0], b[0]) for a in rows for b in rows if (score(a[1], b[1]) + score(a[2], b[2])) / 2 >= threshold - 1e-9}
        assert got == want


def test_lookup_join_beyond_the_broadcast_bound(spark):
    left = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 4000).alias("k"), "id"
    )
    right = spark.range(3500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        plain = left.join(right, ["k"], how).select("k", "id", "v")
        split = joins.lookup_join(left, right, ["k"], how, max_rows=10).select("k", "id", "v")
        assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0
    assert joins.bounded(right, 10) is None


def test_dense_index_beyond_the_broadcast_bound(spark, monkeypatch):
    values = spark.range(5000).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("v"))
    monkeypatch.setattr(ordering, "bounded", lambda df, *a: None)
    rows = ordering.dense_index(values, "v", "i").collect()
    assert all(int(r["v"][1:]) == r["i"] for r in rows) and len(rows) == 5000


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(3000).withColumn("label", F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 3 == 0, "some").otherwise("most"))
    a, b = df.repartition(1), df.repartition(9)
    assert {r["id"] for r in hash_head(a, ["id"], 1234).collect()} == {r["id"] for r in hash_head(b, ["id"], 1234).collect()}
    assert hash_head(a, ["id"], 1234).count() == 1234 and hash_head(a, ["id"], 5000).count() == 3000
    places = {r["id"]: r["pos"] for r in shuffle_rows(a, ["id"]).collect()}
    assert places == {r["id"]: r["pos"] for r in shuffle_rows(b, ["id"]).collect()} and sorted(places.values()) == list(range(3000))
    even = balance_undersample(b, "label", ["id"]).groupBy("label").count().collect()
    assert {r["count"] for r in even} == {300}
    more = balance_oversample(b, "label", ["id"])
    sizes = {r["label"]: r["count"] for r in more.groupBy("label").count().collect()}
    largest = df.filter("label = 'most'").count()
    assert sizes == {"rare": largest, "some": largest, "most": largest}
    assert more.filter("label = 'most'").select("id").distinct().count() == largest


def test_hot_keys_on_both_sides_are_dealt_over_tasks(spark):
    """A third of the rows of either side have no key: the grid of blocks gives the same pairs, in pieces of bounded size."""
    a = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 400).alias("k"), F.col("id").alias("x"))
    b = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.col("id") % 500).alias("j"), F.col("id").alias("y"))
    for null_equal in (True, False):
        same = F.col("k").eqNullSafe(F.col("j")) if null_equal else F.col("k") == F.col("j")
        want = a.join(b, same).agg(F.count("*"), F.sum(F.xxhash64("k", "x", "y").cast("decimal(30,0)"))).first()
        for pairs in (50, 10_000, 10_000_000):
            got = joins.dealt_join(a, b, {"k": "j"}, pairs, null_equal)
            assert got.columns == ["k", "x", "j", "y"]
            assert got.agg(F.count("*"), F.sum(F.xxhash64("k", "x", "y").cast("decimal(30,0)"))).first() == want


def test_copies_of_a_hot_key_grow_as_its_rows(spark, monkeypatch):
    """Ten times the rows have a hundred times the pairs, but only ten times the copies that are shuffled to make them."""
    grids = []
    monkeypatch.setattr(joins, "bounded", lambda df, keep=joins.bounded: grids.append(df.collect()) or keep(df))
    copies = []
    for n in (10_000, 100_000):
        a, b = spark.range(n).selectExpr("1L AS k", "id AS x"), spark.range(n).selectExpr("1L AS j", "id AS y")
        joins.dealt_join(a, b, {"k": "j"}, 100)
        copies.append(sum(n * (r["_rows"] + r["_cols"]) for r in grids[-1]))
    assert copies[0] < copies[1] <= 11 * copies[0]


@pytest.mark.parametrize("most", [1 << 30, 0])
def test_hot_rows_are_sent_where_they_are_few_and_dealt_in_blocks_else(spark, monkeypatch, most):
    """Keys that are hot on either side, a missing one among them: the same pairs, and no row is copied before a shuffle where rows are sent."""
    monkeypatch.setattr(joins, "SENT_BYTES", most, raising=False)
    monkeypatch.setattr(joins, "SENT_AT_ONCE", 20_000, raising=False)
    monkeypatch.setattr(joins, "COPIES", 2, raising=False)
    monkeypatch.setattr(joins, "TASK_ROWS", 5_000, raising=False)
    key = "CASE WHEN id < {n} THEN NULL WHEN id < {m} THEN 'many' WHEN id < {o} THEN 'few' ELSE concat('c', id % 50) END AS {k}"
    a = spark.range(1500).selectExpr(key.format(n=300, m=1000, o=1020, k="k"), "id % 400 AS x")
    b = spark.range(900).selectExpr("id % 350 AS y", key.format(n=250, m=280, o=800, k="j"), "array(id, id) AS z")
    rows = [F.count("*"), F.sum(F.xxhash64("k", "x", "j", "y", "z").cast("decimal(30,0)"))]
    for null_equal in (True, False):
        same = F.col("k").eqNullSafe(F.col("j")) if null_equal else F.col("k") == F.col("j")
        got = joins.dealt_join(a, b, {"k": "j"}, 100, null_equal)
        assert got.columns == ["k", "x", "y", "j", "z"] and got.agg(*rows).first() == a.join(b, same).agg(*rows).first()
        assert ("sequence(0" in got._jdf.queryExecution().toString()) is not bool(most)


def test_few_hot_rows_meet_a_long_side(spark):
    a, b = spark.range(2000).selectExpr("1L AS k", "id AS x"), spark.range(3).selectExpr("1L AS j", "id AS y")
    got = joins.dealt_join(a, b, {"k": "j"}, 100)
    assert got.count() == got.distinct().count() == 6000
    assert joins.dealt_join(a.limit(0), b, {"k": "j"}).count() == 0


def neighbour_information(values, classes, k=3):
    """The estimator over all pairs of points."""
    from collections import Counter

    def psi(x):
        return -0.5772156649015329 + sum(1 / i for i in range(1, x))

    sizes = Counter(c for v, c in zip(values, classes) if v is not None)
    points = [(v, c) for v, c in zip(values, classes) if v is not None and sizes[c] > 1]
    total = psi(len(points))
    for i, (v, c) in enumerate(points):
        near = min(k, sizes[c] - 1)
        r = sorted(abs(v - w) for j, (w, d) in enumerate(points) if d == c and j != i)[near - 1]
        m = sum(w == v if r == 0 else abs(w - v) < r for w, _ in points)
        total += (psi(near) - psi(sizes[c]) - psi(m)) / len(points)
    return max(0.0, total)


@pytest.mark.parametrize("bucket_rows", [None, 7, 40])
def test_mutual_information_by_neighbours_on_any_ranges(spark, bucket_rows):
    draw = random.Random(8)
    rows = []
    for i in range(150):
        y = draw.choice(["a", "a", "b", "c"])
        rows.append((y, draw.choice([None, draw.randrange(4096) / 4096 + (y == "b")]), float(draw.randrange(5)), {"a": 1.0, "b": 2.0, "c": 3.0}[y], i / 64))
    rows += [("single", 0.5, 1.0, 1.0, 1.0), (None, 0.1, 2.0, 2.0, 2.0), ("d", 9.0, None, 7.0, None), ("d", 9.5, None, 7.0, None)]
    df = spark.createDataFrame(rows, "y string, shifted double, few double, told double, spread double").repartition(4)
    got = {r["feature"]: r["importance"] for r in features.mutual_information(df, ["shifted", "few", "told", "spread"], "y", bucket_rows=bucket_rows).collect()}
    known = [r for r in rows if r[0] is not None]
    for i, name in enumerate(["shifted", "few", "told", "spread"]):
        assert got[name] == pytest.approx(neighbour_information([r[i + 1] for r in known], [r[0] for r in known]), abs=1e-9), name


def test_tfidf_pairs_equal_all_pairs_at_several_thresholds(spark):
    draw = random.Random(9)
    words = [f"w{int(draw.paretovariate(0.8)) % 300}" for _ in range(2000)]
    texts = [" ".join(draw.choices(words, k=draw.choice([1, 3, 30, 80]))) for _ in range(120)]
    texts += [t + " " + draw.choice(words) for t in texts[:60]] + texts[:10] + ["", "!!"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    counts = {i: {w: t.lower().split().count(w) for w in t.lower().split()} for t, i in first.items() if any(c.isalnum() for c in t)}
    df_of = {w: sum(w in c for c in counts.values()) for c in counts.values() for w in c}
    raw = {i: {w: n * (math.log((1 + len(first)) / (1 + df_of[w])) + 1) for w, n in c.items()} for i, c in counts.items()}
    unit = {i: {w: x / math.sqrt(sum(v * v for v in c.values())) for w, x in c.items()} for i, c in raw.items()}
    cosine = {(i, j): sum(x * unit[j].get(w, 0.0) for w, x in unit[i].items()) for i in unit for j in unit if i < j}
    for threshold in (0.5, 0.9):
        got = {(r.id_1, r.id_2): r.similarity for r in strings.tfidf_match(df, "id", "text", threshold).collect()}
        assert got.keys() == {p for p, s in cosine.items() if s >= threshold} and all(s == pytest.approx(cosine[p]) for p, s in got.items())


@pytest.mark.parametrize("small", [False, True])
def test_tfidf_pairs_are_found_inside_the_tasks(spark, monkeypatch, small):
    """No pair is joined or shuffled before it matches; blocks of texts and of words, repeated and missing keys give what the SQL gives."""
    import duckdb

    from tablewright.plans.catalog import ORACLES
    from tablewright.plans.registry import rounded

    def joined(*args, **kwargs):
        raise AssertionError("tokens joined with tokens")

    monkeypatch.setattr(strings, "dealt_join", joined)
    if small:
        for name, value in (("BLOCK_TOKENS", 700), ("WORDS_AT_ONCE", 60), ("COMPARED_AT_ONCE", 50), ("HEAVY", 5), ("RARE_SHARE", 0.02)):
            monkeypatch.setattr(strings, name, value, raising=False)
    draw = random.Random(5)
    words = [f"w{int(draw.paretovariate(0.7)) % 400}" for _ in range(3000)]
    texts = [" ".join(draw.choices(words, k=draw.choice([1, 4, 30, 90]))) for _ in range(150)]
    texts += [f"{t}, {draw.choice(words)}" for t in texts[:70]] + texts[:9] + ["", "!!", None]
    ids = [i if i % 17 else None for i in range(len(texts))]
    ids[40:46] = [7, 7, 50, 50, 90, 90]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    with duckdb.connect() as con:
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", list(zip(ids, texts)))
        want = con.execute(ORACLES["tfidf_match"]).fetchall()
    got = [tuple(r) for r in rounded(strings.tfidf_match(df, "doc_id", "text", 0.8)).collect()]
    assert len(want) > 60 and sorted(r[:4] for r in got) == sorted(r[:4] for r in want)
    assert [r[4] for r in sorted(got)] == pytest.approx([r[4] for r in sorted(want)], abs=2e-6)
    assert strings.tfidf_match(df.limit(0), "doc_id", "text").count() == 0


def test_few_joined_heads_of_texts_that_do_not_match_are_kept(spark):
    draw = random.Random(12)
    texts = [" ".join(f"w{draw.randrange(2000)}" for _ in range(60)) for _ in range(150)]
    texts += [f"{t} w{draw.randrange(2000)}" for t in texts[:10]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = strings.word_postings(df, "id", "text", 0.8).localCheckpoint()
    heads = rows.filter("head").groupBy("token").count().selectExpr("sum(count * (count - 1) / 2) AS n").first()["n"]
    met = strings._joined_heads(rows, rows, F.col("id_1") < F.col("id_2"), 0.8).select("id_1", "id_2").collect()
    assert len(met) < 0.7 * heads and {(i, 150 + i) for i in range(10)} <= {(r["id_1"], r["id_2"]) for r in met}


def test_rows_of_few_matching_texts_are_dealt_over_tasks(spark, monkeypatch):
    """Two texts a side with 600 rows each: the pairs of their rows do not come from the one task that holds the pair of texts."""
    monkeypatch.setattr(strings, "TASK_ROWS", 20_000, raising=False)
    monkeypatch.setattr(joins, "CELL_PAIRS", 20_000)
    word = F.when(F.col("id") % 2 == 0, "red round thing").otherwise("blue square stone")
    left, right = (spark.range(1200).select(F.col("id").alias(k), word.alias("text")).unionByName(spark.createDataFrame([(-1, None), (-2, own)], f"{k} long, text string")) for k, own in (("a", "Thing round, RED"), ("b", "none such")))
    got = strings.tfidf_match_tables(left, right, ["text"], 0.9)
    assert got.columns == ["a_1", "text_1", "b_2", "text_2", "similarity"]
    rows = got.withColumn("task", F.spark_partition_id()).toPandas()
    assert len(rows) == 2 * 600 * 600 + 600 and not rows.duplicated(["a_1", "b_2"]).any()
    assert (rows.similarity.round(9) == 1).all() and ((rows.a_1 - rows.b_2) % 2 == 0)[rows.a_1 >= 0].all() and (rows.b_2[rows.a_1 < 0] % 2 == 0).all()
    assert rows.groupby("task").size().max() < len(rows) / 6


def test_knn_of_many_patterns_is_one_search(spark):
    """Six columns with holes: over fifty combinations of missing columns, and no more jobs than for two."""
    rng = np.random.default_rng(6)
    data = np.round(rng.normal(0, 3, (150, 6)), 2)
    data[rng.random(data.shape) < 0.45] = np.nan
    names = list("abcdef")
    schema = "id int, " + ", ".join(f"{c} double" for c in names)
    df = spark.createDataFrame([(i, *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(data)], schema)

    def jobs(columns):
        group = f"knn-{len(columns)}"
        spark.sparkContext.setJobGroup(group, group)
        got = {r["id"]: r for r in impute_knn(df, columns).collect()}
        return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    _, few = jobs(names[:2])
    got, many = jobs(names)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert many <= few + 3
    for i, r in enumerate(data):
        for c in np.flatnonzero(np.isnan(r)):
            found = []
            for other in data:
                both = ~np.isnan(r) & ~np.isnan(other)
                if not math.isnan(other[c]) and both.any():
                    found.append((((r - other)[both] ** 2).sum() * (6 / both.sum()), other[c]))
            found.sort()
            want = np.mean([v for _, v in found[:5]]) if found else np.nanmean(data[:, c])
            assert got[i][names[c]] == pytest.approx(want)


def test_kde_is_the_plain_sum(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=3000), rng.exponential(3, 1000) + 50, np.full(700, 2.5), [-400.0, 900.0]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    for points in (7, 200):
        got = kde(df, "x", points).orderBy("x").collect()
        h = len(values) ** -0.2 * values.std(ddof=1)
        x = np.linspace(values.min() - 3 * h, values.max() + 3 * h, points)
        want = np.exp(-(((x[:, None] - values) / h) ** 2) / 2).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
        assert np.allclose([r.x for r in got], x, rtol=1e-12)
        assert np.abs([r.density for r in got] - want).max() < 3e-13 / (h * np.sqrt(2 * np.pi))
    assert kde(df.limit(0), "x").count() == 0
    assert kde(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x").count() == 0


def test_autocorrelation_of_many_columns_over_ranges(spark):
    rng = np.random.default_rng(5)
    n = 2000
    order = [None] + [int(i) for i in rng.integers(0, 700, n - 1)]
    a, b = np.cumsum(rng.normal(size=n)), rng.normal(size=n)
    rows = [
        (order[i], i, float(a[i]) if i % 3 else None, float(b[i]) if 600 < (order[i] or 0) < 610 else None, 4.0, None) for i in range(n)
    ]
    df = spark.createDataFrame(rows, "o long, i long, a double, b double, c double, d double")
    lines = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = {}
    for k, name in enumerate("ab", 2):
        line = np.array([r[k] for r in lines if r[k] is not None])
        want[name] = abs(np.corrcoef(line[1:], line[:-1])[0, 1])
    for size in (None, 100):
        got = {r[0]: r[1] for r in autocorr_lag1(df, "o", ["a", "b", "c", "d"], size, ties=["i"]).collect()}
        assert got == pytest.approx(want | {"c": 0.0, "d": 0.0}, abs=1e-9)


def test_correlation_with_a_constant_column(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.5, 5.0), (4.0, 7.0, 5.0), (None, 3.0, 5.0)], "a double, b double, c double")
    got = {(r[0], r[1]): r[2] for r in correlation_matrix(df).collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef([1, 2, 4], [2, 4.5, 7])[0, 1])
    assert got["a", "c"] is None and got["c", "b"] is None and got["c", "c"] == 1
