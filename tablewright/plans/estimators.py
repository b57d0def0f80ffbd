"""Queries: imputation, scaling, transforms, feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import long_rows
from ..operators import features, impute, power, scale, smart
from .inputs import HOLED_LINES, HOLED_PARTS, LINE_KEY, holed_lines, holed_parts
from .registry import Tables, query, rounded

_key = ", ".join(LINE_KEY)
WITH_HOLES = f"WITH h AS ({HOLED_LINES})"
WITH_PARTS = f"WITH h AS ({HOLED_PARTS})"
FILLED = ["l_quantity", "l_extendedprice", "l_discount"]


def _median(c: str, source: str = "h") -> str:
    return f"(SELECT quantile_cont({c}, 0.5) FROM {source})"


def _mode(c: str, source: str = "h") -> str:
    return f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(
    f"""{WITH_HOLES}, s AS (SELECT {', '.join(f'{_median(c)} AS {c}' for c in FILLED)}),
    f AS (SELECT {', '.join(f'coalesce(h.{c}, s.{c}) AS {c}' for c in FILLED)} FROM h, s) """
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, round(min(({c} - m) / d), 6) AS min, round(max(({c} - m) / d), 6) AS max,
        round(sum(abs(({c} - m) / d)), 3) AS total FROM f, (SELECT avg({c}) AS m, stddev_samp({c}) AS d FROM f) GROUP BY ALL"""
        for c in FILLED
    )
)
def impute_and_scale(t: Tables):
    """Missing cells filled with medians, then standardised, summed up per column."""
    filled = impute.fit_simple(holed_lines(t), "median", FILLED).transform(holed_lines(t))
    scaled = scale.fit_scale(filled, "zscore", FILLED).transform(filled)
    aggs = [
        a.alias(f"{k}{i}")
        for i, c in enumerate(FILLED)
        for k, a in (("n", F.count(c)), ("a", F.min(c)), ("b", F.max(c)), ("s", F.sum(F.abs(c))))
    ]
    records = [
        {"column": F.lit(c), "n": F.col(f"n{i}"), "min": F.col(f"a{i}"), "max": F.col(f"b{i}"), "total": F.col(f"s{i}")}
        for i, c in enumerate(FILLED)
    ]
    return rounded(long_rows(scaled.agg(*aggs), records), 6, total=3)


def _fill_sql(fills: dict[str, str]) -> str:
    return f"{WITH_HOLES} SELECT {_key}, " + ", ".join(f"round(coalesce({c}, {v}), 6) AS {c}" for c, v in fills.items()) + " FROM h"


def _filled(t: Tables, method: str, **options):
    done, _ = impute.impute(holed_lines(t), method, FILLED, **options)
    return rounded(done.select(*LINE_KEY, *FILLED))


@query(_fill_sql({c: f"(SELECT avg({c}) FROM h)" for c in FILLED}))
def impute_mean(t: Tables):
    return _filled(t, "mean")


@query(_fill_sql({c: _median(c) for c in FILLED}))
def impute_median(t: Tables):
    return _filled(t, "median")


@query(_fill_sql({c: _mode(c) for c in FILLED}))
def impute_most_frequent(t: Tables):
    return _filled(t, "most_frequent")


@query(_fill_sql({c: "0" for c in FILLED}))
def impute_constant(t: Tables):
    return _filled(t, "constant")


@query(_fill_sql({c: f"(SELECT min({c}) FROM h)" for c in FILLED}))
def impute_scaled(t: Tables):
    return _filled(t, "constant", scale="minmax")


@query(f"{WITH_HOLES} SELECT {_key}, coalesce(l_returnflag, {_mode('l_returnflag')}) AS l_returnflag FROM h")
def impute_nonnumeric_mode(t: Tables):
    return impute.impute(holed_lines(t), "median", ["l_returnflag"])[0].select(*LINE_KEY, "l_returnflag")


@query(
    f"{WITH_HOLES} SELECT {_key}, "
    + ", ".join(f"round(coalesce({c}, {_median(c)}), 6) AS {c}" for c in FILLED)
    + f", coalesce(l_returnflag, {_mode('l_returnflag')}) AS l_returnflag, l_tax FROM h",
    name="impute",
)
def impute_all(t: Tables):
    done, _ = impute.impute(holed_lines(t), "median")
    return rounded(done.select(*LINE_KEY, *FILLED, "l_returnflag", "l_tax"))


_ranked = """SELECT p_partkey, round(avg(v), 6) AS v FROM (SELECT r.p_partkey, x.{t} AS v,
    row_number() OVER (PARTITION BY r.p_partkey ORDER BY abs(x.{o} - r.{o}), x.{t}) AS k
    FROM h r JOIN h x ON r.{t} IS NULL AND r.{o} IS NOT NULL AND x.{t} IS NOT NULL AND x.{o} IS NOT NULL) WHERE k <= 5 GROUP BY p_partkey"""


_KNN = (
    f"""{WITH_PARTS}, a AS ({_ranked.format(t='p_size', o='p_retailprice')}), b AS ({_ranked.format(t='p_retailprice', o='p_size')})
    SELECT h.p_partkey, round(coalesce(h.p_size, a.v, (SELECT avg(p_size) FROM h)), 6) AS p_size,
      round(coalesce(h.p_retailprice, b.v, (SELECT avg(p_retailprice) FROM h)), 6) AS p_retailprice
    FROM h LEFT JOIN a ON a.p_partkey = h.p_partkey LEFT JOIN b ON b.p_partkey = h.p_partkey"""
)


@query(_KNN)
def impute_knn(t: Tables):
    done, _ = impute.impute(holed_parts(t), "knn", ["p_size", "p_retailprice"])
    return rounded(done.select("p_partkey", "p_size", "p_retailprice"))


@query()
def impute_knn_scaled(t: Tables):
    # One column decides on the other, so only ties differ from impute_knn: rounding decides them after scaling.
    done, _ = impute.impute(holed_parts(t), "knn", ["p_size", "p_retailprice"], scale="standard")
    return rounded(done.select("p_partkey", "p_size", "p_retailprice"))


@query()
def impute_iterative(t: Tables):
    done, _ = impute.impute(holed_lines(t), "iterative", FILLED)
    return rounded(done.select(*LINE_KEY, *FILLED))


@query(
    """WITH h AS (SELECT vec_id, i, CASE WHEN (vec_id + i) % 6 <> 0 THEN CAST(embedding[i + 1] AS DOUBLE) END AS v FROM embeddings, range(64) AS r(i)),
    m AS (SELECT i, avg(v) AS m FROM h GROUP BY i)
    SELECT vec_id, list(round(coalesce(v, m), 6) ORDER BY i) AS embedding FROM h JOIN m USING (i) GROUP BY vec_id"""
)
def impute_array(t: Tables):
    holed = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") + i) % 6 != 0, x.cast("double")))
    done = impute.impute_array(t.embeddings.select("vec_id", holed.alias("embedding")), "embedding", 64, "mean")
    # A value that rounds to zero keeps its sign, as in IEEE arithmetic and SQL; F.round alone would drop it.
    return done.select("vec_id", F.transform("embedding", lambda x: F.abs(F.round(x, 6)) * F.signum(x)).alias("embedding"))


SIMPLE = {"outlier_methods": ("z", "iqr"), "families": ("normal", "uniform")}


@query()
def suggest_imputer(t: Tables):
    rows = smart.suggest_imputer(_events(t), ["value", "user_id", "event_type"], "event_id", ["event_id"])
    return rounded(rows.drop("dtype"))


@query(name="suggest_imputer_plain")
def suggest_plain(t: Tables):
    """The recommendation without the forest rule."""
    rows = smart.suggest_imputer(_events(t), ["value", "user_id", "event_type"], "event_id", ["event_id"], **SIMPLE)
    return rows.select("column", "method", "reason")


HOLED_EVENTS = """SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN value END AS value,
  CASE WHEN event_id % 9 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS event_type FROM events"""


def _events(t: Tables):
    def holes(c: str, every: int):
        return F.when(F.col("event_id") % every != 0, F.col(c)).alias(c)

    return t.events.select("event_id", holes("value", 6), holes("user_id", 9), holes("event_type", 4))


@query(
    f"""WITH h AS ({HOLED_EVENTS}) SELECT event_id, round(coalesce(value, {_median('value')}), 6) AS value,
      round(coalesce(user_id, {_median('user_id')}), 6) AS user_id, coalesce(event_type, {_mode('event_type')}) AS event_type FROM h"""
)
def impute_smart(t: Tables):
    # Columns with outliers get their median, text its mode.
    done, _ = smart.impute_smart(_events(t), "event_id", ["event_id"])
    return rounded(done.select("event_id", "value", "user_id", "event_type"))


def _scaled(t: Tables, method: str, digits: int = 6):
    model = scale.fit_scale(holed_lines(t), method, FILLED)
    return rounded(model.transform(holed_lines(t)).select(*LINE_KEY, *FILLED), digits)


def _scale_sql(expr: str, stats: str, digits: int = 6) -> str:
    parts = ", ".join(f"round({expr.format(c=c)}, {digits}) AS {c}" for c in FILLED)
    facts = ", ".join(stats.format(c=c) for c in FILLED)
    return f"{WITH_HOLES}, s AS (SELECT {facts} FROM h) SELECT {_key}, {parts} FROM h, s"


@query(_scale_sql("({c} - a_{c}) / b_{c}", "avg({c}) AS a_{c}, stddev_samp({c}) AS b_{c}"))
def scale_zscore(t: Tables):
    return _scaled(t, "zscore")


@query(_scale_sql("({c} - a_{c}) / b_{c}", "min({c}) AS a_{c}, max({c}) - min({c}) AS b_{c}"))
def scale_minmax(t: Tables):
    return _scaled(t, "minmax")


@query(_scale_sql("{c} / power(10, trunc(log10(a_{c})) + 1)", "max(abs({c})) AS a_{c}", 8))
def scale_decimal(t: Tables):
    return _scaled(t, "decimal", 8)


@query(_scale_sql("log10({c} + CASE WHEN a_{c} <= 0 THEN abs(a_{c}) + 1 ELSE 0 END)", "min({c}) AS a_{c}"))
def scale_log10(t: Tables):
    return _scaled(t, "log10")


@query(_scale_sql("({c} - a_{c}) / b_{c}", "quantile_cont({c}, 0.5) AS a_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS b_{c}"))
def scale_robust(t: Tables):
    return _scaled(t, "robust")


@query(
    """WITH s AS (SELECT o_orderkey, o_orderstatus, CAST(floor(o_totalprice) AS VARCHAR) AS total, o_custkey FROM orders)
    SELECT o_orderkey, o_orderstatus, round((floor(o_totalprice) - (SELECT avg(floor(o_totalprice)) FROM orders)) /
      (SELECT stddev_samp(floor(o_totalprice)) FROM orders), 6) AS total FROM orders"""
)
def normalize(t: Tables):
    # The amounts arrive as text and are found to be numeric; the status is not.
    text = t.orders.select("o_orderstatus", F.floor("o_totalprice").cast("string").alias("total"))
    model = scale.fit_scale(text, "zscore")
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.floor("o_totalprice").cast("string").alias("total"))
    return rounded(model.transform(rows))


@query()
def transform_yeojohnson(t: Tables):
    model = power.fit_power(t.customer, "yeo-johnson", ["c_acctbal"])
    return rounded(model.transform(t.customer).select("c_custkey", "c_acctbal"), 4)


@query()
def transform_boxcox(t: Tables):
    model = power.fit_power(t.part, "box-cox", ["p_retailprice"])
    return rounded(model.transform(t.part).select("p_partkey", "p_retailprice"), 4)


_cdf = """WITH q AS (SELECT unnest(range(1000)) AS i, unnest(quantile_cont(value, {probs})) AS q FROM events),
    lo AS (SELECT q, max(i) AS i FROM q GROUP BY q), up AS (SELECT q, min(i) AS i FROM q GROUP BY q),
    e AS (SELECT event_id, value FROM events),
    j AS (SELECT e.event_id, e.value, lo.q AS q0, lo.i AS i0 FROM e ASOF JOIN lo ON e.value >= lo.q),
    k AS (SELECT j.*, up.q AS q1, up.i AS i1 FROM j ASOF JOIN up ON j.value <= up.q)
    SELECT event_id, round(CASE WHEN value = (SELECT max(value) FROM events) THEN 1 WHEN value = (SELECT min(value) FROM events) THEN 0
      WHEN q0 = value THEN (i0 + i1) / 2 / 999.0 ELSE (i0 + (value - q0) / (q1 - q0) * (i1 - i0)) / 999.0 END, 6) AS value FROM k"""


@query(_cdf.format(probs="[" + ", ".join(f"{i}/999.0" for i in range(1000)) + "]"))
def transform_quantile_uniform(t: Tables):
    model = power.fit_quantile(t.events, "quantile_uniform", ["value"])
    return rounded(model.transform(t.events).select("event_id", "value"))


@query(_cdf.format(probs="[" + ", ".join(f"{i}/999.0" for i in range(1000)) + "]"))
def transform(t: Tables):
    done, _ = power.fit_transform(t.events, "quantile_uniform", ["value"])
    return rounded(done.select("event_id", "value"))


@query(_cdf.format(probs="[" + ", ".join(f"{i}/999.0" for i in range(1000)) + "]"))
def transform_quantile_normal(t: Tables):
    model = power.fit_quantile(t.events, "quantile_normal", ["value"])
    # The normal scores, mapped back through the normal distribution function, are the uniform ones.
    back = power.QuantileModel("quantile_normal", {"value": [0.0, 1.0]})
    return rounded(back.inverse(model.transform(t.events)).select("event_id", "value"))


@query("SELECT p_partkey, round(p_retailprice, 4) AS p_retailprice FROM part")
def inverse_transform_boxcox(t: Tables):
    done, model = power.fit_transform(t.part, "box-cox", ["p_retailprice"])
    return rounded(power.inverse_transform(done, model).select("p_partkey", "p_retailprice"), 4)


# The likelihood on an even grid of lambdas and a parabola through its three best points.
_likelihood = """SELECT '{name}' AS "column", l, -count(*) / 2 * ln(var_pop({value})) + (l - 1) * sum({term}) AS f
    FROM {table}, (SELECT i / 50.0 AS l FROM range(-250, 251) AS r(i)) WHERE l <> 0 AND l <> 2 GROUP BY l"""
_yeo = "CASE WHEN {c} >= 0 THEN (power({c} + 1, l) - 1) / l ELSE -(power(1 - {c}, 2 - l) - 1) / (2 - l) END"


@query(
    "WITH g AS ("
    + _likelihood.format(name="c_acctbal", table="customer", value=_yeo.format(c="c_acctbal"), term="sign(c_acctbal) * ln(1 + abs(c_acctbal))")
    + " UNION ALL "
    + _likelihood.format(name="p_retailprice", table="part", value="power(p_retailprice, l) / l", term="ln(p_retailprice)")
    + """), b AS (SELECT "column", arg_max(l, f) AS l FROM g GROUP BY 1),
    p AS (SELECT b."column", b.l, max(f) FILTER (round((g.l - b.l) * 50) = -1) AS x, max(f) FILTER (round((g.l - b.l) * 50) = 0) AS y,
      max(f) FILTER (round((g.l - b.l) * 50) = 1) AS z FROM b JOIN g ON g."column" = b."column" GROUP BY ALL)
    SELECT "column", round(l + (x - z) / (2 * (x - 2 * y + z)) / 50, 2) AS lambda FROM p"""
)
def power_lambda(t: Tables):
    models = {"c_acctbal": power.fit_power(t.customer, "yeo-johnson", ["c_acctbal"]), "p_retailprice": power.fit_power(t.part, "box-cox", ["p_retailprice"])}
    rows = [(c, float(m.params[c][0])) for c, m in models.items()]
    return rounded(t.spark.createDataFrame(rows, "`column` string, `lambda` double"), 2)


@query("SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal, c_mktsegment FROM customer")
def inverse_transform(t: Tables):
    done, model = power.fit_transform(t.customer, "yeo-johnson", ["c_acctbal"])
    return rounded(power.inverse_transform(done, model).select("c_custkey", "c_acctbal", "c_mktsegment"), 4)


SCORED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


_f_score = """SELECT '{c}' AS feature, round((sum(n * m * m) - power(sum(n * m), 2) / sum(n)) / (count(*) - 1)
    / (sum(n * v) / (sum(n) - count(*))), 5) AS importance
  FROM (SELECT l_returnflag, count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v FROM lineitem GROUP BY 1)"""
F_SCORES = " UNION ALL ".join(_f_score.format(c=c) for c in SCORED)


@query(f"SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) <= 2 AS selected FROM ({F_SCORES})")
def select_kbest(t: Tables):
    report, _ = features.select_features(t.lineitem, "l_returnflag", SCORED, "kbest", 2)
    return rounded(report, 5)


def _digamma(x: str) -> str:
    y = f"({x} + 10.0)"
    steps = " - ".join(f"1 / ({x} + {i}.0)" for i in range(10))
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) - {steps})"


# The third neighbour within the class among the values beside, then the points of all classes nearer than it.
_mutual = f"""SELECT '{{c}}' AS feature, round(greatest(0, {_digamma('sum(n)')} + sum(n * ({_digamma('k')} - {_digamma('ny')} - {_digamma('m')})) / sum(n)), 6) AS importance
    FROM (WITH a AS (SELECT l_returnflag AS y, CAST({{c}} AS DOUBLE) AS v, count(*) AS n FROM lineitem GROUP BY ALL),
    b AS (SELECT *, sum(n) OVER (PARTITION BY y) AS ny FROM a), e AS (SELECT y, v, n, ny, least(3, ny - 1) AS k FROM b WHERE ny > 1),
    s AS (SELECT *, [{{{{'d': 0.0, 'o': v, 'n': n - 1}}}}, {', '.join(f"{{{{'d': abs(v - {f}(v, {i}) OVER w), 'o': {f}(v, {i}) OVER w, 'n': {f}(n, {i}) OVER w}}}}" for i in (1, 2, 3) for f in ('lag', 'lead'))}] AS l
      FROM e WINDOW w AS (PARTITION BY y ORDER BY v)),
    t AS (SELECT y, v, n, ny, k, list_filter(l, lambda x: x.d IS NOT NULL) AS l FROM s),
    r AS (SELECT y, v, n, ny, k, list_min(list_transform(list_filter(l, lambda x: list_sum(list_transform(l, lambda z: CASE WHEN z.d <= x.d THEN z.n ELSE 0 END)) >= k),
      lambda x: {{{{'d': x.d, 'o': x.o}}}})) AS q FROM t),
    i AS (SELECT y, v, n, ny, k, q.d = 0 AS tied, CASE WHEN q.o < v THEN q.o ELSE v - q.d END AS low, CASE WHEN q.o > v THEN q.o ELSE v + q.d END AS high FROM r),
    c AS (SELECT v AS x, sum(sum(n)) OVER (ORDER BY v) AS upto, sum(n) AS own FROM e GROUP BY v)
    SELECT i.n, i.ny, i.k, CASE WHEN tied THEN same.own ELSE hi.upto - coalesce(lo.upto, 0) END AS m
    FROM i JOIN c same ON same.x = i.v ASOF LEFT JOIN c hi ON i.high > hi.x ASOF LEFT JOIN c lo ON i.low >= lo.x)"""


@query(" UNION ALL ".join(_mutual.format(c=c) for c in SCORED))
def select_mutual_info(t: Tables):
    return rounded(features.mutual_information(t.lineitem, SCORED, "l_returnflag"))


@query()
def select_random_forest(t: Tables):
    report, _ = features.select_features(t.customer, "c_mktsegment", ["c_acctbal", "c_nationkey"], "random_forest", 2)
    return rounded(report)


@query("SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority_index FROM orders")
def label_encode(t: Tables):
    return features.label_encode(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query(F_SCORES + " ORDER BY importance DESC, feature")
def sort_importance(t: Tables):
    return rounded(features.sort_importance(features.anova_f(t.lineitem, SCORED, "l_returnflag")), 5)


def _best(rank: int) -> str:
    """The value of the feature with that rank of importance."""
    return f"CASE (SELECT feature FROM r WHERE place = {rank}) " + " ".join(f"WHEN '{c}' THEN {c}" for c in SCORED) + " END"


@query(
    f"""WITH r AS (SELECT feature, row_number() OVER (ORDER BY importance DESC, feature) AS place FROM ({F_SCORES}))
    SELECT least(a, b) AS smaller, greatest(a, b) AS larger FROM (SELECT {_best(1)} AS a, {_best(2)} AS b FROM lineitem)"""
)
def feature_transform(t: Tables):
    _, model = features.select_features(t.lineitem, "l_returnflag", SCORED, "kbest", 2)
    # The names of the chosen features depend on the table; their values are compared.
    a, b = (F.col(c) for c in features.feature_transform(t.lineitem, model).columns)
    return features.feature_transform(t.lineitem, model).select(F.least(a, b).alias("smaller"), F.greatest(a, b).alias("larger"))


@query(F_SCORES)
def select_features(t: Tables):
    return rounded(features.select_features(t.lineitem, "l_returnflag", SCORED)[0].select("feature", "importance"), 5)
