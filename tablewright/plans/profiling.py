"""Queries: missing values, column profiles, distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import clusters, distribution as dist, missing, profile
from ..operators.impute import fit_simple
from .inputs import HOLED_LINES, LINE_KEY, NUMBER_TEXTS, holed_lines, number_texts
from .registry import Tables, query, rounded, union_sql

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
WITH_HOLES = f"WITH h AS ({HOLED_LINES})"
HOLED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

_total = " + ".join(f"count(*) - count({c})" for c in HOLED)


@query(
    f"{WITH_HOLES} "
    + union_sql(
        "SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, "
        "round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_percentage, "
        f"{_total} AS total_missing, round(100.0 * ({_total}) / (count(*) * {len(HOLED)}), 6) AS total_missing_percentage FROM h",
        HOLED,
    )
)
def missing_stats(t: Tables):
    return rounded(missing.missing_stats(holed_lines(t), HOLED))


@query(
    f"{WITH_HOLES} SELECT \"column\" FROM ("
    + union_sql("SELECT '{c}' AS \"column\", count(*) - count({c}) AS n FROM h", HOLED)
    + ") WHERE n > 0"
)
def columns_with_missing(t: Tables):
    names = missing.columns_with_missing(holed_lines(t), HOLED)
    return t.spark.createDataFrame([(c,) for c in names], "column string")


@query(
    f"{WITH_HOLES} SELECT "
    + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}" for c in HOLED)
    + ", count(*) AS rows FROM h GROUP BY "
    + ", ".join(str(i + 1) for i in range(len(HOLED)))
)
def missing_pattern(t: Tables):
    return missing.missing_pattern(holed_lines(t), HOLED)


@query(
    f"{WITH_HOLES} SELECT \"column\", note FROM ("
    + union_sql(
        "SELECT '{c}' AS \"column\", count(*) - count({c}) AS n, printf('{c}: %d (%.1f%%)', count(*) - count({c}), "
        "100.0 * (count(*) - count({c})) / count(*)) AS note FROM h",
        HOLED,
    )
    + ") WHERE n > 0"
)
def missing_notes(t: Tables):
    return missing.missing_notes(holed_lines(t), HOLED)


_hash = "CAST('0x' || substr(md5(concat_ws('|', {k}, '{c}|42')), 1, 8) AS BIGINT)"
_key_sql = ", ".join(f"CAST({k} AS VARCHAR)" for k in LINE_KEY)


@query(
    f"SELECT {', '.join(LINE_KEY)}, "
    + ", ".join(
        f"CASE WHEN {_hash.format(k=_key_sql, c=c)} >= {int(0.2 * 2**32)} THEN {c} END AS {c}"
        for c in ("l_quantity", "l_returnflag")
    )
    + " FROM lineitem"
)
def inject_missing(t: Tables):
    columns = ["l_quantity", "l_returnflag"]
    return missing.inject_missing(t.lineitem.select(*LINE_KEY, *columns), LINE_KEY, columns)


@query(
    f"""WITH s AS ({NUMBER_TEXTS}) SELECT {', '.join(LINE_KEY)},
    CASE WHEN regexp_matches(flag, '^\\s*$') THEN NULL ELSE flag END AS flag, quantity FROM s"""
)
def blank_to_null(t: Tables):
    return missing.blanks_to_null(number_texts(t).select(*LINE_KEY, "flag", "quantity"))


FORMAT_SQL = r"""CASE WHEN {v} IS NULL THEN NULL
  WHEN regexp_matches({v}, '^\s*[-+]?\d+\s*$') THEN 'integer'
  WHEN regexp_matches({v}, '^\s*[-+]?\d*\.\d+\s*$') THEN 'decimal'
  WHEN regexp_matches({v}, '^\s*[-+]?\d+(\.\d+)?\s*%\s*$') THEN 'percentage'
  WHEN regexp_matches({v}, '^\s*[$€¥£]\s*[-+]?\d+(\.\d+)?\s*$') OR regexp_matches({v}, '^\s*[-+]?\d+(\.\d+)?\s*[$€¥£]\s*$') THEN 'currency'
  WHEN regexp_matches({v}, '^\s*[-+]?\d*\.?\d+[eE][-+]?\d+\s*$') THEN 'scientific'
  WHEN regexp_matches({v}, '^\s*[-+]?\d{{1,3}}(,\d{{3}})*(\.\d+)?\s*$')
    OR TRY_CAST(trim(trim(replace({v}, ',', ''), '$€¥£%')) AS DOUBLE) IS NOT NULL THEN 'decimal' END"""

TEXTS = ["quantity", "tax", "money", "scale", "flag"]
_formats = ["integer", "decimal", "percentage", "currency", "scientific"]


@query(
    f"WITH s AS ({NUMBER_TEXTS}), f AS ("
    + union_sql("SELECT '{c}' AS \"column\", {c} AS v FROM s", TEXTS)
    + "), k AS (SELECT \"column\", v, "
    + FORMAT_SQL.format(v="v")
    + """ AS f FROM f), c AS (SELECT "column", count(*) AS total_rows, count(v) AS present, count(f) AS numeric_rows, """
    + ", ".join(f"count(*) FILTER (f = '{x}') AS n_{x}" for x in _formats)
    + """ FROM k GROUP BY 1)
    SELECT "column", numeric_rows / present >= 0.8 AS is_numeric, round(numeric_rows / present, 6) AS numeric_ratio,
      round((total_rows - present) / total_rows, 6) AS na_ratio, total_rows, numeric_rows, total_rows - present AS na_rows,
      CASE greatest("""
    + ", ".join(f"n_{x}" for x in _formats)
    + ") WHEN 0 THEN 'non_numeric' "
    + " ".join(f"WHEN n_{x} THEN '{x}'" for x in _formats)
    + " END AS detected_format FROM c"
)
def numeric_profile(t: Tables):
    return rounded(profile.numeric_profile(number_texts(t), TEXTS))


@query(
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS "column", {c} AS value FROM ({NUMBER_TEXTS}) WHERE {c} IS NOT NULL
          ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5)"""
        for c in TEXTS
    )
)
def sample_values(t: Tables):
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = number_texts(t).withColumn("key", key)
    parts = [profile.sample_values(rows, c, "key") for c in TEXTS]
    return reduce(DataFrame.unionAll, parts)


@query(
    f"WITH s AS ({NUMBER_TEXTS}) "
    + union_sql(
        "SELECT '{c}' AS \"column\", count({c}) AS \"values\", "
        "count(TRY_CAST({c} AS DOUBLE)) AS parsed, count({c}) > 0 AND count({c}) = count(TRY_CAST({c} AS DOUBLE)) AS is_numeric FROM s",
        ["quantity", "tax", "money", "scale"],
    )
)
def detect_numeric_strings(t: Tables):
    return profile.numeric_text_columns(number_texts(t), ["quantity", "tax", "money", "scale"])


@query(
    "SELECT row_number() OVER () - 1 AS position, c.\"column\", c.type, o.n_rows, 6 AS n_columns FROM (SELECT unnest(["
    "{'column': 'o_orderkey', 'type': 'bigint'}, {'column': 'o_custkey', 'type': 'bigint'}, {'column': 'o_orderstatus', 'type': 'string'}, "
    "{'column': 'o_totalprice', 'type': 'double'}, {'column': 'o_orderdate', 'type': 'timestamp_ntz'}, {'column': 'o_orderpriority', 'type': 'string'}"
    "], recursive := true)) c, (SELECT count(*) AS n_rows FROM orders) o"
)
def table_overview(t: Tables):
    return profile.table_overview(t.orders)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def head_n(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").limit(5)


@query(
    f"{WITH_HOLES} "
    + union_sql(
        "SELECT '{c}' AS \"column\", typeof(any_value({c})) = 'DOUBLE' AS is_numeric, "
        "round((count(*) - count({c})) / count(*), 6) AS missing_ratio, count(DISTINCT {c}) AS unique_count FROM h",
        HOLED,
    )
)
def column_profile(t: Tables):
    return rounded(profile.column_profile(holed_lines(t), HOLED).drop("dtype"))


@query(
    f"{WITH_HOLES} "
    + union_sql(
        "SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, min({c}) AS min, "
        "round(quantile_cont({c}, 0.25), 5) AS q25, round(quantile_cont({c}, 0.5), 5) AS q50, "
        "round(quantile_cont({c}, 0.75), 5) AS q75, max({c}) AS max FROM h",
        MEASURES,
    )
)
def describe(t: Tables):
    return rounded(profile.describe(holed_lines(t), MEASURES), 5)


_moments = (
    "SELECT '{c}' AS \"column\", count(*) AS total, count({c}) AS n, avg({c}) AS mean, stddev_pop({c}) AS std, stddev_samp({c}) AS ssd, "
    "min({c}) AS lo, max({c}) AS hi, count(DISTINCT {c}) AS u, quantile_cont({c}, 0.5) AS median, "
    "quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, "
    "avg(power({c} - (SELECT avg({c}) FROM h), 3)) / power(stddev_pop({c}), 3) AS skew, "
    "avg(power({c} - (SELECT avg({c}) FROM h), 4)) / power(stddev_pop({c}), 4) - 3 AS kurt FROM h"
)
MOMENTS = f"{WITH_HOLES}, m AS ({union_sql(_moments, MEASURES)})"


@query(
    f"""{MOMENTS} SELECT "column", n, round(mean, 5) AS mean, round(median, 5) AS median, round(std, 5) AS std,
    round(skew, 5) AS skewness, round(kurt, 5) AS kurtosis, round(1 - n / total, 5) AS missing_ratio,
    round(hi - lo, 5) AS value_range, round(u / n, 5) AS unique_ratio FROM m"""
)
def distribution_stats(t: Tables):
    return rounded(dist.distribution_stats(holed_lines(t), MEASURES), 5)


@query(f'{WITH_HOLES} ' + union_sql("SELECT '{c}' AS \"column\", round(skewness({c}), 5) AS skewness FROM h", MEASURES))
def skew_adjusted(t: Tables):
    return rounded(dist.skew_adjusted(holed_lines(t), MEASURES), 5)


def _sigma_sql(spread: str) -> str:
    return f"""{MOMENTS} SELECT "column", round(greatest(hi - mean, mean - lo) / {spread}, 5) AS max_z,
      greatest(hi - mean, mean - lo) > 3 * {spread} AS has_outliers FROM m"""


@query(_sigma_sql("ssd"))
def outlier_3sigma(t: Tables):
    return rounded(dist.outlier_3sigma(holed_lines(t), MEASURES), 5)


@query(_sigma_sql("std"))
def outliers_zscore(t: Tables):
    return rounded(dist.outliers_zscore(holed_lines(t), MEASURES), 5)


@query(
    f"{MOMENTS}, v AS ("
    + union_sql("SELECT '{c}' AS \"column\", {c} AS v FROM h", MEASURES)
    + """) SELECT "column", round(q1 - 1.5 * (q3 - q1), 5) AS lower_fence, round(q3 + 1.5 * (q3 - q1), 5) AS upper_fence,
      count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_outliers,
      count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) > 0 AS has_outliers
    FROM m JOIN v USING ("column") GROUP BY "column", q1, q3"""
)
def outliers_iqr(t: Tables):
    return rounded(dist.outliers_iqr(holed_lines(t), MEASURES), 5)


@query(
    f"""{MOMENTS}, y AS (SELECT *, skew * sqrt((n+1.0)*(n+3.0) / (6.0*(n-2.0))) AS y,
      3.0*(n*n*1.0+27*n-70)*(n+1.0)*(n+3.0) / ((n-2.0)*(n+5.0)*(n+7.0)*(n+9.0)) AS b2,
      3.0*(n-1.0)/(n+1.0) AS e, 24.0*n*(n-2.0)*(n-3.0) / ((n+1.0)*(n+1.0)*(n+3.0)*(n+5.0)) AS v,
      6.0*(n*n*1.0-5*n+2)/((n+7.0)*(n+9.0))*sqrt(6.0*(n+3.0)*(n+5.0)/(n*(n-2.0)*(n-3.0))) AS s FROM m),
    w AS (SELECT *, -1 + sqrt(2*(b2-1)) AS w2, (kurt + 3 - e)/sqrt(v) AS x, 6+8/s*(2/s+sqrt(1+4/(s*s))) AS a FROM y),
    d AS (SELECT *, 1+x*sqrt(2/(a-4)) AS d FROM w),
    z AS (SELECT "column", 1/sqrt(0.5*ln(w2)) * asinh(y/sqrt(2/(w2-1))) AS z1,
      (1-2/(9*a)-sign(d)*power((1-2/a)/abs(d), 1.0/3))/sqrt(2/(9*a)) AS z2 FROM d)
    SELECT "column", round(exp(-(z1*z1+z2*z2)/2), 5) AS p_value, exp(-(z1*z1+z2*z2)/2) > 0.05 AS is_normal FROM z"""
)
def normality_test(t: Tables):
    return rounded(dist.normality_test(holed_lines(t), MEASURES), 5)


@query()
def outliers_isoforest(t: Tables):
    return rounded(dist.outliers_isoforest(t.orders, ["o_orderkey"], ["o_totalprice"]))


@query(
    f"""{MOMENTS} SELECT "column", greatest(hi - mean, mean - lo) > 3 * std AS z,
      lo < q1 - 1.5 * (q3 - q1) OR hi > q3 + 1.5 * (q3 - q1) AS iqr,
      greatest(hi - mean, mean - lo) > 3 * std OR lo < q1 - 1.5 * (q3 - q1) OR hi > q3 + 1.5 * (q3 - q1) AS has_outliers FROM m"""
)
def has_outliers(t: Tables):
    return dist.has_outliers(holed_lines(t), LINE_KEY, MEASURES, methods=("z", "iqr"))


_erfc = (
    "(t*exp(-x*x + -1.26551223 + t*(1.00002368 + t*(0.37409196 + t*(0.09678418 + t*(-0.18628806 + t*(0.27886807 + "
    "t*(-1.13520398 + t*(1.48851587 + t*(-0.82215223 + t*0.17087277))))))))))"
)


_SHARES = "(SELECT 0.00125 * power(2, i) AS share FROM range(9) AS r(i))"


def _ks_sql(columns: list[str], source: str) -> str:
    per = union_sql(
        "SELECT '{c}' AS \"column\", {c} AS v, rank() OVER (ORDER BY {c}) - 1 AS below, count(*) OVER (PARTITION BY {c}) AS n, "
        "count(*) OVER () AS total, (v - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z FROM "
        f"(SELECT {{c}}, {{c}} AS v FROM {source} WHERE {{c}} IS NOT NULL)",
        columns,
    )
    return f"""r AS ({per}), b AS (SELECT *, min(z) OVER w AS lo, max(z) OVER w AS hi FROM r WINDOW w AS (PARTITION BY "column")),
      t AS (SELECT b."column", any_value(lo) - share * (any_value(hi) - any_value(lo)) AS loc, avg(ln(z - (lo - share * (hi - lo)))) AS lm,
        stddev_pop(ln(z - (lo - share * (hi - lo)))) AS ls FROM b, {_SHARES} GROUP BY b."column", share),
      o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY -lm - ln(ls) DESC) = 1),
      p AS (SELECT b.*, (ln(z - loc) - lm) / ls AS q FROM b JOIN o ON b."column" = o."column"),
      f AS (SELECT "column", below / total AS under, (below + n) / total AS above,
        (z - lo) / (hi - lo) AS uniform, 1 - exp((z - lo) / lo) AS exponential, -z / sqrt(2.0) AS xn, -q / sqrt(2.0) AS xl FROM p),
      c AS (SELECT "column", under, above, uniform, exponential,
        (SELECT CASE WHEN x >= 0 THEN e ELSE 2 - e END / 2 FROM (SELECT x, {_erfc} AS e FROM (SELECT xn AS x, 1 / (1 + abs(xn) / 2) AS t))) AS normal,
        (SELECT CASE WHEN x >= 0 THEN e ELSE 2 - e END / 2 FROM (SELECT x, {_erfc} AS e FROM (SELECT xl AS x, 1 / (1 + abs(xl) / 2) AS t))) AS lognormal FROM f)
      SELECT "column", """ + ", ".join(
        f"round(max(greatest(above - {k}, {k} - under)), 5) AS ks_{k}" for k in ("normal", "uniform", "exponential", "lognormal")
    ) + ' FROM c GROUP BY "column"'


@query(f"WITH {_ks_sql(['value'], 'events')}")
def ks_statistics(t: Tables):
    return rounded(dist.ks_statistics(t.events, ["value"]).drop("ks_gamma"), 5)


def _newton(source: str, name: str) -> str:
    """One step of the gamma shape ``k`` towards ln(k) - digamma(k) = gap."""
    psi = "(ln(k+10) - 1/(2*(k+10)) - 1/(12*power(k+10,2)) + 1/(120*power(k+10,4)) - 1/(252*power(k+10,6))"
    psi += "".join(f" - 1/(k+{i})" for i in range(10)) + ")"
    slope = "(1/(k+10) + 1/(2*power(k+10,2)) + 1/(6*power(k+10,3)) - 1/(30*power(k+10,5)) + 1/(42*power(k+10,7))"
    slope += "".join(f" + 1/power(k+{i},2)" for i in range(10)) + ")"
    return f"{name} AS (SELECT * REPLACE (1 / (1/k + (ln(k) - {psi} - gap) / (k*k*(1/k - {slope}))) AS k) FROM {source})"


@query(
    f"""WITH v AS (SELECT value AS v FROM events WHERE value IS NOT NULL),
    m AS (SELECT avg(v) AS mean, stddev_pop(v) AS std, min(v) AS lo, max(v) AS hi FROM v),
    l AS (SELECT any_value(mean) AS mean, lo - share * (hi - lo) AS loc, avg(ln(v - (lo - share * (hi - lo)))) AS lm,
      stddev_pop(ln(v - (lo - share * (hi - lo)))) AS ls FROM v, m, {_SHARES} GROUP BY lo, hi, share),
    g AS (SELECT *, ln(mean - loc) - lm AS gap FROM l),
    k0 AS (SELECT *, (3 - gap + sqrt((gap-3)*(gap-3) + 24*gap)) / (12*gap) AS k FROM g),
    {", ".join(_newton(f"k{i}", f"k{i + 1}") for i in range(6))},
    f AS (SELECT 'normal' AS family, mean AS location, std AS scale, NULL AS shape, -ln(2*pi()*std*std)/2 - 0.5 AS likelihood FROM m
      UNION ALL SELECT 'uniform', lo, hi - lo, NULL, -ln(hi - lo) FROM m
      UNION ALL SELECT 'exponential', lo, mean - lo, NULL, -ln(mean - lo) - 1 FROM m
      UNION ALL SELECT 'lognormal', loc, exp(lm), ls, -lm - ln(ls) - ln(2*pi())/2 - 0.5 FROM k6
      UNION ALL SELECT 'gamma', loc, (mean - loc) / k, k, (k-1)*lm - k - k*ln((mean - loc) / k) - lgamma(k) FROM k6),
    b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY family ORDER BY likelihood DESC) = 1)
    SELECT 'value' AS "column", family, round(location, 4) AS location, round(scale, 4) AS scale, round(shape, 4) AS shape,
      round(likelihood, 5) AS likelihood FROM b"""
)
def fit_families(t: Tables):
    fits = dist.fit_families(t.events, ["value"])
    return fits.withColumns({"likelihood": F.round("likelihood", 5)} | {c: F.round(c, 4) for c in ("location", "scale", "shape")})


@query()
def identify_distribution(t: Tables):
    return dist.identify_distribution(t.events, ["value", "event_type"])


@query(
    """WITH v AS (SELECT value, row_number() OVER (ORDER BY value) AS r, stddev_pop(value) OVER () AS s FROM events),
    d AS (SELECT a.r, abs(a.value - b.value) AS d, row_number() OVER (PARTITION BY a.r ORDER BY abs(a.value - b.value)) AS k, a.s
      FROM v a JOIN v b ON b.r BETWEEN a.r - 3 AND a.r + 3 AND b.r <> a.r)
    SELECT 'value' AS "column", round(1 - avg(d) / any_value(s), 6) AS spatial_correlation FROM d WHERE k <= 3"""
)
def spatial_correlation(t: Tables):
    return rounded(dist.spatial_correlation(t.events, ["value"]))


@query(
    """WITH v AS (SELECT value, lag(value) OVER (ORDER BY event_id) AS before FROM events)
    SELECT 'value' AS "column", round(abs(corr(value, before)), 6) AS autocorrelation FROM v WHERE before IS NOT NULL"""
)
def autocorr_lag1(t: Tables):
    return rounded(dist.autocorr_lag1(t.events, "event_id", ["value"]))


@query(
    """WITH c AS (SELECT c_mktsegment, count(*) / (SELECT count(*) FROM customer) AS p FROM customer GROUP BY 1)
    SELECT 'c_mktsegment' AS "column", count(*) AS categories, round(1 - -sum(p * ln(p)) / ln(count(*)), 6) AS pattern_strength FROM c"""
)
def category_pattern_strength(t: Tables):
    return rounded(profile.category_pattern_strength(t.customer, "c_mktsegment"))


def _clusters_sql(columns: list[str], source: str) -> str:
    per = union_sql(f"SELECT '{{c}}' AS \"column\", {{c}} AS v, count(*) AS n FROM {source} WHERE {{c}} IS NOT NULL GROUP BY {{c}}", columns)
    return f"""WITH r AS ({per}), c AS (SELECT "column", v - sum(v * n) OVER w / sum(n) OVER w AS x, n FROM r WINDOW w AS (PARTITION BY "column")),
      p AS (SELECT *, sum(n) OVER u AS cn, sum(x * n) OVER u AS cs, sum(n) OVER w AS tn, sum(x * n) OVER w AS ts, sum(x * x * n) OVER w AS tq FROM c
        WINDOW w AS (PARTITION BY "column"), u AS (PARTITION BY "column" ORDER BY x ROWS UNBOUNDED PRECEDING)),
      e AS (SELECT a."column", a.x AS xa, b.x AS xb, a.tq,
          a.cs * a.cs / a.cn + (b.cs - a.cs) * (b.cs - a.cs) / (b.cn - a.cn) + (b.ts - b.cs) * (b.ts - b.cs) / (b.tn - b.cn) AS parted
        FROM p a JOIN p b ON a."column" = b."column" AND a.x < b.x AND b.cn < b.tn),
      h AS (SELECT * FROM e QUALIFY parted >= max(parted) OVER (PARTITION BY "column") - 1e-9 * tq),
      g AS (SELECT "column", xa, xb, row_number() OVER (PARTITION BY "column" ORDER BY xa, xb) AS k FROM h),
      l AS (SELECT c.*, CASE WHEN x <= xa THEN 1 WHEN x <= xb THEN 2 ELSE 3 END AS cluster FROM c JOIN g ON c."column" = g."column" AND g.k = 1),
      d AS (SELECT a."column", a.x, a.n, a.cluster = b.cluster AS own, b.cluster, sum(b.n) AS cn, sum(abs(a.x - b.x) * b.n) AS far
        FROM l a JOIN l b ON a."column" = b."column" GROUP BY ALL),
      s AS (SELECT "column", x, any_value(n) AS n, max(CASE WHEN own THEN cn END) AS own_n,
        max(CASE WHEN own AND cn > 1 THEN far / (cn - 1) END) AS inside, min(CASE WHEN NOT own THEN far / cn END) AS other FROM d GROUP BY 1, 2)
      SELECT "column", round(greatest(sum(CASE WHEN own_n > 1 AND greatest(inside, other) > 0 THEN n * (other - inside) / greatest(inside, other) ELSE 0 END)
        / sum(n), 0), 6) AS cluster_tendency FROM s GROUP BY 1"""


@query(_clusters_sql(["c_acctbal"], "customer"))
def cluster_tendency(t: Tables):
    return rounded(clusters.cluster_tendency(t.customer, ["c_acctbal"]))


@query(_clusters_sql(["p_size", "p_retailprice"], "part"))
def cluster_tendency_part(t: Tables):
    return rounded(clusters.cluster_tendency(t.part, ["p_size", "p_retailprice"]))


@query("SELECT p_type AS value, count(*) AS count, round(count(*) / (SELECT count(*) FROM part), 6) AS share FROM part GROUP BY 1")
def value_counts(t: Tables):
    return rounded(profile.value_counts(t.part, "p_type", normalize=True))


@query("SELECT l_partkey AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY count DESC, value LIMIT 10")
def topk_categories(t: Tables):
    return profile.value_counts(t.lineitem, "l_partkey", top=10)


_bins = """WITH s AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w, count(*) AS n FROM lineitem),
  b AS (SELECT least(19, CAST(floor((l_extendedprice - lo) / w) AS INTEGER)) AS bin, count(*) AS count FROM lineitem, s GROUP BY 1)"""


@query(
    f"""{_bins} SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * w, 4) AS lower, round(lo + (g.bin + 1) * w, 4) AS upper,
      coalesce(b.count, 0) AS count, round(1e6 * coalesce(b.count, 0) / (n * w), 4) AS density_per_million
    FROM range(20) AS g(bin) LEFT JOIN b ON b.bin = g.bin, s"""
)
def histogram(t: Tables):
    rows = profile.histogram(t.lineitem, "l_extendedprice", density=True)
    return rounded(rows.withColumn("density_per_million", F.col("density") * 1e6).drop("density"), 4)


@query(
    """WITH s AS (SELECT count(value) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi FROM events),
    p AS (SELECT *, power(n, -0.2) * sd AS h FROM s),
    g AS (SELECT lo - 3 * h + i * (hi - lo + 6 * h) / 199 AS x FROM p, range(200) AS r(i))
    SELECT round(x, 4) AS x, round(sum(exp(-power((x - value) / h, 2) / 2)) / any_value(n * h * sqrt(2 * pi())), 8) AS density
    FROM g, events, p WHERE value IS NOT NULL GROUP BY x"""
)
def kde(t: Tables):
    return rounded(profile.kde(t.events, "value"), 4, density=8)


_box = f"""{MOMENTS}, v AS ({union_sql("SELECT '{c}' AS \"column\", {c} AS v FROM h WHERE {c} IS NOT NULL", MEASURES)})
  SELECT "column", min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)) AS whisker_low, round(q1, 5) AS q25, round(median, 5) AS q50, round(q3, 5) AS q75,
    max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
    count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
  FROM m JOIN v USING ("column") GROUP BY "column", q1, median, q3"""


@query(_box)
def boxplot_stats(t: Tables):
    return rounded(profile.boxplot_stats(holed_lines(t), MEASURES), 5)


_pairs = [(a, b) for a in MEASURES for b in MEASURES]


@query(
    f"{WITH_HOLES} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS column_1, '{b}' AS column_2, round({'1.0' if a == b else f'corr({a}, {b})'}, 6) AS correlation FROM h"
        + (" LIMIT 1" if a == b else "")
        for a, b in _pairs
        if a != b
    )
    + "".join(f" UNION ALL SELECT '{a}', '{a}', 1.0" for a in MEASURES)
)
def correlation_matrix(t: Tables):
    return rounded(profile.correlation_matrix(holed_lines(t), MEASURES))


@query(
    f"""{WITH_HOLES}, f AS (SELECT coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM h)) AS l_quantity,
      coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM h)) AS l_discount FROM h) """
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{stage}' AS stage, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, count({c}) AS count FROM {src}"
        for c in ("l_quantity", "l_discount")
        for stage, src in (("original", "h"), ("processed", "f"))
    )
)
def compare_distributions(t: Tables):
    before, columns = holed_lines(t), ["l_quantity", "l_discount"]
    after = fit_simple(before, "median", columns).transform(before)
    return rounded(profile.compare_distributions(before, after, columns))


@query(
    f"""{WITH_HOLES}, m AS (SELECT l_returnflag AS v FROM h WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    f AS (SELECT coalesce(l_returnflag, (SELECT v FROM m)) AS l_returnflag FROM h),
    a AS (SELECT l_returnflag AS value, count(*) / (SELECT count(l_returnflag) FROM h) AS s FROM h WHERE l_returnflag IS NOT NULL GROUP BY 1),
    b AS (SELECT l_returnflag AS value, count(*) / (SELECT count(*) FROM f) AS s FROM f GROUP BY 1)
    SELECT value, round(coalesce(a.s, 0), 6) AS original_share, round(coalesce(b.s, 0), 6) AS processed_share FROM a FULL JOIN b USING (value)"""
)
def compare_categories(t: Tables):
    before = holed_lines(t)
    after = fit_simple(before, "most_frequent", ["l_returnflag"]).transform(before)
    return rounded(profile.compare_categories(before, after, "l_returnflag"))


@query(
    """SELECT lang, 'text' AS "column", round(avg(length(text)), 4) AS mean_length, round(var_samp(length(text)), 2) AS length_variance,
      CAST(min(length(text)) AS INTEGER) AS min_length, CAST(max(length(text)) AS INTEGER) AS max_length FROM documents GROUP BY lang"""
)
def length_variance(t: Tables):
    return rounded(profile.length_variance(t.documents, ["text"], ["lang"]), 4, length_variance=2)


@query("SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
def filter_label_eq(t: Tables):
    return t.lineitem.filter(F.col("l_returnflag") == "R").select("l_orderkey", "l_quantity", "l_returnflag")


