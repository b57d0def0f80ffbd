"""Queries: sources, sinks, derived tables, the whole preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.structure import ValueRules
from ..session import new_path, write_table
from ..sources import files, synthetic
from .inputs import MESSY, messy_orders
from .matching_queries import labelled_pairs, pair_tables
from .prepare import prepare_table as prepare
from .registry import Tables, query, rounded
from .values import CLEAN_AMOUNT

ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


def orders(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(ORDERS)
def scan_csv(t: Tables):
    """Written and read back with the given types."""
    path = files.sink_csv(orders(t), new_path(t.spark, "orders.csv"))
    return files.scan_csv(t.spark, path, orders(t).schema)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def sink_csv(t: Tables):
    """Read back with inferred types."""
    path = files.sink_csv(orders(t), new_path(t.spark, "orders.csv"))
    return files.scan_csv(t.spark, path).select(
        F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), "o_orderstatus", "o_totalprice"
    )


@query(ORDERS)
def scan_json(t: Tables):
    path = files.sink_json_records(orders(t), new_path(t.spark, "orders.json"))
    return files.scan_json(t.spark, path).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(
    """SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":' ||
      CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}' AS record FROM customer"""
)
def sink_json_records(t: Tables):
    segment = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment")
    return files.json_records(t.customer.select("c_custkey", "c_name", segment))


@query(
    """SELECT false AS ok, count(*) AS n_rows, count(*) FILTER (o_orderkey % 100 = 0) AS n_corrupt FROM orders"""
)
def validate_source(t: Tables):
    """Orders as JSON lines, every hundredth cut off before its end."""
    record = F.to_json(F.struct("o_orderkey", "o_custkey", "o_totalprice"))
    broken = F.when(F.col("o_orderkey") % 100 == 0, F.expr("substring(record, 1, length(record) - 1)")).otherwise(F.col("record"))
    path = new_path(t.spark, "orders.json")
    t.orders.select("o_orderkey", record.alias("record")).select(broken.alias("value")).write.text(path)
    schema = t.orders.select("o_orderkey", "o_custkey", "o_totalprice").schema
    return files.validate_source(t.spark, path, schema=schema).drop("path")


def pair_folder(t: Tables) -> str:
    """The labelled pairs in the folder layout: two tables and three splits."""
    folder = new_path(t.spark, "pairs")
    a, b = pair_tables(t)
    files.sink_csv(a.drop("acctbal"), f"{folder}/tableA.csv")
    files.sink_csv(b.drop("acctbal"), f"{folder}/tableB.csv")
    # The three splits read the pairs, so they are made once.
    pairs = write_table(labelled_pairs(t).drop("n"), "labelled_pairs")
    part = F.col("ltable_id") % 10
    for split, test in (("train", part < 6), ("valid", part.isin(6, 7)), ("test", part > 7)):
        files.sink_csv(pairs.filter(test), f"{folder}/{split}.csv")
    return folder


PAIRS = """SELECT DISTINCT o_custkey AS ltable_id, l_suppkey AS rtable_id, CASE WHEN c_nationkey = s_nationkey THEN 1 ELSE 0 END AS label,
    CASE WHEN o_custkey % 10 < 6 THEN 'train' WHEN o_custkey % 10 < 8 THEN 'valid' ELSE 'test' END AS split,
    'Product A is name: ' || c_name || '.nationkey: ' || c_nationkey || '. Product B is name: ' || s_name || '.nationkey: ' || s_nationkey || '. ' AS text
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"""


@query(PAIRS)
def load_splits(t: Tables):
    return files.load_splits(t.spark, pair_folder(t)).select("ltable_id", "rtable_id", "label", "split", "text")


@query(
    f"""WITH p AS ({PAIRS}), h AS (SELECT *, md5(concat_ws('|', CAST(ltable_id AS VARCHAR), CAST(rtable_id AS VARCHAR), '42')) AS h FROM p),
    b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS k FROM h WHERE split = 'train'),
    n AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM b GROUP BY label)),
    s AS (SELECT *, row_number() OVER (ORDER BY h) - 1 AS pos FROM b, n WHERE k <= n)
    SELECT ltable_id, rtable_id, label, split, pos FROM s WHERE pos < 500 UNION ALL SELECT ltable_id, rtable_id, label, split, -1 FROM p WHERE split <> 'train'"""
)
def read_data(t: Tables):
    rows = files.read_data(t.spark, pair_folder(t), class_balanced=True, max_train_samples=500)
    return rows.select("ltable_id", "rtable_id", "label", "split", F.coalesce("pos", F.lit(-1)).alias("pos"))


def _draw(name: str) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws('|', CAST(c_custkey AS VARCHAR), '{name}|42')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


_names = "['Alpha', 'Beta', 'Gamma', 'Delta', 'Omega']"
_domains = "['technology', 'finance', 'health', 'education', 'retail']"


@query(
    f"""SELECT c_custkey, {_names}[CAST(floor({_draw('name')} * 5) AS INTEGER) + 1] || '_' || CAST(floor({_draw('number')} * 1000) + 1 AS BIGINT) AS company_name,
      round(1e6 + {_draw('revenue')} * 9e6, 2) AS revenue, CAST(50 + floor({_draw('employees')} * 951) AS INTEGER) AS employees,
      strftime(DATE '1990-01-01' + CAST(floor({_draw('founded')} * 11000) AS INTEGER), '%Y-%m-%d') AS founded_date,
      {_domains}[CAST(floor({_draw('domain')} * 5) AS INTEGER) + 1] AS domain FROM customer"""
)
def synth_rows(t: Tables):
    return rounded(synthetic.synth_rows(t.customer, "c_custkey"), 2)


def _normal(name: str) -> str:
    md5 = f"md5(concat_ws('|', CAST(c_custkey AS VARCHAR), '{name}|42'))"
    one = f"((CAST('0x' || substr({md5}, 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
    two = f"((CAST('0x' || substr({md5}, 9, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
    return f"(sqrt(-2 * ln({one})) * cos(2 * pi() * {two}))"


@query(
    f"""SELECT c_custkey, round(100 + 15 * {_normal('normal')}, 4) AS normal_column, round(exp(10 + 0.5 * {_normal('lognormal')}), 4) AS lognormal_column,
      round(-2 * ln(1 - {_draw('exponential')}), 4) AS exponential_column, round(100 * {_draw('uniform')}, 4) AS uniform_column,
      round((50 + 10 * {_normal('outlier')}) * CASE WHEN {_draw('where')} < 0.05 THEN 5 ELSE 1 END, 4) AS outlier_column,
      CASE WHEN {_draw('category')} < 0.4 THEN 'A' WHEN {_draw('category')} < 0.7 THEN 'B' WHEN {_draw('category')} < 0.9 THEN 'C' ELSE 'D' END AS category_column
    FROM customer"""
)
def synth_distributions(t: Tables):
    return rounded(synthetic.synth_distributions(t.customer, "c_custkey"), 4)


@query(
    f"""WITH s AS (SELECT o_orderkey, tagged, placed, CASE WHEN o_orderkey % 6 <> 0 THEN {CLEAN_AMOUNT} END AS amount FROM ({MESSY}))
    SELECT o_orderkey, regexp_extract(tagged, '^(.*?)\\s*\\(', 1) AS tagged, round(coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM s)), 6) AS amount,
      regexp_extract(tagged, '\\(([^()]*)\\)', 1) AS code FROM s"""
)
def prepare_table(t: Tables):
    rows = messy_orders(t).withColumn("amount", F.when(F.col("o_orderkey") % 6 != 0, F.col("amount")))
    done = prepare(rows.select("o_orderkey", "tagged", "amount"), "o_orderkey", ["o_orderkey"], ValueRules(embedded={"tagged": "code"}, numbers=["amount"]))
    return rounded(done.table)


@query(
    f"""WITH s AS (SELECT o_orderkey, tagged, CASE WHEN o_orderkey % 6 <> 0 THEN amount END AS amount FROM ({MESSY}))
    SELECT 'o_orderkey' AS "column", 0 AS missing_before, 0 AS missing_after UNION ALL SELECT 'tagged', 0, 0 UNION ALL SELECT 'code', 0, 0
    UNION ALL SELECT 'amount', count(*) FILTER (amount IS NULL), 0 FROM s"""
)
def prepare_missing(t: Tables):
    rows = messy_orders(t).withColumn("amount", F.when(F.col("o_orderkey") % 6 != 0, F.col("amount")))
    rules = ValueRules(embedded={"tagged": "code"}, numbers=["amount"])
    return prepare(rows.select("o_orderkey", "tagged", "amount"), "o_orderkey", ["o_orderkey"], rules).missing
