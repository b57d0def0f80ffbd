"""Inputs derived from the test tables, as DataFrames and as the same thing in SQL.

No test table has a missing cell, so cells are made missing by a rule on the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .registry import Tables

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

HOLED_LINES = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity,
    CASE WHEN l_partkey % 5 <> 0 THEN l_extendedprice END AS l_extendedprice,
    CASE WHEN l_suppkey % 9 <> 0 THEN l_discount END AS l_discount,
    l_tax, CASE WHEN l_partkey % 11 <> 0 THEN l_returnflag END AS l_returnflag, l_linestatus
  FROM lineitem"""


def _holes(column: str, key: str, every: int):
    return F.when(F.col(key) % every != 0, F.col(column)).alias(column)


def holed_lines(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        _holes("l_quantity", "l_orderkey", 7),
        _holes("l_extendedprice", "l_partkey", 5),
        _holes("l_discount", "l_suppkey", 9),
        "l_tax",
        _holes("l_returnflag", "l_partkey", 11),
        "l_linestatus",
    )


HOLED_PARTS = """SELECT p_partkey, p_name, p_brand, p_type,
    CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS p_size,
    CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS p_retailprice
  FROM part"""


def holed_parts(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", "p_name", "p_brand", "p_type",
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double")).alias("p_size"),
        _holes("p_retailprice", "p_partkey", 5),
    )


# Numbers in many spellings, made from order lines.
NUMBER_TEXTS = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity,
    CASE WHEN l_partkey % 4 = 0 THEN CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR) || '%'
         ELSE '0.0' || CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR) END AS tax,
    CASE l_suppkey % 3 WHEN 0 THEN '$' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
         WHEN 1 THEN '$' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ',000'
         ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' EUR' END AS money,
    CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'e+3' END AS scale,
    CASE WHEN l_linenumber % 2 = 0 THEN '  ' WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag END AS flag
  FROM lineitem"""


def number_texts(t: Tables) -> DataFrame:
    quantity = F.col("l_quantity").cast("bigint").cast("string")
    tax = F.round(F.col("l_tax") * 100).cast("bigint").cast("string")
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        quantity.alias("quantity"),
        F.when(F.col("l_partkey") % 4 == 0, F.concat(tax, F.lit("%"))).otherwise(F.concat(F.lit("0.0"), tax)).alias("tax"),
        F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("$"), quantity))
        .when(F.col("l_suppkey") % 3 == 1, F.concat(F.lit("$"), quantity, F.lit(",000")))
        .otherwise(F.concat(quantity, F.lit(" EUR"))).alias("money"),
        F.when(F.col("l_partkey") % 5 != 0, F.concat(quantity, F.lit("e+3"))).alias("scale"),
        F.when(F.col("l_linenumber") % 2 == 0, "  ").when(F.col("l_linenumber") % 3 == 0, "")
        .otherwise(F.col("l_returnflag")).alias("flag"),
    )


# A customer list as it might arrive: embedded codes, dates in several spellings, ranges, marks, null words.
MESSY = """SELECT o_orderkey,
    o_orderpriority || ' (' || o_orderstatus || ')' AS tagged,
    CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
         WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'soon' END AS placed,
    CASE o_orderkey % 3 WHEN 0 THEN '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)
         WHEN 1 THEN CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) || ',500.5 pts'
         ELSE CAST(o_custkey % 100 AS VARCHAR) || '.5%' END AS amount,
    CASE o_orderkey % 3 WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(year(o_orderdate) + 3 AS VARCHAR)
         WHEN 1 THEN CAST(year(o_orderdate) AS VARCHAR) || '/' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0')
         ELSE 'open' END AS span,
    CASE o_orderkey % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN '-' WHEN 2 THEN NULL ELSE o_orderstatus END AS status,
    'No&#46; ' || chr(42) || o_orderpriority || '&#40;x&#41;  #' || o_orderstatus || ' &#x2B;&eacute;&amp;#40;&#128512;' AS note
  FROM orders"""


def messy_orders(t: Tables) -> DataFrame:
    key, year = F.col("o_orderkey"), F.year("o_orderdate")

    def text(col):
        return col.cast("string")

    return t.orders.select(
        "o_orderkey",
        F.concat("o_orderpriority", F.lit(" ("), "o_orderstatus", F.lit(")")).alias("tagged"),
        F.when(key % 4 == 0, F.date_format("o_orderdate", "yyyy/MM/dd"))
        .when(key % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(key % 4 == 2, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("soon").alias("placed"),
        F.when(key % 3 == 0, F.concat(F.lit("$"), text(F.floor("o_totalprice"))))
        .when(key % 3 == 1, F.concat(text(F.floor(F.col("o_totalprice") / 1000)), F.lit(",500.5 pts")))
        .otherwise(F.concat(text(F.col("o_custkey") % 100), F.lit(".5%"))).alias("amount"),
        F.when(key % 3 == 0, F.concat(text(year), F.lit("-"), text(year + 3)))
        .when(key % 3 == 1, F.concat(text(year), F.lit("/"), F.lpad(text((year + 1) % 100), 2, "0")))
        .otherwise("open").alias("span"),
        F.when(key % 5 == 0, "N/A").when(key % 5 == 1, "-").when(key % 5 == 2, None).otherwise(F.col("o_orderstatus")).alias("status"),
        F.concat(F.lit("No&#46; *"), "o_orderpriority", F.lit("&#40;x&#41;  #"), "o_orderstatus", F.lit(" &#x2B;&eacute;&amp;#40;&#128512;")).alias("note"),
    )


# Customers with their nation, some nations, segments and times spoiled; the truth is kept beside them.
DIRTY = """SELECT c_custkey, c_nationkey, n_name AS true_nation, c_mktsegment AS true_segment,
    CASE WHEN c_custkey % 13 = 0 THEN 'NATION_X' ELSE n_name END AS nation,
    CASE WHEN c_custkey % 17 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment,
    CASE WHEN c_custkey % 19 = 0 THEN 'noon' ELSE lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || '30pm' END AS called
  FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def dirty_customers(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    nation = F.broadcast(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))
    return t.customer.join(nation, "c_nationkey").select(
        "c_custkey", "c_nationkey",
        F.col("n_name").alias("true_nation"),
        F.col("c_mktsegment").alias("true_segment"),
        F.when(key % 13 == 0, "NATION_X").otherwise(F.col("n_name")).alias("nation"),
        F.when(key % 17 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(key % 19 == 0, "noon")
        .otherwise(F.concat(F.lpad((key % 12 + 1).cast("string"), 2, "0"), F.lit("30pm"))).alias("called"),
    )


RULES = {
    "time": {"type": "Date", "attr": ["called"], "format": "%I%M%P"},
    "letters": {"type": "Pattern", "attr": ["segment"], "format": "[A-Z]+"},
    "nation": {"type": "AttrRelation", "source": ["c_nationkey"], "target": ["nation"]},
}

# Predictions for the labelled documents.
ANSWERS = """SELECT l.doc_id, quality, toxic, d.lang, d.source,
    CASE WHEN l.doc_id % 6 = 0 THEN 1 - quality ELSE quality END AS guess,
    CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS gold,
    CASE WHEN l.doc_id % 5 = 0 THEN 'maybe' WHEN l.doc_id % 7 = 0 THEN 'no' ELSE
      CASE WHEN quality = 1 THEN ' YES ' ELSE 'No reason' END END AS said
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def answers(t: Tables) -> DataFrame:
    key = F.col("doc_id")
    return t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id").select(
        "doc_id", "quality", "toxic", "lang", "source",
        F.when(key % 6 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("guess"),
        F.when(F.col("quality") == 1, "Yes").otherwise("No").alias("gold"),
        F.when(key % 5 == 0, "maybe").when(key % 7 == 0, "no")
        .otherwise(F.when(F.col("quality") == 1, " YES ").otherwise("No reason")).alias("said"),
    )


# Embedded items with a class prediction that is wrong for every fifth.
VECTORS = """SELECT vec_id, embedding, label, (label + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END) % 10 AS guess FROM embeddings"""


def labelled_vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(
        "vec_id", "embedding", "label",
        ((F.col("label") + F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0)) % 10).alias("guess"),
    )
