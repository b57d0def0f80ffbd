"""Queries: cell values, names and types, text forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, tables, text
from ..operators import structure
from ..operators.matching import table_diff as diff_tables
from .inputs import LINE_KEY, MESSY, NUMBER_TEXTS, messy_orders, number_texts
from .profiling import FORMAT_SQL
from .registry import Tables, query, rounded

_key = ", ".join(LINE_KEY)
NUMBER_SQL = f"WITH s AS ({NUMBER_TEXTS})"


@query(
    f"{NUMBER_SQL} SELECT {_key}, ({FORMAT_SQL.format(v='money')}) IS NOT NULL AS money_is_number, "
    f"({FORMAT_SQL.format(v='scale')}) IS NOT NULL AS scale_is_number FROM s"
)
def is_numeric_string(t: Tables):
    return number_texts(t).select(
        *LINE_KEY,
        numbers.is_numeric_string("money").alias("money_is_number"),
        numbers.is_numeric_string("scale").alias("scale_is_number"),
    )


@query(f"{NUMBER_SQL} SELECT {_key}, {FORMAT_SQL.format(v='money')} AS money_format, {FORMAT_SQL.format(v='tax')} AS tax_format FROM s")
def classify_numeric_format(t: Tables):
    return number_texts(t).select(
        *LINE_KEY,
        numbers.classify_numeric_format("money").alias("money_format"),
        numbers.classify_numeric_format("tax").alias("tax_format"),
    )


@query(
    f"""{NUMBER_SQL}, k AS (SELECT {FORMAT_SQL.format(v='tax')} AS f FROM s WHERE tax IS NOT NULL),
    c AS (SELECT f, count(*) AS n FROM k WHERE f IS NOT NULL GROUP BY f)
    SELECT coalesce((SELECT f FROM c ORDER BY n DESC, list_position(['integer','decimal','percentage','currency','scientific'], f) LIMIT 1),
      'non_numeric') AS dominant_format"""
)
def dominant_format(t: Tables):
    found = number_texts(t).select(numbers.classify_numeric_format("tax").alias("f"))
    row = found.agg(*[F.count_if(F.col("f") == f).alias(f) for f in numbers.FORMATS])
    return row.select(numbers.dominant_format({f: F.col(f) for f in numbers.FORMATS}).alias("dominant_format"))


@query(
    f"{NUMBER_SQL} SELECT {_key}, TRY_CAST(quantity AS DOUBLE) AS quantity, TRY_CAST(tax AS DOUBLE) AS tax, TRY_CAST(scale AS DOUBLE) AS scale FROM s"
)
def to_numeric_coerce(t: Tables):
    return number_texts(t).select(*LINE_KEY, *[numbers.parse_number(c).alias(c) for c in ("quantity", "tax", "scale")])


MESSY_SQL = f"WITH s AS ({MESSY})"


@query(
    f"""{MESSY_SQL} SELECT o_orderkey, regexp_extract(tagged, '^(.*?)\\s*\\(', 1) AS priority,
    regexp_extract(tagged, '\\(([^()]*)\\)', 1) AS code FROM s"""
)
def extract_embedded(t: Tables):
    value, inner = text.extract_embedded("tagged")
    return messy_orders(t).select("o_orderkey", value.alias("priority"), inner.alias("code"))


@query(
    f"""{MESSY_SQL} SELECT o_orderkey, strftime(coalesce(try_strptime(placed, '%Y-%m-%d'), try_strptime(placed, '%Y/%m/%d'),
      try_strptime(placed, '%d/%m/%Y')), '%Y-%m-%d') AS placed FROM s"""
)
def normalize_dates(t: Tables):
    return messy_orders(t).select("o_orderkey", text.normalize_dates("placed").alias("placed"))


_amount = "TRY_CAST(regexp_extract(replace(amount, ',', ''), '([-+]?\\d*\\.?\\d+)', 1) AS DOUBLE)"
CLEAN_AMOUNT = f"round(CASE WHEN amount LIKE '%\\%' ESCAPE '\\' THEN {_amount} / 100 ELSE {_amount} END, 6)"


@query(f"{MESSY_SQL} SELECT o_orderkey, {CLEAN_AMOUNT} AS amount FROM s")
def clean_numeric(t: Tables):
    return rounded(messy_orders(t).select("o_orderkey", numbers.clean_numeric("amount").alias("amount")))


@query(f"{MESSY_SQL} SELECT o_orderkey, CASE WHEN status IS NULL OR status IN ('N/A', '-') THEN '' ELSE status END AS status FROM s")
def null_tokens_to_empty(t: Tables):
    return messy_orders(t).select("o_orderkey", text.null_tokens_to_empty("status").alias("status"))


START_END = """CASE WHEN span <> 'open' THEN CAST(substr(span, 1, 4) AS INTEGER) END AS span_start,
  CASE WHEN span = 'open' THEN NULL WHEN length(span) = 9 THEN CAST(substr(span, 6) AS INTEGER)
    ELSE CAST(substr(span, 1, 2) || substr(span, 6) AS INTEGER) END AS span_end"""


@query(f"SELECT o_orderkey, coalesce(span_start, -1) AS span_start, coalesce(span_end, -1) AS span_end FROM ({MESSY_SQL} SELECT o_orderkey, {START_END} FROM s)")
def split_range(t: Tables):
    start, end = text.split_range("span")
    return messy_orders(t).select("o_orderkey", start.alias("span_start"), end.alias("span_end")).na.fill(-1)


# Numeric references in either base as their characters, then the named ones; the ampersand's own last.
DECODED = (
    "replace(replace(list_reduce(list_prepend(note, list_distinct(regexp_extract_all(note, '&#x?[0-9A-F]+;'))), "
    "lambda t, r: replace(t, r, chr(CAST(CASE WHEN r LIKE '&#x%' THEN '0' || substr(r, 3, length(r) - 3) ELSE substr(r, 3, length(r) - 3) END AS INT)))), "
    "'&eacute;', 'é'), '&amp;', '&')"
)
NOTE = (
    f"trim(regexp_replace(regexp_replace({DECODED}, "
    "'[^\\p{L}\\p{N}\\s.,:;%$€£¥/()''&+-]', '', 'g'), '\\s+', ' ', 'g'))"
)


@query(f"{MESSY_SQL} SELECT o_orderkey, {NOTE} AS note FROM s")
def strip_special(t: Tables):
    return messy_orders(t).select("o_orderkey", text.strip_special("note").alias("note"))


MESSY_RULES = structure.ValueRules(
    embedded={"tagged": "code"}, dates=["placed"], numbers=["amount"], ranges={"span": ("span_start", "span_end")},
    nulls=["status"], special=["note"],
)


@query(
    f"""{MESSY_SQL} SELECT o_orderkey, regexp_extract(tagged, '^(.*?)\\s*\\(', 1) AS tagged,
      strftime(coalesce(try_strptime(placed, '%Y-%m-%d'), try_strptime(placed, '%Y/%m/%d'), try_strptime(placed, '%d/%m/%Y')), '%Y-%m-%d') AS placed,
      {CLEAN_AMOUNT} AS amount, span, CASE WHEN status IS NULL OR status IN ('N/A', '-') THEN '' ELSE status END AS status,
      {NOTE} AS note, regexp_extract(tagged, '\\(([^()]*)\\)', 1) AS code, coalesce(span_start, -1) AS span_start, coalesce(span_end, -1) AS span_end
      FROM (SELECT *, {START_END} FROM s)"""
)
def normalize_table(t: Tables):
    return rounded(structure.normalize_table(messy_orders(t), MESSY_RULES).na.fill(-1, ["span_start", "span_end"]))


def responses(t: Tables):
    """Each event as a small table in text form, in the spellings a reply can have."""
    cells = F.concat(F.lit('["type", "user"], ["'), "event_type", F.lit('", "'), F.col("user_id").cast("string"), F.lit('"]'))
    kind = F.col("event_id") % 4
    reply = (
        F.when(kind == 0, F.concat(F.lit("normalized_table = ["), cells, F.lit("]")))
        .when(kind == 1, F.concat(F.lit("Here it is:\nnormalized_table=[\n"), cells, F.lit(",\n]\nDone.")))
        .when(kind == 2, F.concat(F.lit("["), F.replace(cells, F.lit('"'), F.lit("'")), F.lit("]")))
        .otherwise(F.concat(F.lit("sorry, no table for "), "event_type"))
    )
    return t.events.select("event_id", reply.alias("reply"))


@query(
    """SELECT event_id, CAST(0 AS INTEGER) AS row_no, 'type' AS c1, 'user' AS c2 FROM events WHERE event_id % 4 <> 3
    UNION ALL SELECT event_id, 1, event_type, CAST(user_id AS VARCHAR) FROM events WHERE event_id % 4 <> 3"""
)
def parse_table_response(t: Tables):
    rows = tables.parse_table_response(responses(t), ["event_id"], "reply")
    return rows.select("event_id", "row_no", F.get("cells", 0).alias("c1"), F.get("cells", 1).alias("c2"))


@query(
    """SELECT event_id, 1 AS row_no, event_type AS type, CAST(user_id AS VARCHAR) AS user, CAST(NULL AS VARCHAR) AS other
    FROM events WHERE event_id % 4 <> 3"""
)
def rows_to_table(t: Tables):
    return tables.rows_to_table(responses(t), ["event_id"], "reply", ["type", "user", "other"])


@query(
    f"""{MESSY_SQL} SELECT "column", status, coalesce(changed_cells, 0) AS changed_cells, rows_before, rows_after FROM (VALUES ('o_orderkey', 'key'), ('tagged', 'kept'), ('placed', 'kept'), ('amount', 'kept'), ('span', 'kept'),
      ('status', 'kept'), ('note', 'kept'), ('code', 'new'), ('span_start', 'new'), ('span_end', 'new')) AS c("column", status)
    LEFT JOIN (SELECT 'tagged' AS "column", count(*) AS changed_cells FROM s
      UNION ALL SELECT 'placed', count(*) FILTER (o_orderkey % 4 <> 1) FROM s
      UNION ALL SELECT 'amount', count(*) FROM s UNION ALL SELECT 'span', 0
      UNION ALL SELECT 'status', count(*) FILTER (status IS NULL OR status IN ('N/A', '-')) FROM s
      UNION ALL SELECT 'note', count(*) FROM s) USING ("column"), (SELECT count(*) AS rows_before, count(*) AS rows_after FROM s)"""
)
def table_diff(t: Tables):
    messy = messy_orders(t)
    return diff_tables(messy, structure.normalize_table(messy, MESSY_RULES), ["o_orderkey"]).na.fill(0, ["changed_cells"])


@query(
    """WITH x AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) AS r(i)),
    f AS (SELECT vec_id, i, printf('%.6g', v) AS s FROM x)
    SELECT vec_id, string_agg(i || ': ' || s, ' | ' ORDER BY i) AS sequence FROM f GROUP BY vec_id"""
)
def serialize_sequence(t: Tables):
    values = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", text.serialize_sequence(values, "|", add_index=True).alias("sequence"))


@query(
    """SELECT p_partkey, 'name: ' || trim(p_name) || ' , brand: ' || p_brand || ' , size: ' || CAST(p_size AS VARCHAR)
      || ' , type: ' || CASE WHEN p_partkey % 3 = 0 THEN 'nan' ELSE p_type END AS text FROM part"""
)
def serialize_row(t: Tables):
    kind = F.when(F.col("p_partkey") % 3 != 0, F.col("p_type"))
    columns = {"name": "p_name", "brand": "p_brand", "size": "p_size", "type": kind}
    return t.part.select("p_partkey", text.serialize_row(columns, sep=",").alias("text"))


@query(
    """SELECT c_custkey, 'Same? Customer A is name: ' || c_name || '. Customer B is segment: ' || c_mktsegment || '.! ' AS text FROM customer"""
)
def serialize_pair(t: Tables):
    a, b = text.serialize_row({"name": "c_name"}), text.serialize_row({"segment": "c_mktsegment"})
    return t.customer.select("c_custkey", text.serialize_pair(a, b, "Customer", "!", "Same?").alias("text"))


@query("SELECT doc_id, CASE quality WHEN 1 THEN 'Yes' || chr(10) WHEN 0 THEN 'No' || chr(10) END AS label_str FROM labels")
def label_to_text(t: Tables):
    return t.labels.select("doc_id", text.label_to_text("quality").alias("label_str"))


@query("SELECT c_custkey, round(log10(c_acctbal + 1000), 6) AS logged FROM customer")
def math_log_shift(t: Tables):
    return rounded(t.customer.select("c_custkey", numbers.log_shift("c_acctbal", 1000).alias("logged")))


@query("SELECT c_custkey, round(c_acctbal / 10000, 8) AS scaled FROM customer")
def math_decimal_scale(t: Tables):
    return rounded(t.customer.select("c_custkey", numbers.decimal_scale("c_acctbal", 4).alias("scaled")), 8)


@query(
    "SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS date, o_orderpriority FROM orders"
)
def normalize_column_names(t: Tables):
    return structure.normalize_column_names(t.orders)


@query(
    f"""{NUMBER_SQL} SELECT 'quantity' AS "column", 'int64' AS kind UNION ALL SELECT 'tax', 'category'
    UNION ALL SELECT 'money', 'category' UNION ALL SELECT 'scale', 'int64' UNION ALL SELECT 'flag', 'category'"""
)
def infer_types(t: Tables):
    kinds = structure.inferred_types(number_texts(t).select("quantity", "tax", "money", "scale", "flag"))
    return t.spark.createDataFrame(list(kinds.items()), "column string, kind string")


@query(
    """SELECT * FROM (VALUES (0, 'o_orderkey', 'o_orderkey', 'string', 'bigint', 'int64'), (1, 'o_custkey', 'o_custkey', 'string', 'bigint', 'int64'),
      (2, 'o_orderstatus', 'status', 'string', 'string', 'category'), (3, 'o_totalprice', 'price', 'string', 'double', 'float64'),
      (4, 'o_orderdate', 'date', 'string', 'timestamp', 'datetime'), (5, 'o_orderpriority', 'o_orderpriority', 'string', 'string', 'category'))
    AS c(position, old_name, new_name, old_type, new_type, kind)"""
)
def normalize_structure(t: Tables):
    days = t.orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return structure.normalize_structure(structure.text_table(days))[1]


@query(
    """SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_totalprice AS price, strftime(o_orderdate, '%Y-%m-%d') AS date,
      o_orderpriority FROM orders"""
)
def convert_types(t: Tables):
    days = t.orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    done, _ = structure.normalize_structure(structure.text_table(days))
    return done.withColumn("date", F.date_format("date", "yyyy-MM-dd"))
