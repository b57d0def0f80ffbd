"""Queries: metrics, sampling, balancing, examples, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import examples, metrics, sample
from .inputs import ANSWERS, answers
from .registry import Tables, query, rounded

A = f"WITH a AS ({ANSWERS})"
_scores = """round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(1, p + r), 6) AS f1,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1_standard"""


def _task_sql(correct: str) -> str:
    return f"""{A}, c AS (SELECT lower(trim(gold)) AS l, lower(trim(said)) AS s FROM a), k AS (SELECT l, {correct} AS ok FROM c),
      n AS (SELECT count(*) AS total, count(*) FILTER (ok) AS good, count(*) FILTER (l = 'yes' AND ok) AS tp, count(*) FILTER (l = 'yes' AND NOT ok) AS fn,
        count(*) FILTER (l = 'no' AND ok) AS tn, count(*) FILTER (l = 'no' AND NOT ok) AS fp FROM k),
      m AS (SELECT *, tp / greatest(1, tp + fp) AS p, tp / greatest(1, tp + fn) AS r FROM n)
      SELECT {_scores}, round(good / total, 6) AS accuracy, total, tp, tn, fp, fn FROM m"""


@query(_task_sql("s = l"))
def task_metrics(t: Tables):
    return rounded(metrics.task_metrics(answers(t), "said", "gold", "entity_matching"))


@query(_task_sql("ends_with(string_split(s, chr(10) || chr(10))[-1], l)"))
def task_metrics_suffix(t: Tables):
    return rounded(metrics.task_metrics(answers(t), "said", "gold", "error_detection"))


@query(_task_sql("starts_with(s, l)"))
def task_metrics_prefix(t: Tables):
    return rounded(metrics.task_metrics(answers(t), "said", "gold", "schema_matching"))


@query(
    f"""{A}, n AS (SELECT count(*) AS n, count(*) FILTER (quality = guess) AS same, count(*) FILTER (quality = 1 AND guess = 1) AS tp,
      count(*) FILTER (quality = 0 AND guess = 1) AS fp, count(*) FILTER (quality = 0 AND guess = 0) AS tn,
      count(*) FILTER (quality = 1 AND guess = 0) AS fn FROM a),
    m AS (SELECT *, tp / greatest(1, tp + fp) AS p, tp / greatest(1, tp + fn) AS r FROM n)
    SELECT round(same / n, 6) AS accuracy, {_scores}, tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives FROM m"""
)
def binary_metrics(t: Tables):
    return rounded(metrics.binary_metrics(answers(t), "quality", "guess"))


# Order status guessed from the priority: several classes, some only on one side.
STATES = """SELECT o_orderkey, o_orderstatus AS y,
    CASE WHEN o_orderkey % 4 = 0 THEN 'X' WHEN o_orderkey % 5 = 0 THEN 'P' ELSE o_orderstatus END AS p FROM orders"""


def states(t: Tables):
    key = F.col("o_orderkey")
    guess = F.when(key % 4 == 0, "X").when(key % 5 == 0, "P").otherwise(F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", F.col("o_orderstatus").alias("y"), guess.alias("p"))


CLASSES = f"""WITH s AS ({STATES}), c AS (SELECT y AS class FROM s UNION SELECT p FROM s),
  n AS (SELECT class, (SELECT count(*) FROM s WHERE y = class AND p = class) AS tp, (SELECT count(*) FROM s WHERE y <> class AND p = class) AS fp,
    (SELECT count(*) FROM s WHERE y = class AND p <> class) AS fn FROM c),
  m AS (SELECT *, tp / greatest(1, tp + fp) AS p, tp / greatest(1, tp + fn) AS r FROM n)"""


@query(f"{CLASSES} SELECT class, tp, fp, fn, {_scores} FROM m")
def class_metrics(t: Tables):
    return rounded(metrics.class_metrics(states(t), "y", "p"))


@query(
    f"""{CLASSES} SELECT round((SELECT count(*) FILTER (y = p) / count(*) FROM s), 6) AS accuracy, round(avg(p), 6) AS precision,
      round(avg(r), 6) AS recall, round(avg(2 * p * r / greatest(1, p + r)), 6) AS f1, count(*) AS n_classes FROM m"""
)
def multiclass_metrics(t: Tables):
    return rounded(metrics.multiclass_metrics(states(t), "y", "p"))


@query(f"WITH s AS ({STATES}) SELECT y AS true_class, p AS pred_class, count(*) AS n FROM s GROUP BY 1, 2")
def confusion(t: Tables):
    return metrics.confusion(states(t), "y", "p")


@query(f"WITH s AS ({STATES}) SELECT y AS class FROM s UNION SELECT p FROM s")
def class_union(t: Tables):
    return metrics.class_union(states(t), "y", "p")


@query(
    f"""WITH s AS ({STATES}) SELECT y || '->' || p AS error_type, count(*) AS count, sum(count(*)) OVER ()::BIGINT AS total_errors,
      round(sum(count(*)) OVER () / (SELECT count(*) FROM s), 6) AS error_rate FROM s WHERE y <> p GROUP BY y, p"""
)
def error_analysis(t: Tables):
    return rounded(metrics.error_analysis(states(t), "y", "p"))


@query(f"WITH s AS ({STATES}) SELECT * FROM s WHERE y <> p")
def error_examples(t: Tables):
    return metrics.error_examples(states(t), "y", "p")


def _hash(key: str, seed: str = "42") -> str:
    return f"md5(concat_ws('|', CAST({key} AS VARCHAR), '{seed}'))"


@query(f"SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY {_hash('o_orderkey')}, o_orderkey) - 1 AS pos FROM orders")
def shuffle_rows(t: Tables):
    return sample.shuffle_rows(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"])


@query(f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {_hash('o_orderkey')} LIMIT 1000")
def sample_data(t: Tables):
    return sample.sample_data(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], max_samples=1000)


@query(
    f"""SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY {_hash('o_orderkey')}) AS r FROM orders)
    WHERE r <= floor(0.25 * (SELECT count(*) FROM orders))"""
)
def sample_data_share(t: Tables):
    return sample.sample_data(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], max_percent=0.25)


@query(
    f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_hash('doc_id')}) AS r FROM labels),
    s AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) SELECT doc_id, quality FROM r, s WHERE r <= n"""
)
def balance_undersample(t: Tables):
    return sample.balance_undersample(t.labels.select("doc_id", "quality"), "quality", ["doc_id"])


@query(
    f"""WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), x AS (SELECT max(n) AS n FROM n),
    r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_hash('doc_id')}) - 1 AS place FROM labels),
    d AS (SELECT quality, j AS draw, CAST('0x' || substr(md5(concat_ws('|', CAST(quality AS VARCHAR), CAST(j AS VARCHAR), '42')), 1, 8) AS BIGINT) % n.n AS place
      FROM n, x, range((SELECT n FROM x)) AS g(j) WHERE n.n < x.n)
    SELECT r.doc_id, r.quality, d.draw FROM d JOIN r USING (quality, place)
    UNION ALL SELECT doc_id, l.quality, -1 FROM labels l JOIN n USING (quality), x WHERE n.n = x.n"""
)
def balance_oversample(t: Tables):
    return sample.balance_oversample(t.labels.select("doc_id", "quality"), "quality", ["doc_id"]).na.fill(-1, ["draw"])


@query(
    " UNION ALL ".join(
        f"""SELECT {i} AS grp, c_custkey, {c} FROM customer
        WHERE CAST('0x' || substr({_hash('c_custkey', f'group{i}|42')}, 1, 8) AS BIGINT) < {int(0.3 * 2**32)}"""
        for i, c in enumerate(["c_mktsegment AS value", "c_name AS value"])
    )
)
def sample_ratio_groups(t: Tables):
    parts = sample.sample_ratio_groups(t.customer, ["c_custkey"], [["c_mktsegment"], ["c_name"]])
    named = [p.toDF("c_custkey", "value").withColumn("grp", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b), named)


SHOWN = """SELECT o_orderkey, 'priority ' || o_orderpriority || ' ' AS text, CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END || chr(10) AS label_str FROM orders"""


def shown(t: Tables):
    text = F.concat(F.lit("priority "), "o_orderpriority", F.lit(" "))
    return t.orders.select("o_orderkey", text.alias("text"), F.when(F.col("o_orderstatus") == "F", "Yes\n").otherwise("No\n").alias("label_str"))


@query(f"SELECT * FROM ({SHOWN}) ORDER BY {_hash('o_orderkey')} LIMIT 10")
def random_examples(t: Tables):
    return examples.random_examples(shown(t), "o_orderkey", 10)


@query(f"SELECT o_orderkey, trim(text) || ' ' || CASE WHEN label_str LIKE 'Y%' THEN 'Yes' ELSE 'No' END AS example FROM ({SHOWN})")
def example_text(t: Tables):
    return examples.example_text(shown(t)).select("o_orderkey", "example")


PROMPT = """SELECT string_agg(trim(text) || ' ' || CASE WHEN label_str LIKE 'Y%' THEN 'Yes' ELSE 'No' END, chr(10) || chr(10) ORDER BY o_orderkey)
  || chr(10) AS prompt FROM ({rows})"""


@query(PROMPT.format(rows=f"SELECT * FROM ({SHOWN}) ORDER BY {_hash('o_orderkey')} LIMIT 10"))
def format_examples(t: Tables):
    return examples.format_examples(examples.random_examples(shown(t), "o_orderkey", 10), "o_orderkey", 10)


@query(PROMPT.format(rows=f"SELECT * FROM ({SHOWN}) ORDER BY {_hash('o_orderkey')} LIMIT 6"))
def generate_prompt(t: Tables):
    return examples.generate_prompt(shown(t), "o_orderkey", "random", 6)


@query(
    f"""WITH s AS ({SHOWN}), y AS (SELECT * FROM s WHERE label_str LIKE 'Y%' ORDER BY o_orderkey LIMIT 8),
    n AS (SELECT * FROM s WHERE label_str LIKE 'N%' ORDER BY {_hash('o_orderkey')}, o_orderkey LIMIT 1)
    SELECT * FROM y WHERE o_orderkey < (SELECT max(o_orderkey) FROM y) UNION ALL SELECT * FROM n"""
)
def balance_yes_no(t: Tables):
    rows = shown(t)
    chosen = rows.filter(F.col("label_str").startswith("Y")).orderBy("o_orderkey").limit(8)
    return examples.balance_yes_no(chosen, rows, "o_orderkey")


@query("SELECT c_custkey AS id, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def union_all(t: Tables):
    def firms(df, key: str, name: str, kind: str):
        return df.select(F.col(key).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("kind"))

    return firms(t.customer, "c_custkey", "c_name", "customer").unionByName(firms(t.supplier, "s_suppkey", "s_name", "supplier"))
