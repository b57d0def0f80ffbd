"""Queries: joins, matching, nearest rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import examples, matching, strings, vectors
from .inputs import VECTORS, labelled_vectors
from .registry import Tables, query, rounded

# Order lines and their key, some keys missing, to be matched on order and line number.
LINES = "SELECT CASE WHEN l_partkey % 20 <> 0 THEN l_orderkey END AS o, l_linenumber AS line, l_suppkey AS supp, l_quantity AS quantity FROM lineitem"


def lines(t: Tables):
    return t.lineitem.select(
        F.when(F.col("l_partkey") % 20 != 0, F.col("l_orderkey")).alias("o"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_quantity").alias("quantity"),
    )


# Orders as another system might keep them: fewer columns, keys missing now and then.
ORDERS = "SELECT CASE WHEN o_custkey % 50 <> 0 THEN o_orderkey END AS o, o_custkey AS cust, CAST(o_custkey % 7 AS DOUBLE) AS quantity FROM orders"


def other_orders(t: Tables):
    return t.orders.select(
        F.when(F.col("o_custkey") % 50 != 0, F.col("o_orderkey")).alias("o"),
        F.col("o_custkey").alias("cust"),
        (F.col("o_custkey") % 7).cast("double").alias("quantity"),
    )


@query(
    f"""SELECT a.o, a.line, a.supp, a.quantity AS quantity_1, b.cust, b.quantity AS quantity_2
    FROM ({LINES}) a JOIN ({ORDERS}) b ON a.o IS NOT DISTINCT FROM b.o"""
)
def exact_match(t: Tables):
    return matching.exact_match(lines(t), other_orders(t), ["o"])


@query(
    """SELECT a.n_name, a.r AS r_1, b.r AS r_2, a.n_nationkey AS n_nationkey_1, b.n_nationkey AS n_nationkey_2
    FROM (SELECT CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS n_name, n_regionkey AS r, n_nationkey FROM nation) a
    JOIN (SELECT CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS n_name, n_regionkey AS r, n_nationkey FROM nation) b
      ON a.n_name IS NOT DISTINCT FROM b.n_name"""
)
def exact_match_nulls(t: Tables):
    def nations(every: int):
        name = F.when(F.col("n_nationkey") % every != 0, F.col("n_name")).alias("n_name")
        return t.nation.select(name, F.col("n_regionkey").alias("r"), "n_nationkey")

    return matching.exact_match(nations(5), nations(4), ["n_name"])


@query(
    """SELECT a.l_orderkey, a.l_linenumber, a.l_partkey AS l_partkey_1, b.l_partkey AS l_partkey_2
    FROM lineitem a JOIN lineitem b USING (l_orderkey, l_linenumber)"""
)
def self_match(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return matching.self_match(rows, ["l_orderkey", "l_linenumber"])


@query(
    f"""SELECT count(*) AS matches, 'o' AS match_columns, 6 AS n_columns FROM ({LINES}) a JOIN ({ORDERS}) b ON a.o IS NOT DISTINCT FROM b.o"""
)
def match_summary(t: Tables):
    return matching.exact_match_summary(lines(t), other_orders(t), ["o"])


@query(
    """SELECT a.l_orderkey AS l_orderkey_1, a.l_linenumber AS l_linenumber_1, a.l_quantity AS l_quantity_1, a.l_discount AS l_discount_1,
      b.l_orderkey AS l_orderkey_2, b.l_linenumber AS l_linenumber_2, b.l_quantity AS l_quantity_2, b.l_discount AS l_discount_2
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
      AND abs(a.l_quantity - b.l_quantity) <= 3 AND abs(a.l_discount - b.l_discount) <= 0.025"""
)
def rule_match(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return matching.rule_match(rows, rows, ["l_orderkey"], {"l_quantity": 3.0, "l_discount": 0.025})


# Similarity of two short texts in SQL: each character's places in the first text as a bit mask, then one
# row of the longest-common-subsequence table per character of the second, held in a 128-bit number.
MASKS = """{name} AS (SELECT x, map_from_entries(list({{'k': ch, 'v': mask}})) AS m FROM (
    SELECT x, ch, sum(1::HUGEINT << (i - 1))::HUGEINT AS mask FROM (
      SELECT x, unnest(string_split(x, '')) AS ch, unnest(range(1, length(x) + 1)) AS i FROM (SELECT DISTINCT x FROM ({texts}))) GROUP BY 1, 2) GROUP BY 1)"""


def masks_sql(texts: str, name: str = "masks") -> str:
    return MASKS.format(texts=texts, name=name)


def ratio_sql(a: str, b: str, m: str) -> str:
    full = f"((1::HUGEINT << length({a})) - 1)"
    hits = f"list_transform(string_split({b}, ''), lambda c: coalesce({m}[c], 0::HUGEINT))"
    common = f"length({a}) - bit_count(list_reduce({hits}, lambda v, x: ((v + (v & x)) | (v - (v & x))) & {full}, {full}))"
    return f"(round_even(200.0 * ({common}) / (length({a}) + length({b})), 0) / 100)"


@query(
    f"""WITH {masks_sql('SELECT url AS x FROM pages')},
    p AS (SELECT a.page_id AS page_id_1, b.page_id AS page_id_2, {ratio_sql('a.url', 'b.url', 'masks.m')} AS similarity
      FROM pages a JOIN masks ON x = a.url JOIN pages b ON 2 * least(length(a.url), length(b.url)) >= 0.9 * (length(a.url) + length(b.url)))
    SELECT page_id_1, page_id_2, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.95"""
)
def fuzzy_match(t: Tables):
    pages = t.pages.select("page_id", "url")
    found = strings.fuzzy_match(pages, pages, ["url"], 0.95)
    return rounded(found.select("page_id_1", "page_id_2", "similarity"))


def products(t: Tables, large: bool):
    rows = t.part.filter(F.col("p_size") > 25 if large else F.col("p_size") <= 25)
    name = F.replace("p_name", F.lit("small"), F.lit("smal")) if large else F.col("p_name")
    return rows.select(name.alias("name"), F.col("p_type").alias("kind")).distinct()


PRODUCTS = f"""WITH a AS (SELECT DISTINCT p_name AS name, p_type AS kind FROM part WHERE p_size <= 25),
  b AS (SELECT DISTINCT replace(p_name, 'small', 'smal') AS name, p_type AS kind FROM part WHERE p_size > 25),
  {masks_sql('SELECT name AS x FROM a UNION ALL SELECT kind FROM a')},
  s AS (SELECT a.name AS name_1, a.kind AS kind_1, b.name AS name_2, b.kind AS kind_2,
    ({ratio_sql('a.name', 'b.name', 'n.m')} + {ratio_sql('a.kind', 'b.kind', 'k.m')}) / 2 AS similarity
    FROM a JOIN masks n ON n.x = a.name JOIN masks k ON k.x = a.kind, b)"""


@query(f"{PRODUCTS} SELECT name_1, kind_1, name_2, kind_2, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.9")
def fuzzy_match_columns(t: Tables):
    return rounded(strings.fuzzy_match(products(t, False), products(t, True), ["name", "kind"], 0.9))


@query(
    f"""{PRODUCTS}, same AS (SELECT * FROM s WHERE name_1 = name_2 AND kind_1 = kind_2)
    SELECT name_1, kind_1, name_2, kind_2, 1.0 AS similarity, 'exact' AS method FROM same
    UNION ALL SELECT name_1, kind_1, name_2, kind_2, round(similarity, 6), 'fuzzy' FROM s WHERE similarity >= 0.9
      AND name_1 || '|' || kind_1 NOT IN (SELECT name_1 || '|' || kind_1 FROM same)
      AND name_2 || '|' || kind_2 NOT IN (SELECT name_2 || '|' || kind_2 FROM same)"""
)
def hybrid_match(t: Tables):
    return rounded(matching.hybrid_match(products(t, False), products(t, True), ["name", "kind"], 0.9))


@query(
    f"""{PRODUCTS}, f AS (SELECT * FROM s WHERE similarity >= 0.9),
    c AS (SELECT 'name' AS column_1, 'name' AS column_2, name_1 AS p, name_2 AS q FROM f UNION ALL SELECT 'name', 'kind', name_1, kind_2 FROM f
      UNION ALL SELECT 'kind', 'name', kind_1, name_2 FROM f UNION ALL SELECT 'kind', 'kind', kind_1, kind_2 FROM f)
    SELECT column_1, column_2, round(avg({ratio_sql('p', 'q', 'masks.m')}), 6) AS similarity FROM c JOIN masks ON x = p GROUP BY 1, 2"""
)
def column_similarity_matrix(t: Tables):
    found = strings.fuzzy_match(products(t, False), products(t, True), ["name", "kind"], 0.9)
    return rounded(matching.column_similarity_matrix(found, ["name", "kind"]))


def _shelf_sql(i: int) -> str:
    return f"SELECT p_name || '{['', 's', 'x'][i]}' AS name, min(p_partkey) AS id FROM part WHERE p_brand = 'Brand#{i + 1}' GROUP BY 1"


@query(
    f"""WITH a AS ({_shelf_sql(0)}), b AS ({_shelf_sql(1)}), c AS ({_shelf_sql(2)}), {masks_sql('SELECT name AS x FROM a')},
    ab AS (SELECT a.id AS entity1, b.id AS entity2, {ratio_sql('a.name', 'b.name', 'm')} AS s FROM a JOIN masks ON x = a.name, b),
    ac AS (SELECT a.id AS entity1, c.id AS entity3, {ratio_sql('a.name', 'c.name', 'm')} AS s FROM a JOIN masks ON x = a.name, c)
    SELECT entity1, entity2, entity3, round((ab.s + ac.s) / 2, 6) AS score FROM ab JOIN ac USING (entity1) WHERE ab.s >= 0.8 AND ac.s >= 0.8"""
)
def three_way_match(t: Tables):
    """Three brands' product lists, two of them with a letter added to every name."""

    def shelf(i: int):
        name = F.concat("p_name", F.lit(["", "s", "x"][i]))
        return t.part.filter(F.col("p_brand") == f"Brand#{i + 1}").groupBy(name.alias("name")).agg(F.min("p_partkey").alias("id"))

    return rounded(matching.three_way_match(shelf(0), shelf(1), shelf(2), ["name"], "id", 0.8))


@query(
    """WITH e AS (SELECT text, min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY text),
    k AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS token FROM e)
      WHERE token <> '' GROUP BY ALL),
    d AS (SELECT token, count(*) AS df FROM k GROUP BY 1),
    r AS (SELECT id, token, tf * (ln((1.0 + (SELECT count(*) FROM e)) / (1 + df)) + 1) AS raw FROM k JOIN d USING (token)),
    w AS (SELECT id, token, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS w FROM r),
    p AS (SELECT a.id AS id_1, b.id AS id_2, sum(a.w * b.w) AS similarity FROM w a JOIN w b ON a.token = b.token AND a.id < b.id GROUP BY 1, 2)
    SELECT id_1, id_2, x.copies AS copies_1, y.copies AS copies_2, round(similarity, 6) AS similarity
    FROM p JOIN e x ON x.id = id_1 JOIN e y ON y.id = id_2 WHERE similarity >= 0.8"""
)
def tfidf_match(t: Tables):
    return rounded(strings.tfidf_match(t.documents, "doc_id", "text", 0.8))


@query(
    """WITH a AS (SELECT p_partkey, p_name, p_type, concat_ws(' ', p_name, p_type) AS x, p_size <= 25 AS small FROM part),
    e AS (SELECT DISTINCT x FROM a),
    c AS (SELECT x, k, count(*) AS tf FROM (SELECT x, unnest(regexp_split_to_array(lower(x), '[^\\p{L}\\p{N}]+')) AS k FROM e) WHERE k <> '' GROUP BY ALL),
    w AS (SELECT x, k, tf * (ln((1 + (SELECT count(*) FROM e)) / (1 + count(*) OVER (PARTITION BY k))) + 1) AS w FROM c),
    u AS (SELECT x, k, w / sqrt(sum(w * w) OVER (PARTITION BY x)) AS w FROM w),
    s AS (SELECT l.x AS x1, r.x AS x2, sum(l.w * r.w) AS s FROM u l JOIN u r USING (k)
      WHERE l.x IN (SELECT x FROM a WHERE small) AND r.x IN (SELECT x FROM a WHERE NOT small) GROUP BY ALL HAVING s >= 0.85)
    SELECT l.p_partkey AS p_partkey_1, l.p_name AS p_name_1, l.p_type AS p_type_1, r.p_partkey AS p_partkey_2, r.p_name AS p_name_2,
      r.p_type AS p_type_2, round(s, 6) AS similarity FROM s JOIN a l ON l.x = x1 AND l.small JOIN a r ON r.x = x2 AND NOT r.small"""
)
def tfidf_match_tables(t: Tables):
    parts = t.part.select("p_partkey", "p_name", "p_type", "p_size")
    small, large = (parts.filter(c).drop("p_size") for c in ("p_size <= 25", "p_size > 25"))
    return strings.tfidf_match_tables(small, large, ["p_name", "p_type"], 0.85, digits=6)


@query(
    """WITH l AS (SELECT o_custkey AS ltable_id, l_suppkey AS rtable_id, CASE WHEN c_nationkey = s_nationkey THEN 1 ELSE 0 END AS label, count(*) AS n
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
    SELECT ltable_id, rtable_id, label, n, c_name AS name_A, c_nationkey AS nation_A, s_name AS name_B, s_nationkey AS nation_B,
      'Firm A is name: ' || c_name || '.nation: ' || c_nationkey || '. Firm B is name: ' || s_name || '.nation: ' || s_nationkey || '. ' AS text,
      CASE label WHEN 1 THEN 'Yes' || chr(10) ELSE 'No' || chr(10) END AS label_str
    FROM l JOIN customer ON c_custkey = ltable_id JOIN supplier ON s_suppkey = rtable_id"""
)
def pair_join(t: Tables):
    pairs = labelled_pairs(t)
    return matching.pair_join(pairs, *pair_tables(t), drop=["acctbal"], rename={"nationkey": "nation"}, noun="Firm")


def pair_tables(t: Tables):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    return a, b


def labelled_pairs(t: Tables):
    """Customers and the suppliers of their orders, labelled by whether they share a nation."""
    sold = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = sold.groupBy(F.col("o_custkey").alias("ltable_id"), F.col("l_suppkey").alias("rtable_id")).agg(F.count("*").alias("n"))
    pairs = pairs.join(t.customer.select(F.col("c_custkey").alias("ltable_id"), "c_nationkey"), "ltable_id")
    pairs = pairs.join(t.supplier.select(F.col("s_suppkey").alias("rtable_id"), "s_nationkey"), "rtable_id")
    label = F.when(F.col("c_nationkey") == F.col("s_nationkey"), 1).otherwise(0)
    return pairs.select("ltable_id", "rtable_id", label.alias("label"), "n")


COSINES = f"""WITH v AS ({VECTORS}), u AS (SELECT vec_id, label, guess, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM v),
    c AS (SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS s
      FROM u a JOIN u b ON {{on}}),
    k AS (SELECT i, j, s, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS r FROM c)"""


@query(COSINES.format(on="a.vec_id < b.vec_id") + " SELECT i, j, round(s, 6) AS similarity FROM k WHERE r <= 10 AND s > 0")
def similar_pairs(t: Tables):
    return rounded(vectors.similar_pairs(t.embeddings, "vec_id", "embedding", 10))


@query(COSINES.format(on="a.vec_id <> b.vec_id") + " SELECT i, j, round(s, 6) AS similarity FROM k WHERE r <= 5")
def topk_neighbours(t: Tables):
    return rounded(vectors.topk_neighbours(t.embeddings, "vec_id", "embedding", 5))


@query(
    COSINES.format(on="a.vec_id < b.vec_id")
    + """, t AS (SELECT i AS id_1, j AS id_2, s AS similarity FROM k WHERE r <= 3 AND s > 0 ORDER BY s DESC, i, j LIMIT 10)
    SELECT id_1, id_2, round(similarity, 6) AS similarity FROM t"""
)
def topk_matches(t: Tables):
    return rounded(matching.topk_matches(_vector_matches(t), ["id_1", "id_2"]))


@query(
    COSINES.format(on="a.vec_id < b.vec_id")
    + """, t AS (SELECT i, j, s FROM k WHERE r <= 3 AND s > 0 ORDER BY s DESC, i, j LIMIT 10)
    SELECT CAST(i AS VARCHAR) AS source, CAST(j AS VARCHAR) AS target, round(s, 6) AS weight FROM t"""
)
def match_edges(t: Tables):
    return rounded(matching.match_edges(_vector_matches(t), "id"))


def _vector_matches(t: Tables):
    pairs = vectors.similar_pairs(t.embeddings, "vec_id", "embedding", 3)
    return pairs.select(F.col("i").alias("id_1"), F.col("j").alias("id_2"), "similarity")


HARD = COSINES.format(on="a.vec_id < b.vec_id") + """, h AS (SELECT i, j FROM k JOIN u x ON x.vec_id = i JOIN u y ON y.vec_id = j
      WHERE r <= 10 AND s > 0 AND x.label <> y.label AND (x.label <> x.guess OR y.label <> y.guess)),
    m AS (SELECT DISTINCT vec_id FROM (SELECT i AS vec_id FROM h UNION ALL SELECT j FROM h) ORDER BY vec_id LIMIT 10)"""


def _guessed(t: Tables):
    rows = labelled_vectors(t)
    return rows.select("vec_id", "embedding", F.col("label").cast("string").alias("label_str"), F.col("guess").cast("string").alias("preds"))


@query(HARD + " SELECT vec_id, CAST(label AS VARCHAR) AS label_str, CAST(guess AS VARCHAR) AS preds FROM u WHERE vec_id IN (SELECT vec_id FROM m)")
def hard_samples(t: Tables):
    return examples.hard_samples(_guessed(t), "vec_id", "embedding", 10).drop("embedding")


@query(
    HARD
    + """ SELECT string_agg('Vector ' || vec_id || '. ' || CAST(label AS VARCHAR), chr(10) || chr(10) ORDER BY vec_id) || chr(10) AS prompt
    FROM u WHERE vec_id IN (SELECT vec_id FROM m)"""
)
def generate_prompt_validation(t: Tables):
    rows = _guessed(t).withColumn("text", F.concat(F.lit("Vector "), "vec_id", F.lit(".")))
    return examples.generate_prompt(rows, "vec_id", "validation", 10, "data_imputation", "embedding")


@query(
    COSINES.format(on="a.vec_id < b.vec_id")
    + """, m AS (SELECT DISTINCT vec_id FROM (SELECT i AS vec_id FROM k WHERE r <= 3 AND s > 0 UNION ALL SELECT j FROM k WHERE r <= 3 AND s > 0)
      ORDER BY vec_id LIMIT 20) SELECT vec_id, label FROM u WHERE vec_id IN (SELECT vec_id FROM m)"""
)
def distinct_members(t: Tables):
    pairs = vectors.similar_pairs(t.embeddings, "vec_id", "embedding", 3)
    return examples.distinct_members(pairs, t.embeddings.select("vec_id", "label"), "vec_id", 20)


@query(f"WITH v AS ({VECTORS}) SELECT vec_id, label, guess FROM v WHERE label <> guess")
def filter_mispredicted(t: Tables):
    rows = labelled_vectors(t).select("vec_id", "label", "guess")
    text = rows.withColumns({"label_str": F.concat(F.lit(" L"), F.col("label")), "preds": F.concat(F.lit("l"), F.col("guess"), F.lit(" "))})
    return examples.filter_mispredicted(text).select("vec_id", "label", "guess")
