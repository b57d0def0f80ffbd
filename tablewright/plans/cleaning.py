"""Queries: rule-based cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as r
from .inputs import DIRTY, RULES, dirty_customers
from .registry import Tables, query, rounded

D = f"WITH d AS ({DIRTY})"
_time = "regexp_matches(called, '^(0[1-9]|1[0-2])[0-5][0-9](am|pm)$')"
FIX = """f AS (SELECT c_nationkey, nation AS fix FROM (SELECT c_nationkey, nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, nation) AS k
    FROM d GROUP BY c_nationkey, nation) WHERE k = 1)"""
REPAIRED = f"""{D}, {FIX}, x AS (SELECT d.*, fix, CASE WHEN {_time} THEN called END AS called_2,
    CASE WHEN regexp_matches(segment, '^[A-Z]+$') THEN segment END AS segment_2, fix AS nation_2 FROM d JOIN f USING (c_nationkey))"""
LOG = f"""{REPAIRED}, log AS (
    SELECT c_custkey, 'called' AS "column", called AS old, called_2 AS "new", 'time' AS cleaner FROM x WHERE called IS DISTINCT FROM called_2
    UNION ALL SELECT c_custkey, 'segment', segment, segment_2, 'letters' FROM x WHERE segment IS DISTINCT FROM segment_2
    UNION ALL SELECT c_custkey, 'nation', nation, nation_2, 'nation' FROM x WHERE nation IS DISTINCT FROM nation_2)"""


def cleaned(t: Tables):
    return r.clean_rules(dirty_customers(t), r.expand_rules(RULES))


@query(f"{D} SELECT c_custkey, CASE WHEN {_time} THEN called END AS called, NOT {_time} AS violation FROM d")
def clean_date(t: Tables):
    return r.clean_date(dirty_customers(t), "called", "%I%M%P").select("c_custkey", "called", "violation")


@query(
    f"""{D} SELECT c_custkey, CASE WHEN regexp_matches(segment, '^[A-Z]+$') THEN segment END AS segment,
      NOT regexp_matches(segment, '^[A-Z]+$') AS violation FROM d"""
)
def clean_pattern(t: Tables):
    return r.clean_pattern(dirty_customers(t), "segment", "[A-Z]+").select("c_custkey", "segment", "violation")


@query(f"{D}, {FIX} SELECT c_custkey, c_nationkey, fix AS nation, nation <> fix AS violation FROM d JOIN f USING (c_nationkey)")
def clean_fd(t: Tables):
    return r.clean_fd(dirty_customers(t), "c_nationkey", "nation").select("c_custkey", "c_nationkey", "nation", "violation")


@query(
    f"""{D}, {FIX}, v AS (SELECT c_nationkey, count(DISTINCT nation) AS variants FROM d GROUP BY 1)
    SELECT c_nationkey AS source, fix, variants FROM f JOIN v USING (c_nationkey) WHERE variants > 1"""
)
def fd_violations(t: Tables):
    return r.dependency_violations(dirty_customers(t), "c_nationkey", "nation")


@query(f"{REPAIRED} SELECT c_custkey, called_2 AS called, segment_2 AS segment, nation_2 AS nation FROM x")
def clean_rules(t: Tables):
    return r.repaired_table(cleaned(t)).select("c_custkey", "called", "segment", "nation")


@query(
    f"""{REPAIRED} SELECT c_custkey, c_nationkey, true_nation, true_segment, nation_2 AS nation, segment_2 AS segment, called_2 AS called FROM x"""
)
def repair_table(t: Tables):
    return r.repaired_table(cleaned(t))


@query(f"{LOG} SELECT * FROM log")
def repair_log(t: Tables):
    return r.repair_log(cleaned(t), ["c_custkey"])


@query(
    f"""{LOG} SELECT log.*, CASE cleaner WHEN 'time' THEN 'Date' WHEN 'letters' THEN 'Pattern' ELSE 'AttrRelation' END AS kind,
      CASE cleaner WHEN 'time' THEN 'called' WHEN 'letters' THEN 'segment' ELSE 'c_nationkey' END AS sources FROM log"""
)
def repair_provenance(t: Tables):
    return r.repair_provenance(r.repair_log(cleaned(t), ["c_custkey"]), r.expand_rules(RULES))


# Two rules on one source, so that they form one group.
GROUPED = {**RULES, "region": {"type": "AttrRelation", "source": ["c_nationkey"], "target": ["segment"]}}
CONTRIBUTION = f"""{LOG}, seg AS (SELECT c_nationkey, segment_2 AS fix FROM (SELECT c_nationkey, segment_2,
      row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, segment_2) AS k FROM x WHERE segment_2 IS NOT NULL GROUP BY c_nationkey, segment_2) WHERE k = 1),
    n AS (SELECT * FROM (VALUES ('time', 1), ('letters', 2), ('nation', 2), ('region', 2)) AS v(cleaner, "group")),
    c AS (SELECT cleaner, count(*) AS k FROM log GROUP BY 1 UNION ALL
      SELECT 'region', count(*) FROM x JOIN seg USING (c_nationkey) WHERE segment_2 IS NOT NULL AND segment_2 <> seg.fix),
    w AS (SELECT "group", cleaner, coalesce(k, 0) AS repaired, round(coalesce(k, 0) / sum(k) OVER (PARTITION BY "group"), 6) AS weight FROM n LEFT JOIN c USING (cleaner))"""


def contribution(t: Tables):
    ruled = r.expand_rules(GROUPED)
    return r.group_contribution(r.repair_log(r.clean_rules(dirty_customers(t), ruled), ["c_custkey"]), ruled)


@query(f"{CONTRIBUTION} SELECT * FROM w")
def group_contribution(t: Tables):
    return rounded(contribution(t))


@query(f'{CONTRIBUTION} SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY weight DESC, cleaner) AS rank FROM w')
def rank_rules(t: Tables):
    return rounded(r.rank_rules(contribution(t)))


@query(
    f"""{REPAIRED}, c AS (SELECT nation AS d, nation_2 AS r, true_nation AS t FROM x UNION ALL SELECT segment, segment_2, true_segment FROM x),
    n AS (SELECT count(*) FILTER (d IS DISTINCT FROM t) AS errors, count(*) FILTER (d IS DISTINCT FROM r) AS changed,
      count(*) FILTER (d IS DISTINCT FROM r AND r IS NOT DISTINCT FROM t) AS repaired FROM c),
    m AS (SELECT *, repaired / changed AS p, repaired / errors AS q FROM n)
    SELECT errors, changed, repaired, round(p, 6) AS precision, round(q, 6) AS recall, round(2 * p * q / (p + q), 6) AS f1 FROM m"""
)
def repair_quality(t: Tables):
    dirty = dirty_customers(t)
    truth = dirty.select("c_custkey", F.col("true_nation").alias("nation"), F.col("true_segment").alias("segment"))
    return rounded(r.repair_quality(dirty, r.repaired_table(cleaned(t)), truth, ["c_custkey"], ["nation", "segment"]))
