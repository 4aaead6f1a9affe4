"""Registered graph queries over the edges between the tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from evitrace.operators import coverage, graph, search, traverse
from evitrace.plans.corpus import graph_edges, graph_entries, stored_graph
from evitrace.tables import load
from evitrace.vocab import HEURISTIC

CUSTOMER = ("Customer:c:Customer#000000007", "Customer#000000007")
SUPPLIER = ("Supplier:c:Supplier#000000003", "Supplier#000000003")
ORDER = "Order:c:42"
SERVED = ("approved-current", "draft")


def edge_resolution(spark, sf):
    return graph.resolve_targets(graph_entries(spark, sf), graph_edges(spark, sf))


def edge_health(spark, sf):
    return graph.edge_health(edge_resolution(spark, sf))


def edge_health_sample(spark, sf):
    return graph.edge_health_sample(edge_resolution(spark, sf), cap=20)


def target_candidates(spark, sf):
    entries = graph_entries(spark, sf)
    return graph.target_candidates(entries, graph.resolve_targets(entries, graph_edges(spark, sf)))


def incoming_edges(spark, sf):
    return graph.incoming(stored_graph(spark, sf)[0], list(SUPPLIER), include_heuristic=True).drop("target_key")


def relation_search(spark, sf):
    return search.relation_search(
        *stored_graph(spark, sf)[:2], SUPPLIER[1], kind="invokes-class",
        include_heuristic=True, lanes=SERVED,
    )


def explain(spark, sf):
    return graph.explain(*stored_graph(spark, sf)[:2], *SUPPLIER, lanes=SERVED, include_heuristic=True)


def relation_outgoing(spark, sf):
    """What one order refers to; the anchor is found whatever its case."""
    return search.relation_search(
        *stored_graph(spark, sf)[:2], "ORDER:c:4", direction="outgoing", include_heuristic=True, lanes=SERVED,
    )


def section_counts(spark, sf):
    return graph.section_counts(*stored_graph(spark, sf)[:2], *SUPPLIER, lanes=SERVED, include_heuristic=True)


def section_counts_exact(spark, sf):
    return graph.section_counts(*stored_graph(spark, sf)[:2], *CUSTOMER, top=2)


def explain_excluded(spark, sf):
    return graph.explain_excluded(*stored_graph(spark, sf)[:2], *CUSTOMER)


def context_sections(spark, sf):
    return graph.context(*stored_graph(spark, sf)[:2], *SUPPLIER, lanes=SERVED, include_heuristic=True)


def _impact(anchor, direction, **options):
    def run(spark, sf):
        edges, entries, names = stored_graph(spark, sf)
        return traverse.impact(edges, entries, anchor, direction, names=names, **options)

    return run


def capped_edges_priority(spark, sf):
    """At most 300 edges per supplier: returned lines first, then by order and line."""
    kept = graph.capped_edges(_supplier_edges(spark, sf), "supplier", "position", {"returned": 10, "open": 20})
    return kept.select("supplier", "kind", "position", "priority")


def _supplier_edges(spark, sf):
    kind = F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_linestatus") == "O", "open").otherwise("shipped")
    place = F.struct(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_partkey").alias("c"),
                     F.col("l_extendedprice").alias("d"))
    # Lines repeat under this key in the synthetic data; equal places are one place.
    return load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supplier"), kind.alias("kind"), F.to_json(place).alias("j"), place.alias("p")).distinct().select(
        "supplier", "kind", F.format_string("%012d.%02d.%012d.%015.2f", "p.a", "p.b", "p.c", "p.d").alias("position"))


def truncated_families(spark, sf):
    edges = _supplier_edges(spark, sf)
    kept = graph.capped_edges(edges, "supplier", "position", {"returned": 10, "open": 20})
    return graph.truncated_families(edges, kept, "supplier")


def stored_edge_health(spark, sf):
    """Brand targets of parts against the live brands of the parts above size 25."""
    parts = load(spark, sf, "part")
    brand = F.regexp_replace("p_brand", "#", "_")
    edges = parts.select(
        F.col("p_partkey").cast("string").alias("source"), F.lit("references-field").alias("kind"),
        F.when(F.col("p_size") > 40, F.concat(brand, F.lit("__c")))
        .when(F.col("p_size") > 20, F.concat(brand, F.lit("__c."), F.col("p_type"), F.lit("__c")))
        .otherwise(F.concat(F.lit("pkg__"), brand, F.lit("__c"))).alias("target"),
        F.when(F.col("p_type") == "PROMO", HEURISTIC).otherwise("source-exact").alias("assurance"),
    )
    live = parts.filter(F.col("p_retailprice") > 1060).select(
        F.explode(F.array(F.concat(brand, F.lit("__c")), F.concat(brand, F.lit("__c."), "p_type", F.lit("__c")))).alias("name")
    )
    return coverage.stored_edge_health(edges, live).groupBy("verdict", "kind").agg(
        F.count(F.lit(1)).alias("targets"), F.count_distinct("component").alias("components")
    )


def evidence_closure(spark, sf):
    """What the last turn of every conversation rests on, following each turn to the one before."""
    turns = load(spark, sf, "conversations").select("conv_id", "turn", "role")
    ident = lambda t: F.concat_ws(":", "conv_id", t)
    depends = turns.filter(F.col("turn") > 0).select(ident(F.col("turn")).alias("id"), ident(F.col("turn") - 1).alias("depends_on"))
    starts = turns.groupBy("conv_id").agg(F.max("turn").alias("turn")).select(ident(F.col("turn")).alias("start"))
    return traverse.closure(starts, depends)


QUERIES = {
    **{f.__name__: f for f in (
        edge_resolution, edge_health, edge_health_sample, target_candidates, incoming_edges, relation_search,
        relation_outgoing, section_counts, section_counts_exact,
        explain, explain_excluded, context_sections, capped_edges_priority, truncated_families,
        stored_edge_health, evidence_closure,
    )},
    "impact_in": _impact(CUSTOMER[0], "incoming", lanes=SERVED),
    "impact_out": _impact(ORDER, "outgoing", include_heuristic=True),
}

_G = """WITH nr AS (SELECT n_name, r_name, r_name || '.' || n_name AS q FROM nation JOIN region ON n_regionkey = r_regionkey),
entries AS (
 SELECT 'Region:c:' || r_name AS identity, r_name AS full_name, 'approved-current' AS lane FROM region
 UNION ALL SELECT 'Nation:c:' || q, q, 'approved-current' FROM nr
 UNION ALL SELECT 'Customer:c:' || c_name, c_name, CASE WHEN c_acctbal < 0 THEN 'approved-drifted' ELSE 'approved-current' END FROM customer
 UNION ALL SELECT 'Supplier:c:' || s_name, s_name, CASE WHEN s_acctbal < 0 THEN 'revoked' ELSE 'approved-current' END FROM supplier
 UNION ALL SELECT 'Part:' || p_partkey || ':' || p_name, p_name, 'approved-current' FROM part
 UNION ALL SELECT 'Order:c:' || o_orderkey, o_orderkey::VARCHAR, CASE WHEN o_orderstatus = 'P' THEN 'draft' ELSE 'approved-current' END FROM orders),
edges AS (SELECT *, lower(target) AS target_key FROM (
 SELECT 'Nation:c:' || q AS source, 'belongs-to' AS kind, r_name AS target, 'source-exact' AS assurance FROM nr
 UNION ALL SELECT 'Customer:c:' || c_name, 'belongs-to', 'NATION_' || c_nationkey, 'source-exact' FROM customer
 UNION ALL SELECT 'Supplier:c:' || s_name, 'belongs-to', 'NATION_' || s_nationkey, 'source-exact' FROM supplier
 UNION ALL SELECT 'Part:' || p_partkey || ':' || p_name, 'references-field', p_brand || '__c', 'source-exact' FROM part
 UNION ALL SELECT 'Part:' || p_partkey || ':' || p_name, 'relationship', p_name, 'source-exact' FROM part
 UNION ALL SELECT 'Order:c:' || o_orderkey, 'belongs-to', 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0'), 'source-exact' FROM orders
 UNION ALL SELECT 'Order:c:' || l_orderkey, 'invokes-class', 'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0'), 'source-derived-heuristic' FROM lineitem))"""
_R = _G + """, f AS (SELECT lower(full_name) AS k, count(*) AS n, min(identity) AS i FROM entries GROUP BY 1),
id AS (SELECT lower(identity) AS k, count(*) AS n, min(identity) AS i FROM entries GROUP BY 1),
m AS (SELECT lower(regexp_extract(full_name, '[^.]*$')) AS k, count(*) AS n, min(identity) AS i FROM entries WHERE contains(full_name, '.') GROUP BY 1),
t AS (SELECT target_key, count(*) AS incoming, count(DISTINCT target) AS spellings, min(target) AS spelling FROM edges GROUP BY 1),
targets AS (SELECT target_key, incoming, spellings, spelling,
  CASE WHEN coalesce(f.n, id.n, m.n) IS NULL THEN 'no-entry' WHEN coalesce(f.n, id.n, m.n) > 1 THEN 'ambiguous'
       WHEN f.n IS NULL AND id.n IS NULL THEN 'resolved-by-member' ELSE 'resolved' END AS resolution,
  CASE WHEN coalesce(f.n, id.n, m.n) = 1 THEN CASE WHEN f.n = 1 THEN f.i WHEN id.n = 1 THEN id.i ELSE m.i END END AS target_identity,
  coalesce(f.n, id.n, m.n, 0) AS candidates,
  CASE WHEN f.n IS NOT NULL THEN 'full' WHEN id.n IS NOT NULL THEN 'identity' WHEN m.n IS NOT NULL THEN 'member' END AS stage,
  regexp_matches(spelling, '__(c|e|mdt|b|x)$') AND NOT contains(regexp_replace(spelling, '__(c|e|mdt|b|x)$', ''), '__') AND NOT contains(spelling, '.') AS decidable
  FROM t LEFT JOIN f ON f.k = target_key LEFT JOIN id ON id.k = target_key LEFT JOIN m ON m.k = target_key)"""
_IN = "target_key IN ('{}', '{}')"


def _in(pair):
    return _IN.format(*[p.lower() for p in pair])


_SUP_EDGES = """e AS (SELECT DISTINCT l_suppkey AS supplier, CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_linestatus = 'O' THEN 'open' ELSE 'shipped' END AS kind,
  printf('%012d.%02d.%012d.%015.2f', l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS position FROM lineitem),
k AS (SELECT *, CASE kind WHEN 'returned' THEN 10 WHEN 'open' THEN 20 ELSE 50 END AS priority FROM e),
kept AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY supplier ORDER BY priority, position) <= 300)"""


def _counts(names, sure, lanes, top):
    return f"""x AS (SELECT CASE WHEN kind = 'belongs-to' THEN 'parts' ELSE 'incoming' END AS section, kind, {sure} AS s, lane AS l, coalesce(lane IN {lanes}, false) AS a
  FROM edges LEFT JOIN entries ON source = identity WHERE {_in(names)}
  UNION ALL SELECT 'outgoing', kind, {sure}, NULL, true FROM edges WHERE source = '{names[0]}'),
c AS (SELECT section, kind, count(*) FILTER (s AND a) AS edges, count(*) FILTER (NOT s) AS heuristic, count(*) FILTER (s AND NOT a) AS other_lane,
  count(*) FILTER (s AND a AND l IS NOT DISTINCT FROM 'approved-current') AS cur FROM x GROUP BY 1, 2)
SELECT section, kind, edges, heuristic, other_lane, (greatest(sum(cur) OVER w - {top}, 0) + greatest(sum(edges - cur) OVER w - {top}, 0))::BIGINT AS beyond
FROM c WINDOW w AS (PARTITION BY section)"""


ORACLE = {
    "edge_resolution": f"{_R} SELECT target_key, incoming, spellings, spelling, resolution, target_identity, candidates, stage, decidable FROM targets",
    "edge_health": f"{_R} SELECT resolution, count(*) AS targets, count(*) FILTER (decidable) AS decidable, sum(incoming)::BIGINT AS edges FROM targets GROUP BY resolution",
    "edge_health_sample": f"""{_R}, x AS (SELECT CASE WHEN resolution = 'ambiguous' THEN 'ambiguous' ELSE 'decidable-no-entry' END AS finding, target_key
  FROM targets WHERE resolution = 'ambiguous' OR (resolution = 'no-entry' AND decidable))
SELECT finding, target_key, count(*) OVER (PARTITION BY finding) AS total FROM x QUALIFY row_number() OVER (PARTITION BY finding ORDER BY target_key) <= 20""",
    "target_candidates": f"""{_R} SELECT target_key, 'full' AS stage, identity AS candidate FROM targets JOIN entries ON lower(full_name) = target_key
WHERE resolution = 'ambiguous' AND stage = 'full'""",
    "incoming_edges": f"{_G} SELECT source, kind, target, assurance FROM edges WHERE {_in(SUPPLIER)}",
    "relation_search": f"""{_G} SELECT source, kind, target, assurance, lane AS lifecycle FROM edges JOIN entries ON source = identity
WHERE target_key = '{SUPPLIER[1].lower()}' AND kind = 'invokes-class' AND lane IN ('approved-current', 'draft')""",
    "relation_outgoing": f"""{_G} SELECT source, kind, target, assurance, lane AS lifecycle FROM edges JOIN entries ON source = identity
WHERE source = 'Order:c:4' AND lane IN ('approved-current', 'draft')""",
    "section_counts": f"""{_G}, {_counts(SUPPLIER, "true", "('approved-current', 'draft')", 25)}""",
    "section_counts_exact": f"""{_G}, {_counts(CUSTOMER, "assurance = 'source-exact'", "('approved-current')", 2)}""",
    "explain": f"""{_G}, x AS (SELECT source, kind, assurance, target, lane AS lifecycle, lane = 'approved-current' AS is_current FROM edges JOIN entries ON source = identity
WHERE {_in(SUPPLIER)} AND lane IN ('approved-current', 'draft'))
SELECT source, kind, assurance, lifecycle, is_current, row_number() OVER (PARTITION BY is_current ORDER BY source, kind, assurance, target)::INTEGER AS rank FROM x
QUALIFY rank <= 50""",
    "explain_excluded": f"""{_G}, x AS (SELECT assurance <> 'source-exact' AS h, lane = 'approved-current' AS c FROM edges LEFT JOIN entries ON source = identity WHERE {_in(CUSTOMER)})
SELECT count(*) FILTER (h) AS heuristic_edge, count(*) FILTER (NOT h AND NOT c) AS lifecycle, greatest(count(*) FILTER (NOT h AND c) - 50, 0) AS cap FROM x""",
    "context_sections": f"""{_G}, x AS (SELECT CASE WHEN kind = 'belongs-to' THEN 'parts' ELSE 'incoming' END AS section, kind, source, target, assurance, lane AS lifecycle
  FROM edges JOIN entries ON source = identity WHERE {_in(SUPPLIER)} AND lane IN ('approved-current', 'draft'))
SELECT * FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY section, lifecycle ORDER BY kind, source, target) <= 25)
UNION ALL SELECT 'outgoing', kind, source, target, assurance, NULL FROM edges WHERE source = '{SUPPLIER[0]}'""",
    "capped_edges_priority": f"WITH {_SUP_EDGES} SELECT supplier, kind, position, priority FROM kept",
    "truncated_families": f"""WITH {_SUP_EDGES}, a AS (SELECT supplier, kind, count(*) AS declared FROM e GROUP BY 1, 2), b AS (SELECT supplier, kind, count(*) AS kept FROM kept GROUP BY 1, 2)
SELECT a.supplier AS supplier, a.kind AS kind, declared, coalesce(kept, 0) AS kept, declared - coalesce(kept, 0) AS dropped FROM a
LEFT JOIN b ON a.supplier = b.supplier AND a.kind = b.kind WHERE declared > coalesce(kept, 0)""",
    "stored_edge_health": """WITH p AS (SELECT *, replace(p_brand, '#', '_') AS brand FROM part),
parts AS (SELECT brand || '__c' AS component, p_type = 'PROMO' AS bare FROM p WHERE p_size > 40
  UNION ALL SELECT brand || '__c', false FROM p WHERE p_size > 20 AND p_size <= 40
  UNION ALL SELECT brand || '__c.' || p_type || '__c', false FROM p WHERE p_size > 20 AND p_size <= 40),
live AS (SELECT DISTINCT lower(brand) || '__c' AS k FROM p WHERE p_retailprice > 1060 UNION SELECT DISTINCT lower(brand || '__c.' || p_type || '__c') FROM p WHERE p_retailprice > 1060
  UNION SELECT DISTINCT lower(p_type) || '__c' FROM p WHERE p_retailprice > 1060),
v AS (SELECT component, CASE WHEN k IS NOT NULL THEN 'fine' WHEN bare THEN 'undecidable' ELSE 'gone' END AS verdict FROM parts LEFT JOIN live ON k = lower(component))
SELECT verdict, 'references-field' AS kind, count(*) AS targets, count(DISTINCT component) AS components FROM v GROUP BY verdict""",
    "evidence_closure": """SELECT s.conv_id || ':' || s.turn AS start, c.conv_id || ':' || c.turn AS id
FROM (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id) s JOIN conversations c ON c.conv_id = s.conv_id AND c.turn <= s.turn""",
    "impact_in": f"""{_R}, names AS (SELECT identity AS node, lower(identity) AS k, identity AS name FROM entries UNION ALL SELECT identity, lower(full_name), full_name FROM entries),
hops AS (SELECT n.node, e.source AS dst, e.kind, false AS own FROM names n JOIN edges e ON e.target_key = n.k WHERE e.assurance = 'source-exact'
  UNION ALL SELECT e.source, coalesce(t.target_identity, e.target), e.kind, true FROM edges e JOIN targets t USING (target_key) WHERE e.kind = 'belongs-to'),
served AS (SELECT h.*, lane FROM hops h LEFT JOIN entries ON dst = identity WHERE lane IS NULL OR lane IN ('approved-current', 'draft')),
l1 AS (SELECT dst AS node, 1 AS hop, lane, CASE WHEN own THEN '^' ELSE '' END || kind || '>' || dst AS path FROM served WHERE node = '{CUSTOMER[0]}' AND dst <> '{CUSTOMER[0]}'),
l2 AS (SELECT s.dst AS node, 2 AS hop, s.lane, l1.path || ' ' || CASE WHEN own THEN '^' ELSE '' END || s.kind || '>' || s.dst AS path FROM served s JOIN l1 ON s.node = l1.node
  WHERE s.dst <> '{CUSTOMER[0]}' AND s.dst NOT IN (SELECT node FROM l1))
SELECT node, hop, lane AS lifecycle, lane IS NOT NULL AS resolved, path, 'source-exact' AS min_assurance FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2)""",
    "impact_out": f"""{_R}, hops AS (SELECT e.source AS node, coalesce(t.target_identity, e.target) AS dst, e.kind, e.assurance FROM edges e JOIN targets t USING (target_key)),
served AS (SELECT h.*, lane FROM hops h LEFT JOIN entries ON dst = identity WHERE lane IS NULL OR lane = 'approved-current'),
l1 AS (SELECT dst AS node, 1 AS hop, lane, kind || '>' || dst AS path, assurance AS a FROM served WHERE node = '{ORDER}'),
l2 AS (SELECT s.dst AS node, 2 AS hop, s.lane, l1.path || ' ' || s.kind || '>' || s.dst AS path, CASE WHEN a = 'source-exact' THEN s.assurance ELSE a END AS a FROM served s JOIN l1 ON s.node = l1.node
  WHERE s.dst <> '{ORDER}' AND s.dst NOT IN (SELECT node FROM l1))
SELECT node, hop, lane AS lifecycle, lane IS NOT NULL AS resolved, path, a AS min_assurance FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2)""",
}
