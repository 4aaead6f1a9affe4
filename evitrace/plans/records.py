"""Registered work-record, requirement, naming and query-gate queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from evitrace.functions import names, text
from evitrace.operators import records
from evitrace.sources import soql
from evitrace.tables import load


def soql_gate(spark, sf):
    """Query texts written from parts and nations, against an allowlist of objects."""
    parts = load(spark, sf, "part")
    query = F.concat(
        F.lit("SELECT Id, (SELECT Id FROM "), F.regexp_replace("p_brand", "#", ""), F.lit(") FROM "), F.col("p_type"),
        F.lit(" WHERE Name = 'x FROM Hidden it\\'s' AND N = "), F.col("p_size").cast("string"), F.when(F.col("p_size") > 45, " ${X}").otherwise(""),
    )
    rows = parts.select("p_partkey", F.when(F.col("p_size") < 3, "SELECT").otherwise(query).alias("query"))
    allowed = ["SMALL", "PROMO", "ECONOMY", *[f"Brand{i}" for i in range(1, 20)]]
    return soql.gate(rows, allowed).select("p_partkey", F.array_join("from_objects", "|").alias("from_objects"), "verdict")


def requirement_items(spark, sf):
    """Customers as items, their orders as children; a child without total lacks detail."""
    customers, orders = load(spark, sf, "customer"), load(spark, sf, "orders")
    items = customers.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("item_id"), F.col("c_nationkey").alias("revision"), F.lit("d").alias("description"), F.lit("").alias("criteria")).unionByName(
        orders.select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("item_id"), F.lit(1).alias("revision"),
                      F.when(F.col("o_totalprice") > 20000, "d").otherwise("").alias("description"), F.when(F.col("o_orderstatus") == "F", "c").alias("criteria")))
    links = orders.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("parent_id"), F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("child_id"))
    return records.requirement(items, links).filter(F.col("item_id").startswith("C"))


def revision_drift(spark, sf):
    """Orders' first line counts as revisions against counts of the lines shipped by 1998."""
    lines = load(spark, sf, "lineitem")
    before = lines.groupBy(F.col("l_orderkey").alias("item_id")).agg(F.count(F.lit(1)).alias("revision"))
    now = lines.filter(F.col("l_shipdate") < F.lit(datetime(1999, 1, 1))).groupBy(F.col("l_orderkey").alias("item_id")).agg(F.count(F.lit(1)).alias("revision"))
    return records.revision_drift(before, now)


def entry_reference_problems(spark, sf):
    """Orders bind their customer as an entry; balances and segments break some bindings."""
    customers, orders = load(spark, sf, "customer"), load(spark, sf, "orders")
    lanes = customers.filter(F.col("c_acctbal") < 9800).select(
        F.col("c_custkey").cast("string").alias("identity"),
        F.when(F.col("c_acctbal") < 0, "approved-drifted").otherwise("approved-current").alias("lane"),
        F.col("c_mktsegment").alias("digest"), F.col("c_nationkey").cast("string").alias("tree"), F.lit("p@1").alias("entry_profile"),
        F.create_map(F.lit("typeFacts"), F.when(F.col("c_acctbal") > 7000, "source-derived-heuristic").otherwise("source-exact")).alias("assurance"),
        F.create_map(F.lit("typeFacts"), F.lit("full")).alias("coverage"),
    )
    bound = orders.join(customers.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey"), "o_custkey")
    references = bound.select(
        F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_custkey").cast("string").alias("entry_id"),
        F.when(F.col("o_orderstatus") == "F", F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("content_digest"),
        F.when(F.col("o_orderpriority") == "5-LOW", "0").otherwise(F.col("c_nationkey").cast("string")).alias("tree_digest"), F.lit("p@1").alias("profile"),
    )
    return records.entry_reference_problems(references, lanes)


def chunk_classes(spark, sf):
    """Documents against the digest their reviewed label stands for."""
    digested = load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("semantics_digest"))
    entries = digested.select(F.col("doc_id").cast("string").alias("identity"), "semantics_digest")
    newest = load(spark, sf, "labels").join(digested, "doc_id").select(
        F.col("doc_id").cast("string").alias("identity"), F.when(F.col("quality") == 1, F.col("semantics_digest")).otherwise("older").alias("ledger_semantics"))
    return records.chunk_classes(entries, newest)


def receipt_freshness(spark, sf):
    events = load(spark, sf, "events")
    problem = records.receipt_problem(F.col("ts"), datetime(2024, 1, 5), 24 * 60, F.col("event_type") != "error", F.col("value") > 1)
    return events.groupBy("event_type", problem.alias("problem")).agg(F.count(F.lit(1)).alias("receipts"))


def verification_outcome(spark, sf):
    events = load(spark, sf, "events")
    outcome = records.verification_outcome(F.col("event_type") == "error", F.col("value"), F.lit(40.0), F.col("user_id"))
    return events.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("runs"))


def compare_and_set(spark, sf):
    """Events as writes on a user's document, each based on a version from its payload."""
    writes = load(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("write_id"), F.get_json_object("props", "$.k").cast("int").alias("based_on"))
    current = load(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("version"))
    return records.compare_and_set(writes, current)


def safe_names(spark, sf):
    """File names of documents called by their texts."""
    docs = load(spark, sf, "documents")
    title = F.when(F.col("source") == "src1", "con-1").when(F.col("source") == "src2", F.col("text")).otherwise(F.concat_ws("_", "lang", F.col("doc_id").cast("string")))
    safe = names.safe_name(title, F.col("doc_id").cast("string"))
    path = F.concat(F.lit("prose/Document/"), "lang", F.lit("/"), safe, F.lit(".md"))
    return docs.select("doc_id", safe.alias("safe_name"), names.identity_of_path(path).alias("proven"))


def turn_summary(spark, sf):
    """First line and word count of every turn, and the line that mentions its second word."""
    turns = load(spark, sf, "conversations")
    needle = F.get(F.split("text", " "), F.lit(1))
    return turns.select("conv_id", "turn", text.word_count(F.col("text")).alias("words"), text.first_line_with(F.col("text"), needle).alias("line"))


QUERIES = {f.__name__: f for f in (
    soql_gate, requirement_items, revision_drift, entry_reference_problems, chunk_classes, receipt_freshness, verification_outcome,
    compare_and_set, safe_names, turn_summary,
)}

_ENC = "list_aggregate(list_transform(string_split({0}, ''), lambda c: CASE WHEN regexp_matches(c, '^[A-Za-z0-9_-]$') THEN c ELSE regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') END), 'string_agg', '')"

ORACLE = {
    "soql_gate": """WITH q AS (SELECT p_partkey, p_size, p_type AS a, replace(p_brand, '#', '') AS b FROM part)
SELECT p_partkey, CASE WHEN p_size < 3 THEN '' WHEN a < b THEN a || '|' || b ELSE b || '|' || a END AS from_objects,
 CASE WHEN p_size < 3 OR p_size > 45 THEN 'QUERY_VALIDATION_DENIED' WHEN a NOT IN ('SMALL', 'PROMO', 'ECONOMY') OR replace(b, 'Brand', '')::INTEGER NOT BETWEEN 1 AND 19
   THEN 'OBJECT_NOT_ALLOWLISTED' ELSE 'OK' END AS verdict FROM q""",
    "requirement_items": """SELECT 'C' || c_custkey AS item_id, c_nationkey AS revision, count(o_orderkey) AS children,
 count(*) FILTER (o_totalprice <= 20000 AND o_orderstatus <> 'F') AS missing_detail,
 CASE WHEN count(*) FILTER (o_totalprice <= 20000 AND o_orderstatus <> 'F') > 0 THEN 'partial' ELSE 'complete' END AS completeness,
 ceil(count(o_orderkey) / 100)::BIGINT AS batches FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey""",
    "revision_drift": """WITH b AS (SELECT l_orderkey AS item_id, count(*) AS revision, nullif(count(*) FILTER (l_shipdate < TIMESTAMP '1999-01-01'), 0) AS now FROM lineitem GROUP BY 1)
SELECT item_id, revision, now, CASE WHEN now IS NULL THEN 'gone' ELSE 'moved' END AS state FROM b WHERE now IS NULL OR now <> revision""",
    "entry_reference_problems": """WITH r AS (SELECT o_orderkey::VARCHAR AS record_id, o_custkey::VARCHAR AS entry_id, o_orderstatus, o_orderpriority, c_nationkey, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT record_id, entry_id, CASE WHEN c_acctbal >= 9800 THEN 'missing' WHEN o_orderstatus = 'F' THEN 'digest differs' WHEN o_orderpriority = '5-LOW' AND c_nationkey <> 0 THEN 'scope or profile differs'
  WHEN c_acctbal < 0 THEN 'lane not accepted' WHEN c_acctbal > 7000 THEN 'section not groundable' END AS problem FROM r)
SELECT * FROM p WHERE problem IS NOT NULL""",
    "chunk_classes": """SELECT d.doc_id::VARCHAR AS identity, CASE WHEN quality = 1 THEN 'facts-only' ELSE 'prose' END AS change FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "receipt_freshness": """SELECT event_type, CASE WHEN event_type = 'error' OR value <= 1 THEN 'not a verified receipt'
 WHEN floor(epoch(ts)) > epoch(TIMESTAMP '2024-01-05') OR epoch(TIMESTAMP '2024-01-05') - floor(epoch(ts)) > 86400 THEN 'not fresh' END AS problem, count(*) AS receipts FROM events GROUP BY 1, 2""",
    "verification_outcome": """SELECT CASE WHEN event_type = 'error' THEN 'timed-out' WHEN value > 40 THEN 'output-limit-exceeded' WHEN user_id = 0 THEN 'passed' ELSE 'failed' END AS outcome, count(*) AS runs FROM events GROUP BY 1""",
    "compare_and_set": """WITH w AS (SELECT user_id AS doc_id, event_id AS write_id, json_extract_string(props, '$.k')::INTEGER = coalesce(c_nationkey, 0) AS fits FROM events LEFT JOIN customer ON user_id = c_custkey),
f AS (SELECT doc_id, min(write_id) AS winner FROM w WHERE fits GROUP BY 1)
SELECT w.doc_id AS doc_id, write_id, CASE WHEN fits AND write_id = winner THEN 'accepted' ELSE 'stale' END AS outcome FROM w LEFT JOIN f ON f.doc_id = w.doc_id""",
    "safe_names": f"""WITH t AS (SELECT doc_id, lang, CASE source WHEN 'src1' THEN 'con-1' WHEN 'src2' THEN text ELSE lang || '_' || doc_id END AS title FROM documents),
e AS (SELECT *, {_ENC.format('title')} AS enc, substr(sha256('"' || doc_id || '"'), 1, 8) AS mark FROM t),
s AS (SELECT *, CASE WHEN length(enc) > 100 THEN regexp_replace(left(enc, 100), '%[0-9A-F]?$', '') || '-' || mark ELSE enc END AS stem FROM e),
n AS (SELECT doc_id, lang, CASE WHEN upper(split_part(stem, '-', 1)) IN ('CON', 'PRN', 'AUX', 'NUL') THEN stem || '-' || mark ELSE stem END AS name FROM s)
SELECT doc_id, name AS safe_name, CASE WHEN regexp_matches(name, '^[A-Za-z0-9_-]{{1,100}}$') AND upper(split_part(name, '-', 1)) NOT IN ('CON', 'PRN', 'AUX', 'NUL') THEN 'Document:' || lang || ':' || name END AS proven FROM n""",
    "turn_summary": """WITH t AS (SELECT conv_id, turn, text, string_split_regex(text, '\\r\\n|\\n|\\r') AS ls, string_split(text, ' ')[2] AS w FROM conversations)
SELECT conv_id, turn, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'))::INTEGER AS words, list_position(list_transform(ls, lambda x: contains(x, w)), true)::INTEGER AS line FROM t""",
}
