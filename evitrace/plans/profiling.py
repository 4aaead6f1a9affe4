"""Registered profiling and probe queries over the star and the event log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from evitrace.operators import probe, profile
from evitrace.tables import load

AT = datetime(1998, 6, 1)
EVENTS_AT = datetime(2024, 1, 20)


def _iso(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"))
    return df


def profile_baseline(spark, sf):
    return _iso(profile.object_baseline(load(spark, sf, "lineitem"), ["l_shipdate"]), "earliest", "latest")


def _customers(spark, sf):
    """Customers with blanks where a balance is negative, so that fills differ."""
    return load(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_name")).otherwise("").alias("c_name"),
        F.when(F.col("c_acctbal") >= 1000, F.col("c_nationkey")).alias("c_nationkey"),
        F.col("c_acctbal"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("c_mktsegment"),
        F.when(F.col("c_acctbal") > 5000, F.array("c_mktsegment")).otherwise(F.array().cast("array<string>")).alias("tags"),
    )


def profile_fill(spark, sf):
    df = _customers(spark, sf)
    return profile.field_fill(df, df.columns)


def profile_cardinality(spark, sf):
    return profile.field_cardinality(_customers(spark, sf), "c_name")


def profile_distribution(spark, sf):
    return profile.categorical_distribution(load(spark, sf, "part"), "p_name")


def profile_key(spark, sf):
    return profile.key_integrity(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def profile_relationship(spark, sf):
    return profile.relationship_shape(load(spark, sf, "orders"), "o_custkey")


def profile_effectivity(spark, sf):
    orders = load(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("starts"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate") + F.make_dt_interval(days=F.lit(30))).alias("ends"),
    )
    return profile.config_effectivity(orders, "starts", "ends", AT)


def profile_shape(spark, sf):
    """Structural shapes of the events, with their instants as text."""
    events = load(spark, sf, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id", "event_type",
        F.when(F.col("value") > 1, F.col("value")).alias("value"), "props",
        F.concat("event_type", F.lit("@example.org")).alias("mail"),
        F.lpad(F.col("event_id").cast("string"), 15, "a").alias("ref"),
        (F.col("value") > 10).alias("big"),
    )
    return profile.sample_shape(events).drop("rank")


def profile_churn(spark, sf):
    events = load(spark, sf, "events").select("ts", (F.col("ts") + F.make_dt_interval(hours=F.col("user_id").cast("int"))).alias("modified"))
    return profile.churn_profile(events, "ts", "modified", 90, datetime(2024, 4, 10))


def profile_collision(spark, sf):
    return profile.precedence_collision(load(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], "o_orderdate")


def safe_snapshot(spark, sf):
    customers = load(spark, sf, "customer").select(
        "c_custkey", F.col("c_name").alias("card_holder"), "c_nationkey",
        F.when(F.col("c_mktsegment") == "BUILDING", F.lpad(F.col("c_custkey").cast("string"), 18, "0")).otherwise(F.col("c_mktsegment")).alias("segment"),
        F.lit("x").alias("OwnerId"),
    )
    return profile.safe_snapshot(customers, ["c_custkey", "card_holder", "c_nationkey", "segment", "OwnerId"])


def safe_snapshot_withheld(spark, sf):
    return profile.withheld_counts(safe_snapshot(spark, sf))


def probe_object_shape(spark, sf):
    return probe.object_shape(load(spark, sf, "events"), "ts")


def probe_distribution_suppressed(spark, sf):
    orders = load(spark, sf, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("k"))
    return probe.distribution(orders, "k", floor=8)


def probe_fill(spark, sf):
    return probe.field_fill(_customers(spark, sf), ["c_mktsegment", "c_nationkey", "c_acctbal"])


def probe_cardinality(spark, sf):
    return probe.field_cardinality(load(spark, sf, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


def probe_lookup(spark, sf):
    return probe.lookup_shape(_customers(spark, sf), {"c_nationkey": "Nation", "c_mktsegment": "Segment"})


def probe_recency(spark, sf):
    return probe.recency_window(load(spark, sf, "events"), "ts", 7, EVENTS_AT, declared=7)


def _sample(spark, sf):
    """The 25 newest orders with their customer as a nested record."""
    orders = load(spark, sf, "orders")
    newest = orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25)
    customer = load(spark, sf, "customer")
    joined = newest.join(customer, newest["o_custkey"] == customer["c_custkey"], "left")
    parent = F.struct(
        F.struct(F.when(F.col("c_acctbal") > 5000, "Account").otherwise("Contact").alias("type")).alias("attributes"),
        F.col("c_name").alias("Name"), F.when(F.col("c_acctbal") > 2000, F.col("c_mktsegment")).alias("Segment"),
    )
    return joined.select(
        F.struct(F.lit("Order").alias("type")).alias("attributes"),
        F.col("o_orderkey").alias("Number"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("Status"),
        F.when(F.col("c_acctbal") > 0, parent).alias("Owner"),
    )


def probe_sample(spark, sf):
    return probe.record_sample(_sample(spark, sf))


def probe_structure(spark, sf):
    return probe.record_structure(_sample(spark, sf))


QUERIES = {f.__name__: f for f in (
    profile_baseline, profile_fill, profile_cardinality, profile_distribution, profile_key,
    profile_relationship, profile_effectivity, profile_shape, profile_churn, profile_collision,
    safe_snapshot, safe_snapshot_withheld, probe_object_shape, probe_distribution_suppressed,
    probe_fill, probe_cardinality, probe_lookup, probe_recency, probe_sample, probe_structure,
)}

_CUST = """c AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_name ELSE '' END AS c_name,
  CASE WHEN c_acctbal >= 1000 THEN c_nationkey END AS c_nationkey, c_acctbal,
  nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, c_acctbal > 5000 AS tagged FROM customer)"""
_SAMPLE = """s AS (SELECT * FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25) o
  LEFT JOIN customer ON o_custkey = c_custkey)"""
_TS = "strftime({}, '%Y-%m-%dT%H:%M:%S')"


def _shape(col, expr):
    return f"SELECT '{col}' AS field, {expr} AS shape FROM events"


_TEXT_SHAPE = """CASE WHEN {0} IS NULL THEN 'null' WHEN regexp_matches({0}, '^[a-zA-Z0-9]{{15}}([a-zA-Z0-9]{{3}})?$') THEN 'salesforce-id'
 WHEN regexp_matches({0}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T') THEN 'datetime' WHEN regexp_matches({0}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN 'date'
 WHEN contains({0}, '@') AND contains({0}, '.') THEN 'email-like' ELSE 'text[' || length({0}) || ']' END"""
_MASK = "CASE WHEN {0} IS NULL THEN NULL ELSE 'sensitive-field sha256:' || sha256('\"' || {0} || '\"') END"

ORACLE = {
    "profile_baseline": f"SELECT count(*) AS observed_rows, {_TS.format('min(l_shipdate)')} AS earliest, {_TS.format('max(l_shipdate)')} AS latest FROM lineitem",
    "profile_fill": f"""WITH {_CUST} SELECT f AS field, n AS filled, t AS total FROM (
 SELECT 'c_custkey' AS f, count(c_custkey) AS n, count(*) AS t FROM c UNION ALL SELECT 'c_name', count(nullif(c_name, '')), count(*) FROM c
 UNION ALL SELECT 'c_nationkey', count(c_nationkey), count(*) FROM c UNION ALL SELECT 'c_acctbal', count(c_acctbal), count(*) FROM c
 UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), count(*) FROM c UNION ALL SELECT 'tags', count(*) FILTER (tagged), count(*) FROM c)""",
    "profile_cardinality": f"WITH {_CUST} SELECT 'c_name' AS field, count(DISTINCT nullif(c_name, '')) AS distinct_values, count(nullif(c_name, '')) AS total, count(*) - count(nullif(c_name, '')) AS null_or_empty FROM c",
    "profile_distribution": """WITH g AS (SELECT CASE WHEN p_name IS NULL OR p_name = '' THEN '«null»' ELSE left(p_name, 120) END AS value, count(*) AS count FROM part GROUP BY 1)
SELECT value, count, (SELECT count(*) FROM g) AS distinct_observed, (SELECT count(*) FROM g) > 50 AS truncated FROM g ORDER BY count DESC, value LIMIT 50""",
    "profile_key": """WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL), 0)::BIGINT AS missing_key,
 count(*) FILTER (l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL) AS distinct_keys,
 count(*) FILTER (n > 1) AS duplicate_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_rows FROM g""",
    "profile_relationship": """WITH g AS (SELECT count(*) AS n FROM orders WHERE o_custkey <> 0 GROUP BY o_custkey), l AS (SELECT list(n ORDER BY n) AS c FROM g)
SELECT (SELECT count(*) FROM orders WHERE o_custkey <> 0) AS filled, (SELECT count(*) FROM orders) AS total, len(c)::BIGINT AS distinct_parents,
 c[1] AS fan_out_min, c[len(c)] AS fan_out_max, c[len(c) // 2 + 1] AS fan_out_median FROM l""",
    "profile_effectivity": """WITH o AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS s,
  CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate + INTERVAL 30 DAY END AS e FROM orders),
w AS (SELECT coalesce(s, TIMESTAMP '0001-01-01') AS low, coalesce(e, TIMESTAMP '9999-12-31') AS high FROM o WHERE s IS NOT NULL OR e IS NOT NULL),
a AS (SELECT low, lag(high) OVER (ORDER BY low, high) AS before FROM w)
SELECT count(*) FILTER (low <= TIMESTAMP '1998-06-01' AND high >= TIMESTAMP '1998-06-01') AS active,
 count(*) FILTER (low > TIMESTAMP '1998-06-01') AS future, count(*) FILTER (low <= TIMESTAMP '1998-06-01' AND high < TIMESTAMP '1998-06-01') AS expired,
 (SELECT count(*) FROM o WHERE s IS NULL AND e IS NULL) AS unbounded, (SELECT count(*) FROM a WHERE low <= before) AS overlapping_windows FROM w""",
    "profile_shape": "WITH s AS (" + " UNION ALL ".join((
        _shape("event_id", "'number'"), _shape("ts", "'datetime'"), _shape("day", "'date'"), _shape("user_id", "'number'"),
        _shape("event_type", _TEXT_SHAPE.format("event_type")), _shape("value", "CASE WHEN value > 1 THEN 'number' ELSE 'null' END"),
        _shape("props", _TEXT_SHAPE.format("props")), _shape("mail", "'email-like'"), _shape("ref", "'salesforce-id'"),
        _shape("big", "CASE WHEN value IS NULL THEN 'null' ELSE 'boolean' END"),
    )) + """), g AS (SELECT field, shape, count(*) AS count FROM s GROUP BY field, shape)
SELECT field, shape, count FROM g QUALIFY row_number() OVER (PARTITION BY field ORDER BY count DESC, shape) <= 20""",
    "profile_churn": """SELECT count(*) AS observed_rows, count(*) FILTER (ts >= TIMESTAMP '2024-01-11') AS created_in_window,
 count(*) FILTER (ts + to_hours(user_id) >= TIMESTAMP '2024-01-11') AS modified_in_window, 90 AS window_days FROM events""",
    "profile_collision": """WITH g AS (SELECT count(*) AS n, count(DISTINCT o_orderdate) AS d FROM orders GROUP BY o_custkey, o_orderpriority)
SELECT count(*) AS groups, count(*) FILTER (n > 1) AS colliding_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS colliding_rows,
 count(*) FILTER (n > 1 AND d < n) AS undecidable_groups FROM g""",
    "safe_snapshot": f"""SELECT c_custkey::VARCHAR AS c_custkey, {_MASK.format('c_name')} AS card_holder, c_nationkey::VARCHAR AS c_nationkey,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'salesforce-id sha256:' || sha256('"' || lpad(c_custkey::VARCHAR, 18, '0') || '"') ELSE c_mktsegment END AS segment FROM customer""",
    "safe_snapshot_withheld": """SELECT 'c_custkey' AS field, 0::BIGINT AS withheld UNION ALL SELECT 'card_holder', count(c_name) FROM customer
UNION ALL SELECT 'c_nationkey', 0 UNION ALL SELECT 'segment', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'""",
    "probe_object_shape": f"""SELECT count(*) AS record_count, {_TS.format('min(ts)')} || 'Z' AS created_first, {_TS.format('max(ts)')} || 'Z' AS created_last,
 {_TS.format('max(ts)')} || 'Z' AS last_modified_max FROM events""",
    "probe_distribution_suppressed": """WITH g AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT * FROM (SELECT coalesce(left(k::VARCHAR, 80), '(null)') AS key, n AS record_count, 1::BIGINT AS groups FROM g WHERE n >= 8)
UNION ALL SELECT NULL, sum(n)::BIGINT, count(*) FROM g WHERE n < 8 HAVING count(*) > 0""",
    "probe_fill": f"""WITH {_CUST} SELECT 'c_mktsegment' AS field, count(c_mktsegment) AS filled_count, count(*) AS total_count FROM c
UNION ALL SELECT 'c_nationkey', count(c_nationkey), count(*) FROM c UNION ALL SELECT 'c_acctbal', count(c_acctbal), count(*) FROM c""",
    "probe_cardinality": """SELECT 'o_custkey' AS field, count(DISTINCT o_custkey) AS distinct_count, count(*) AS total_count FROM orders
UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus), count(*) FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), count(*) FROM orders""",
    "probe_lookup": f"""WITH {_CUST} SELECT 'c_mktsegment' AS field, count(c_mktsegment) AS filled_count, count(*) AS total_count, 'Segment' AS target_object FROM c
UNION ALL SELECT 'c_nationkey', count(c_nationkey), count(*), 'Nation' FROM c""",
    "probe_recency": "SELECT 7 AS window_days, count(*) AS record_count FROM events WHERE ts >= TIMESTAMP '2024-01-13' AND ts <= TIMESTAMP '2024-01-20'",
    "probe_sample": f"""WITH {_SAMPLE} SELECT 'Number' AS field, count(o_orderkey) AS populated_count, count(*) AS sample_size FROM s
UNION ALL SELECT 'Owner.Name', count(c_name) FILTER (c_acctbal > 0), count(*) FROM s
UNION ALL SELECT 'Owner.Segment', count(c_mktsegment) FILTER (c_acctbal > 2000), count(*) FROM s
UNION ALL SELECT 'Status', count(*) FILTER (o_orderstatus <> 'P'), count(*) FROM s""",
    "probe_structure": f"""WITH {_SAMPLE}, t AS (SELECT list_sort(list(DISTINCT CASE WHEN c_acctbal > 5000 THEN 'Account' ELSE 'Contact' END) FILTER (c_acctbal > 0)) AS k,
 count(*) FILTER (c_acctbal > 0) AS p, count(*) AS n FROM s)
SELECT 'Owner' AS path, k[1] AS target_object, p AS populated, n AS sample_size, k[2] AS polymorphic_type FROM t""",
}
