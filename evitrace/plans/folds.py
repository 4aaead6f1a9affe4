"""Registered queries of operation batches, ledger anomalies, expiry streams and relaxed requests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evitrace.operators import batches, features, relax
from evitrace.operators.search import Request
from evitrace.plans import sql
from evitrace.plans.corpus import corpus
from evitrace.session import require_checkpoint_dir, ship_package
from evitrace.streaming import expiry, numbering
from evitrace.tables import load

#: Events as operations on feature documents, one feature with most of them. Nodes are named by the
#: stretch of events, relations and claims refer to nodes of theirs or of stretches before.
_LOG = {
    "slug": "CASE WHEN user_id % 3 <> 0 THEN 'F' ELSE concat('F', CAST(user_id % 10 AS {text})) END",
    "batch": "CASE WHEN event_id % 1000 < 60 THEN event_id - event_id % 1000 ELSE event_id - event_id % 3 END",
    "position": "event_id",
    "kind": """CASE WHEN k = 11 THEN 'section' WHEN k = 13 THEN 'meta' WHEN event_type IN ('signup', 'view') THEN 'node'
        WHEN event_type = 'click' THEN 'relation' WHEN event_type = 'purchase' OR value >= 20 THEN 'claim' ELSE 'node' END""",
    "op": """CASE WHEN k = 11 THEN 'replace' WHEN k = 13 THEN CASE WHEN event_type = 'view' THEN 'resolve-question' ELSE 'add-question' END
        WHEN event_type <> 'error' THEN 'set' WHEN value < 20 OR k = 7 THEN 'remove' ELSE 'withdraw' END""",
    "id": """CASE WHEN k = 11 THEN CASE WHEN event_type = 'error' THEN 'Preface' ELSE 'Automation' END
        WHEN k = 13 THEN concat('FQ-', CAST(event_id // 500 AS {text}))
        WHEN event_type IN ('signup', 'view') THEN concat('FN-', CAST(event_id // 64 - k % 4 AS {text}))
        WHEN event_type = 'click' THEN concat('FR-', CAST(event_id // 32 - k % 2 AS {text}))
        WHEN event_type = 'purchase' THEN concat('FC-', CAST(event_id // 32 - k % 3 AS {text}))
        WHEN value < 20 THEN concat('FN-', CAST(event_id // 64 - k % 8 AS {text}))
        ELSE concat('FC-', CAST(event_id // 32 - k % 5 AS {text})) END""",
    "refs": """CASE WHEN k IN (11, 13) THEN {empty}
        WHEN event_type = 'click' THEN {array}(concat('FN-', CAST(event_id // 64 - k % 4 AS {text})), concat('FN-', CAST(event_id // 64 - k % 3 AS {text})))
        WHEN event_type = 'purchase' THEN {array}(concat('FN-', CAST(event_id // 64 - k % 2 AS {text}))) ELSE {empty} END""",
}


def _log(spark, sf):
    events = load(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    spell = {"text": "STRING", "array": "array", "empty": "CAST(array() AS ARRAY<STRING>)"}
    return events.select(*[
        F.expr(text.format(**spell).replace("//", " DIV ")).alias(name) for name, text in _LOG.items()
    ])


def feature_batches(spark, sf):
    """Verdict of every batch of operations, version and state of its feature after it."""
    return batches.decide_batches(_log(spark, sf))


def feature_batch_state(spark, sf):
    """Items that the accepted batches leave, per feature and kind."""
    log = _log(spark, sf)
    taken = batches.accepted_operations(log, batches.decide_batches(log))
    items = taken.filter(F.col("kind").isin("node", "relation", "claim")).select(
        "slug", "kind", "id", "op", F.col("refs").alias("payload"), F.col("position").alias("sequence"))
    return features.apply_operations(items).groupBy("slug", "kind").agg(
        F.count_if(~F.col("tombstoned")).alias("live"), F.count_if("tombstoned").alias("removed"))


#: Events as numbers of two ledgers, one with three quarters of them: numbers come in three waves,
#: some a wave late, some twice; those of half of the errors never come.
_NUMBERS = """SELECT CASE WHEN event_id % 4 = 3 THEN 'small' ELSE 'large' END AS ledger,
  CASE WHEN event_id % 4 = 3 THEN event_id // 4 ELSE event_id // 4 * 3 + event_id % 4 END AS number,
  CASE WHEN event_id % 1000 < 400 THEN 0 WHEN event_id % 1000 < 700 THEN 1 ELSE 2 END + CASE WHEN k < 10 THEN 1 ELSE 0 END + again AS wave
FROM {events} WHERE (again = 0 OR k = 5 OR k = 50) AND NOT (event_type = 'error' AND k >= 50)"""


def ledger_anomalies(spark, sf):
    """Gaps, late numbers and replays of two ledgers, found by a stream in two runs of one state."""
    ship_package(spark)
    events = load(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    twice = events.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    records = spark.sql(_NUMBERS.format(events="{t}").replace("//", " DIV "), t=twice)
    base = f"{require_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    for run in ("wave < 2", "wave >= 2"):
        records.filter(run).write.mode("append").parquet(f"{base}/records")
        arrived = spark.readStream.schema(records.schema).parquet(f"{base}/records")
        with numbering.keyed_state(spark):
            stream = numbering.anomalies(arrived, start=0).writeStream.format("parquet").option("path", f"{base}/found")
            stream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(numbering.ANOMALIES).parquet(f"{base}/found")


def _expiries(spark, records, **options):
    """The newest status of every block after two runs of one stream, the second with the later half of the time."""
    base = f"{require_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    for run in ("at < TIMESTAMP '2024-01-16'", "at >= TIMESTAMP '2024-01-16'"):
        records.filter(run).write.mode("append").parquet(f"{base}/records")
        arrived = spark.readStream.schema(records.schema).parquet(f"{base}/records")
        with numbering.keyed_state(spark):
            changes = expiry.expiry_stream(arrived, **options)
            stream = changes.writeStream.format("parquet").option("path", f"{base}/changes").option("checkpointLocation", f"{base}/state")
            stream.trigger(availableNow=True).start().awaitTermination()
    return expiry.current_blocks(spark.read.schema(changes.schema).parquet(f"{base}/changes"))


def org_expiry_stream(spark, sf):
    """Events as observations that last one to six days, errors as policies of one to three days."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    error = F.col("event_type") == "error"
    return _expiries(spark, load(spark, sf, "events").select(
        F.col("event_type").alias("org_key"), F.col("user_id").cast("string").alias("identity"), F.col("ts").cast("timestamp").alias("at"),
        (F.col("ts") + F.make_dt_interval(days=(1 + k % 6).cast("int"))).cast("timestamp").alias("expires_at"),
        F.when(error, 1 + k % 5 / 2).alias("max_age_days"),
    ))


def result_cache(spark, sf):
    """Events as results kept for 24 hours since they were last stored; those over leave the state."""
    return _expiries(spark, load(spark, sf, "events").select(
        F.col("event_type").alias("org_key"), F.col("user_id").cast("string").alias("identity"), F.col("ts").cast("timestamp").alias("at"),
        F.lit(None).cast("timestamp").alias("expires_at"), F.lit(None).cast("double").alias("max_age_days"),
    ), max_age_days=1, forget=True)


#: Two facets that no entry satisfies both, and three filters that some fail.
_STRICT = Request(
    metadata_type="document", namespace="en",
    facets=["family:prefix=src1", "document.length:lte=400", "document.length:gte=1500"],
)


def relaxations(spark, sf):
    """What a request without an answer would serve if up to three of its filters were dropped."""
    return relax.relaxations(corpus(spark, sf), _STRICT, most=3)


QUERIES = {f.__name__: f for f in (feature_batches, feature_batch_state, ledger_anomalies, org_expiry_stream, result_cache, relaxations)}

_COLUMNS = ", ".join(
    f"{text.format(text='VARCHAR', array='list_value', empty='[]::VARCHAR[]')} AS {name}" for name, text in _LOG.items()
)
# One operation a step, of all features at once; the state before a batch is kept beside the one in work.
_BATCHES = f"""WITH RECURSIVE l AS (SELECT {_COLUMNS} FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY position) AS n, count(*) OVER (PARTITION BY slug, batch) AS size,
  row_number() OVER (PARTITION BY slug, batch ORDER BY position) AS i FROM l),
f AS (SELECT DISTINCT slug, 0::BIGINT AS n, NULL::BIGINT AS batch, 0::BIGINT AS size, false AS last, NULL::VARCHAR AS reason, 0::BIGINT AS version,
    []::STRUCT(id VARCHAR, refs VARCHAR[])[] AS kept, []::VARCHAR[] AS kept_dead, []::STRUCT(id VARCHAR, refs VARCHAR[])[] AS work, []::VARCHAR[] AS dead FROM o
  UNION ALL
  SELECT slug, n, batch, size, last, reason, version + CASE WHEN last AND reason IS NULL THEN 1 ELSE 0 END,
    CASE WHEN last AND reason IS NULL THEN work ELSE kept END, CASE WHEN last AND reason IS NULL THEN dead ELSE kept_dead END,
    CASE WHEN last AND reason IS NOT NULL THEN kept ELSE work END, CASE WHEN last AND reason IS NOT NULL THEN kept_dead ELSE dead END
  FROM (SELECT * REPLACE (CASE WHEN size > 40 THEN 'more than 40 operations' WHEN reason IS NOT NULL THEN reason
      WHEN last AND NOT list_has_all(list_transform(work, lambda x: x.id), flatten(list_transform(work, lambda x: x.refs))) THEN 'broken reference' END AS reason)
  FROM (SELECT slug, n, batch, size, last, reason, version, kept, kept_dead,
      CASE WHEN reason IS NOT NULL OR kind = 'section' OR op = 'resolve-question' THEN work
        WHEN op IN ('remove', 'withdraw') THEN list_filter(work, lambda x: x.id <> id)
        ELSE list_append(list_filter(work, lambda x: x.id <> id), {{'id': id, 'refs': refs}}) END AS work,
      CASE WHEN reason IS NULL AND op IN ('remove', 'withdraw') THEN list_append(dead, id) ELSE dead END AS dead
  FROM (SELECT * REPLACE (CASE WHEN i > 1 AND reason IS NOT NULL THEN reason
      WHEN kind = 'claim' AND op = 'remove' THEN 'unknown operation' WHEN kind = 'section' THEN CASE WHEN id = 'Preface' THEN 'unknown section' END
      WHEN kind = 'node' AND op = 'withdraw' THEN 'unknown operation'
      WHEN op = 'add-question' THEN CASE WHEN held THEN 'id already used' END
      WHEN op = 'set' THEN CASE WHEN list_contains(dead, id) THEN 'tombstoned' END
      WHEN NOT held THEN 'not live' END AS reason)
  FROM (SELECT o.slug, o.n, o.batch, o.size, o.i, o.kind, o.op, o.id, o.refs, o.i = o.size AS last, f.reason, f.version, f.kept, f.kept_dead, f.work, f.dead,
      list_contains(list_transform(f.work, lambda x: x.id), o.id) AS held FROM f JOIN o ON o.slug = f.slug AND o.n = f.n + 1)))))"""

_EVENTS = """(SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events CROSS JOIN (VALUES (0), (1)) t(again))"""

_STAGES = ("lifecycle", "metadataType", "scope", *(f"facet:{f}" for f in _STRICT.facets))

# Blocks b(org_key, identity, observed_at, expires_at) at the newest instant, in whole milliseconds.
_EXPIRED = """SELECT org_key, identity, observed_at, CASE WHEN expires_at <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)
  THEN 'org-expired' ELSE 'org-fresh' END AS status, expires_at FROM b"""

ORACLE = {
    "org_expiry_stream": """WITH e AS (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
p AS (SELECT (1 + k % 5 / 2) * INTERVAL 1 DAY AS age FROM e WHERE event_type = 'error' ORDER BY ts DESC, k % 5 LIMIT 1),
o AS (SELECT event_type AS org_key, user_id::VARCHAR AS identity, ts AS observed_at, max(ts + (1 + k % 6) * INTERVAL 1 DAY) AS until
  FROM e WHERE event_type <> 'error' GROUP BY event_type, user_id, ts QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC) = 1),
b AS (SELECT org_key, identity, observed_at, least(until, observed_at + age) AS expires_at FROM o CROSS JOIN p) """ + _EXPIRED,
    "result_cache": """WITH b AS (SELECT event_type AS org_key, user_id::VARCHAR AS identity, max(ts) AS observed_at, max(ts) + INTERVAL 1 DAY AS expires_at
  FROM events GROUP BY ALL) """ + _EXPIRED,
    "relaxations": f"""WITH {sql.ENTRIES},
b AS (SELECT CASE WHEN lane = 'approved-current' THEN 0 ELSE 1 END | CASE WHEN lower(metadata_type) = 'document' THEN 0 ELSE 2 END
  | CASE WHEN namespace = 'en' THEN 0 ELSE 4 END | CASE WHEN starts_with(family, 'src1') THEN 0 ELSE 8 END
  | CASE WHEN n_chars <= 400 THEN 0 ELSE 16 END | CASE WHEN n_chars >= 1500 THEN 0 ELSE 32 END AS bits FROM entries),
s AS (SELECT m, (SELECT count(*) FROM b WHERE (bits & m) = bits) AS served FROM range({1 << len(_STAGES)}) t(m) WHERE bit_count(m) <= 3)
SELECT array_to_string(list_filter({list(_STAGES)}, lambda x, i: (m >> (i - 1)) & 1 = 1), ' + ') AS dropped, bit_count(m)::INTEGER AS filters, served,
  NOT EXISTS (SELECT 1 FROM s x WHERE (x.m & s.m) = x.m AND bit_count(x.m) = bit_count(s.m) - 1 AND x.served >= s.served) AS needed FROM s""",
    "ledger_anomalies": f"""WITH r AS ({_NUMBERS.format(events=_EVENTS)}),
c AS (SELECT ledger, wave, number, count(*) AS c FROM r GROUP BY ALL),
w AS (SELECT ledger, wave, max(max(number)) OVER (PARTITION BY ledger ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM c GROUP BY 1, 2),
s AS (SELECT c.*, coalesce(top, -1) AS top, min(wave) OVER (PARTITION BY ledger, number) < wave AS seen FROM c JOIN w USING (ledger, wave)),
g AS (SELECT ledger, wave, coalesce(lag(number) OVER (PARTITION BY ledger, wave ORDER BY number), top) + 1 AS low, number - 1 AS high FROM s WHERE number > top),
p AS (SELECT ledger, wave, number, 'replay' AS kind, c - CASE WHEN seen THEN 0 ELSE 1 END AS copies FROM s UNION ALL
  SELECT ledger, wave, number, 'late', 1 FROM s WHERE NOT seen AND number <= top),
i AS (SELECT *, number - row_number() OVER (PARTITION BY ledger, wave, kind, copies ORDER BY number) AS island FROM p WHERE copies > 0)
SELECT ledger, wave::BIGINT AS wave, kind, min(number) AS low, max(number) AS high, copies::BIGINT AS copies FROM i GROUP BY ledger, wave, kind, copies, island
UNION ALL SELECT ledger, wave::BIGINT, 'gap', low, high, 0::BIGINT FROM g WHERE low <= high""",
    "feature_batches": f"""{_BATCHES}
SELECT slug, batch, size AS operations, reason IS NULL AS accepted, reason, version, 'draft' AS state FROM f WHERE last""",
    "feature_batch_state": f"""{_BATCHES},
t AS (SELECT slug, kept, kept_dead FROM f QUALIFY row_number() OVER (PARTITION BY slug ORDER BY n DESC) = 1),
i AS (SELECT slug, unnest(list_transform(kept, lambda x: x.id)) AS id, true AS live FROM t UNION ALL SELECT slug, unnest(kept_dead), false FROM t)
SELECT slug, CASE left(id, 2) WHEN 'FN' THEN 'node' WHEN 'FR' THEN 'relation' ELSE 'claim' END AS kind, count(*) FILTER (live) AS live, count(*) FILTER (NOT live) AS removed
FROM i WHERE left(id, 2) <> 'FQ' GROUP BY 1, 2""",
}
