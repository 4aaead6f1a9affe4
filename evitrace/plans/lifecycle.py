"""Registered ledger, lane, coverage, citation, observation and workflow queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from evitrace.operators import coverage, lanes, ledger, ordered
from evitrace.plans import sql
from evitrace.plans.corpus import entries, identity_of
from evitrace.tables import load
from evitrace.vocab import CURRENT_LANE, LANES, PROTECTED_STATUSES, TRANSITIONS

AT = datetime(2024, 1, 25)
ISO = "yyyy-MM-dd'T'HH:mm:ss"


def _event_ledger(spark, sf):
    return load(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("identity"), F.col("event_id").alias("sequence"),
        F.col("event_type").alias("action"), F.date_format("ts", ISO).alias("reviewed_at"), "props", "value",
    )


def ledger_latest(spark, sf):
    return ledger.latest(_event_ledger(spark, sf))


def ledger_gaps(spark, sf):
    """Breaks in the numbering once the error records are taken out."""
    kept = _event_ledger(spark, sf).filter(F.col("action") != "error")
    return ledger.gaps(kept).drop("copies")


def current_approval(spark, sf):
    """The newest purchase of at least ten per user."""
    held = (F.col("action") == "purchase") & (F.col("value") >= 10)
    return ledger.newest_matching(_event_ledger(spark, sf), held).select("identity", "sequence", "value")


# --- lanes -------------------------------------------------------------------------------


def _lane_inputs(spark, sf):
    """Documents with a label as approved entries, and a ledger that breaks some of them."""
    # Texts are digested before the join, which then moves narrow rows only.
    digested = load(spark, sf, "documents").select(
        identity_of().alias("identity"), "source", "lang", "n_chars", "doc_id", F.sha2("text", 256).alias("content"),
        F.sha2(F.concat("text", F.lit("!")), 256).alias("altered"),
    )
    document = digested.join(load(spark, sf, "labels"), "doc_id", "left")
    inputs = document.select(
        "identity",
        (~((F.col("source") == "src3") & (F.col("lang") == "es"))).alias("path_ok"),
        F.when(F.col("quality").isNull(), "draft").otherwise("approved").alias("state"),
        F.when(F.col("n_chars") < 60, 1).otherwise(0).alias("problems"),
        F.col("content").alias("content_digest"),
        F.when(F.col("source") == "src5", F.col("altered")).otherwise(F.col("content")).alias("approved_digest"),
        F.lit("r1").alias("reviewed_by"), F.lit("2024-01-01").alias("reviewed_at"),
        F.when(F.col("source") == "src9", "bulk").otherwise("single").alias("mechanism"),
        (F.col("quality") == 1).alias("fragments_current"),
    )
    approvals = document.filter(F.col("quality").isNotNull() & (F.col("source") != "src19")).select(
        "identity", (F.col("doc_id") * 2).alias("sequence"), F.lit("approve").alias("action"),
        F.when(F.col("source") == "src7", F.col("altered")).otherwise(F.col("content")).alias("ledger_digest"),
        F.lit("r1").alias("reviewed_by"), F.lit("2024-01-01").alias("reviewed_at"), F.lit("single").alias("mechanism"),
    )
    revocations = document.filter(F.col("toxic") == 1).select(
        "identity", (F.col("doc_id") * 2 + 1).alias("sequence"), F.lit("revoke").alias("action"),
        F.col("content").alias("ledger_digest"), F.lit("r2").alias("reviewed_by"),
        F.lit("2024-02-01").alias("reviewed_at"), F.lit("single").alias("mechanism"),
    )
    return inputs, approvals.unionByName(revocations)


def lane_cascade(spark, sf):
    return lanes.compute(*_lane_inputs(spark, sf)).select("identity", "lane", "reason")


def lane_by_type_pivot(spark, sf):
    pivoted = coverage.lanes_by_type(entries(spark, sf), "namespace")
    return pivoted.select("namespace", *[F.col(f"`{lane}`").alias(lane.replace("-", "_")) for lane in LANES])


def _components(spark, sf):
    return load(spark, sf, "documents").select(
        F.col("source").alias("metadata_type"), F.concat_ws(".", "source", F.col("doc_id").cast("string")).alias("name")
    )


def _entry_rows(spark, sf):
    """Entries exist for labelled documents; short ones still hold the draft sentinel."""
    labelled = load(spark, sf, "labels").select("doc_id", "quality", "toxic")
    described = load(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("metadata_type"), F.concat_ws(".", "source", F.col("doc_id").cast("string")).alias("full_name"),
        F.when(F.col("n_chars") < 150, "<AGENT_DESCRIPTION>").when(F.trim("text") == "", "").otherwise("described").alias("purpose"),
    )
    return described.join(labelled, "doc_id").select(
        "metadata_type", "full_name", "purpose",
        F.when(F.col("toxic") == 1, "revoked").when(F.col("quality") == 1, CURRENT_LANE).otherwise("approved-drifted").alias("lane"),
    )


def coverage_missing(spark, sf):
    return coverage.missing_entries(_components(spark, sf), _entry_rows(spark, sf), cap=20)


def unprofiled_types(spark, sf):
    return coverage.unprofiled_types(_components(spark, sf), ["src0", "src1", "src2", "src3"])


def readiness(spark, sf):
    return coverage.readiness(_components(spark, sf), _entry_rows(spark, sf))


def _references(spark, sf):
    digested = load(spark, sf, "documents").select("doc_id", identity_of().alias("entry_id"), F.sha2("text", 256).alias("content"))
    cited = digested.join(load(spark, sf, "labels"), "doc_id").select(
        "entry_id",
        F.when(F.col("quality") == 1, F.col("content")).when(F.col("toxic") == 1, "").otherwise("stale").alias("cited_digest"),
    )
    unknown = load(spark, sf, "benchmark").select(
        F.concat(F.lit("Document:en:none."), F.col("item_id").cast("string")).alias("entry_id"), F.lit("").alias("cited_digest")
    )
    return cited.unionByName(unknown)


def citation_verdicts(spark, sf):
    computed = lanes.compute(*_lane_inputs(spark, sf))
    return lanes.citation_verdicts(_references(spark, sf), computed).drop("cited_digest")


def citation_counts(spark, sf):
    computed = lanes.compute(*_lane_inputs(spark, sf))
    return lanes.severity_counts(lanes.citation_verdicts(_references(spark, sf), computed))


def _observations(spark, sf):
    events = load(spark, sf, "events").withColumn("identity", F.col("user_id").cast("string"))
    blocks = events.groupBy("identity", F.col("event_type").alias("org_key")).agg(
        F.max("ts").alias("observed_at"), (F.max("ts") + F.make_dt_interval(days=F.lit(6))).alias("expires_at"),
    ).withColumn("org_digest", F.concat(F.lit("org-"), "org_key"))
    sections = events.groupBy("identity").agg(
        F.count(F.lit(1)).cast("string").alias("stored_digest"),
        F.count_if(F.col("value") > 0.05).cast("string").alias("recomputed_digest"),
    )
    newest = ledger.latest(events.select("identity", F.col("event_id").alias("sequence"), F.col("event_type").alias("action"), "value"))
    recorded = newest.filter(F.col("action") != "signup").join(sections, "identity").select(
        "identity", F.lit("attach").alias("action"),
        F.when(F.col("value") < 2, "replayed").otherwise(F.col("recomputed_digest")).alias("ledger_digest"),
    )
    configured = spark.createDataFrame(
        [("click", "org-click", None), ("view", "org-view", datetime(2024, 1, 14)), ("purchase", "org-purchase", None),
         ("error", "org-rebuilt", None)],
        "org_key string, configured_digest string, refreshed_at timestamp",
    )
    return sections, blocks, recorded, configured


def org_lane(spark, sf):
    return lanes.observation_lanes(*_observations(spark, sf), AT, 10)


def org_section_absent(spark, sf):
    """Customers as entries against the users' observation sections."""
    sections, _, recorded, _ = _observations(spark, sf)
    holders = load(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("identity"))
    kept = sections.filter(F.col("stored_digest") == F.col("recomputed_digest"))
    return lanes.section_status(holders, kept, recorded)


def org_lane_counts(spark, sf):
    """Observation blocks, and customers without a section, per status."""
    return lanes.status_counts(org_lane(spark, sf), org_section_absent(spark, sf))


# --- workflow ----------------------------------------------------------------------------

# Which state pair an event type stands for.
_STATES = {
    "view": "intake/draft", "click": "intake/incomplete", "error": "intake/blocked",
    "signup": "design/draft", "purchase": "design/awaiting_human",
}


def transitions_invalid(spark, sf):
    """Moves between neighbouring events of a user that the transition table does not allow."""
    state = F.element_at(F.create_map(*[F.lit(x) for kv in _STATES.items() for x in kv]), F.col("event_type"))
    events = load(spark, sf, "events").select("user_id", "event_id", state.alias("state"))
    moves = ordered.previous(events, ["user_id"], "event_id", "state").filter(F.col("previous").isNotNull())
    allowed = [f"{a}>{b}" for a, targets in TRANSITIONS.items() for b in targets]
    return moves.filter(~F.concat_ws(">", "previous", "state").isin(allowed)).select("user_id", "event_id", "previous", "state")


def convergence(spark, sf):
    """Gap-set sizes per user, from the events' payload, against the counted stop."""
    rounds = load(spark, sf, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("int").alias("size"))
    return ordered.convergence(rounds, "user_id", "event_id", "size", cap=12)


def protected_moves(spark, sf):
    """Events whose target status only a human may set."""
    state = F.element_at(F.create_map(*[F.lit(x) for kv in {**_STATES, "purchase": "design/accepted"}.items() for x in kv]), F.col("event_type"))
    events = load(spark, sf, "events").select("event_type", state.alias("state"))
    return events.groupBy("event_type", "state").agg(F.count(F.lit(1)).alias("events")).withColumn(
        "protected", F.substring_index("state", "/", -1).isin(*PROTECTED_STATUSES)
    )


QUERIES = {f.__name__: f for f in (
    ledger_latest, ledger_gaps, current_approval, lane_cascade, lane_by_type_pivot, coverage_missing,
    unprofiled_types, readiness, citation_verdicts, citation_counts, org_lane, org_section_absent, org_lane_counts,
    transitions_invalid, convergence, protected_moves,
)}

_DOC = """doc AS (SELECT 'Document:' || lang || ':' || source || '.' || d.doc_id AS identity, source, lang, quality, toxic, n_chars, d.doc_id AS doc_id,
  sha256(text) AS content, sha256(text || '!') AS altered, text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
_LANES = f"""WITH {_DOC}, lanes AS (SELECT identity, content,
 CASE WHEN source = 'src3' AND lang = 'es' THEN 'not-effective|path does not round-trip'
  WHEN quality IS NULL THEN 'draft|not approved yet' WHEN n_chars < 60 THEN 'not-effective|validation problems'
  WHEN coalesce(toxic, 0) <> 1 AND source = 'src19' THEN 'not-effective|no ledger record'
  WHEN toxic = 1 THEN 'revoked|approval revoked' WHEN source = 'src7' THEN 'not-effective|digest is not the latest record'
  WHEN source = 'src5' THEN 'not-effective|in-file mirror mismatch' WHEN source = 'src9' THEN 'not-effective|in-file provenance mismatch'
  WHEN quality <> 1 THEN 'approved-drifted|source moved on' ELSE 'approved-current|current' END AS lr FROM doc),
lane AS (SELECT identity, content, split_part(lr, '|', 1) AS lane, split_part(lr, '|', 2) AS reason FROM lanes)"""
_VERDICTS = f"""{_LANES}, refs AS (
 SELECT identity AS entry_id, CASE WHEN quality = 1 THEN content WHEN toxic = 1 THEN '' ELSE 'stale' END AS cited FROM doc WHERE quality IS NOT NULL
 UNION ALL SELECT 'Document:en:none.' || item_id, '' FROM benchmark),
v AS (SELECT entry_id, CASE WHEN lane IS NULL THEN 'missing' WHEN lane = 'revoked' THEN 'revoked' WHEN lane = 'draft' THEN 'not-approved'
  WHEN lane = 'not-effective' THEN 'not-effective' WHEN cited <> '' AND cited <> content THEN 'digest-mismatch'
  WHEN lane = 'approved-drifted' THEN 'drifted' ELSE 'current' END AS verdict FROM refs LEFT JOIN lane ON entry_id = identity),
s AS (SELECT entry_id, verdict, CASE verdict WHEN 'current' THEN 'ok' WHEN 'drifted' THEN 'warning' ELSE 'invalid' END AS severity FROM v)"""
_COMP = """comp AS (SELECT source AS metadata_type, source || '.' || doc_id AS name FROM documents),
ent AS (SELECT source AS metadata_type, source || '.' || d.doc_id AS name,
  CASE WHEN toxic = 1 THEN 'revoked' WHEN quality = 1 THEN 'approved-current' ELSE 'approved-drifted' END AS lane,
  n_chars < 150 OR trim(text) = '' AS undescribed FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
_ORG = """WITH ev AS (SELECT *, user_id::VARCHAR AS identity FROM events),
blocks AS (SELECT identity, event_type AS org_key, max(ts) AS observed, max(ts) + INTERVAL 6 DAY AS expires FROM ev GROUP BY 1, 2),
sections AS (SELECT identity, count(*) AS stored, count(*) FILTER (value > 0.05) AS recomputed FROM ev GROUP BY 1),
last AS (SELECT identity, event_type, value FROM ev QUALIFY row_number() OVER (PARTITION BY identity ORDER BY event_id DESC) = 1),
led AS (SELECT identity, value < 2 AS replayed FROM last WHERE event_type <> 'signup')"""
_STATE = "CASE event_type WHEN 'view' THEN 'intake/draft' WHEN 'click' THEN 'intake/incomplete' WHEN 'error' THEN 'intake/blocked' WHEN 'signup' THEN 'design/draft' ELSE 'design/awaiting_human' END"

ORACLE = {
    "ledger_latest": """SELECT user_id::VARCHAR AS identity, event_id AS sequence, event_type AS action,
 strftime(ts, '%Y-%m-%dT%H:%M:%S') AS reviewed_at, props, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
    "ledger_gaps": """WITH k AS (SELECT event_id AS sequence, lag(event_id) OVER (ORDER BY event_id) AS previous FROM events WHERE event_type <> 'error')
SELECT previous, sequence, sequence - previous - 1 AS missing FROM k WHERE sequence - previous > 1""",
    "current_approval": """SELECT user_id::VARCHAR AS identity, event_id AS sequence, value FROM events WHERE event_type = 'purchase' AND value >= 10
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
    "lane_cascade": f"{_LANES} SELECT identity, lane, reason FROM lane",
    "lane_by_type_pivot": f"""WITH {sql.ENTRIES} SELECT namespace, """ + ", ".join(
        f"count(*) FILTER (lane = '{lane}') AS {lane.replace('-', '_')}" for lane in LANES) + " FROM entries GROUP BY namespace",
    "coverage_missing": f"""WITH {_COMP}, gap AS (SELECT * FROM comp ANTI JOIN ent USING (metadata_type, name))
SELECT metadata_type, name, count(*) OVER (PARTITION BY metadata_type) AS total FROM gap
QUALIFY row_number() OVER (PARTITION BY metadata_type ORDER BY name) <= 20""",
    "unprofiled_types": "SELECT source AS metadata_type, count(*) AS components FROM documents WHERE source NOT IN ('src0', 'src1', 'src2', 'src3') GROUP BY source",
    "readiness": f"""WITH {_COMP} SELECT c.metadata_type AS metadata_type, count(*) AS components, """ + ", ".join(
        f"count(*) FILTER (lane = '{lane}') AS {lane.replace('-', '_')}" for lane in LANES) + """,
 count(*) FILTER (lane IS NULL) AS no_entry, count(*) FILTER (lane IS NOT NULL AND undescribed) AS undescribed
 FROM comp c LEFT JOIN ent e ON c.metadata_type = e.metadata_type AND c.name = e.name GROUP BY c.metadata_type""",
    "citation_verdicts": f"{_VERDICTS} SELECT entry_id, verdict, severity FROM s",
    "citation_counts": f"{_VERDICTS} SELECT count(*) FILTER (severity = 'ok') AS ok, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'invalid') AS invalid FROM s",
    "org_lane": _ORG + """, r AS (SELECT b.*, least(expires, observed + INTERVAL 10 DAY) AS eff,
  CASE WHEN stored <> recomputed THEN 'section digest does not recompute' WHEN replayed IS NULL THEN 'no ledger record'
       WHEN replayed THEN 'digest is not the latest record' END AS problem
  FROM blocks b JOIN sections USING (identity) LEFT JOIN led USING (identity))
SELECT identity, org_key, CASE WHEN problem IS NOT NULL THEN 'org-not-effective' WHEN org_key IN ('signup', 'error') THEN 'org-superseded'
  WHEN org_key = 'view' AND observed < TIMESTAMP '2024-01-14' THEN 'org-superseded' WHEN TIMESTAMP '2024-01-25' >= eff THEN 'org-expired' ELSE 'org-fresh' END AS status,
 CASE WHEN problem IS NOT NULL THEN problem WHEN org_key = 'signup' THEN 'alias is not configured' WHEN org_key = 'error' THEN 'configured identity changed'
  WHEN org_key = 'view' AND observed < TIMESTAMP '2024-01-14' THEN 'observed before the refresh' WHEN TIMESTAMP '2024-01-25' >= eff THEN 'past its effective expiry' END AS reason,
 strftime(eff, '%Y-%m-%dT%H:%M:%SZ') AS expires_at FROM r""",
    "org_section_absent": _ORG + """ SELECT c_custkey::VARCHAR AS identity, CASE WHEN led.identity IS NOT NULL THEN 'org-not-effective' ELSE 'org-absent' END AS section
FROM customer LEFT JOIN led ON led.identity = c_custkey::VARCHAR
WHERE c_custkey::VARCHAR NOT IN (SELECT identity FROM sections WHERE stored = recomputed)""",
    "transitions_invalid": f"""WITH s AS (SELECT user_id, event_id, {_STATE} AS state FROM events),
m AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM s),
allowed(a) AS (VALUES ('intake/draft>design/draft'), ('intake/draft>intake/incomplete'), ('intake/draft>intake/blocked'), ('intake/incomplete>intake/draft'),
 ('intake/incomplete>intake/blocked'), ('intake/blocked>intake/draft'), ('intake/blocked>intake/incomplete'), ('design/draft>design/awaiting_human'), ('design/awaiting_human>design/draft'))
SELECT user_id, event_id, previous, state FROM m WHERE previous IS NOT NULL AND previous || '>' || state NOT IN (SELECT a FROM allowed)""",
    "convergence": """WITH r AS (SELECT user_id, event_id, json_extract_string(props, '$.k')::INTEGER AS size FROM events),
a AS (SELECT *, row_number() OVER w AS round, min(size) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM r WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, max(CASE WHEN best IS NULL OR size < best THEN round END) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM a)
SELECT user_id, event_id, round, size, least(size, coalesce(best, size)) AS smallest, round - last AS rounds_without_shrink,
 (round - last >= 2 OR round >= 12) AND size > 0 AS blocked FROM b""",
    "protected_moves": f"""SELECT event_type, replace({_STATE}, 'awaiting_human', 'accepted') AS state, count(*) AS events,
 event_type = 'purchase' AS protected FROM events GROUP BY 1, 2""",
}

ORACLE["org_lane_counts"] = f"""WITH s AS (SELECT status, identity FROM ({ORACLE['org_lane']}) UNION ALL SELECT section, identity FROM ({ORACLE['org_section_absent']})),
d(status) AS (VALUES ('org-fresh'), ('org-expired'), ('org-superseded'), ('org-not-effective'), ('org-absent'))
SELECT d.status, count(identity) AS records, count(DISTINCT identity) AS identities FROM d LEFT JOIN s USING (status) GROUP BY d.status"""
