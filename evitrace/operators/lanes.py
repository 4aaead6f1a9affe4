"""Lifecycle lanes, citation verdicts and observation lanes: ordered cascades over a ledger."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evitrace.operators.ledger import latest
from evitrace.operators.postings import zero_filled

#: What an observation section can be.
ORG_STATUSES = ("org-fresh", "org-expired", "org-superseded", "org-not-effective", "org-absent")
PROVENANCE = ("reviewed_by", "reviewed_at", "mechanism")


def compute(entries: DataFrame, ledger: DataFrame) -> DataFrame:
    """Lane and reason per entry; the order of the tests is the meaning.

    ``entries``: identity, path_ok, state, problems, content_digest, approved_digest,
    reviewed_by, reviewed_at, mechanism, fragments_current. ``ledger``: identity, sequence,
    action, ledger_digest and the provenance columns.
    """
    newest = latest(ledger).select(
        "identity", "action", "ledger_digest", *[F.col(c).alias(f"l_{c}") for c in PROVENANCE]
    )
    joined = entries.join(newest, "identity", "left")
    same_provenance = F.lit(True)
    for c in PROVENANCE:
        same_provenance = same_provenance & F.col(c).eqNullSafe(F.col(f"l_{c}"))
    steps = [
        (~F.col("path_ok"), "not-effective", "path does not round-trip"),
        (F.col("state") == "draft", "draft", "not approved yet"),
        (F.col("problems") > 0, "not-effective", "validation problems"),
        (F.col("action").isNull(), "not-effective", "no ledger record"),
        (F.col("action") == "revoke", "revoked", "approval revoked"),
        (~F.col("ledger_digest").eqNullSafe(F.col("content_digest")), "not-effective", "digest is not the latest record"),
        (~F.col("approved_digest").eqNullSafe(F.col("content_digest")), "not-effective", "in-file mirror mismatch"),
        (~same_provenance, "not-effective", "in-file provenance mismatch"),
        (~F.col("fragments_current"), "approved-drifted", "source moved on"),
    ]
    lane, reason = F, F
    for test, name, why in steps:
        lane, reason = lane.when(test, name), reason.when(test, why)
    return joined.select(
        *entries.columns, lane.otherwise("approved-current").alias("lane"),
        reason.otherwise("current").alias("reason"),
    )


def citation_verdicts(references: DataFrame, lanes: DataFrame) -> DataFrame:
    """Verdict and severity of cited entries.

    ``references``: entry_id, cited_digest. ``lanes``: identity, lane, content_digest.
    """
    joined = references.join(
        lanes.select(F.col("identity").alias("entry_id"), "lane", "content_digest"), "entry_id", "left"
    )
    verdict = (
        F.when(F.col("lane").isNull(), "missing")
        .when(F.col("lane") == "revoked", "revoked")
        .when(F.col("lane") == "draft", "not-approved")
        .when(F.col("lane") == "not-effective", "not-effective")
        .when((F.col("cited_digest") != "") & ~F.col("cited_digest").eqNullSafe(F.col("content_digest")), "digest-mismatch")
        .when(F.col("lane") == "approved-drifted", "drifted")
        .otherwise("current")
    )
    severity = (
        F.when(F.col("verdict") == "current", "ok").when(F.col("verdict") == "drifted", "warning").otherwise("invalid")
    )
    return joined.withColumn("verdict", verdict).withColumn("severity", severity).select(
        *references.columns, "verdict", "severity"
    )


def severity_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(
        F.count_if(F.col("severity") == "ok").alias("ok"),
        F.count_if(F.col("severity") == "warning").alias("warning"),
        F.count_if(F.col("severity") == "invalid").alias("invalid"),
    )


def observation_lanes(sections: DataFrame, blocks: DataFrame, ledger: DataFrame, configured: DataFrame,
                      at: datetime, max_age_days: int) -> DataFrame:
    """Freshness of observation blocks; expiry is recomputed against an instant on every read.

    ``sections``: identity, stored_digest, recomputed_digest. ``blocks``: identity, org_key,
    observed_at, expires_at, org_digest. ``ledger``: newest record per identity with action and
    ledger_digest. ``configured``: org_key, configured_digest, refreshed_at (a small closed list).
    """
    checked = sections.join(ledger.select("identity", "action", "ledger_digest"), "identity", "left").select(
        "identity",
        F.when(~F.col("stored_digest").eqNullSafe(F.col("recomputed_digest")), "section digest does not recompute")
        .when(F.col("action").isNull(), "no ledger record")
        .when(~F.col("ledger_digest").eqNullSafe(F.col("recomputed_digest")), "digest is not the latest record")
        .alias("problem"),
    )
    rows = blocks.join(checked, "identity").join(configured, "org_key", "left")
    effective = F.least(
        F.col("expires_at"), F.col("observed_at") + F.make_dt_interval(days=F.lit(max_age_days))
    )
    steps = [
        (F.col("problem").isNotNull(), "org-not-effective", F.col("problem")),
        (F.col("configured_digest").isNull() & F.col("refreshed_at").isNull(), "org-superseded", F.lit("alias is not configured")),
        (~F.col("configured_digest").eqNullSafe(F.col("org_digest")), "org-superseded", F.lit("configured identity changed")),
        (F.col("observed_at") < F.col("refreshed_at"), "org-superseded", F.lit("observed before the refresh")),
        (F.lit(at) >= effective, "org-expired", F.lit("past its effective expiry")),
    ]
    status, reason = F, F
    for test, name, why in steps:
        status, reason = status.when(test, name), reason.when(test, why)
    return rows.select(
        "identity", "org_key", status.otherwise("org-fresh").alias("status"),
        reason.otherwise(F.lit(None)).alias("reason"),
        F.date_format(effective, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("expires_at"),
    )


def section_status(entries: DataFrame, sections: DataFrame, ledger: DataFrame) -> DataFrame:
    """Entries without an observation section: absent, or lost after an attach."""
    without = entries.join(sections.select("identity"), "identity", "left_anti")
    return without.join(ledger.select("identity", "action"), "identity", "left").select(
        "identity",
        F.when(F.col("action") == "attach", "org-not-effective").otherwise("org-absent").alias("section"),
    )


def status_counts(blocks: DataFrame, without: DataFrame) -> DataFrame:
    """Blocks and entries per status, every status with a row.

    ``blocks``: rows of :func:`observation_lanes`. ``without``: rows of :func:`section_status`, one
    per entry that has no section.
    """
    rows = blocks.select("status", "identity").unionByName(without.select(F.col("section").alias("status"), "identity"))
    counts = rows.groupBy("status").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("identity").alias("identities"))
    named = zero_filled(counts.select("status", "records"), "status", list(ORG_STATUSES), "records")
    # Both sides have at most one row per status.
    return named.join(counts.select("status", "identities"), "status", "left").select(
        "status", "records", F.coalesce("identities", F.lit(0)).cast("bigint").alias("identities"))
