"""Feature documents: closure and authority checks, lanes, citation verdicts, operations.

A document's parts are rows keyed by ``slug``: nodes, relations, claims, bindings. Every check
returns one row per problem.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evitrace.vocab import CITABLE_AUTHORITIES, CORE_SECTIONS, SOURCE_REQUIRED


def live(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.coalesce(F.col("tombstoned"), F.lit(False)))


def _missing(references: DataFrame, existing: DataFrame, problem: str) -> DataFrame:
    """References (slug, id, ref) whose target does not exist."""
    held = existing.select("slug", F.col("id").alias("ref"))
    return references.join(held, ["slug", "ref"], "left_anti").select(
        "slug", "id", F.lit(problem).alias("problem"), F.col("ref").alias("detail")
    )


def _refs(rows: DataFrame, column: str) -> DataFrame:
    return rows.select("slug", "id", F.explode(column).alias("ref"))


def violations(nodes: DataFrame, relations: DataFrame, claims: DataFrame, bindings: DataFrame) -> DataFrame:
    """Broken references and claims beyond their authority: ``(slug, id, problem, detail)``.

    nodes: slug, id, kind, artifact_id, role, role_note, evidence, tombstoned. relations: slug,
    id, from_id, to_id, assurance, evidence, tombstoned. claims: slug, id, type, authority,
    citation_policy, evidence, depends_on, tombstoned. bindings: slug, id, tombstoned.
    """
    nodes, relations, claims, bindings = (live(t) for t in (nodes, relations, claims, bindings))
    every = reduce(DataFrame.unionByName, [t.select("slug", "id") for t in (nodes, relations, claims, bindings)])
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1

    def broken(rows, test, problem, detail):
        return rows.filter(test).select("slug", "id", F.lit(problem).alias("problem"), F.coalesce(F.col(detail), F.lit("")).alias("detail"))

    problems = [
        broken(nodes, (F.col("kind") == "artifact") & F.col("artifact_id").isNull(), "artifact node without artifact", "kind"),
        broken(nodes, (F.col("role") == "other") & F.col("role_note").isNull(), "other role without note", "role"),
        _missing(_refs(nodes, "evidence"), claims, "evidence claim does not exist"),
        _missing(relations.select("slug", "id", F.col("from_id").alias("ref")), nodes, "from node does not exist"),
        _missing(relations.select("slug", "id", F.col("to_id").alias("ref")), nodes, "to node does not exist"),
        _missing(_refs(relations, "evidence"), bindings, "binding does not exist"),
        broken(relations, (F.col("assurance") == "source-exact") & empty("evidence"), "exact relation without binding", "assurance"),
        _missing(_refs(claims, "depends_on"), every, "dependency does not exist"),
        _missing(_refs(claims, "evidence"), bindings, "binding does not exist"),
        broken(claims, (F.col("authority") == "human-attested") & F.col("type").isin(*SOURCE_REQUIRED), "type needs source evidence", "type"),
        broken(claims, (F.col("authority") == "source-exact") & empty("evidence"), "exact claim without binding", "authority"),
        broken(
            claims,
            F.col("authority").isin("source-derived-heuristic", "unresolved") & (F.col("citation_policy") != "never-citable"),
            "inferred claim must not be citable", "authority",
        ),
    ]
    return reduce(DataFrame.unionByName, problems)


def narrative_violations(documents: DataFrame, known_sections: list[str]) -> DataFrame:
    """Core sections missing or empty, unknown sections, unfilled marks. ``documents``: slug, sections."""
    core = documents.select("slug", F.explode(F.array(*[F.lit(s) for s in CORE_SECTIONS])).alias("detail"), "sections").filter(
        F.trim(F.coalesce(F.try_element_at("sections", "detail"), F.lit(""))) == ""
    ).select("slug", F.lit("core section missing or empty").alias("problem"), "detail")
    unknown = documents.select("slug", F.explode(F.map_keys("sections")).alias("detail")).filter(
        ~F.col("detail").isin(known_sections)
    ).select("slug", F.lit("unknown section").alias("problem"), "detail")
    unfilled = documents.filter(F.exists(F.map_values("sections"), lambda v: v.contains("<AGENT_"))).select(
        "slug", F.lit("unfilled mark").alias("problem"), F.lit("").alias("detail")
    )
    return core.unionByName(unknown).unionByName(unfilled)


def lane(documents: DataFrame, problem_counts: DataFrame, newest: DataFrame) -> DataFrame:
    """Lane of a feature document: revocation first, then draft, problems, digest.

    documents: slug, state, digest. problem_counts: slug, problems. newest: slug, action, ledger_digest.
    """
    joined = documents.join(problem_counts, "slug", "left").join(newest, "slug", "left")
    name = (
        F.when(F.col("action") == "revoke", "revoked")
        .when(F.col("state") == "draft", "draft")
        .when(F.coalesce("problems", F.lit(0)) > 0, "not-effective")
        .when(~F.col("ledger_digest").eqNullSafe(F.col("digest")), "not-effective")
        .otherwise("approved-current")
    )
    return joined.select("slug", name.alias("lane"))


def citation_verdicts(requests: DataFrame, lanes: DataFrame, claims: DataFrame, closure: DataFrame,
                      bindings: DataFrame, current: DataFrame) -> DataFrame:
    """Verdict per requested claim of a feature.

    requests: slug, claim_id, pinned_digest. lanes: slug, lane, invalid, digest. claims: slug, id,
    authority, citation_policy. closure: slug, claim_id, binding_id. bindings: slug, binding_id,
    entry_id, bound_digest. current: entry_id, digest (approved-current entries only).
    """
    state = (
        F.when(F.col("entry_digest").isNull(), "unknown")
        .when(F.col("entry_digest") == F.col("bound_digest"), "current").otherwise("drifted")
    )
    states = bindings.join(current.select("entry_id", F.col("digest").alias("entry_digest")), "entry_id", "left").withColumn("state", state)
    rested = closure.join(states.select("slug", "binding_id", "state"), ["slug", "binding_id"], "left")
    selected = rested.groupBy("slug", "claim_id").agg(
        F.count_if(F.col("state") == "drifted").alias("drifted"),
        F.count_if(F.coalesce(F.col("state"), F.lit("unknown")) == "unknown").alias("unknown"),
        F.count_if(F.col("state").isNotNull() & (F.col("state") != "current")).alias("selected_stale"),
    )
    whole = states.groupBy("slug").agg(F.count_if(F.col("state") != "current").alias("stale"))
    joined = (
        requests.join(lanes, "slug", "left")
        .join(claims.select("slug", F.col("id").alias("claim_id"), "authority", "citation_policy"), ["slug", "claim_id"], "left")
        .join(selected, ["slug", "claim_id"], "left").join(whole, "slug", "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    verdict = (
        F.when(F.coalesce(F.col("invalid"), F.lit(False)), "invalid")
        .when(~F.col("lane").eqNullSafe("approved-current"), "not-approved")
        .when(F.col("pinned_digest").isNotNull() & (F.col("pinned_digest") != F.col("digest")), "superseded")
        .when(F.col("authority").isNull(), "unknown-id")
        .when((F.col("citation_policy") != "citable-after-approval") | ~F.col("authority").isin(*CITABLE_AUTHORITIES), "not-citable")
        .when(zero("drifted") > 0, "drifted")
        .when(zero("unknown") > 0, "unknown")
        .when(zero("stale") - zero("selected_stale") > 0, "degraded")
        .otherwise("current")
    )
    return joined.select("slug", "claim_id", verdict.alias("verdict"))


def apply_operations(operations: DataFrame) -> DataFrame:
    """State after an operation log: the last write per (slug, kind, id) wins; removals stay as
    tombstones so that ids are never reused."""
    payload = F.max_by(F.struct("op", "payload"), "sequence")
    last = operations.groupBy("slug", "kind", "id").agg(payload.alias("w"), F.max("sequence").alias("sequence"))
    return last.select("slug", "kind", "id", "sequence", F.col("w.payload").alias("payload"),
                       F.col("w.op").isin("remove", "withdraw", "unbind").alias("tombstoned"))


def search(nodes: DataFrame, claims: DataFrame, layer: str | None = None, claim_type: str | None = None,
           text: str | None = None) -> DataFrame:
    """Slugs with a live node of a layer, a live claim of a type, and a text in any claim."""
    slugs = nodes.select("slug").union(claims.select("slug")).distinct()
    if layer:
        slugs = slugs.join(live(nodes).filter(F.col("layer") == layer).select("slug").distinct(), "slug", "left_semi")
    if claim_type:
        slugs = slugs.join(live(claims).filter(F.col("type") == claim_type).select("slug").distinct(), "slug", "left_semi")
    if text:
        slugs = slugs.join(live(claims).filter(F.lower("text").contains(text.lower())).select("slug").distinct(), "slug", "left_semi")
    return slugs
