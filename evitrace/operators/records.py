"""Work records and requirements: references, receipts, items and their drift."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evitrace.functions.digest import digest
from evitrace.operators.ordered import prefix
from evitrace.vocab import EXACT

# Fixed value: shape of a rule definition line in a Markdown source.
RULE_LINE = r"^[-*]?\s*\*\*((?:SAFE|MP|ORG|SF)-[A-Z0-9-]+)\s+—"


def entry_reference_problems(references: DataFrame, lanes: DataFrame, require_current: bool = True) -> DataFrame:
    """What is wrong with bound entry references: (entry_id, problem), none when all hold.

    references: record_id, entry_id, content_digest, tree_digest, profile. lanes: identity, lane,
    digest, tree, entry_profile, assurance and coverage (maps by section).
    """
    joined = references.join(lanes.withColumnRenamed("identity", "entry_id"), "entry_id", "left")
    sections = F.array_union(F.map_keys("assurance"), F.map_keys("coverage"))
    groundable = F.forall(sections, lambda s: F.try_element_at("assurance", s).eqNullSafe(EXACT) & F.try_element_at("coverage", s).eqNullSafe("full"))
    accepted = ["approved-current"] if require_current else ["approved-current", "approved-drifted"]
    problem = (
        F.when(F.col("lane").isNull(), "missing")
        .when(~F.col("digest").eqNullSafe(F.col("content_digest")), "digest differs")
        .when(~(F.col("tree").eqNullSafe(F.col("tree_digest")) & F.col("entry_profile").eqNullSafe(F.col("profile"))), "scope or profile differs")
        .when(~F.col("lane").isin(accepted), "lane not accepted")
    )
    if require_current:
        problem = problem.when(~F.coalesce(groundable, F.lit(True)), "section not groundable")
    each = joined.select("record_id", "entry_id", problem.alias("problem")).filter(F.col("problem").isNotNull())
    twice = references.groupBy("record_id", "entry_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return each.unionByName(twice.select("record_id", "entry_id", F.lit("bound twice").alias("problem")))


def rule_definitions(lines: DataFrame) -> DataFrame:
    """Rule id, digest of its definition and how often it is declared.

    ``lines``: source, line, text. A definition runs on over the indented lines below it; lines
    are grouped into blocks by a chunked prefix count, however long their source is.
    """
    rule = F.regexp_extract("text", RULE_LINE, 1)
    starts = F.when(F.col("text").rlike(r"^(  |\t)"), 0).otherwise(1)
    opened = lines.withColumn("rule", rule).withColumn("starts", starts)
    marked = prefix(opened, ["source"], "line", before=("sum", F.col("starts"))).withColumn("block", F.col("before") + F.col("starts"))
    blocks = marked.groupBy("source", "block").agg(
        F.max("rule").alias("rule_id"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("body"),
    ).filter(F.col("rule_id") != "")
    return blocks.groupBy("rule_id").agg(F.min(digest(F.col("body"))).alias("digest"), F.count(F.lit(1)).alias("declarations"))


def resolve_rules(references: DataFrame, declarations: DataFrame) -> DataFrame:
    """The first declaring source by tier order, and whether the stored reference still equals it.

    references: rule_id, source_file, source_sha. declarations: rule_id, tier_order, file, sha.
    """
    first = declarations.groupBy("rule_id").agg(F.min_by(F.struct("file", "sha"), "tier_order").alias("d")).select("rule_id", "d.*")
    joined = references.join(first, "rule_id", "left")
    same = F.col("file").eqNullSafe(F.col("source_file")) & F.col("sha").eqNullSafe(F.col("source_sha"))
    return joined.select("rule_id", F.when(F.col("file").isNull(), "undeclared").when(~same, "stale").otherwise("current").alias("state"))


def chunk_classes(entries: DataFrame, newest: DataFrame) -> DataFrame:
    """Whether re-approval covers prose or facts only, against the newest ledger record."""
    joined = entries.join(newest.select("identity", "ledger_semantics"), "identity", "left")
    return joined.select("identity", F.when(
        F.col("ledger_semantics").eqNullSafe(F.col("semantics_digest")), "facts-only"
    ).otherwise("prose").alias("change"))


def receipt_problem(verified_at: Column, at: datetime, max_age_minutes: int, *equal: Column) -> Column:
    """Why a receipt does not hold: a field differs, it comes from the future, it is too old."""
    age = F.unix_timestamp(F.lit(at)) - F.unix_timestamp(verified_at)
    holds = F.lit(True)
    for test in equal:
        holds = holds & F.coalesce(test, F.lit(False))
    return F.when(~holds, "not a verified receipt").when((age < 0) | (age > max_age_minutes * 60), "not fresh")


def verification_outcome(timed_out: Column, output_bytes: Column, max_bytes: Column, exit_code: Column) -> Column:
    return (
        F.when(timed_out, "timed-out").when(output_bytes > max_bytes, "output-limit-exceeded")
        .when(exit_code == 0, "passed").otherwise("failed")
    )


def undeclared_profiles(required: DataFrame, declared: DataFrame) -> DataFrame:
    """Required verification profiles nobody declared. Both: record_id, profile."""
    return required.select("record_id", "profile").distinct().join(declared, ["record_id", "profile"], "left_anti")


def supersede(approvals: DataFrame) -> DataFrame:
    """Status after a newer approval of the same record: only the newest stays active."""
    newest = approvals.groupBy("record_id").agg(F.max("sequence").alias("last"))
    status = F.when((F.col("status") == "active") & (F.col("sequence") < F.col("last")), "superseded").otherwise(F.col("status"))
    return approvals.join(newest, "record_id").withColumn("status", status).drop("last")


def compare_and_set(writes: DataFrame, current: DataFrame) -> DataFrame:
    """Which writes are refused because their caller's version is stale.

    writes: doc_id, write_id, based_on. current: doc_id, version. Of several writes on the same
    version the first wins.
    """
    joined = writes.join(current, "doc_id", "left").withColumn("fits", F.col("based_on").eqNullSafe(F.coalesce("version", F.lit(0))))
    first = joined.filter("fits").groupBy("doc_id").agg(F.min("write_id").alias("winner"))
    return joined.join(first, "doc_id", "left").select(
        "doc_id", "write_id", F.when(~F.col("fits"), "stale").when(F.col("write_id") == F.col("winner"), "accepted").otherwise("stale").alias("outcome")
    )


def allocate_ids(new: DataFrame, used: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Next ids per document and kind; numbers of removed parts are never reused.

    new: slug, kind, ord (position in its batch). used: slug, kind, number.
    """
    last = used.groupBy("slug", "kind").agg(F.max("number").alias("last"))
    place = F.row_number().over(Window.partitionBy("slug", "kind").orderBy("ord"))
    prefix = F.element_at(F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv]), F.col("kind"))
    numbered = new.withColumn("place", place).join(last, ["slug", "kind"], "left")
    number = F.coalesce("last", F.lit(0)) + F.col("place")
    return numbered.select("slug", "kind", "ord", F.concat(prefix, F.lit("-"), F.lpad(number.cast("string"), 3, "0")).alias("id"))


# --- requirement items -------------------------------------------------------------------


def requirement(items: DataFrame, links: DataFrame, max_children: int = 100) -> DataFrame:
    """Items with their children: counts, missing detail, completeness.

    items: item_id, revision, description, criteria. links: parent_id, child_id. Children are
    joined and counted, never gathered; more than a batch allows is stated.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    child = items.select(F.col("item_id").alias("child_id"), (blank("description") & blank("criteria")).alias("bare"))
    joined = links.join(child, "child_id", "left")
    counts = joined.groupBy(F.col("parent_id").alias("item_id")).agg(
        F.count(F.lit(1)).alias("children"), F.count_if(F.coalesce(F.col("bare"), F.lit(True))).alias("missing_detail")
    )
    out = items.select("item_id", "revision").join(counts, "item_id", "left").na.fill(0, ["children", "missing_detail"])
    return out.withColumn("completeness", F.when(F.col("missing_detail") > 0, "partial").otherwise("complete")).withColumn(
        "batches", F.ceil(F.col("children") / max_children).cast("bigint")
    )


def revision_drift(snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """Items whose revision moved or that are gone since a snapshot."""
    joined = snapshot.select("item_id", "revision").join(live.select("item_id", F.col("revision").alias("now")), "item_id", "left")
    state = F.when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("revision"), "moved")
    return joined.withColumn("state", state).filter(F.col("state").isNotNull())
