"""Gap sets: what a plan, a discovery or a verification still lacks, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evitrace.vocab import DISCOVERY_RESULTS, VERDICTS


def _gap(kind: str, ident: Column, suffix: str = "") -> list[Column]:
    return [
        F.concat(F.lit(kind + ":"), ident.cast("string"), F.lit(suffix)).alias("gap_id"),
        F.lit(kind).alias("kind"),
    ]


def discovery(subjects: DataFrame, results: DataFrame) -> DataFrame:
    """Subjects without a closing result. ``subjects``: subject; ``results``: subject, result."""
    closing = results.filter(F.col("result").isin(*DISCOVERY_RESULTS)).select("subject").distinct()
    return subjects.select("subject").distinct().join(closing, "subject", "left_anti").select(*_gap("discovery", F.col("subject")))


def uncovered(criteria: DataFrame, plan: DataFrame) -> DataFrame:
    """Criteria no plan item refers to. ``criteria``: ac_ref; ``plan``: ac_ref."""
    return criteria.select("ac_ref").distinct().join(plan.select("ac_ref").distinct(), "ac_ref", "left_anti").select(*_gap("plan", F.col("ac_ref")))


def ungrounded(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Plan items whose subject has no closing result. ``plan``: item_id, subject."""
    closing = results.filter(F.col("result").isin(*DISCOVERY_RESULTS)).select("subject").distinct()
    return plan.join(closing, "subject", "left_anti").select(*_gap("plan", F.col("item_id"), ":ungrounded"))


def triggered(plan: DataFrame, matrix: DataFrame, always: list[str], limitations: DataFrame) -> DataFrame:
    """The checklist: rules for each plan item's cell or type wildcard, standing rules, limits.

    ``plan``: artifact, action. ``matrix``: cell, rule_id. ``limitations``: item_id. The plan's
    distinct cells are formed before the lookup, so its size does not multiply.
    """
    cells = plan.select("artifact", "action").distinct().select(F.explode(F.array(
        F.concat_ws(":", "artifact", "action"), F.concat("artifact", F.lit(":*"))
    )).alias("cell")).distinct()
    rules = cells.join(matrix, "cell").select(F.col("rule_id").alias("item_id"), F.lit("rule").alias("item_kind"))
    standing = plan.sparkSession.createDataFrame([(r, "rule") for r in always], "item_id string, item_kind string")
    return rules.unionByName(standing).unionByName(
        limitations.select("item_id", F.lit("limitation").alias("item_kind"))
    ).distinct()


def verification(checklist: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Open items of the newest round. ``verdicts``: item_id, verdict, sentence, addressed_by."""
    joined = checklist.select("item_id").distinct().join(verdicts.withColumn("seen", F.lit(True)), "item_id", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    why = (
        F.when(F.col("seen").isNull(), "no verdict")
        .when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "not a verdict")
        .when(blank("sentence"), "no sentence")
        .when((F.col("verdict") == "violation") & blank("addressed_by"), "unaddressed")
    )
    rows = joined.withColumn("why", why).filter(F.col("why").isNotNull())
    suffix = F.when(F.col("why") == "unaddressed", ":unaddressed").otherwise("")
    return rows.select(
        F.concat(F.lit("verify:"), "item_id", suffix).alias("gap_id"), F.lit("verify").alias("kind"), "why"
    )


def submit_blockers(plan: DataFrame, results: DataFrame, writing: tuple[str, ...] = ("create", "modify", "delete")) -> DataFrame:
    """Writing plan items on package-owned subjects that were not found.

    ``plan``: item_id, action, subject; ``results``: subject, result, ownership, namespace.
    """
    owned = (F.col("ownership") == "package") | (F.coalesce(F.col("namespace"), F.lit("")) != "")
    risky = results.filter(owned & ~F.col("result").eqNullSafe("found")).select("subject", "result")
    return plan.filter(F.col("action").isin(*writing)).join(risky, "subject").select(
        "item_id", "action", "subject", F.coalesce("result", F.lit("none")).alias("result")
    )


def scope_uncovered(components: DataFrame, bound: DataFrame, profiles: list[str], owner_type: str = "CustomObject") -> DataFrame:
    """Scope components that no bound entry grounds, by itself or by its owner.

    Each component is looked up under both keys; one hit is enough. ``components``: type, name.
    """
    kind = F.when(F.lower("type").isin("customobject", "object"), owner_type).otherwise(F.col("type"))
    typed = components.select("type", "name", kind.alias("entry_type")).distinct()
    unprofiled = typed.filter(~F.col("entry_type").isin(profiles)).select("type", "name", F.lit("no entry profile").alias("problem"))
    keys = typed.filter(F.col("entry_type").isin(profiles)).select(
        "type", "name",
        F.explode(F.array_compact(F.array(
            F.struct(F.col("entry_type").alias("t"), F.col("name").alias("n")),
            F.when(F.col("name").contains("."), F.struct(F.lit(owner_type).alias("t"), F.substring_index("name", ".", 1).alias("n"))),
        ))).alias("k"),
    )
    held = bound.select(F.col("type").alias("bt"), F.col("name").alias("bn")).distinct()
    hits = keys.join(held, (F.col("k.t") == F.col("bt")) & (F.col("k.n") == F.col("bn")), "left")
    open_ = hits.groupBy("type", "name").agg(F.count("bt").alias("hits")).filter(F.col("hits") == 0)
    return open_.select("type", "name", F.lit("not covered").alias("problem")).unionByName(unprofiled)
