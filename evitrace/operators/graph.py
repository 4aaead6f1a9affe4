"""The dependency graph: target resolution, incoming and outgoing edges, packs, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evitrace.functions.analyze import fold_key, fold_name
from evitrace.vocab import (
    CONTAINMENT, CURRENT_LANE, EXACT, HEURISTIC, HEURISTIC_KINDS, LOCAL_SUFFIXES,
    PERMISSION_KINDS, TOP, TRUNCATION_FAMILIES,
)


def assurance(kind: Column, flag: Column | None = None) -> Column:
    """An edge is inferred when its kind always is, or when the collector flagged it."""
    inferred = kind.isin(*HEURISTIC_KINDS)
    if flag is not None:
        inferred = inferred | F.coalesce(flag, F.lit(False))
    return F.when(inferred, HEURISTIC).otherwise(EXACT)


def local_name(name: Column) -> Column:
    """An unnamespaced name with a local suffix: only this source tree can hold it."""
    suffix = "|".join(s[2:] for s in LOCAL_SUFFIXES)
    stem = F.regexp_replace(name, f"__({suffix})$", "")
    return F.coalesce(name.rlike(f"__({suffix})$") & ~stem.contains("__"), F.lit(False))


def decidable(target: Column) -> Column:
    """Whether an entry for the target could exist; a dotted name needs both halves local."""
    head = F.substring_index(target, ".", 1)
    member = F.substr(target, F.char_length(head) + 2)
    return F.when(~target.contains(".") | (member == ""), local_name(target)).otherwise(
        local_name(head) & local_name(member)
    )


def name_keys(entries: DataFrame) -> DataFrame:
    """Every folded name an entry answers to, with the stage that name belongs to."""
    full = fold_name(F.col("full_name"))
    return entries.select(
        "identity",
        F.explode(F.array_compact(F.array(
            F.when(F.col("full_name") != "", F.struct(F.lit("full").alias("stage"), full.alias("key"))),
            F.struct(F.lit("identity").alias("stage"), fold_name(F.col("identity")).alias("key")),
            F.when(F.col("full_name").rlike(r"[^.].*\."), F.struct(
                F.lit("member").alias("stage"), fold_name(F.substring_index("full_name", ".", -1)).alias("key"))),
        ))).alias("n"),
    ).select("identity", "n.stage", "n.key")


def resolve_targets(entries: DataFrame, edges: DataFrame, few: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """One row per folded target: how often it is named and what it resolves to.

    ``few`` (target keys of a small written table) restricts the work to those targets; entries are
    then filtered as they are scanned and only matching names are shuffled. ``names``: stored
    :func:`name_keys` of the entries.

    The three lookups (full name, identity, member) are one aggregate over name keys and one
    join. Candidates stay rows (:func:`target_candidates`); here they are counted, so a name
    shared by very many entries does not become one very long list.
    """
    names = name_keys(entries) if names is None else names
    if few is not None:
        names = names.join(few.withColumnRenamed("target_key", "key"), "key", "left_semi")

    def of(stage: str, fold) -> Column:
        return fold(F.when(F.col("stage") == stage, F.col("identity")))

    lookup = names.groupBy("key").agg(
        *[of(s, F.count).alias(f"n_{s}") for s in ("full", "identity", "member")],
        *[of(s, F.min).alias(f"id_{s}") for s in ("full", "identity", "member")],
    ).withColumnRenamed("key", "target_key")
    spelled = edges.groupBy("target_key", "target").agg(F.count(F.lit(1)).alias("n"))
    targets = spelled.groupBy("target_key").agg(
        F.sum("n").alias("incoming"), F.count(F.lit(1)).alias("spellings"), F.min("target").alias("spelling")
    )
    joined = targets.join(lookup, "target_key", "left").na.fill(0, ["n_full", "n_identity", "n_member"])
    stage = F.when(F.col("n_full") > 0, "full").when(F.col("n_identity") > 0, "identity").when(
        F.col("n_member") > 0, "member"
    )
    count = F.coalesce(*[F.nullif(F.col(f"n_{s}"), F.lit(0)) for s in ("full", "identity", "member")], F.lit(0))
    first = F.when(F.col("n_full") > 0, F.col("id_full")).when(F.col("n_identity") > 0, F.col("id_identity")).otherwise(F.col("id_member"))
    resolution = (
        F.when(count == 0, "no-entry").when(count > 1, "ambiguous")
        .when(stage == "member", "resolved-by-member").otherwise("resolved")
    )
    return joined.select(
        "target_key", "incoming", "spellings", "spelling", resolution.alias("resolution"),
        F.when(count == 1, first).alias("target_identity"), count.alias("candidates"),
        stage.alias("stage"), decidable(F.col("spelling")).alias("decidable"),
    )


def target_candidates(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """The candidates of ambiguous targets, one row each."""
    names = name_keys(entries).withColumnRenamed("key", "target_key")
    open_ = targets.filter(F.col("resolution") == "ambiguous").select("target_key", "stage")
    return open_.join(names, ["target_key", "stage"]).select("target_key", "stage", F.col("identity").alias("candidate"))


def edge_health(targets: DataFrame) -> DataFrame:
    """Targets per resolution, and how many of them an entry could have been written for."""
    return targets.groupBy("resolution").agg(
        F.count(F.lit(1)).alias("targets"),
        F.count_if("decidable").alias("decidable"),
        F.sum("incoming").alias("edges"),
    )


def edge_health_sample(targets: DataFrame, cap: int = TOP["edge_health"]) -> DataFrame:
    """The first names of the two findings, each with the size of its population."""
    finding = F.when(F.col("resolution") == "ambiguous", "ambiguous").when(
        (F.col("resolution") == "no-entry") & F.col("decidable"), "decidable-no-entry"
    )
    rows = targets.withColumn("finding", finding).filter(F.col("finding").isNotNull()).select("finding", "target_key")
    from evitrace.operators.coverage import sampled

    return sampled(rows, "finding", ["target_key"], cap)


def incoming(edges: DataFrame, names: list[str], kinds: list[str] | None = None,
             include_heuristic: bool = False) -> DataFrame:
    """Edges that point at any of the names, one row per edge."""
    hit = F.col("target_key").isin(sorted({fold_key(n) for n in names}))
    if kinds is not None:
        hit = hit & F.col("kind").isin(*kinds)
    if not include_heuristic:
        hit = hit & (F.col("assurance") == EXACT)
    return edges.filter(hit)


def _with_lane(rows: DataFrame, entries: DataFrame, lanes) -> DataFrame:
    served = entries.filter(F.col("lane").isin(*lanes)).select(
        F.col("identity").alias("source"), F.col("lane").alias("lifecycle")
    )
    return rows.join(served, "source")


def lane_capped(rows: DataFrame, group: list[str], order: list[str], top: int) -> DataFrame:
    """Each section and lane bucket has its own budget, so neither crowds out the other."""
    window = Window.partitionBy(*group, "is_current").orderBy(*order)
    return (
        rows.withColumn("is_current", F.col("lifecycle").eqNullSafe(CURRENT_LANE))
        .withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top)
    )


def explain(edges: DataFrame, entries: DataFrame, identity: str, full_name: str, lanes=(CURRENT_LANE,),
            include_heuristic: bool = False, top: int = TOP["explain"]) -> DataFrame:
    """What points at an entry: (source, kind, assurance) rows, capped per lane bucket."""
    found = incoming(edges, [identity, full_name], include_heuristic=include_heuristic)
    rows = _with_lane(found, entries, lanes)
    capped = lane_capped(rows, [], ["source", "kind", "assurance", "target"], top)
    return capped.select("source", "kind", "assurance", "lifecycle", "is_current", "rank")


def explain_excluded(edges: DataFrame, entries: DataFrame, identity: str, full_name: str,
                     lanes=(CURRENT_LANE,), include_heuristic: bool = False, top: int = TOP["explain"]) -> DataFrame:
    """What that answer leaves out: heuristic edges, other lanes, rows beyond the cap."""
    found = incoming(edges, [identity, full_name], include_heuristic=True)
    allowed = entries.filter(F.col("lane").isin(*lanes)).select(F.col("identity").alias("source"), F.col("lane").alias("lifecycle"))
    joined = found.join(allowed, "source", "left")
    heuristic = (F.col("assurance") != EXACT) & F.lit(not include_heuristic)
    other = ~heuristic & F.col("lifecycle").isNull()
    kept = ~heuristic & F.col("lifecycle").isNotNull()
    current = kept & (F.col("lifecycle") == CURRENT_LANE)
    beyond = lambda c: F.greatest(F.count_if(c) - top, F.lit(0))
    return joined.agg(
        F.count_if(heuristic).alias("heuristic_edge"),
        F.count_if(other).alias("lifecycle"),
        (beyond(current) + beyond(kept & ~(F.col("lifecycle") == CURRENT_LANE))).alias("cap"),
    )


def section_of(kind: Column) -> Column:
    return F.when(kind == CONTAINMENT, "parts").when(kind.isin(*PERMISSION_KINDS), "permissions").otherwise("incoming")


def section_counts(edges: DataFrame, entries: DataFrame, identity: str, full_name: str, lanes=(CURRENT_LANE,),
                   include_heuristic: bool = False, top: int = TOP["context"]) -> DataFrame:
    """Totals behind an explanation or a pack: edges per section and kind, and what is not shown.

    ``edges`` counts what passes the lanes and the assurance, ``heuristic`` and ``other_lane`` what
    they leave out; ``beyond`` is what a cap of ``top`` per section would leave out of the section,
    lanes apart.
    """
    keep = F.lit(include_heuristic) | (F.col("assurance") == EXACT)
    served = entries.select(F.col("identity").alias("source"), F.col("lane").alias("lifecycle"))
    into = incoming(edges, [identity, full_name], include_heuristic=True).join(served, "source", "left").select(
        section_of(F.col("kind")).alias("section"), "kind", keep.alias("sure"), "lifecycle",
        F.coalesce(F.col("lifecycle").isin(*lanes), F.lit(False)).alias("allowed"),
    )
    out = edges.filter(F.col("source") == identity).select(
        F.lit("outgoing").alias("section"), "kind", keep.alias("sure"), F.lit(None).cast("string").alias("lifecycle"), F.lit(True).alias("allowed")
    )
    shown = F.col("sure") & F.col("allowed")
    # The kinds are a closed vocabulary, so the groups are few and combine inside each task.
    counts = into.unionByName(out).groupBy("section", "kind").agg(
        F.count_if(shown).alias("edges"), F.count_if(~F.col("sure")).alias("heuristic"),
        F.count_if(F.col("sure") & ~F.col("allowed")).alias("other_lane"),
        F.count_if(shown & F.col("lifecycle").eqNullSafe(CURRENT_LANE)).alias("_current"),
    )
    whole = Window.partitionBy("section")
    current, rest = F.sum("_current").over(whole), F.sum(F.col("edges") - F.col("_current")).over(whole)
    beyond = F.greatest(current - top, F.lit(0)) + F.greatest(rest - top, F.lit(0))
    return counts.select("section", "kind", "edges", "heuristic", "other_lane", beyond.alias("beyond"))


def context(edges: DataFrame, entries: DataFrame, identity: str, full_name: str, lanes=(CURRENT_LANE,),
            include_heuristic: bool = False, top: int = TOP["context"]) -> DataFrame:
    """The pack around one entry: parts, permissions, other incoming and outgoing edges.

    Every section is capped per lane bucket; outgoing edges form one list.
    """
    pointing = _with_lane(incoming(edges, [identity, full_name], include_heuristic=include_heuristic), entries, lanes)
    into = lane_capped(pointing.withColumn("section", section_of(F.col("kind"))), ["section"], ["kind", "source", "target"], top)
    out = edges.filter(F.col("source") == identity)
    if not include_heuristic:
        out = out.filter(F.col("assurance") == EXACT)
    order = Window.partitionBy("source").orderBy("kind", "target")
    outgoing = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    shape = ["section", "kind", "source", "target", "assurance", "lifecycle"]
    return into.select(*shape).unionByName(
        outgoing.select(
            F.lit("outgoing").alias("section"), "kind", "source", "target", "assurance",
            F.lit(None).cast("string").alias("lifecycle"),
        )
    )


def capped_edges(edges: DataFrame, component: str, position: str, priorities: dict[str, int], cap: int = 300) -> DataFrame:
    """The collector's edge cap: by priority of kind, then document order, per component."""
    rank = F.lit(50)
    for kind, value in priorities.items():
        rank = F.when(F.col("kind") == kind, value).otherwise(rank)
    order = Window.partitionBy(component).orderBy("priority", position)
    return edges.withColumn("priority", rank).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)


def truncated_families(edges: DataFrame, kept: DataFrame, component: str) -> DataFrame:
    """Kinds a cap dropped, per component, as the difference of two counts."""
    full = edges.groupBy(component, "kind").agg(F.count(F.lit(1)).alias("declared"))
    held = kept.groupBy(component, "kind").agg(F.count(F.lit(1)).alias("kept"))
    joined = full.join(held, [component, "kind"], "left").na.fill(0, ["kept"])
    return joined.filter(F.col("kept") < F.col("declared")).withColumn("dropped", F.col("declared") - F.col("kept"))


def truncation_gaps(truncated: DataFrame, kinds: list[str]) -> DataFrame:
    """Capped families that can hide rows of the asked kinds; an unknown family always counts."""
    asked = set(kinds)
    irrelevant = [
        family for family, hidden in TRUNCATION_FAMILIES.items() if asked and not asked & set(hidden)
    ]
    keep = ~F.col("kind").isin(irrelevant) if irrelevant else F.lit(True)
    return truncated.filter(keep).groupBy("kind").agg(
        F.count(F.lit(1)).alias("sources"), F.sum("dropped").alias("dropped")
    )
