"""Search: hard filters, then a mode (identity, text, structured, message or relation)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evitrace.functions.analyze import analyze_text, fold_key, fold_name
from evitrace.functions.text import MERGE_MARK, fingerprint_text, message_fingerprint, snippet
from evitrace.operators import rank
from evitrace.operators.facets import Facet, matches, parse
from evitrace.session import cut_lineage
from evitrace.vocab import CURRENT_LANE, EXACT, TOP


@dataclass
class Request:
    """What the caller asks; every filter is optional."""

    text: str | None = None
    identity: str | None = None
    lanes: tuple[str, ...] = (CURRENT_LANE,)
    metadata_type: str | None = None
    namespace: str | None = None
    facets: list[str] = field(default_factory=list)
    top: int = TOP["search"]

    @property
    def terms(self) -> list[str]:
        return rank.distinct_terms(analyze_text(self.text)) if self.text else []


@dataclass
class Corpus:
    """Entries with their declared facets and token fields.

    ``entries`` carries ``identity``, ``full_name``, ``metadata_type``, ``namespace``, ``lane``
    and ``purpose``; ``fields`` maps the ranking fields to the text columns they index. Where
    lanes come from another table, ``texts`` are the entries before that join and ``lanes`` is
    ``(lane_key, lane)``: texts are then analysed first and only narrow rows are joined.
    """

    entries: DataFrame
    facets: dict[str, Facet]
    fields: dict[str, Column]
    texts: DataFrame | None = None
    lanes: DataFrame | None = None
    lane_key: str = "identity"


@dataclass
class Prepared:
    """One pass over the texts for one query: narrow rows per entry, and the statistics row."""

    rows: DataFrame
    stats: DataFrame


def stage_filters(corpus: Corpus, request: Request) -> dict[str, Column]:
    """The hard filters in the order their exclusions are reported."""
    stages = {"lifecycle": F.col("lane").isin(*request.lanes)}
    if request.metadata_type:
        stages["metadataType"] = F.coalesce(
            fold_name(F.col("metadata_type")) == fold_key(request.metadata_type), F.lit(False)
        )
    if request.namespace == "c":
        stages["scope"] = F.col("namespace").isNull()
    elif request.namespace is not None:
        stages["scope"] = F.coalesce(
            fold_name(F.col("namespace")) == fold_key(request.namespace), F.lit(False)
        )
    for expression in request.facets:
        stages[f"facet:{expression}"] = matches(corpus.facets, [expression])
    return stages


def _needs_lane(corpus: Corpus, stage: str) -> bool:
    return stage.startswith("facet:") and corpus.facets[parse(stage[len("facet:"):], corpus.facets).key].needs_lane


def candidate(corpus: Corpus, request: Request) -> Column:
    keep = F.lit(True)
    for stage in stage_filters(corpus, request).values():
        keep = keep & stage
    return keep


def excluded_counts(corpus: Corpus, request: Request) -> DataFrame:
    """How many entries each hard filter dropped, counted where it first fails: one pass."""
    still = F.lit(True)
    counters = []
    for name, stage in stage_filters(corpus, request).items():
        counters.append(
            F.struct(F.lit(name).alias("stage"), F.count_if(still & ~stage).alias("excluded"))
        )
        still = still & stage
    counters.append(F.struct(F.lit("kept").alias("stage"), F.count_if(still).alias("excluded")))
    return corpus.entries.agg(F.array(*counters).alias("c")).select(F.inline("c"))


def prepare(corpus: Corpus, request: Request) -> Prepared:
    """Counts the query's terms in every entry and writes the counts.

    Texts are read and analysed once and never shuffled: what is written holds the counts, the
    outcome of the filters and, for entries with a hit, the excerpt. Statistics, lanes, scores
    and both result lists come from that narrow table.
    """
    narrow = ["identity", "full_name", "metadata_type", "_passes"]
    source = corpus.entries if corpus.texts is None else corpus.texts
    passes, later = F.lit(True), F.lit(True)
    for name, stage in stage_filters(corpus, request).items():
        if name == "lifecycle" or _needs_lane(corpus, name):
            later = later & stage
        else:
            passes = passes & stage
    narrow.append("lane" if corpus.lanes is None else corpus.lane_key)
    narrow = list(dict.fromkeys(narrow))
    counted = rank.term_frequencies(
        source.withColumn("_passes", passes), corpus.fields, request.terms, [*narrow, "purpose"]
    )
    hit = F.exists("tf", lambda per_term: F.exists(per_term, lambda n: n > 0))
    rows = cut_lineage(counted.select(
        *narrow, "lens", "tf", F.when(hit, snippet(F.col("purpose"), request.terms)).alias("snippet")
    ))
    if corpus.lanes is not None:
        rows = rows.join(corpus.lanes, corpus.lane_key, "left").withColumn("lane", F.coalesce("lane", F.lit("draft")))
    rows = rows.withColumn("_candidate", F.col("_passes") & later)
    stats = rank.corpus_statistics(rows, corpus.fields, request.terms, F.col("_candidate"))
    return Prepared(rows, stats)


def query_terms(corpus: Corpus, request: Request) -> DataFrame:
    """Term statistics of the query; they describe the whole corpus, whatever the filters."""
    return rank.query_term_statistics(prepare(corpus, request).stats, request.terms)


def text_search(corpus: Corpus, request: Request, prepared: Prepared | None = None) -> DataFrame:
    """Top hits by text. Empty when every term that scored is too common to rank anything."""
    prepared = prepared or prepare(corpus, request)
    ranked = rank.scored(prepared.rows.filter("_candidate"), corpus.fields, request.terms, prepared.stats)
    useful = rank.discriminates(F.col("_s"), len(request.terms))
    return rank.top(ranked, request.top).filter(useful).select(
        "identity", "full_name", "metadata_type", F.col("lane").alias("lifecycle"), "score",
        rank.matched_on(corpus.fields, request.terms).alias("matched_on"), "snippet",
        F.lit("structured-plus-lexical" if request.facets else "lexical").alias("match_class"),
    )


def draft_search(corpus: Corpus, request: Request, prepared: Prepared | None = None) -> DataFrame:
    """The draft lane ranked on its own; the two lists are never merged."""
    prepared = prepared or prepare(corpus, request)
    drafts = prepared.rows.filter(F.col("lane") == "draft")
    ranked = rank.scored(drafts, corpus.fields, request.terms, prepared.stats)
    best = ranked.orderBy(F.desc("score"), "identity").limit(request.top).filter(F.col("score") > 0)
    return best.select(
        "identity", F.col("lane").alias("lifecycle"), F.round("score", 4).alias("score"),
        rank.matched_on(corpus.fields, request.terms).alias("matched_on"), F.lit("draft-lane").alias("match_class"),
    )


def structured_search(corpus: Corpus, request: Request) -> DataFrame:
    """No text: the first entries by identity that pass the hard filters."""
    return (
        corpus.entries.filter(candidate(corpus, request))
        .select("identity", "full_name", "metadata_type", F.col("lane").alias("lifecycle"))
        .orderBy("identity")
        .limit(request.top)
    )


def identity_search(corpus: Corpus, request: Request) -> DataFrame:
    """Exact identity or case-folded full name.

    More than one identity without a namespace is ambiguous: every candidate is listed and none
    is ranked.
    """
    wanted = (F.col("identity") == request.identity) | (
        fold_name(F.col("full_name")) == fold_key(request.identity)
    )
    hits = corpus.entries.filter(candidate(corpus, request) & wanted).select("identity", "lane")
    distinct = hits.agg(F.count_distinct("identity").alias("n")).scalar()
    outcome = F.when(F.lit(request.namespace is None) & (distinct > 1), "AMBIGUOUS").otherwise("OK")
    return hits.select("identity", F.col("lane").alias("lifecycle"), outcome.alias("outcome"))


def message_key() -> Column:
    """Key of a declared message: its element, template and resolved text together."""
    return F.sha2(F.concat_ws("\x1f", "element", "template", "resolved"), 256)


def needle_key() -> Column:
    return F.sha2(F.col("needle"), 256)


def message_search(messages: DataFrame, needles: DataFrame) -> DataFrame:
    """Which declared messages a pasted text is, by the first of four tiers that matches.

    ``messages``: identity, element, template, resolved. ``needles``: needle_id, needle. Distinct
    texts meet distinct messages: a row is (needle_key, message_key, match, needles, messages) with
    the number of rows on either side, so n copies pasted into m declarations are one row and not
    n times m. :func:`expand_messages` lists members. Each tier is an equi-join on its own key;
    hashing the keys keeps whole texts out of the shuffle and the equality is checked again on
    the text itself.
    """
    messages = messages.withColumn("message_key", message_key()).groupBy("message_key").agg(
        F.count(F.lit(1)).alias("messages"), F.min(F.struct("element", "template", "resolved")).alias("m")
    ).select("message_key", "messages", "m.*")
    needles = needles.withColumn("needle_key", needle_key()).groupBy("needle_key").agg(
        F.count(F.lit(1)).alias("needles"), F.min("needle").alias("needle")
    )
    # Whole texts are compared; edges are trimmed the way the message was entered.
    blank = " \t\n\r\x0b\x0c"
    trimmed = lambda c: F.btrim(F.col(c), F.lit(blank))
    left = messages.select(
        "message_key", "messages",
        F.explode(F.array_compact(F.array(
            F.struct(F.lit(1).alias("tier"), trimmed("template").alias("key")),
            F.when(F.col("resolved") != "", F.struct(F.lit(2).alias("tier"), trimmed("resolved").alias("key"))),
            F.when(F.col("element") != "", F.struct(F.lit(3).alias("tier"), F.col("element").alias("key"))),
            F.struct(F.lit(4).alias("tier"), message_fingerprint(F.col("template")).alias("key")),
            F.when(F.col("resolved") != "", F.struct(F.lit(4).alias("tier"), message_fingerprint(F.col("resolved")).alias("key"))),
        ))).alias("k"),
    ).select("message_key", "messages", "k.tier", "k.key", F.xxhash64("k.tier", "k.key").alias("h"))
    asked = needles.select(
        "needle_key", "needles",
        F.explode(F.array(
            *[F.struct(F.lit(t).alias("n_tier"), trimmed("needle").alias("n_key")) for t in (1, 2, 3)],
            F.struct(F.lit(4).alias("n_tier"), message_fingerprint(trimmed("needle")).alias("n_key")),
        )).alias("k"),
    ).select("needle_key", "needles", "k.n_tier", "k.n_key", F.xxhash64("k.n_tier", "k.n_key").alias("n_h"))
    asked = asked.filter(~((F.col("n_tier") == 4) & F.col("n_key").isin("", MERGE_MARK)))
    hits = left.join(
        asked,
        (F.col("h") == F.col("n_h")) & (F.col("tier") == F.col("n_tier")) & (F.col("key") == F.col("n_key")),
    )
    names = F.element_at(
        F.array(*[F.lit(n) for n in (
            "exact-source-message", "exact-resolved-label", "element-api-name", "safe-fingerprint",
        )]),
        F.col("tier"),
    )
    return (
        hits.groupBy("needle_key", "message_key", "needles", "messages").agg(F.min("tier").alias("tier"))
        .select("needle_key", "message_key", names.alias("match"), "needles", "messages")
    )


def expand_messages(matches: DataFrame, messages: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle_id, identity, element, match) of matches whose members a caller wants to see."""
    asked = needles.select("needle_id", needle_key().alias("needle_key"))
    declared = messages.select("identity", "element", message_key().alias("message_key"))
    return matches.join(asked, "needle_key").join(declared, "message_key").select("needle_id", "identity", "element", "match")


def relation_search(edges: DataFrame, entries: DataFrame, anchor: str, direction: str = "incoming",
                    kind: str | None = None, include_heuristic: bool = False,
                    lanes: tuple[str, ...] = (CURRENT_LANE,)) -> DataFrame:
    """Edges at an anchor, one row per edge, restricted to sources in the given lanes."""
    keep = F.lit(True) if include_heuristic else F.col("assurance") == EXACT
    if kind:
        keep = keep & (F.col("kind") == kind)
    if direction == "incoming":
        chosen = edges.filter(keep & (F.col("target_key") == fold_key(anchor)))
    else:
        chosen = edges.filter(keep)
    served = entries.filter(F.col("lane").isin(*lanes)).select(
        F.col("identity").alias("source"), "full_name", F.col("lane").alias("lifecycle")
    )
    if direction == "outgoing":
        key = fold_key(anchor)
        served = served.filter((fold_name(F.col("source")) == key) | (fold_name(F.col("full_name")) == key))
    return chosen.join(served, "source").select("source", "kind", "target", "assurance", "lifecycle")
