"""How the given tables stand in for entries, messages, components and edges."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evitrace.functions.analyze import fold_name
from evitrace.operators.facets import Facet
from evitrace.operators.graph import name_keys
from evitrace.operators.search import Corpus
from evitrace.session import cut_lineage, require_checkpoint_dir
from evitrace.sources import generation
from evitrace.sources.tree import fingerprint
from evitrace.tables import load
from evitrace.vocab import CONTAINMENT, EXACT, HEURISTIC


def lane_of_labels() -> "F.Column":
    """Lane of a document from its label row (null row: nobody reviewed it)."""
    return (
        F.when(F.col("toxic") == 1, "revoked")
        .when(F.col("quality") == 1, "approved-current")
        .when(F.col("quality") == 0, "approved-drifted")
        .otherwise("draft")
    )


def identity_of(doc_id="doc_id") -> "F.Column":
    return F.concat_ws(":", F.lit("Document"), "lang", F.concat_ws(".", "source", F.col(doc_id).cast("string")))


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(
        identity_of().alias("identity"),
        F.concat_ws(".", "source", F.col("doc_id").cast("string")).alias("full_name"),
        F.lit("Document").alias("metadata_type"),
        F.col("lang").alias("namespace"),
        F.col("source").alias("family"),
        F.concat(F.lit("documents/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_path"),
        "n_chars",
        F.col("text").alias("purpose"),
        "doc_id",
    )


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lane per labelled document; the others are drafts."""
    return load(spark, sf_dir, "labels").select("doc_id", lane_of_labels().alias("lane"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries, with the lane their labels give them.

    Queries over the narrow columns shuffle those alone; whatever reads the text starts from
    :func:`corpus` and joins lanes afterwards.
    """
    joined = _texts(load(spark, sf_dir, "documents")).join(lanes(spark, sf_dir), "doc_id", "left")
    return joined.withColumn("lane", F.coalesce("lane", F.lit("draft")))


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    rows = entries(spark, sf_dir)
    texts = _texts(load(spark, sf_dir, "documents"))
    fields = {
        "identity": F.concat_ws(" ", "identity", "full_name"),
        "label": F.substring_index("purpose", "\n", 1),
        "purpose": F.col("purpose"),
        "attribute": F.concat_ws(" ", "metadata_type", "full_name", "namespace", "family"),
        "relationTarget": F.col("family"),
        "sourcePath": F.col("source_path"),
    }
    return Corpus(rows, facets_of(rows), fields, texts, lanes(spark, sf_dir), "doc_id")


def facets_of(rows: DataFrame) -> dict[str, Facet]:
    declared = {
        "metadataType": ("string", F.col("metadata_type")),
        "fullName": ("string", F.col("full_name")),
        "namespace": ("string", F.col("namespace")),
        "family": ("string", F.col("family")),
        "sourcePath": ("string", F.col("source_path")),
        "effectiveState": ("string", F.col("lane")),
        "document.length": ("number", F.col("n_chars")),
        "document.reviewed": ("boolean", F.col("lane") != "draft"),
        "document.words": ("list", F.split("purpose", "[ \n]")),
    }
    with_lane = ("effectiveState", "document.reviewed")
    return {key: Facet(key, kind, column, key in with_lane) for key, (kind, column) in declared.items()}


# --- the table graph ---------------------------------------------------------------------


def _ident(kind: str, full: "F.Column") -> "F.Column":
    return F.concat(F.lit(f"{kind}:c:"), full)


def graph_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the star's dimensions and orders as an entry: identity, full_name, lane.

    Nations are qualified by their region, so a bare nation name resolves by member; parts share
    names, so a part name is ambiguous.
    """
    region = load(spark, sf_dir, "region")
    nation = load(spark, sf_dir, "nation")
    customer = load(spark, sf_dir, "customer")
    supplier = load(spark, sf_dir, "supplier")
    part = load(spark, sf_dir, "part")
    orders = load(spark, sf_dir, "orders")
    # Region and nation are fixed dimensions; the join key is the region's primary key.
    named = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    qualified = F.concat_ws(".", "r_name", "n_name")
    key = F.col("p_partkey").cast("string")

    def current(identity, full_name):
        return identity.alias("identity"), full_name.alias("full_name"), F.lit("approved-current").alias("lane")

    blocks = [
        region.select(*current(_ident("Region", F.col("r_name")), F.col("r_name"))),
        named.select(*current(_ident("Nation", qualified), qualified)),
        customer.select(
            _ident("Customer", F.col("c_name")).alias("identity"), F.col("c_name").alias("full_name"),
            F.when(F.col("c_acctbal") < 0, "approved-drifted").otherwise("approved-current").alias("lane"),
        ),
        supplier.select(
            _ident("Supplier", F.col("s_name")).alias("identity"), F.col("s_name").alias("full_name"),
            F.when(F.col("s_acctbal") < 0, "revoked").otherwise("approved-current").alias("lane"),
        ),
        part.select(*current(F.concat(F.lit("Part:"), key, F.lit(":"), "p_name"), F.col("p_name"))),
        orders.select(
            _ident("Order", F.col("o_orderkey").cast("string")).alias("identity"),
            F.col("o_orderkey").cast("string").alias("full_name"),
            F.when(F.col("o_orderstatus") == "P", "draft").otherwise("approved-current").alias("lane"),
        ),
    ]
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block)
    return out


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between those entries, each target spelled the way its row spells it."""
    region = load(spark, sf_dir, "region")
    nation = load(spark, sf_dir, "nation")
    customer = load(spark, sf_dir, "customer")
    supplier = load(spark, sf_dir, "supplier")
    part = load(spark, sf_dir, "part")
    orders = load(spark, sf_dir, "orders")
    lineitem = load(spark, sf_dir, "lineitem")
    named = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    qualified = F.concat_ws(".", "r_name", "n_name")
    bare_nation = lambda c: F.concat(F.lit("NATION_"), F.col(c).cast("string"))

    def edge(source, kind, target, assurance=EXACT, plain=False):
        """``plain``: the target is a fixed word and a number, which folds without Python."""
        return (
            source.alias("source"), F.lit(kind).alias("kind"), target.alias("target"),
            F.lit(assurance).alias("assurance"), fold_name(target, exact=not plain).alias("target_key"),
        )

    order_id = lambda c: _ident("Order", F.col(c).cast("string"))
    numbered = lambda label, c: F.concat(F.lit(f"{label}#"), F.lpad(F.col(c).cast("string"), 9, "0"))
    blocks = [
        named.select(*edge(_ident("Nation", qualified), CONTAINMENT, F.col("r_name"))),
        customer.select(*edge(_ident("Customer", F.col("c_name")), CONTAINMENT, bare_nation("c_nationkey"), plain=True)),
        supplier.select(*edge(_ident("Supplier", F.col("s_name")), CONTAINMENT, bare_nation("s_nationkey"), plain=True)),
        part.select(*edge(F.concat(F.lit("Part:"), F.col("p_partkey").cast("string"), F.lit(":"), "p_name"),
                          "references-field", F.concat(F.col("p_brand"), F.lit("__c")))),
        part.select(*edge(F.concat(F.lit("Part:"), F.col("p_partkey").cast("string"), F.lit(":"), "p_name"),
                          "relationship", F.col("p_name"))),
        orders.select(*edge(order_id("o_orderkey"), CONTAINMENT, numbered("Customer", "o_custkey"), plain=True)),
        lineitem.select(*edge(order_id("l_orderkey"), "invokes-class", numbered("Supplier", "l_suppkey"), HEURISTIC, plain=True)),
    ]
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block)
    return out


def stored_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, entries, name keys) as tables of the shared folder, written once per state of the files.

    Edges lie sorted by target and names by key, so that a lookup of a few reads a few row groups.
    The state is told by the files' names, sizes and times; a table that was not finished is
    written again.
    """
    base = sf_dir.rstrip("/")
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{base}/{n}.parquet" for n in names])
    state = [base, *map(str, fingerprint(files.select(F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))).first())]
    home = f"{require_checkpoint_dir(spark).rstrip('/')}/graph-{hashlib.sha256('|'.join(state).encode()).hexdigest()[:16]}"
    if generation.read_mark(spark, home) is None:
        found = graph_entries(spark, sf_dir)
        found.write.mode("overwrite").parquet(f"{home}/entries")
        # Dividing by ranges reads its rows twice: folded names are written before.
        cut_lineage(graph_edges(spark, sf_dir)).repartitionByRange("target_key", "source").sortWithinPartitions("target_key").write.mode("overwrite").parquet(f"{home}/edges")
        keys = cut_lineage(name_keys(generation.read_back(spark, home, "entries")))
        keys.repartitionByRange("key", "identity").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{home}/names")
        generation.write_mark(spark, home, "|".join(state))
    return tuple(generation.read_back(spark, home, n) for n in ("edges", "entries", "names"))
