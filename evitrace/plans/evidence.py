"""Registered text, digest, reconciliation, selection, gap and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evitrace.functions import digest as dg
from evitrace.functions import text as tx
from evitrace.operators import features, gaps, matching, reconcile, resolve
from evitrace.plans import sql
from evitrace.plans.corpus import entries
from evitrace.sources import fields
from evitrace.sources.tree import line_range, tree_digest
from evitrace.tables import load


# --- text --------------------------------------------------------------------------------


def html_text(spark, sf):
    pages = load(spark, sf, "pages").select("page_id", "html")
    text = pages.select("page_id", tx.plain_text(F.col("html")).alias("text"))
    return text.select("page_id", F.char_length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha"))


def clause_candidates(spark, sf):
    pages = load(spark, sf, "pages").select("page_id", "html")
    lines = pages.select("page_id", F.posexplode(tx.clauses(F.col("html"))).alias("pos", "line"))
    return lines.select(
        "page_id", (F.col("pos") + 1).alias("ordinal"), F.substring("line", 1, 2000).alias("summary"),
        dg.digest(F.col("line")).alias("text_digest"), dg.digest(tx.clause_key(F.col("line"))).alias("fingerprint"),
    )


def message_fingerprint(spark, sf):
    turns = load(spark, sf, "conversations")
    message = F.concat(F.upper("text"), F.lit("  {!$Record."), "role", F.lit("} \t{!x}!\n"))
    return turns.select("conv_id", "turn", F.sha2(tx.message_fingerprint(message), 256).alias("fingerprint"))


def snippet(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", "text")
    return rows.select("doc_id", tx.snippet(F.col("text"), ["license", "nicht", "the"]).alias("snippet"))


def _requirement_text():
    return F.concat_ws(
        " ", F.concat(F.lit("Flow for"), F.lit("")), F.concat("p_type", F.lit("__c."), F.regexp_replace("p_brand", "#", ""), F.lit("__c")),
        F.lit("uses"), F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.lit("__c")), F.lit("and"),
        F.concat("p_type", F.lit("__c")), F.when(F.col("p_size") > 25, "in a permission set"), "p_name",
    )


def subjects(spark, sf):
    """Names mentioned in a requirement sentence written from each part."""
    rows = load(spark, sf, "part").select("p_partkey", F.explode(tx.subjects(_requirement_text())).alias("s"))
    return rows.select("p_partkey", "s.name", "s.hint")


def classify_answer(spark, sf):
    answer = (
        F.when(F.col("role") == "user", F.concat(F.lit(" Up to you. "), "text"))
        .when(F.col("turn") == 1, " N/A. ").otherwise(F.col("text"))
    )
    return load(spark, sf, "conversations").groupBy("role", tx.classify_answer(answer).alias("answer")).agg(F.count(F.lit(1)).alias("turns"))


def safe_literal(spark, sf):
    """Page addresses, contact strings and long texts as configuration literals."""
    pages = load(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("literal"))
    docs = load(spark, sf, "documents").select(
        (-F.col("doc_id") - 1).alias("id"),
        F.when(F.col("source") == "src1", F.concat("lang", F.lit("@example.org"))).when(F.col("source") == "src2", "10.1.2.3")
        .when(F.col("source") == "src4", F.concat(F.lit("api_key = "), "lang")).when(F.col("source") == "src6", F.sha2("text", 256))
        .otherwise(F.regexp_replace("text", r"[^a-z ]", " ")).alias("literal"),
    )
    return pages.unionByName(docs).select("id", tx.safe_literal(F.col("literal")).alias("kept"))


def section_map(spark, sf):
    """The turns of a conversation as headed sections: their number and the first heading."""
    body = F.concat(F.lit("## Purpose\n"), "text", F.lit("\n## "), "role", F.lit("\n"), F.col("turn").cast("string"))
    rows = load(spark, sf, "conversations").select("conv_id", "turn", tx.body_sections(body).alias("s"))
    return rows.select("conv_id", "turn", F.size("s").alias("sections"), F.element_at("s", "Purpose").alias("purpose"))


# --- digests -----------------------------------------------------------------------------


def canonical_digest(spark, sf):
    nation = load(spark, sf, "nation")
    fields = {"name": F.col("n_name"), "key": F.col("n_nationkey"), "region": F.when(F.col("n_regionkey") > 1, F.col("n_regionkey"))}
    return nation.select("n_nationkey", dg.canonical_digest(fields).alias("digest"))


def corpus_digest(spark, sf):
    """Digest of the whole entry set, whatever its order."""
    files = load(spark, sf, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256")
    )
    return tree_digest(files)


def line_evidence(spark, sf):
    """Lines two to four of every document, numbered."""
    return line_range(load(spark, sf, "documents").select("doc_id", "text"), "text", 2, 4)


# --- reconciliation ----------------------------------------------------------------------


def _sources(spark, sf):
    customers = load(spark, sf, "customer")
    left = customers.filter(F.col("c_acctbal") > -500).select(
        "c_custkey", "c_name", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"),
    )
    right = customers.filter(F.col("c_acctbal") < 9500).select(
        "c_custkey", "c_name", F.when(F.col("c_acctbal") > 8000, F.lit(None)).otherwise(F.col("c_nationkey")).alias("nation"),
        F.when(F.col("c_acctbal") < 500, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("segment"),
    )
    return left, right


def reconcile_fields(spark, sf):
    rows = reconcile.reconcile(*_sources(spark, sf), ["c_custkey"], ["c_name", "nation"], family="segment")
    return rows.withColumn("contested", F.array_join("contested", "|"))


def reconcile_summary(spark, sf):
    left, right = (
        df.join(load(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("home")), "c_custkey") for df in _sources(spark, sf)
    )
    rows = reconcile.reconcile(left, right, ["home", "c_custkey"], ["c_name", "nation"], family="segment")
    return reconcile.summary(rows, ["home"])


def identity_reconciliation(spark, sf):
    """Parts of two sources that lack some parts, codes and names of each other."""
    parts = load(spark, sf, "part").withColumn("shape", F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")))
    code, size = F.col("p_partkey").cast("string"), F.col("p_size")
    named = F.when(size > 10, F.concat_ws("|", "shape", F.upper("p_name")))
    left = parts.filter("p_type <> 'ECONOMY' OR p_size <= 40").select(code.alias("id"), code.alias("code"), named.alias("name"), "shape")
    right = parts.filter("p_brand <> 'Brand#2'").select(
        F.concat(F.lit("R"), code).alias("id"), F.when(size > 35, code).otherwise("").alias("code"), named.alias("name"), "shape")
    return matching.match(left, right, ["code", "name", "shape"])


def formula_chains(spark, sf):
    """Orders as formulas that climb up to fourteen lookups of a tree of customers and name a field."""
    customers = load(spark, sf, "customer").filter("c_custkey > 0")
    name = lambda key: F.concat(F.lit("C"), key.cast("string"))
    targets = customers.select(
        name(F.col("c_custkey")).alias("object"), F.lit("Up").alias("stem"), name(F.shiftright("c_custkey", 1)).alias("target"))
    up = F.repeat(F.lit("Up__r."), (1 + F.col("o_orderkey") % 14).cast("int"))
    formulas = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("component_id"), name(F.col("o_custkey")).alias("object_name"),
        F.concat(F.lit("IF("), up, F.lit("Name <> '', "), up, F.lit("Rank__c, Total__c)")).alias("formula"))
    return fields.formula_references(formulas, targets)


def _packages(spark, sf):
    parts = load(spark, sf, "part")
    version = F.concat_ws(".", F.lit("1"), F.col("p_size").cast("string"))
    left = parts.select("p_brand", "p_name", version.alias("version"))
    right = parts.select("p_brand", "p_name", F.when(F.col("p_size") > 48, F.concat(version, F.lit(".1"))).otherwise(version).alias("version"))
    return left, right


def package_difference(spark, sf):
    return reconcile.compare_lists(*_packages(spark, sf))


def package_status(spark, sf):
    return reconcile.list_status(*_packages(spark, sf))


def type_families(spark, sf):
    """Type labels of both sources built from the parts' vocabulary, folded to families."""
    parts = load(spark, sf, "part")
    noun = F.substring_index("p_name", " ", -1)
    catalog = F.when(noun == "bolt", "Lookup( )").when(noun == "gear", "Formula (Number)").when(noun == "ring", "Date/Time").when(
        noun == "widget", "Multi-Select Picklist").when(noun == "plate", "Name").otherwise(F.concat("p_type", F.lit("  X")))
    described = F.when(noun == "bolt", "reference").when(noun == "gear", "Double").when(noun == "ring", "DateTime").otherwise(F.col("p_type"))
    return parts.groupBy(
        reconcile.catalog_family(catalog).alias("catalog"), reconcile.describe_family(described).alias("described")
    ).agg(F.count(F.lit(1)).alias("parts"))


def schema_digest(spark, sf):
    return reconcile.schema_digest(load(spark, sf, "conversations"), "conv_id", "turn", "role")


# --- selection ---------------------------------------------------------------------------


def _selection(spark, sf):
    parts = load(spark, sf, "part")
    path = F.concat_ws("/", F.lit("force-app"), "p_brand", "p_type", F.concat("p_name", F.lit(".part-meta.xml")))
    components = parts.select(
        F.concat(F.lit("Part:"), F.col("p_partkey").cast("string")).alias("component_id"),
        F.when(F.col("p_type") == "PROMO", "AuraDefinitionBundle").otherwise("Part").alias("metadata_type"),
        F.col("p_name").alias("name"), path.alias("path"),
    )
    asked = lambda kind, column, df=parts: df.select(F.lit(kind).alias("kind"), column.alias("input")).distinct()
    inputs = (
        asked("path", F.concat(F.lit("/work/"), F.upper(path)))
        .unionByName(asked("path", F.concat_ws("/", F.lit("./force-app"), "p_brand", "p_type")))
        .unionByName(asked("path", F.regexp_replace(path, "-meta.xml$", "")))
        .unionByName(asked("path", F.concat_ws("/", F.lit("force-app"), "p_brand", F.lit("PROMO/helper.js"))))
        .unionByName(asked("path", F.concat(F.lit("force-app/notes/"), "p_brand")))
        .unionByName(asked("path", F.concat(F.lit("src/../"), "p_brand")))
        .unionByName(asked("name", F.upper("p_name")))
        .unionByName(asked("name", F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))))
        .unionByName(asked("name", F.concat("p_brand", F.lit("?"))))
    )
    generic = parts.select(F.concat(F.lit("force-app/notes/"), "p_brand").alias("path")).filter(~F.col("path").endswith("7"))
    return inputs, components, generic


def resolve_selection(spark, sf):
    return resolve.resolve(*_selection(spark, sf))[0]


def resolve_matches(spark, sf):
    return resolve.resolve(*_selection(spark, sf))[1]


def suggestions(spark, sf):
    """Close part names for three misspelt ones; the matching ratio has no SQL form."""
    return resolve.suggestions(["smal rings", "hot gaer", "zzzz"], _selection(spark, sf)[1]).drop("rank")


# --- gaps --------------------------------------------------------------------------------


def _design(spark, sf):
    """Orders as criteria, returned lines as plan items on parts, suppliers' parts as discovery."""
    orders, lines, parts = (load(spark, sf, t) for t in ("orders", "lineitem", "part"))
    criteria = orders.select(F.col("o_orderkey").cast("string").alias("ac_ref"))
    plan = lines.filter(F.col("l_returnflag") == "R").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("item_id"), F.col("l_orderkey").cast("string").alias("ac_ref"),
        F.col("l_partkey").cast("string").alias("subject"),
        F.when(F.col("l_linestatus") == "O", "create").otherwise("reuse").alias("action"),
        F.when(F.col("l_discount") > 0.05, "Flow").otherwise("ApexClass").alias("artifact"),
    )
    results = parts.select(
        F.col("p_partkey").cast("string").alias("subject"),
        F.when(F.col("p_size") > 40, "pending").when(F.col("p_size") > 30, "no-entry").otherwise("found").alias("result"),
        F.when(F.col("p_type") == "PROMO", "package").otherwise("local").alias("ownership"),
        F.when(F.col("p_brand") == "Brand#7", "ns").otherwise("").alias("namespace"),
    )
    return criteria, plan, results


def gap_sets(spark, sf):
    """All open gaps of the design: undiscovered subjects, uncovered criteria, ungrounded items."""
    criteria, plan, results = _design(spark, sf)
    rows = gaps.discovery(plan, results).unionByName(gaps.uncovered(criteria, plan)).unionByName(gaps.ungrounded(plan, results))
    return rows.groupBy("gap_id", "kind").agg(F.count(F.lit(1)).alias("items"))


def submit_blockers(spark, sf):
    _, plan, results = _design(spark, sf)
    return gaps.submit_blockers(plan, results).groupBy("subject", "action", "result").agg(F.count(F.lit(1)).alias("items"))


def _checklist(spark, sf):
    _, plan, results = _design(spark, sf)
    matrix = spark.createDataFrame(
        [("Flow:create", "MP-FLOW-1"), ("Flow:*", "MP-FLOW-2"), ("ApexClass:reuse", "MP-APEX-1"), ("ApexClass:delete", "MP-APEX-9")],
        "cell string, rule_id string",
    )
    limits = results.filter(F.col("ownership") == "package").select(F.concat(F.lit("LIM:"), "subject", F.lit(":1")).alias("item_id"))
    return gaps.triggered(plan, matrix, ["SAFE-1"], limits)


def rule_triggers(spark, sf):
    return _checklist(spark, sf)


def verify_gaps(spark, sf):
    verdicts = load(spark, sf, "part").filter(F.col("p_size") > 5).select(
        F.concat(F.lit("LIM:"), F.col("p_partkey").cast("string"), F.lit(":1")).alias("item_id"),
        F.when(F.col("p_size") > 45, "maybe").when(F.col("p_size") > 20, "violation").otherwise("ok").alias("verdict"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("sentence"),
        F.when(F.col("p_brand") > "Brand#2", F.col("p_brand")).otherwise("").alias("addressed_by"),
    )
    return gaps.verification(_checklist(spark, sf), verdicts)


def scope_uncovered(spark, sf):
    """Parts of a scope against bound entries: the part itself or the brand that owns it."""
    parts = load(spark, sf, "part")
    owner = F.regexp_replace("p_brand", "#", "_")
    components = parts.select(
        F.when(F.col("p_type") == "PROMO", "Letterhead").when(F.col("p_size") > 45, "object").otherwise("CustomField").alias("type"),
        F.when(F.col("p_size") > 45, owner).otherwise(F.concat_ws(".", owner, "p_name")).alias("name"),
    )
    bound = parts.filter(F.col("p_retailprice") > 1080).select(
        F.explode(F.array(
            F.struct(F.lit("CustomObject").alias("type"), F.when(F.col("p_size") < 10, owner).otherwise("none").alias("name")),
            F.struct(F.lit("CustomField").alias("type"), F.concat_ws(".", owner, "p_name").alias("name")),
        )).alias("b")
    ).select("b.type", "b.name")
    return gaps.scope_uncovered(components, bound, ["CustomField", "CustomObject"])


# --- features ----------------------------------------------------------------------------


def _feature(spark, sf):
    """Each line status as one feature: parts and suppliers as nodes, lines as relations,
    orders as bindings, customers as claims that depend on orders and on one another."""
    none = F.array().cast("array<string>")
    slugs = F.explode(F.array(F.lit("open-lines"), F.lit("filled-lines"))).alias("slug")
    parts, suppliers, orders, lines, customers = (load(spark, sf, t) for t in ("part", "supplier", "orders", "lineitem", "customer"))
    ident = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    nodes = parts.select(
        slugs, ident("FN-P", "p_partkey").alias("id"), F.when(F.col("p_size") < 25, "artifact").otherwise("concept").alias("kind"),
        F.when(F.col("p_type") != "SMALL", F.col("p_name")).alias("artifact_id"),
        F.when(F.col("p_brand") == "Brand#9", "other").otherwise("core").alias("role"),
        F.when(F.col("p_size") > 10, "note").alias("role_note"),
        F.when(F.col("p_size") == 7, F.array(ident("FC-", "p_partkey"))).otherwise(none).alias("evidence"),
        (F.col("p_size") > 47).alias("tombstoned"),
    ).unionByName(suppliers.select(
        slugs, ident("FN-S", "s_suppkey").alias("id"), F.lit("concept").alias("kind"), F.lit(None).cast("string").alias("artifact_id"),
        F.lit("core").alias("role"), F.lit(None).cast("string").alias("role_note"), none.alias("evidence"), (F.col("s_acctbal") < 0).alias("tombstoned"),
    ))
    relations = lines.select(
        F.when(F.col("l_linestatus") == "O", "open-lines").otherwise("filled-lines").alias("slug"),
        F.concat_ws("-", F.lit("FR"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        ident("FN-P", "l_partkey").alias("from_id"), ident("FN-S", "l_suppkey").alias("to_id"),
        F.when(F.col("l_tax") > 0.04, "source-exact").otherwise("human-attested").alias("assurance"),
        F.when(F.col("l_quantity") > 10, F.array(ident("FB-", "l_orderkey"))).otherwise(none).alias("evidence"),
        (F.col("l_returnflag") != "R").alias("tombstoned"),
    )
    claims = customers.select(
        slugs, ident("FC-", "c_custkey").alias("id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "data-relationship").otherwise("feature-purpose").alias("type"),
        F.when(F.col("c_acctbal") > 5000, "human-attested").when(F.col("c_acctbal") > 1000, "source-exact").otherwise("unresolved").alias("authority"),
        F.when(F.col("c_acctbal") > 500, "citable-after-approval").otherwise("never-citable").alias("citation_policy"),
        F.when(F.col("c_nationkey") > 5, F.array(ident("FB-", "c_custkey"))).otherwise(none).alias("evidence"),
        F.array(F.concat(F.lit("FC-"), (F.col("c_custkey") + 1).cast("string"))).alias("depends_on"),
        F.lit(False).alias("tombstoned"),
    )
    bindings = orders.select(slugs, ident("FB-", "o_orderkey").alias("id"), (F.col("o_orderstatus") == "P").alias("tombstoned"))
    return nodes, relations, claims, bindings


def feature_violations(spark, sf):
    rows = features.violations(*_feature(spark, sf))
    return rows.groupBy("slug", "id", "problem", "detail").agg(F.count(F.lit(1)).alias("copies"))


def feature_operations(spark, sf):
    """Events as an operation log on users' documents: the last write per user and type wins."""
    log = load(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("slug"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("id"),
        F.when(F.col("value") < 3, "remove").otherwise("set").alias("op"), F.col("value").cast("string").alias("payload"), F.col("event_id").alias("sequence"),
    )
    return features.apply_operations(log).drop("payload")


def feature_citations(spark, sf):
    """Claims cited by the events of a feature: one feature per customer segment."""
    customers, orders = load(spark, sf, "customer"), load(spark, sf, "orders")
    claims = customers.select(
        F.col("c_mktsegment").alias("slug"), F.col("c_custkey").cast("string").alias("id"),
        F.when(F.col("c_acctbal") > 3000, "source-exact").otherwise("unresolved").alias("authority"),
        F.when(F.col("c_acctbal") > 1000, "citable-after-approval").otherwise("never-citable").alias("citation_policy"),
    )
    placed = orders.join(customers.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("slug")), "o_custkey")
    closure = placed.select("slug", F.col("o_custkey").cast("string").alias("claim_id"), F.col("o_orderkey").cast("string").alias("binding_id"))
    bindings = placed.select(
        "slug", F.col("o_orderkey").cast("string").alias("binding_id"), F.col("o_orderkey").cast("string").alias("entry_id"),
        F.when(F.col("o_totalprice") > 300000, "old").otherwise(F.col("o_orderstatus")).alias("bound_digest"),
    )
    current = orders.filter(F.col("o_orderpriority") != "1-URGENT").select(F.col("o_orderkey").cast("string").alias("entry_id"), F.col("o_orderstatus").alias("digest"))
    lanes = customers.groupBy(F.col("c_mktsegment").alias("slug")).agg(F.count(F.lit(1)).cast("string").alias("digest")).select(
        "slug", F.when(F.col("slug") == "MACHINERY", "draft").otherwise("approved-current").alias("lane"),
        (F.col("slug") == "HOUSEHOLD").alias("invalid"), "digest",
    )
    requests = customers.select(
        "c_mktsegment", "c_custkey", "c_acctbal").select(
        F.col("c_mktsegment").alias("slug"),
        F.when(F.col("c_acctbal") > 9000, F.concat(F.lit("X"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string")).alias("claim_id"),
        F.when(F.col("c_acctbal") < -800, "other").alias("pinned_digest"),
    )
    return features.citation_verdicts(requests, lanes, claims, closure, bindings, current)


def feature_search(spark, sf):
    """Sources that hold a French document and an approved one with a text in it."""
    rows = entries(spark, sf)
    nodes = rows.select(F.col("family").alias("slug"), F.col("namespace").alias("layer"), (F.col("lane") == "revoked").alias("tombstoned"))
    claims = rows.select(F.col("family").alias("slug"), F.col("lane").alias("type"), F.col("purpose").alias("text"), (F.col("lane") == "draft").alias("tombstoned"))
    return features.search(nodes, claims, layer="fr", claim_type="approved-current", text="license")


QUERIES = {f.__name__: f for f in (
    html_text, clause_candidates, message_fingerprint, snippet, subjects, classify_answer, safe_literal, section_map,
    canonical_digest, corpus_digest, line_evidence, formula_chains, identity_reconciliation, reconcile_fields, reconcile_summary, package_difference, package_status,
    type_families, schema_digest, resolve_selection, resolve_matches, suggestions, gap_sets, submit_blockers, rule_triggers,
    verify_gaps, scope_uncovered, feature_violations, feature_operations, feature_citations, feature_search,
)}

_PLAIN = "html"
for _pattern, _replacement in (
    ("(?i)<\\s*(br|/p|/div|/li|/tr)\\s*/?>", "chr(10)"), ("<[^>]*>", "' '"), ("(?i)&nbsp;", "' '"), ("(?i)&amp;", "'&'"), ("(?i)&lt;", "'<'"),
    ("(?i)&gt;", "'>'"), ("(?i)&quot;", "'\"'"), ("(?i)&#39;", "''''"), ("[ \\t]+", "' '"),
):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_pattern}', {_replacement}, 'g')"
_TRIMJ = "regexp_replace({}, '^[\\s\\v ]+|[\\s\\v ]+$', '', 'g')"
_LINES = f"list_filter(list_transform(string_split({_PLAIN}, chr(10)), lambda x: {_TRIMJ.format('x')}), lambda x: x <> '')"
_SRC = """a AS (SELECT c_custkey, c_name, c_nationkey AS nation, c_mktsegment AS segment FROM customer WHERE c_acctbal > -500),
b AS (SELECT c_custkey, c_name, CASE WHEN c_acctbal > 8000 THEN NULL ELSE c_nationkey END AS nation,
  CASE WHEN c_acctbal < 500 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment FROM customer WHERE c_acctbal < 9500),
j AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS k, a.c_custkey IS NOT NULL AS ha, b.c_custkey IS NOT NULL AS hb, a.c_name AS an, b.c_name AS bn,
  a.nation AS ai, b.nation AS bi, a.segment AS s1, b.segment AS s2 FROM a FULL JOIN b ON a.c_custkey = b.c_custkey),
r AS (SELECT k AS c_custkey, CASE WHEN ha AND hb AND an IS DISTINCT FROM bn THEN NULL WHEN ha THEN an ELSE bn END AS c_name,
  CASE WHEN ha AND hb AND ai IS DISTINCT FROM bi THEN NULL WHEN ha THEN ai ELSE bi END AS nation, coalesce(s1, s2, 'other:unknown') AS segment,
  concat_ws('|', CASE WHEN ha AND hb AND an IS DISTINCT FROM bn THEN 'c_name' END, CASE WHEN ha AND hb AND ai IS DISTINCT FROM bi THEN 'nation' END,
    CASE WHEN ha AND hb AND s1 IS DISTINCT FROM s2 THEN 'segment' END) AS contested,
  CASE WHEN ha THEN 'available' ELSE 'missing' END AS left_coverage, CASE WHEN hb THEN 'available' ELSE 'missing' END AS right_coverage FROM j)"""
_PKG = """l AS (SELECT p_brand, p_name, '1.' || p_size AS version FROM part),
r AS (SELECT p_brand, p_name, '1.' || p_size || CASE WHEN p_size > 48 THEN '.1' ELSE '' END AS version FROM part),
d AS (SELECT p_brand, p_name, version, sum(x)::BIGINT AS left_count, sum(y)::BIGINT AS right_count FROM (
  SELECT *, 1 AS x, 0 AS y FROM l UNION ALL SELECT *, 0, 1 FROM r) GROUP BY 1, 2, 3)"""
_SEL = """c AS (SELECT 'Part:' || p_partkey AS component_id, p_type = 'PROMO' AS bundle, p_name AS name, p_brand, p_type,
  'force-app/' || p_brand || '/' || p_type || '/' || p_name || '.part-meta.xml' AS path FROM part),
i AS (SELECT DISTINCT kind, input, k FROM (
  SELECT 'path' AS kind, '/work/' || upper(path) AS input, lower(path) AS k FROM c
  UNION ALL SELECT 'path', './force-app/' || p_brand || '/' || p_type, lower('force-app/' || p_brand || '/' || p_type) FROM c
  UNION ALL SELECT 'path', replace(path, '-meta.xml', ''), lower(replace(path, '-meta.xml', '')) FROM c
  UNION ALL SELECT 'path', 'force-app/' || p_brand || '/PROMO/helper.js', lower('force-app/' || p_brand || '/PROMO/helper.js') FROM c
  UNION ALL SELECT 'path', 'force-app/notes/' || p_brand, lower('force-app/notes/' || p_brand) FROM c
  UNION ALL SELECT 'path', 'src/../' || p_brand, NULL FROM c
  UNION ALL SELECT 'name', upper(name), lower(name) FROM c
  UNION ALL SELECT 'name', 'part:' || replace(component_id, 'Part:', ''), lower(component_id) FROM c
  UNION ALL SELECT 'name', p_brand || '?', lower(p_brand || '?') FROM c)),
m AS (
  SELECT kind, input, 1 AS tier, component_id, path FROM i JOIN c ON kind = 'path' AND k = lower(path)
  UNION SELECT kind, input, 2, component_id, path FROM i JOIN c ON kind = 'path' AND ends_with(k, '-meta.xml') AND replace(k, '-meta.xml', '') = lower(path)
  UNION SELECT kind, input, 3, component_id, path FROM i JOIN c ON kind = 'path' AND k || '-meta.xml' = lower(path)
  UNION SELECT kind, input, 4, NULL, NULL FROM i JOIN c ON kind = 'path' AND k = lower('force-app/notes/' || p_brand) AND NOT ends_with(p_brand, '7')
  UNION SELECT kind, input, 5, component_id, path FROM i JOIN c ON kind = 'path' AND bundle AND starts_with(k, lower('force-app/' || p_brand || '/' || p_type || '/'))
  UNION SELECT kind, input, 6, component_id, path FROM i JOIN c ON kind = 'path' AND starts_with(lower(path), k || '/')
  UNION SELECT kind, input, 7, component_id, path FROM i JOIN c ON kind = 'name' AND k IN (lower(name), lower(component_id), lower(name || '.part-meta.xml'), lower(name || '.part-meta'))),
t AS (SELECT kind, input, tier, count(component_id) AS n, count(DISTINCT path) AS f FROM m GROUP BY 1, 2, 3),
w AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY kind, input ORDER BY tier) = 1),
s AS (SELECT i.kind AS kind, i.input AS input, CASE WHEN i.kind = 'path' AND k IS NULL THEN 'unsupported' WHEN tier = 4 THEN 'unsupported' WHEN n IS NULL THEN 'unmatched'
   WHEN n = 1 THEN 'resolved' WHEN i.kind = 'name' AND f > 1 THEN 'ambiguous' WHEN n > 25 THEN 'unsupported' ELSE 'expanded' END AS resolution,
  coalesce(n, 0) AS matches, tier FROM i LEFT JOIN w ON i.kind = w.kind AND i.input = w.input)"""
_PLAN = """plan AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS item_id, l_orderkey::VARCHAR AS ac_ref, l_partkey::VARCHAR AS subject,
  CASE WHEN l_linestatus = 'O' THEN 'create' ELSE 'reuse' END AS action, CASE WHEN l_discount > 0.05 THEN 'Flow' ELSE 'ApexClass' END AS artifact
  FROM lineitem WHERE l_returnflag = 'R'),
res AS (SELECT p_partkey::VARCHAR AS subject, CASE WHEN p_size > 40 THEN 'pending' WHEN p_size > 30 THEN 'no-entry' ELSE 'found' END AS result,
  p_type = 'PROMO' AS package, p_brand = 'Brand#7' AS ns, p_size FROM part)"""
_CHECK = _PLAN + """, matrix(artifact, action, rule) AS (VALUES ('Flow', 'create', 'MP-FLOW-1'), ('Flow', '*', 'MP-FLOW-2'), ('ApexClass', 'reuse', 'MP-APEX-1'), ('ApexClass', 'delete', 'MP-APEX-9')),
items AS (SELECT DISTINCT rule AS item_id, 'rule' AS item_kind FROM plan p JOIN matrix m ON p.artifact = m.artifact AND (m.action = '*' OR m.action = p.action)
  UNION SELECT 'SAFE-1', 'rule' UNION SELECT 'LIM:' || subject || ':1', 'limitation' FROM res WHERE package)"""
_FEAT = """slugs(slug) AS (VALUES ('open-lines'), ('filled-lines')),
nodes AS (SELECT slug, 'FN-P' || p_partkey AS id, p_size, p_type, p_brand, p_partkey, true AS part FROM part, slugs WHERE p_size <= 47
  UNION ALL SELECT slug, 'FN-S' || s_suppkey, NULL, NULL, NULL, NULL, false FROM supplier, slugs WHERE s_acctbal >= 0),
rels AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'open-lines' ELSE 'filled-lines' END AS slug, 'FR-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id,
  'FN-P' || l_partkey AS f, 'FN-S' || l_suppkey AS t, l_tax > 0.04 AS exact, CASE WHEN l_quantity > 10 THEN 'FB-' || l_orderkey END AS ev FROM lineitem WHERE l_returnflag = 'R'),
claims AS (SELECT slug, 'FC-' || c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'data-relationship' ELSE 'feature-purpose' END AS type,
  CASE WHEN c_acctbal > 5000 THEN 'human-attested' WHEN c_acctbal > 1000 THEN 'source-exact' ELSE 'unresolved' END AS authority, c_acctbal > 500 AS citable,
  CASE WHEN c_nationkey > 5 THEN 'FB-' || c_custkey END AS ev, 'FC-' || (c_custkey + 1) AS dep FROM customer, slugs),
binds AS (SELECT slug, 'FB-' || o_orderkey AS id FROM orders, slugs WHERE o_orderstatus <> 'P'),
p AS (
  SELECT slug, id, 'artifact node without artifact' AS problem, 'artifact' AS detail FROM nodes WHERE part AND p_size < 25 AND p_type = 'SMALL'
  UNION ALL SELECT slug, id, 'other role without note', 'other' FROM nodes WHERE p_brand = 'Brand#9' AND p_size <= 10
  UNION ALL SELECT n.slug, n.id, 'evidence claim does not exist', 'FC-' || p_partkey FROM nodes n WHERE p_size = 7 AND NOT EXISTS (SELECT 1 FROM claims c WHERE c.slug = n.slug AND c.id = 'FC-' || p_partkey)
  UNION ALL SELECT r.slug, r.id, 'from node does not exist', f FROM rels r WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.slug = r.slug AND n.id = f)
  UNION ALL SELECT r.slug, r.id, 'to node does not exist', t FROM rels r WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.slug = r.slug AND n.id = t)
  UNION ALL SELECT r.slug, r.id, 'binding does not exist', ev FROM rels r WHERE ev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM binds b WHERE b.slug = r.slug AND b.id = ev)
  UNION ALL SELECT slug, id, 'exact relation without binding', 'source-exact' FROM rels WHERE exact AND ev IS NULL
  UNION ALL SELECT c.slug, c.id, 'dependency does not exist', dep FROM claims c WHERE NOT EXISTS (SELECT 1 FROM claims d WHERE d.slug = c.slug AND d.id = c.dep)
  UNION ALL SELECT c.slug, c.id, 'binding does not exist', ev FROM claims c WHERE ev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM binds b WHERE b.slug = c.slug AND b.id = ev)
  UNION ALL SELECT slug, id, 'type needs source evidence', type FROM claims WHERE authority = 'human-attested' AND type = 'data-relationship'
  UNION ALL SELECT slug, id, 'exact claim without binding', authority FROM claims WHERE authority = 'source-exact' AND ev IS NULL
  UNION ALL SELECT slug, id, 'inferred claim must not be citable', authority FROM claims WHERE authority = 'unresolved' AND citable)"""
_NOUN = "regexp_extract(p_name, '[^ ]*$')"

def _tier_sql(n, tier):
    """Pairs of tier ``n`` and the rows that are left after it."""
    return f"""p{n} AS MATERIALIZED (SELECT min(id) FILTER (side = 'left') AS l, min(id) FILTER (side = 'right') AS r, '{tier}' AS tier FROM r{n} WHERE {tier} <> ''
  GROUP BY {tier} HAVING count(*) FILTER (side = 'left') = 1 AND count(*) FILTER (side = 'right') = 1),
r{n + 1} AS MATERIALIZED (SELECT * FROM r{n} WHERE NOT (side = 'left' AND id IN (SELECT l FROM p{n})) AND NOT (side = 'right' AND id IN (SELECT r FROM p{n})))"""


ORACLE = {
    "formula_chains": """WITH o AS (SELECT o_orderkey AS component_id, o_custkey AS k, (1 + o_orderkey % 14)::INTEGER AS n FROM orders),
h AS (SELECT component_id, k, n, unnest(range(n))::INTEGER AS i FROM o),
known AS (SELECT component_id, k >> n AS top FROM h GROUP BY component_id, k, n
  HAVING bool_and((k >> i) IN (SELECT c_custkey FROM customer WHERE c_custkey > 0)))
SELECT component_id, 'C' || top || field AS target FROM known, (VALUES ('.Name'), ('.Rank__c')) f(field)
UNION ALL SELECT component_id, 'C' || k || '.Total__c' FROM o""",
    "identity_reconciliation": f"""WITH RECURSIVE parts AS (SELECT *, concat_ws('|', p_brand, p_type, p_size) AS shape FROM part),
n AS (SELECT *, CASE WHEN p_size > 10 THEN shape || '|' || upper(p_name) END AS name FROM parts),
r0 AS MATERIALIZED (SELECT 'left' AS side, p_partkey::VARCHAR AS id, p_partkey::VARCHAR AS code, name, shape FROM n WHERE p_type <> 'ECONOMY' OR p_size <= 40
  UNION ALL SELECT 'right', 'R' || p_partkey, CASE WHEN p_size > 35 THEN p_partkey::VARCHAR END, name, shape FROM n WHERE p_brand <> 'Brand#2'),
{_tier_sql(0, 'code')}, {_tier_sql(1, 'name')}, {_tier_sql(2, 'shape')},
k AS (SELECT side || ':' || id AS node, side, 'c' || code AS key FROM r3 WHERE code IS NOT NULL UNION ALL SELECT side || ':' || id, side, 'n' || name FROM r3 WHERE name IS NOT NULL
  UNION ALL SELECT side || ':' || id, side, 's' || shape FROM r3 WHERE shape IS NOT NULL),
links AS MATERIALIZED (SELECT node, key FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING count(DISTINCT side) = 2)),
reach AS (SELECT DISTINCT node, node AS other FROM links UNION SELECT reach.node, b.node FROM reach JOIN links a ON a.node = other JOIN links b USING (key)),
c AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
m AS (FROM p0 UNION ALL FROM p1 UNION ALL FROM p2)
SELECT side, id, CASE WHEN component IS NULL THEN 'alone' ELSE 'contested' END AS status, NULL::VARCHAR AS tier, NULL::VARCHAR AS partner, component
FROM r3 LEFT JOIN c ON node = side || ':' || id
UNION ALL SELECT 'left', l, 'matched', tier, r, NULL FROM m UNION ALL SELECT 'right', r, 'matched', tier, l, NULL FROM m""",
    "html_text": f"WITH t AS (SELECT page_id, array_to_string({_LINES}, chr(10)) AS text FROM pages) SELECT page_id, length(text)::INTEGER AS n_chars, sha256(text) AS text_sha FROM t",
    "clause_candidates": f"""WITH l AS (SELECT page_id, list_filter(list_transform({_LINES}, lambda x: {_TRIMJ.format("regexp_replace(x, '^[\\s]*([-*•]|[0-9]+[.)])[\\s]*', '')")}), lambda x: length(x) > 2) AS ls FROM pages),
e AS (SELECT page_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS ordinal FROM l)
SELECT page_id, ordinal::INTEGER AS ordinal, left(line, 2000) AS summary, 'sha256:' || sha256(line) AS text_digest,
 'sha256:' || sha256(trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g'))) AS fingerprint FROM e""",
    "message_fingerprint": """SELECT conv_id, turn, sha256(replace(lower(trim(regexp_replace(regexp_replace(upper(text) || '  {!$Record.' || role || '} ' || chr(9) || '{!x}!' || chr(10),
 '\\{![^}]*\\}', chr(65532), 'g'), '\\s+', ' ', 'g'))), 'ß', 'ss')) AS fingerprint FROM conversations""",
    "snippet": """WITH t AS (SELECT doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS b FROM documents),
p AS (SELECT *, length(b) AS n, lower(b) AS lo FROM t),
q AS (SELECT *, CASE WHEN contains(lo, 'license') THEN strpos(lo, 'license') - 1 + 3 WHEN contains(lo, 'nicht') THEN strpos(lo, 'nicht') - 1 + 2
  WHEN contains(lo, 'the') THEN strpos(lo, 'the') - 1 + 1 END AS centre FROM p),
w AS (SELECT *, CASE WHEN centre IS NULL THEN 240 ELSE least(n, greatest(0, centre - 120) + 240) END AS e0 FROM q),
x AS (SELECT *, CASE WHEN centre IS NULL THEN 0 ELSE greatest(0, e0 - 240) END AS s0 FROM w),
y AS (SELECT *, CASE WHEN s0 > 0 AND strpos(substr(b, s0 + 1, e0 - s0), ' ') > 0 THEN s0 + strpos(substr(b, s0 + 1, e0 - s0), ' ') ELSE s0 END AS s1 FROM x),
z AS (SELECT *, CASE WHEN e0 < n AND strpos(reverse(substr(b, s1 + 1, e0 - s1)), ' ') > 0 AND e0 - strpos(reverse(substr(b, s1 + 1, e0 - s1)), ' ') > s1
  THEN e0 - strpos(reverse(substr(b, s1 + 1, e0 - s1)), ' ') ELSE e0 END AS e1 FROM y)
SELECT doc_id, CASE WHEN b = '' OR starts_with(b, '<AGENT_') THEN NULL WHEN n <= 240 THEN b
 ELSE CASE WHEN s1 > 0 THEN '…' ELSE '' END || trim(substr(b, s1 + 1, e1 - s1)) || CASE WHEN e1 < n THEN '…' ELSE '' END END AS snippet FROM z""",
    "subjects": """SELECT p_partkey, p_type || '__c.' || replace(p_brand, '#', '') || '__c' AS name, 'object-member' AS hint FROM part
UNION ALL SELECT p_partkey, 'P' || p_partkey || '__c', 'api-name' FROM part UNION ALL SELECT p_partkey, 'Flow', 'artefact-type' FROM part
UNION ALL SELECT p_partkey, 'PermissionSet', 'artefact-type' FROM part WHERE p_size > 25""",
    "classify_answer": """WITH a AS (SELECT role, CASE WHEN role = 'user' THEN ' Up to you. ' || text WHEN turn = 1 THEN ' N/A. ' ELSE text END AS t FROM conversations),
s AS (SELECT role, rtrim(lower(trim(t)), '.!') AS t FROM a)
SELECT role, CASE WHEN t IN ('', 'n/a', 'na', 'unknown', 'tbd', '-', '?') THEN 'non-answer' WHEN contains(t, 'up to you') THEN 'delegated' ELSE 'complete' END AS answer, count(*) AS turns
FROM s GROUP BY 1, 2""",
    "safe_literal": """WITH x AS (SELECT page_id AS id, url AS literal FROM pages UNION ALL SELECT -doc_id - 1, CASE source WHEN 'src1' THEN lang || '@example.org' WHEN 'src2' THEN '10.1.2.3'
 WHEN 'src4' THEN 'api_key = ' || lang WHEN 'src6' THEN sha256(text) ELSE regexp_replace(text, '[^a-z ]', ' ', 'g') END FROM documents), t AS (SELECT id, trim(literal) AS l FROM x)
SELECT id, CASE WHEN l = '' THEN NULL WHEN contains(l, '://') THEN lower(regexp_extract(l, '://([^/?#:]*)', 1))
 WHEN regexp_matches(l, '(?i)\\b(password|passwd|secret|token|api[_-]?key|bearer|authorization|client[_-]?secret)\\b') OR regexp_matches(l, '[A-Za-z0-9+/=_-]{40,}')
   OR regexp_matches(l, '[\\w.+-]+@[\\w-]+\\.[\\w.-]+') OR regexp_matches(l, '\\b\\d{1,3}(\\.\\d{1,3}){3}\\b') THEN NULL
 WHEN length(l) > 200 THEN substr(l, 1, 199) || '…' ELSE l END AS kept FROM t""",
    "section_map": "SELECT conv_id, turn, 2 AS sections, trim(text, chr(32) || chr(9) || chr(10)) AS purpose FROM conversations",
    "canonical_digest": """SELECT n_nationkey, 'sha256:' || sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '","region":' || coalesce(CASE WHEN n_regionkey > 1 THEN n_regionkey::VARCHAR END, 'null') || '}') AS digest FROM nation""",
    "corpus_digest": """WITH f AS (SELECT sha256(source || '/' || doc_id || chr(10) || sha256(text)) AS h FROM documents)
SELECT count(*) AS files, 'sha256:' || sha256(concat_ws(' ', count(*), sum(('0x' || substr(h, 1, 15))::BIGINT), sum(('0x' || substr(h, 16, 15))::BIGINT),
 sum(('0x' || substr(h, 31, 15))::BIGINT), sum(('0x' || substr(h, 46, 15))::BIGINT))) AS digest FROM f""",
    "line_evidence": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text FROM l)
SELECT doc_id, line::INTEGER AS line, text FROM e WHERE line BETWEEN 2 AND 4""",
    "reconcile_fields": f"WITH {_SRC} SELECT * FROM r",
    "reconcile_summary": f"""WITH {_SRC}, h AS (SELECT r.*, c_nationkey AS home, CASE WHEN contested = '' THEN 0 ELSE len(string_split(contested, '|')) END AS n FROM r JOIN customer c ON r.c_custkey = c.c_custkey)
SELECT home, count(*) AS fields, sum(n)::BIGINT AS contested_properties, count(*) FILTER (left_coverage = 'missing') AS right_only,
 count(*) FILTER (right_coverage = 'missing') AS left_only, CASE WHEN max(n) > 0 THEN 'MISMATCH' ELSE 'MATCH' END AS status FROM h GROUP BY home""",
    "package_difference": f"WITH {_PKG} SELECT * FROM d WHERE left_count <> right_count",
    "package_status": f"""WITH {_PKG} SELECT sum(left_count)::BIGINT AS left_rows, sum(right_count)::BIGINT AS right_rows, count(*) FILTER (left_count <> right_count) AS differing,
 CASE WHEN count(*) FILTER (left_count <> right_count) > 0 THEN 'MISMATCH' ELSE 'VERIFIED' END AS status FROM d""",
    "type_families": f"""SELECT CASE {_NOUN} WHEN 'bolt' THEN 'id' WHEN 'gear' THEN 'number' WHEN 'ring' THEN 'datetime' WHEN 'widget' THEN 'multipicklist' WHEN 'plate' THEN 'text' ELSE 'other:' || lower(p_type) || '-x' END AS catalog,
 CASE {_NOUN} WHEN 'bolt' THEN 'reference' WHEN 'gear' THEN 'number' WHEN 'ring' THEN 'datetime' ELSE 'other:' || lower(p_type) END AS described, count(*) AS parts FROM part GROUP BY 1, 2""",
    "schema_digest": """SELECT conv_id, count(*) AS fields, 'sha256:' || sha256('[' || string_agg('{"name":"' || turn || '","typeFamily":"' || role || '"}', ',' ORDER BY turn::VARCHAR, role) || ']') AS schema_digest,
 'VERIFIED' AS status FROM conversations GROUP BY conv_id""",
    "resolve_selection": f"WITH {_SEL} SELECT kind, input, resolution, matches, tier FROM s",
    "resolve_matches": f"WITH {_SEL} SELECT s.kind AS kind, s.input AS input, component_id FROM s JOIN m ON s.kind = m.kind AND s.input = m.input AND s.tier = m.tier WHERE resolution IN ('resolved', 'expanded', 'ambiguous')",
    "gap_sets": f"""WITH {_PLAN}, ok AS (SELECT subject FROM res WHERE result IN ('found', 'no-entry')), g AS (
  SELECT DISTINCT 'discovery:' || subject AS gap_id, 'discovery' AS kind FROM plan ANTI JOIN ok USING (subject)
  UNION ALL SELECT 'plan:' || o_orderkey, 'plan' FROM orders WHERE o_orderkey::VARCHAR NOT IN (SELECT ac_ref FROM plan)
  UNION ALL SELECT 'plan:' || item_id || ':ungrounded', 'plan' FROM plan ANTI JOIN ok USING (subject))
SELECT gap_id, kind, count(*) AS items FROM g GROUP BY 1, 2""",
    "submit_blockers": f"""WITH {_PLAN} SELECT subject, action, result, count(*) AS items FROM plan JOIN res USING (subject)
WHERE action = 'create' AND (package OR ns) AND result <> 'found' GROUP BY 1, 2, 3""",
    "rule_triggers": f"WITH {_CHECK} SELECT item_id, item_kind FROM items",
    "verify_gaps": f"""WITH {_CHECK}, v AS (SELECT 'LIM:' || p_partkey || ':1' AS item_id, CASE WHEN p_size > 45 THEN 'maybe' WHEN p_size > 20 THEN 'violation' ELSE 'ok' END AS verdict,
  p_size % 2 = 0 AS said, p_brand > 'Brand#2' AS addressed FROM part WHERE p_size > 5),
x AS (SELECT i.item_id AS item_id, CASE WHEN verdict IS NULL THEN 'no verdict' WHEN verdict = 'maybe' THEN 'not a verdict' WHEN NOT said THEN 'no sentence'
  WHEN verdict = 'violation' AND NOT addressed THEN 'unaddressed' END AS why FROM items i LEFT JOIN v ON i.item_id = v.item_id)
SELECT 'verify:' || item_id || CASE WHEN why = 'unaddressed' THEN ':unaddressed' ELSE '' END AS gap_id, 'verify' AS kind, why FROM x WHERE why IS NOT NULL""",
    "scope_uncovered": """WITH c AS (SELECT DISTINCT CASE WHEN p_type = 'PROMO' THEN 'Letterhead' WHEN p_size > 45 THEN 'object' ELSE 'CustomField' END AS type,
  CASE WHEN p_size > 45 THEN replace(p_brand, '#', '_') ELSE replace(p_brand, '#', '_') || '.' || p_name END AS name FROM part),
b AS (SELECT DISTINCT 'CustomObject' AS t, replace(p_brand, '#', '_') AS n FROM part WHERE p_retailprice > 1080 AND p_size < 10
  UNION SELECT 'CustomField', replace(p_brand, '#', '_') || '.' || p_name FROM part WHERE p_retailprice > 1080)
SELECT type, name, CASE WHEN type = 'Letterhead' THEN 'no entry profile' ELSE 'not covered' END AS problem FROM c WHERE type = 'Letterhead'
 OR NOT EXISTS (SELECT 1 FROM b WHERE (t = CASE WHEN type = 'object' THEN 'CustomObject' ELSE type END AND n = name) OR (t = 'CustomObject' AND contains(name, '.') AND n = split_part(name, '.', 1)))""",
    "feature_violations": f"WITH {_FEAT} SELECT slug, id, problem, detail, count(*) AS copies FROM p GROUP BY 1, 2, 3, 4",
    "feature_operations": """WITH e AS (SELECT *, json_extract_string(props, '$.k') AS id FROM events)
SELECT user_id::VARCHAR AS slug, event_type AS kind, id, event_id AS sequence, value < 3 AS tombstoned FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type, id ORDER BY event_id DESC) = 1""",
    "feature_citations": """WITH o AS (SELECT c_mktsegment AS slug, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'unknown' WHEN o_totalprice > 300000 THEN 'drifted' ELSE 'current' END AS state
  FROM orders JOIN customer ON o_custkey = c_custkey),
sel AS (SELECT slug, o_custkey, count(*) FILTER (state = 'drifted') AS d, count(*) FILTER (state = 'unknown') AS u, count(*) FILTER (state <> 'current') AS st FROM o GROUP BY 1, 2),
al AS (SELECT slug, count(*) FILTER (state <> 'current') AS st FROM o GROUP BY 1),
req AS (SELECT c_mktsegment AS slug, CASE WHEN c_acctbal > 9000 THEN 'X' || c_custkey ELSE c_custkey::VARCHAR END AS claim_id, c_acctbal < -800 AS pinned, c_acctbal > 9000 AS unknown_id,
  c_acctbal, c_custkey FROM customer)
SELECT r.slug AS slug, claim_id, CASE WHEN r.slug = 'HOUSEHOLD' THEN 'invalid' WHEN r.slug = 'MACHINERY' THEN 'not-approved' WHEN pinned THEN 'superseded' WHEN unknown_id THEN 'unknown-id'
  WHEN c_acctbal <= 3000 THEN 'not-citable' WHEN coalesce(sel.d, 0) > 0 THEN 'drifted' WHEN coalesce(sel.u, 0) > 0 THEN 'unknown'
  WHEN coalesce(al.st, 0) - coalesce(sel.st, 0) > 0 THEN 'degraded' ELSE 'current' END AS verdict
FROM req r LEFT JOIN sel ON sel.slug = r.slug AND sel.o_custkey = r.c_custkey LEFT JOIN al ON al.slug = r.slug""",
    "feature_search": f"""WITH {sql.ENTRIES} SELECT DISTINCT family AS slug FROM entries WHERE family IN (SELECT family FROM entries WHERE namespace = 'fr' AND lane <> 'revoked')
AND family IN (SELECT family FROM entries WHERE lane = 'approved-current') AND family IN (SELECT family FROM entries WHERE lane <> 'draft' AND contains(lower(purpose), 'license'))""",
}
