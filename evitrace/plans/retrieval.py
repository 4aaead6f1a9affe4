"""Registered retrieval queries: search, term statistics, facets, identities, messages, index."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from evitrace.operators import postings, rank, search
from evitrace.operators.search import Request
from evitrace.plans import sql
from evitrace.plans.corpus import corpus, entries, facets_of
from evitrace.tables import load
from evitrace.vocab import LANES

QUERY = Request(text="License nicht avec", top=10)
COMMON = Request(text="the in zzqxv", top=10)
NARROW = Request(
    text="license the", lanes=("approved-current", "approved-drifted"),
    facets=["namespace:in=en|fr", "document.length:gte=400"], top=10,
)
HARD = Request(
    lanes=("approved-current", "approved-drifted"), metadata_type="document", namespace="en",
    facets=["family:prefix=src1", "document.length:lte=3000"],
)


def _served(hits):
    return hits.select(
        "identity", "lifecycle", "score", F.array_join("matched_on", "|").alias("matched_on")
    )


def search_text(spark, sf):
    return _served(search.text_search(corpus(spark, sf), QUERY))


def search_faceted(spark, sf):
    return _served(search.text_search(corpus(spark, sf), NARROW))


def term_stats(spark, sf):
    return search.query_terms(corpus(spark, sf), Request(text="the License nicht avec zzqxv"))


def discrimination_guard(spark, sf):
    """Candidates score on common words only, so nothing is served."""
    c = corpus(spark, sf)
    prepared = search.prepare(c, COMMON)
    served = search.text_search(c, COMMON, prepared).agg(F.count(F.lit(1)).alias("served")).scalar()
    s = F.struct(*prepared.stats.columns)
    return prepared.stats.select(
        rank.discriminates(s, len(COMMON.terms)).alias("discriminating"),
        F.array_max("candidate_df").alias("best_candidate_df"),
        served.alias("served"),
    )


def draft_side_lane(spark, sf):
    return _served(search.draft_search(corpus(spark, sf), QUERY))


def excluded_counts(spark, sf):
    return search.excluded_counts(corpus(spark, sf), HARD)


def structured_search(spark, sf):
    return search.structured_search(corpus(spark, sf), HARD)


def _facet(expression):
    def run(spark, sf):
        rows = entries(spark, sf)
        hit = search.matches(facets_of(rows), [expression])
        return rows.filter(hit).select("identity", "lane", "n_chars")

    run.__doc__ = f"Entries whose facet satisfies {expression}."
    return run


FACETS = {
    "facet_eq": "namespace:eq=FR",
    "facet_in": "family:in=src3|SRC17|none",
    "facet_exists": "family:exists=",
    "facet_prefix": "sourcePath:prefix=documents/src1/",
    "facet_has": "fullName:has=c7.",
    "facet_gte": "document.length:gte=2500",
    "facet_lte": "document.length:lte=120.5",
    "facet_boolean": "document.reviewed:eq=TRUE",
    "facet_list_has": "document.words:has=pathetic",
    "facet_list_prefix": "document.words:prefix=einun",
}


def identity_lookup(spark, sf):
    return search.identity_search(corpus(spark, sf), Request(identity="src11.31", lanes=LANES))


def ambiguous_identity(spark, sf):
    """Full names held by several identities: the part names of the star."""
    from evitrace.plans.corpus import graph_entries

    twins = graph_entries(spark, sf).groupBy("full_name").agg(F.count_distinct("identity").alias("candidates"), F.min("identity").alias("first_candidate"))
    return twins.filter(F.col("candidates") > 1)


def error_tiers(spark, sf):
    """Pasted benchmark passages against declared messages: the conversation turns and the
    passages themselves in upper case with wider blanks, so that every tier can match."""
    turns = load(spark, sf, "conversations")
    passages = load(spark, sf, "benchmark")
    spoken = turns.select(
        F.concat_ws(":", F.lit("Turn"), "conv_id", "turn").alias("identity"),
        F.concat_ws("_", "role", F.col("turn").cast("string")).alias("element"),
        F.col("text").alias("template"), F.lit("").alias("resolved"),
    )
    declared = passages.select(
        F.concat(F.lit("Passage:"), F.col("item_id").cast("string")).alias("identity"),
        F.concat(F.lit("Show_"), F.col("item_id").cast("string")).alias("element"),
        F.concat(F.lit("  "), F.translate("text", ascii_lowercase, ascii_uppercase), F.lit("\n")).alias("template"),
        F.when(F.char_length("text") > 200, F.col("text")).otherwise("").alias("resolved"),
    )
    needles = passages.select(
        F.concat(F.lit("P"), F.col("item_id").cast("string")).alias("needle_id"),
        F.col("text").alias("needle"),
    ).unionByName(turns.filter(F.col("role") == "user").select(
        F.concat_ws(":", F.lit("T"), "conv_id", "turn").alias("needle_id"), F.col("text").alias("needle"),
    )).unionByName(passages.select(
        F.concat(F.lit("E"), F.col("item_id").cast("string")).alias("needle_id"),
        F.concat(F.lit("Show_"), F.col("item_id").cast("string")).alias("needle"),
    ))
    return search.message_search(spoken.unionByName(declared), needles)


def posting_stats(spark, sf):
    c = corpus(spark, sf)
    return postings.document_frequency(c.texts, c.fields)


def token_postings(spark, sf):
    """Postings of the documents' prose: token, entry, frequency."""
    c = corpus(spark, sf)
    only = {k: c.fields[k] for k in ("label", "purpose", "attribute")}
    rows = postings.token_postings(c.texts, only)
    return rows.groupBy("field", "token").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("tf").cast("bigint")).alias("occurrences"),
        F.max("tf").cast("bigint").alias("highest"),
    )


def avg_field_len(spark, sf):
    c = corpus(spark, sf)
    return postings.field_lengths(c.texts, c.fields)


def facet_postings(spark, sf):
    rows = entries(spark, sf)
    facets = {k: F.col(c) for k, c in (("namespace", "namespace"), ("family", "family"), ("effectiveState", "lane"))}
    return postings.facet_postings(rows, facets).groupBy("facet", "value").agg(
        F.count(F.lit(1)).alias("entries"), F.min("identity").alias("first_identity")
    )


def manifest_counts(spark, sf):
    """Entries by lane (every lane, zero-filled), by namespace and by family."""
    rows = entries(spark, sf)
    by_lane = postings.zero_filled(
        rows.groupBy(F.col("lane").alias("value")).agg(F.count(F.lit(1)).alias("entries")), "value", list(LANES)
    ).select(F.lit("lane").alias("dimension"), "value", "entries")
    grouped = rows.select(
        F.explode(F.array(
            F.struct(F.lit("namespace").alias("dimension"), F.col("namespace").alias("value")),
            F.struct(F.lit("family").alias("dimension"), F.col("family").alias("value")),
            F.struct(F.lit("metadataType").alias("dimension"), F.col("metadata_type").alias("value")),
        )).alias("d")
    ).groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("entries"))
    return by_lane.unionByName(grouped)


QUERIES = {
    "search_text": search_text,
    "search_faceted": search_faceted,
    "term_stats": term_stats,
    "discrimination_guard": discrimination_guard,
    "draft_side_lane": draft_side_lane,
    "excluded_counts": excluded_counts,
    "structured_search": structured_search,
    **{name: _facet(expression) for name, expression in FACETS.items()},
    "identity_lookup": identity_lookup,
    "ambiguous_identity": ambiguous_identity,
    "error_tiers": error_tiers,
    "posting_stats": posting_stats,
    "token_postings": token_postings,
    "avg_field_len": avg_field_len,
    "facet_postings": facet_postings,
    "manifest_counts": manifest_counts,
}


def _facet_sql(where):
    return f"WITH {sql.ENTRIES} SELECT identity, lane, n_chars FROM entries WHERE {where}"


_WORDS = "string_split_regex(purpose, '[ \n]')"
_FP = r"trim(regexp_replace(regexp_replace({}, '\{{![^}}]*\}}', chr(65532), 'g'), '[\s]+', ' ', 'g'))"
_TRIM = r"regexp_replace({}, '^[\s]+|[\s]+$', '', 'g')"


def _fp(c):
    return "replace(lower(" + _FP.format(c) + "), 'ß', 'ss')"


ORACLE = {
    "search_text": sql.bm25("license", "nicht", "avec") + """
SELECT id AS identity, lane AS lifecycle, score, matched_on FROM scores WHERE lane = 'approved-current' AND score > 0
ORDER BY score DESC, id LIMIT 10""",
    "search_faceted": sql.bm25("license", "the") + """
SELECT id AS identity, scores.lane AS lifecycle, score, matched_on FROM scores JOIN entries ON identity = id
WHERE scores.lane IN ('approved-current', 'approved-drifted') AND namespace IN ('en', 'fr') AND n_chars >= 400 AND score > 0
ORDER BY score DESC, id LIMIT 10""",
    "term_stats": sql.bm25("the", "license", "nicht", "avec", "zzqxv") + """
SELECT term, df::BIGINT AS document_frequency, n::BIGINT AS corpus_size, round(idf, 4) AS idf, df > 0 AS matched,
       n >= 4 AND df >= 0.5 * n AS saturated FROM idf""",
    "discrimination_guard": sql.bm25("the", "in", "zzqxv") + """,
cdf AS (SELECT term, count(DISTINCT id) AS c FROM tf JOIN entries ON identity = id WHERE lane = 'approved-current' GROUP BY term),
useful AS (SELECT count(*) > 0 AS u FROM cdf JOIN idf USING (term) WHERE NOT (n >= 4 AND df >= 0.5 * n))
SELECT u AS discriminating, (SELECT max(c) FROM cdf) AS best_candidate_df,
       CASE WHEN u THEN least(10, (SELECT count(*) FROM scores WHERE lane = 'approved-current')) ELSE 0 END::BIGINT AS served FROM useful""",
    "draft_side_lane": sql.bm25("license", "nicht", "avec") + """
SELECT id AS identity, lane AS lifecycle, score, matched_on FROM scores WHERE lane = 'draft' AND score > 0
ORDER BY score DESC, id LIMIT 10""",
    "excluded_counts": f"""WITH {sql.ENTRIES},
s AS (SELECT lane IN ('approved-current', 'approved-drifted') AS a, lower(metadata_type) = 'document' AS b,
             namespace = 'en' AS c, starts_with(family, 'src1') AS d, n_chars <= 3000 AS e FROM entries)
SELECT 'lifecycle' AS stage, count(*) FILTER (NOT a) AS excluded FROM s
UNION ALL SELECT 'metadataType', count(*) FILTER (a AND NOT b) FROM s
UNION ALL SELECT 'scope', count(*) FILTER (a AND b AND NOT c) FROM s
UNION ALL SELECT 'facet:family:prefix=src1', count(*) FILTER (a AND b AND c AND NOT d) FROM s
UNION ALL SELECT 'facet:document.length:lte=3000', count(*) FILTER (a AND b AND c AND d AND NOT e) FROM s
UNION ALL SELECT 'kept', count(*) FILTER (a AND b AND c AND d AND e) FROM s""",
    "structured_search": f"""WITH {sql.ENTRIES}
SELECT identity, full_name, metadata_type, lane AS lifecycle FROM entries
WHERE lane IN ('approved-current', 'approved-drifted') AND namespace = 'en' AND starts_with(family, 'src1') AND n_chars <= 3000
ORDER BY identity LIMIT 10""",
    "facet_eq": _facet_sql("namespace = 'fr'"),
    "facet_in": _facet_sql("family IN ('src3', 'src17', 'none')"),
    "facet_exists": _facet_sql("family IS NOT NULL"),
    "facet_prefix": _facet_sql("starts_with(source_path, 'documents/src1/')"),
    "facet_has": _facet_sql("contains(full_name, 'c7.')"),
    "facet_gte": _facet_sql("n_chars >= 2500"),
    "facet_lte": _facet_sql("n_chars <= 120.5"),
    "facet_boolean": _facet_sql("lane <> 'draft'"),
    "facet_list_has": _facet_sql(f"len(list_filter({_WORDS}, lambda v: lower(v) = 'pathetic')) > 0"),
    "facet_list_prefix": _facet_sql(f"len(list_filter({_WORDS}, lambda v: starts_with(lower(v), 'einun'))) > 0"),
    "identity_lookup": f"""WITH {sql.ENTRIES}, h AS (SELECT identity, lane AS lifecycle FROM entries WHERE full_name = 'src11.31' OR identity = 'src11.31')
SELECT identity, lifecycle, CASE WHEN (SELECT count(DISTINCT identity) FROM h) > 1 THEN 'AMBIGUOUS' ELSE 'OK' END AS outcome FROM h""",
    "ambiguous_identity": """SELECT p_name AS full_name, count(*) AS candidates, min('Part:' || p_partkey || ':' || p_name) AS first_candidate
FROM part GROUP BY p_name HAVING count(*) > 1""",
    "error_tiers": f"""WITH m AS (
  SELECT 'Turn:' || conv_id || ':' || turn AS identity, role || '_' || turn AS element, text AS template, '' AS resolved FROM conversations
  UNION ALL SELECT 'Passage:' || item_id, 'Show_' || item_id, '  ' || translate(text, '{ascii_lowercase}', '{ascii_uppercase}') || chr(10), CASE WHEN length(text) > 200 THEN text ELSE '' END FROM benchmark),
needles AS (
  SELECT 'P' || item_id AS needle_id, text AS needle FROM benchmark
  UNION ALL SELECT 'T:' || conv_id || ':' || turn, text FROM conversations WHERE role = 'user'
  UNION ALL SELECT 'E' || item_id, 'Show_' || item_id FROM benchmark),
mk AS (SELECT sha256(element || chr(31) || template || chr(31) || resolved) AS message_key, count(*) OVER (PARTITION BY element, template, resolved) AS messages, *,
  {_TRIM.format('template')} AS t, {_TRIM.format('resolved')} AS r, {_fp('template')} AS f, {_fp('resolved')} AS rf FROM m),
nk AS (SELECT sha256(needle) AS needle_key, count(*) OVER (PARTITION BY needles.needle) AS needles, {_TRIM.format('needle')} AS needle, {_fp('needle')} AS nf FROM needles),
hits AS (
  SELECT needle_key, message_key, needles, messages, 1 AS tier FROM mk JOIN nk ON t = needle
  UNION ALL SELECT needle_key, message_key, needles, messages, 2 FROM mk JOIN nk ON r = needle WHERE resolved <> ''
  UNION ALL SELECT needle_key, message_key, needles, messages, 3 FROM mk JOIN nk ON element = needle WHERE element <> ''
  UNION ALL SELECT needle_key, message_key, needles, messages, 4 FROM mk JOIN nk ON f = nf WHERE nf NOT IN ('', chr(65532))
  UNION ALL SELECT needle_key, message_key, needles, messages, 4 FROM mk JOIN nk ON rf = nf WHERE resolved <> '' AND nf NOT IN ('', chr(65532)))
SELECT needle_key, message_key, needles, messages,
  CASE min(tier) WHEN 1 THEN 'exact-source-message' WHEN 2 THEN 'exact-resolved-label' WHEN 3 THEN 'element-api-name' ELSE 'safe-fingerprint' END AS match
FROM hits GROUP BY needle_key, message_key, needles, messages""",
    "posting_stats": f"""WITH {sql.ENTRIES}, {sql.FIELD_TEXTS}, {sql.TOKENS}
SELECT tok AS token, count(DISTINCT id) AS document_frequency FROM tok GROUP BY tok""",
    "token_postings": f"""WITH {sql.ENTRIES}, {sql.FIELD_TEXTS}, {sql.TOKENS},
c AS (SELECT id, field, tok, count(*) AS tf FROM tok WHERE field IN ('label', 'purpose', 'attribute') GROUP BY id, field, tok)
SELECT field, tok AS token, count(*) AS documents, sum(tf)::BIGINT AS occurrences, max(tf)::BIGINT AS highest FROM c GROUP BY field, tok""",
    "avg_field_len": f"""WITH {sql.ENTRIES}, {sql.FIELD_TEXTS}, {sql.TOKENS},
c AS (SELECT field, count(*) AS tokens FROM tok GROUP BY field), d AS (SELECT field, count(*) AS documents FROM texts GROUP BY field)
SELECT field, documents, coalesce(tokens, 0)::BIGINT AS tokens, round(coalesce(tokens, 0) / documents, 4) AS average_length FROM d LEFT JOIN c USING (field)""",
    "facet_postings": f"""WITH {sql.ENTRIES}, f AS (
  SELECT 'namespace' AS facet, lower(namespace) AS value, identity FROM entries
  UNION ALL SELECT 'family', lower(family), identity FROM entries
  UNION ALL SELECT 'effectiveState', lower(lane), identity FROM entries)
SELECT facet, value, count(*) AS entries, min(identity) AS first_identity FROM f WHERE value IS NOT NULL GROUP BY facet, value""",
    "manifest_counts": f"""WITH {sql.ENTRIES}, lanes(value) AS (VALUES ('approved-current'), ('approved-drifted'), ('draft'), ('revoked'),
  ('scope-mismatch'), ('unsupported-profile'), ('not-effective'))
SELECT 'lane' AS dimension, value, count(identity) AS entries FROM lanes LEFT JOIN entries ON lane = value GROUP BY value
UNION ALL SELECT 'namespace', namespace, count(*) FROM entries GROUP BY namespace
UNION ALL SELECT 'family', family, count(*) FROM entries GROUP BY family
UNION ALL SELECT 'metadataType', metadata_type, count(*) FROM entries GROUP BY metadata_type""",
}
