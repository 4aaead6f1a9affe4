"""SQL text fragments for the DuckDB side of the comparison. No engine code is used here."""

LANE = """CASE WHEN toxic = 1 THEN 'revoked' WHEN quality = 1 THEN 'approved-current'
             WHEN quality = 0 THEN 'approved-drifted' ELSE 'draft' END"""

ENTRIES = f"""entries AS (
  SELECT 'Document:' || lang || ':' || source || '.' || d.doc_id AS identity,
         source || '.' || d.doc_id AS full_name, 'Document' AS metadata_type, lang AS namespace,
         source AS family, 'documents/' || source || '/' || d.doc_id || '.md' AS source_path,
         {LANE} AS lane, n_chars, text AS purpose, d.doc_id AS doc_id
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

FIELD_TEXTS = """texts AS (
  SELECT identity AS id, 'identity' AS field, identity || ' ' || full_name AS txt FROM entries
  UNION ALL SELECT identity, 'label', split_part(purpose, chr(10), 1) FROM entries
  UNION ALL SELECT identity, 'purpose', purpose FROM entries
  UNION ALL SELECT identity, 'attribute', metadata_type || ' ' || full_name || ' ' || namespace || ' ' || family FROM entries
  UNION ALL SELECT identity, 'relationTarget', family FROM entries
  UNION ALL SELECT identity, 'sourcePath', source_path FROM entries)"""

_FOLD = """strip_accents(replace(replace(replace(replace(replace(tok, 'æ', 'ae'), 'œ', 'oe'),
           'ł', 'l'), 'đ', 'd'), 'ø', 'o'))"""
_SUFFIX = "__(c|r|e|mdt|b|x|kav|s|hd|share|history)$"

# texts(id, field, txt) -> tok(id, field, tok), duplicates kept
TOKENS = f"""raws AS (
  SELECT id, field, raw FROM (
    SELECT id, field, unnest(string_split_regex(txt, '[\\s,;:/\\\\()\\[\\]{{}}<>"''`|!?]+')) AS raw FROM texts)
  WHERE trim(raw, '.-') <> ''),
symbols AS (SELECT id, field, replace(lower(trim(raw, '.-')), 'ß', 'ss') AS tok FROM raws),
segments AS (
  SELECT id, field, replace(lower(trim(seg)), 'ß', 'ss') AS seg FROM (
    SELECT id, field, unnest(string_split_regex(regexp_replace(raw, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '\\.+')) AS seg
    FROM raws)),
suffixes AS (SELECT id, field, regexp_extract(seg, '{_SUFFIX}') AS tok FROM segments
             WHERE regexp_extract(seg, '{_SUFFIX}') <> ''),
words AS (
  SELECT id, field, tok FROM (
    SELECT id, field, unnest(string_split_regex(regexp_replace(seg, '{_SUFFIX}', ''), '[-_\\s]+')) AS tok FROM segments)
  WHERE tok <> ''),
base AS (SELECT * FROM symbols UNION ALL SELECT * FROM words),
tok AS (SELECT * FROM base UNION ALL SELECT * FROM suffixes
        UNION ALL SELECT id, field, {_FOLD} AS tok FROM base WHERE {_FOLD} <> tok)"""

WEIGHTS = """weights(field, w) AS (VALUES ('identity', 6.0::DOUBLE), ('label', 3.0::DOUBLE),
  ('purpose', 2.0::DOUBLE), ('attribute', 1.5::DOUBLE), ('relationTarget', 1.0::DOUBLE), ('sourcePath', 0.2::DOUBLE))"""


def terms(*words: str) -> str:
    return "terms(term) AS (VALUES " + ", ".join(f"('{w}')" for w in words) + ")"


def bm25(*words: str) -> str:
    """CTEs up to ``scores(id, score, matched_on)`` over every entry."""
    return f"""WITH {ENTRIES}, {FIELD_TEXTS}, {TOKENS}, {WEIGHTS}, {terms(*words)},
n AS (SELECT count(*)::DOUBLE AS n FROM entries),
len AS (SELECT t.id, t.field, coalesce(c, 0) AS len FROM texts t LEFT JOIN
        (SELECT id, field, count(*) AS c FROM tok GROUP BY id, field) k ON t.id = k.id AND t.field = k.field),
avgs AS (SELECT field, avg(len)::DOUBLE AS a FROM len GROUP BY field),
tf AS (SELECT id, field, tok AS term, count(*)::DOUBLE AS tf FROM tok WHERE tok IN (SELECT term FROM terms)
       GROUP BY id, field, tok),
df AS (SELECT term, count(DISTINCT id)::DOUBLE AS df FROM tf GROUP BY term),
idf AS (SELECT t.term, coalesce(df, 0) AS df, n.n, ln(1 + (n.n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf
        FROM terms t LEFT JOIN df ON t.term = df.term CROSS JOIN n),
wtf AS (SELECT tf.id, tf.term, sum(w * tf / (0.25 + 0.75 * (greatest(len.len, 1) / a)) ORDER BY tf.field) AS wtf
        FROM tf JOIN weights USING (field) JOIN len ON len.id = tf.id AND len.field = tf.field
        JOIN avgs ON avgs.field = tf.field GROUP BY tf.id, tf.term),
total AS (SELECT id, sum(idf * wtf * 2.2 / (wtf + 1.2) ORDER BY wtf.term) AS score FROM wtf JOIN idf USING (term) GROUP BY id),
matched AS (SELECT id, list(field || ':' || term ORDER BY field, term) AS m FROM tf GROUP BY id),
scores AS (SELECT total.id, round(score, 4) AS score, array_to_string(m[1:8], '|') AS matched_on, lane
           FROM total JOIN matched USING (id) JOIN entries ON entries.identity = total.id)"""
