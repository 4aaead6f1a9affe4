"""The persisted index: one immutable folder per generation, and a pointer to the current one.

Each table is its own Parquet folder, so a query reads only the families it needs. Token
postings are range-partitioned by (token, identity) and sorted by token: a query's few tokens touch
few row groups, and a token held by very many entries simply spans several files. The same postings
lie packed by entry, from which an update keeps those of untouched entries.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evitrace import __version__
from evitrace.functions.text import snippet
from evitrace.operators import graph, postings, rank
from evitrace.operators.facets import Facet
from evitrace.operators.search import Corpus, Request, stage_filters
from evitrace.session import cut_lineage
from evitrace.sources import locate
from evitrace.sources.tree import tree_digest
from evitrace.vocab import B, FIELD_WEIGHTS, K1, LANES


#: Bytes of a row group of stored texts.
ROW_GROUP = 1 << 20


class StaleIndex(RuntimeError):
    """The pointer is missing or the entry set changed since the generation was written."""


def stamps(corpus: Corpus) -> DataFrame:
    """(identity, stamp): a digest of all that is indexed of an entry, its fields and facets too."""
    held = [F.col(c) for c in ("lane", "full_name", "metadata_type", "namespace")]
    held += [*corpus.fields.values(), *(f.column for f in corpus.facets.values())]
    text = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in held])
    return corpus.entries.select("identity", F.sha2(text, 256).alias("stamp"))


def entry_set_digest(corpus: Corpus, edges: DataFrame | None = None) -> str:
    """Identity of the entries, their fields, facets and edges, and of the code that indexes them."""
    return _set_digest(stamps(corpus), edges)


def _set_digest(stamped: DataFrame, edges: DataFrame | None) -> str:
    pairs = stamped.select(F.col("identity").alias("path"), F.col("stamp").alias("sha256"))
    if edges is not None:
        # An edge is told by its columns; copies of one differ in nothing and add up all the same.
        row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(edges.columns)]), 256)
        pairs = pairs.unionByName(edges.select(F.concat(F.lit("edge "), "source").alias("path"), row.alias("sha256")))
    digest = tree_digest(pairs).first()["digest"]
    return f"{digest.removeprefix('sha256:')[:16]}-{__version__}"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Temporary file, then an atomic rename over the pointer."""
    fs, hadoop = _file_system(spark, path)
    staged = hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(staged, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    final = hadoop.Path(path)
    if not fs.rename(staged, final):
        fs.delete(final, False)
        if not fs.rename(staged, final):
            raise StaleIndex(f"could not publish {path}")


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, hadoop = _file_system(spark, path)
    if not fs.exists(hadoop.Path(path)):
        return None
    return "\n".join(r.value for r in spark.read.text(path).collect())


def read_mark(spark: SparkSession, home: str) -> str | None:
    """What :func:`write_mark` left when the tables of a folder were all written."""
    return _read_text(spark, f"{home}/complete.txt")


def write_mark(spark: SparkSession, home: str, text: str) -> None:
    _write_text(spark, f"{home}/complete.txt", text)


def read_back(spark: SparkSession, home: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{home}/{name}")


def build(corpus: Corpus, root: str, edges: DataFrame | None = None, source: str | None = None,
          packed: DataFrame | None = None, stamped: DataFrame | None = None) -> dict:
    """Write a generation unless it already exists, then move the pointer to it.

    ``source`` is a cheap stamp of the files behind the corpus, kept in the manifest so that readers
    can tell without reading a text whether the generation is current. ``packed``: postings by entry
    that are already known, as from :func:`update`; ``stamped``: its stamps. Entries without their texts are a table of their
    own, which filters read; texts are read for excerpts of served rows alone, and lie sorted by
    identity within each file, with a locator beside them that names the files of an identity.
    """
    entries = corpus.entries
    spark = entries.sparkSession
    stamped = cut_lineage(stamps(corpus)) if stamped is None else stamped
    generation = _set_digest(stamped, edges)
    home = f"{root.rstrip('/')}/gen-{generation}"
    manifest = _read_text(spark, f"{home}/manifest.json")
    if manifest is None:
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{home}/{name}")
        put(stamped, "stamps")
        # Short row groups: what reads the texts next is divided among tasks whatever the given files are.
        entries.sortWithinPartitions("identity").write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{home}/documents")
        kinds = {k: (f.kind, f.needs_lane) for k, f in corpus.facets.items()}
        columns = [f.column.alias(f"facet_{i}") for i, f in enumerate(corpus.facets.values())]
        written = read_back(spark, home, "documents")
        put(written.select("identity", "full_name", "metadata_type", "namespace", "lane", *columns).sortWithinPartitions("identity"), "entries")
        locate.write_locator(spark, home, "documents")
        # Texts are analysed once; an update keeps what that pass wrote, sorting reads it.
        put(packed if packed is not None else postings.token_postings(written, corpus.fields, keep=["lane"], packed=True), "postings")
        put(postings.sorted_postings(read_back(spark, home, "postings"), list(corpus.fields)), "tokens")
        facets = {k: f.column for k, f in corpus.facets.items()}
        if facets:
            put(postings.facet_postings(written, facets, ordered=True), "facets")
        if edges is not None:
            put(edges.repartitionByRange("target_key", "source").sortWithinPartitions("target_key"), "edges")
            put(graph.resolve_targets(entries, edges), "targets")
        lanes = {r["lane"]: r["count"] for r in read_back(spark, home, "entries").groupBy("lane").count().collect()}
        # One row per field: the statistics every query needs go into the manifest.
        held = {r["field"]: r["n"] for r in read_back(spark, home, "tokens").groupBy("field").agg(F.sum(F.col("tf").cast("bigint")).alias("n")).collect()}
        total = sum(lanes.values())
        body = {
            "generation": generation, "entries": total,
            "meanLengths": {f: held.get(f, 0) / total if total else 0.0 for f in corpus.fields},
            "laneCounts": {lane: lanes.get(lane, 0) for lane in LANES},
            "fields": list(corpus.fields), "facets": [[k, *v] for k, v in kinds.items()], "complete": True,
        }
        _write_text(spark, f"{home}/manifest.json", json.dumps(body, sort_keys=True))
    else:
        body = json.loads(manifest)
    _write_text(spark, f"{root.rstrip('/')}/current.json", json.dumps({"generation": generation, "source": source}))
    return body


def load(spark: SparkSession, root: str, corpus: Corpus | None = None, edges: DataFrame | None = None, source: str | None = None) -> dict:
    """The current manifest. With ``corpus`` (and ``edges``) the generation must match them, with
    ``source`` the stamp it was built with."""
    pointer = _read_text(spark, f"{root.rstrip('/')}/current.json")
    if pointer is None:
        raise StaleIndex("no generation pointer; build the index first")
    current = json.loads(pointer)
    generation = current["generation"]
    manifest = _read_text(spark, f"{root.rstrip('/')}/gen-{generation}/manifest.json")
    if manifest is None or not json.loads(manifest)["complete"]:
        raise StaleIndex("the current generation is incomplete; rebuild")
    if source is not None and current.get("source") != source:
        raise StaleIndex("files changed since the index was built; rebuild")
    if corpus is not None and entry_set_digest(corpus, edges) != generation:
        raise StaleIndex("entries changed since the index was built; rebuild")
    return {**json.loads(manifest), "home": f"{root.rstrip('/')}/gen-{generation}"}


def stored(spark: SparkSession, manifest: dict) -> Corpus:
    """The entries of a generation with their facets, without texts."""
    rows = read_back(spark, manifest["home"], "entries")
    facets = {k: Facet(k, kind, F.col(f"facet_{i}"), needs) for i, (k, kind, needs) in enumerate(manifest["facets"])}
    return Corpus(rows, facets, {})


def fetch(spark: SparkSession, manifest: dict, ids: Iterable[str]) -> DataFrame:
    """Whole entries of a generation by identity, read from the files that hold them."""
    return locate.fetch(spark, manifest["home"], "documents", ids)


def search(spark: SparkSession, manifest: dict, request: Request) -> DataFrame:
    """Ranked search from a generation: the same rows as a search by scanning the texts.

    The query's tokens select a few row groups of the postings; lane and field size travel with
    each posting. Other filters read the entries' narrow table. Term frequencies are scalar
    subqueries. The served identities, at most ``request.top``, are found first; their names and
    texts are then fetched from the files that hold them (:func:`fetch`).
    """
    home, terms = manifest["home"], request.terms
    corpus = stored(spark, manifest)
    hits = read_back(spark, home, "tokens").filter(F.col("token").isin(terms))
    served = hits.filter(F.col("lane").isin(*request.lanes))
    others = [test for name, test in stage_filters(corpus, request).items() if name != "lifecycle"]
    if others:
        allowed = corpus.entries
        for test in others:
            allowed = allowed.filter(test)
        served = served.join(allowed.select("identity"), "identity", "left_semi")

    def frequencies(rows: DataFrame) -> Column:
        counts = rows.groupBy("token").agg(F.count_distinct("identity").alias("df"))
        return counts.agg(F.map_from_entries(F.collect_list(F.struct("token", "df"))).alias("m")).scalar()

    def of(counts: str, term: str) -> Column:
        return F.coalesce(F.try_element_at(counts, F.lit(term)), F.lit(0))

    means = F.create_map(*[F.lit(x) for f, mean in manifest["meanLengths"].items() for x in (f, float(mean) or 1.0)])
    count = F.lit(manifest["entries"])
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in FIELD_WEIGHTS.items() for x in kv]), F.col("field"))
    gain = weight * F.col("tf") / ((1 - B) + B * F.col("size") / F.col("means")[F.col("field")])
    # One row per entry: a sum per term side by side, and at most a mark per field and term.
    sums = served.withColumn("means", means).withColumn("gain", gain).groupBy("identity", "lane").agg(
        *[F.sum(F.when(F.col("token") == t, F.col("gain"))).alias(f"w{i}") for i, t in enumerate(terms)],
        F.slice(F.sort_array(F.collect_set(F.concat_ws(":", "field", "token"))), 1, 8).alias("matched_on"),
    ).withColumn("df", frequencies(hits)).withColumn("kept_df", frequencies(served))
    total, useful = F.lit(0.0), F.lit(False)
    for i, t in enumerate(terms):
        w = F.col(f"w{i}")
        total = total + F.coalesce(rank.idf(count, of("df", t)) * w * (K1 + 1) / (w + K1), F.lit(0.0))
        useful = useful | ((of("kept_df", t) > 0) & ~rank.saturated(count, of("df", t)))
    best = sums.select("identity", F.col("lane").alias("lifecycle"), F.round(total, 4).alias("score"), "matched_on", useful.alias("useful"))
    best = best.orderBy(F.desc("score"), "identity").limit(request.top).filter((F.col("score") > 0) & F.col("useful")).drop("useful")
    best = cut_lineage(best)
    rows = fetch(spark, manifest, [r.identity for r in best.select("identity").collect()])
    texts = rows.select("identity", "full_name", "metadata_type", snippet(F.col("purpose"), terms).alias("snippet"))
    return best.join(texts, "identity").select(
        "identity", "full_name", "metadata_type", "lifecycle", "score", "matched_on", "snippet",
        F.lit("structured-plus-lexical" if request.facets else "lexical").alias("match_class"),
    ).orderBy(F.desc("score"), "identity")


def verify(hits: DataFrame, entries: DataFrame, recorded: DataFrame) -> DataFrame:
    """Re-digest of the served rows alone: each hit says whether its entry is unchanged.

    ``hits``: a top-k, hence bounded by the request. ``recorded``: identity, digest at build.
    """
    few = F.broadcast(hits.select("identity"))
    now = entries.join(few, "identity", "left_semi").select("identity", F.sha2("purpose", 256).alias("now"))
    then = recorded.join(few, "identity", "left_semi").select("identity", F.col("digest").alias("then"))
    checked = hits.join(now, "identity", "left").join(then, "identity", "left")
    state = F.when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("then"), "changed").otherwise("verified")
    return checked.select(*hits.columns, state.alias("verification"))


def changed_entries(previous: DataFrame, corpus: Corpus, now: DataFrame | None = None) -> DataFrame:
    """Entries to re-project: new, changed or removed since ``previous`` (identity, stamp).

    Copies of an identity are compared as a whole: one copy more or less is a change. A null
    identity is one like others. ``now``: the stamps of ``corpus`` if they are known.
    """
    sides = (stamps(corpus) if now is None else now).select("identity", "stamp", F.lit(1).alias("now"), F.lit(0).alias("was")).unionByName(
        previous.select("identity", "stamp", F.lit(0).alias("now"), F.lit(1).alias("was")))
    held = sides.groupBy("identity", "stamp").agg(F.sum("now").alias("now"), F.sum("was").alias("was"))
    held = held.groupBy("identity").agg(F.sum("now").alias("now"), F.sum("was").alias("was"), F.some(F.col("now") != F.col("was")).alias("differs"))
    change = F.when(F.col("was") == 0, "new").when(F.col("now") == 0, "removed").otherwise("changed")
    return held.filter("differs").select("identity", change.alias("change"))


def incremental(previous: DataFrame, stamped: DataFrame, corpus: Corpus, now: DataFrame | None = None) -> DataFrame:
    """Token postings after an update: untouched entries keep their rows, the rest are redone.

    The columns are those of ``previous``, a generation's lane among them; it may be packed by
    entry. ``now``: the stamps of ``corpus`` if they are known.
    """
    change = cut_lineage(changed_entries(stamped, corpus, now).withColumnRenamed("identity", "_identity"))
    same = F.col("identity").eqNullSafe(F.col("_identity"))
    kept = previous.join(change, same, "left_anti")
    redo = corpus.entries.join(change.filter(F.col("change") != "removed"), same, "left_semi")
    lane = ["lane"] if "lane" in previous.columns else []
    return kept.unionByName(postings.token_postings(redo, corpus.fields, keep=lane, packed="tokens" in previous.columns))


def update(corpus: Corpus, root: str, edges: DataFrame | None = None, source: str | None = None) -> dict:
    """A new generation from the current one: only new and changed entries are analysed again."""
    spark = corpus.entries.sparkSession
    home = load(spark, root)["home"]
    now = cut_lineage(stamps(corpus))
    packed = incremental(read_back(spark, home, "postings"), read_back(spark, home, "stamps"), corpus, now)
    return build(corpus, root, edges, source, packed, now)
