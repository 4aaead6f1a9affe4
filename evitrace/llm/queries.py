"""The registered queries of the operators, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from evitrace.llm import alignment, ann, bpe, grammar, hostrules, jaccard, langid, mixing, simhash, spelling, toxicity, urlrules, warc
from evitrace.llm.common import fold_of, table


def op1_language_id(spark, sf):
    docs, fold = table(spark, sf, "documents"), fold_of(F.col("doc_id"), 4)
    found = langid.identify(docs, langid.train(docs, fold != 2))
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_bpe(spark, sf):
    docs = table(spark, sf, "documents")
    coded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_toxicity(spark, sf):
    docs, fold = table(spark, sf, "documents"), fold_of(F.col("doc_id"), 3)
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf, "labels"), fold != 1))
    return scored.select(
        "doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"), "sentences")


def op4_warc(spark, sf):
    return warc.round_trip(table(spark, sf, "pages"))


def op5_quality_rules(spark, sf):
    return hostrules.judge(table(spark, sf, "documents"))


def op6_nearest_neighbours(spark, sf):
    return ann.search(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_secret_scans(spark, sf):
    found = grammar.scan(table(spark, sf, "documents"))

    def kind(name):
        return F.filter("spans", lambda s: s["kind"] == name)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != grammar.LEARNED)
    return found.select(
        "doc_id", *[F.size(kind(k)).cast("long").alias(f"n_{k}") for k in grammar.KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_mixing(spark, sf):
    mixed = mixing.mix(table(spark, sf, "documents"), mixing.quality_weights(table(spark, sf, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash(spark, sf):
    return simhash.group(table(spark, sf, "documents"))


def op10_url_filters(spark, sf):
    return urlrules.judge(table(spark, sf, "pages"))


def op11_jaccard_join(spark, sf):
    return jaccard.group(table(spark, sf, "documents"))


def op12_tokenizer_alignment(spark, sf):
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.measure(table(spark, sf, "documents"), *paths)


def op13_spelling_variants(spark, sf):
    return spelling.variants(table(spark, sf, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_quality_rules": op5_quality_rules,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_secret_scans": op7_secret_scans,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_url_filters": op10_url_filters,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE = {
    "op4_warc": warc.ORACLE,
    "op5_quality_rules": hostrules.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op10_url_filters": urlrules.ORACLE,
}
