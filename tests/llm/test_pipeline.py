import random

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from evitrace.llm import grammar, simhash


def fixture(spark, folder):
    rng = random.Random(11)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(800)]
    rows, labels = [], []
    for i in range(600):
        text = ". ".join(" ".join(rng.choices(words, k=9)) for _ in range(rng.randrange(2, 12)))
        toxic = i % 5 == 0
        if toxic:
            text += f". you {rng.choice(['grokker', 'snarled'])} of {words[i]}."
        if i % 7 == 0:
            text += f" password = '{rng.getrandbits(120):030x}'"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, i % 2, int(toxic)))
    rows += [(1000 + i, *rows[3 * i][1:]) for i in range(50)]  # copies
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (1, *rows[1][1:]), (None, "alone here", "en", "s2", 10)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "1 AS size").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage is repeated here without Spark's operators on what the one before gave."""
    rows = fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    given, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        given.write.parquet(f"{tmp_path}/in-{name}")
        given = stage(spark, spark.read.parquet(f"{tmp_path}/in-{name}"), str(tmp_path))
        given.write.parquet(f"{tmp_path}/{name}")
        given = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [tuple(r) for r in given.collect()]
        if name != "bpe":
            assert given.columns == docs.columns
    bad = {i for i, t, *_ in rows if t and ("grokker" in t or "snarled" in t)}
    assert sorted(r[0] or -1 for r in seen["toxicity"]) == sorted(r[0] or -1 for r in rows if r[0] not in bad)

    fps = [simhash.fingerprint(r[1]) for r in seen["toxicity"]]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(seen["toxicity"]):
        groups.setdefault(find(i), []).append(r[0])
    want = [min((x for x in g if x is not None), default=None) for g in groups.values()]
    assert sorted(r[0] or -1 for r in seen["simhash_near_dedup"]) == sorted(x or -1 for x in want)

    clean = {r[0]: r for r in seen["secret_scans"]}
    for r in seen["simhash_near_dedup"]:
        text = clean[r[0]][1]
        assert (text is None) == (r[1] is None) and clean[r[0]][2:4] == r[2:4]
        assert not grammar.base_spans(text or "") and clean[r[0]][4] == (None if r[4] is None else len(text))
        if r[1] and not grammar.base_spans(r[1]):
            assert text == r[1]

    sizes = sum(len((r[1] or "").split()) for r in seen["secret_scans"])
    assert abs(sum(len((r[1] or "").split()) for r in seen["mixing"]) - 1.5 * sizes) < 0.02 * sizes
    assert {r[:2] for r in seen["mixing"]} <= {r[:2] for r in seen["secret_scans"]}

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r[0] or -1, library.encode(r[1] or "", add_special_tokens=False).ids) for r in seen["mixing"])
    assert sorted((r[0] or -1, r[2]) for r in seen["bpe"]) == want


def test_run_on_given_tables(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and rows.count() > 0


def test_run_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


