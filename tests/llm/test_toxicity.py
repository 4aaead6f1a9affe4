import random
from zlib import crc32

from evitrace.llm import toxicity
from evitrace.llm.queries import QUERIES

BAD = ("grok", "snarl", "vilequo")


def sample(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choices(words, k=8)) for _ in range(rng.randrange(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            k = rng.randrange(len(lines))
            lines[k] = f"you {rng.choice(BAD)}{rng.choice(['', 'er', 'ing'])} " + lines[k]
        rows.append((". ".join(lines) + ".", int(toxic)))
    return rows


def test_sentences_are_found_from_document_labels():
    model = toxicity.fit(*map(list, zip(*sample(800, 1))))
    right = sum((model.document(t)[0] >= toxicity.REJECT) == bool(y) for t, y in sample(400, 2))
    assert right >= 395
    text = "All is fine here. You are a snarling one. So it goes."
    score, found = model.document(text)
    assert score >= 0.7 and [text[a:b].strip() for a, b, _ in found] == ["You are a snarling one"]


def test_labels_of_one_kind_teach_nothing():
    assert toxicity.fit(["a b"], [1]).document("a b")[0] < 1 and toxicity.fit([], []).document(None)[0] == 0


def test_rows(spark, docs):
    rows = [(i, t, "en", "a") for i, (t, _) in enumerate(sample(400, 3))]
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(sample(400, 3))] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs(rows), labels)
    odd = [(1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a"), (None, "You grok", "en", "a"), (5, "nice words. " * 50_000, "en", "b")]
    got = {r.doc_id: r.score for r in toxicity.score(docs(odd, "sentences"), model).collect()}
    assert got[1] == got[2] < 0.7 and got[5] < 0.7 <= got[None]
    assert sorted(r.doc_id for r in toxicity.reject(docs(odd), model).collect()) == [1, 2, 2, 5]
    assert toxicity.score(docs([]), model).count() == 0


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op3_toxicity"](spark, sf).drop("sentences").collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert sum(p for y, p in held if y == 0) <= 0.01 * len(held)
    assert sum(p for y, p in held if y == 1) >= 0.7 * sum(y for y, _ in held)
