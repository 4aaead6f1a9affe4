from evitrace.llm import mixing


def test_rows(spark, docs):
    rows = [(i, "w " * (1 + i % 50), "en", f"s{i % 4}") for i in range(2000)]
    rows += [(5000, None, "en", "s1"), (5001, "", None, None), (None, "a b", None, None), (5002, "x " * 100_000, "en", "s2"), (7, "w " * 8, "en", "s3")]
    got = mixing.mix(docs(rows, "target")).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"doc_id", "size", "source_size", "target", "taken"}
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert abs(sum(t for _, t in by) - min(1.5 * total, 2 * total)) < 1e-6 * total
    for (size, target), taken in by.items():
        assert target <= 2 * size and sum(taken) == int(target)
    again = mixing.mix(docs(rows[::-1], "target"))
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in again.collect()) == sorted((r.doc_id or -1, r.size, r.taken) for r in got)
    assert mixing.mix(docs([])).count() == 0


def test_quality_draws_more_often(spark, docs):
    rows = [(i, "w " * 10, "en", "a") for i in range(6000)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6000)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs(rows), mixing.quality_weights(labels)).filter("taken > size").collect()
    good = sum(r.doc_id % 2 for r in got)
    assert good > 1.5 * (len(got) - good)


def test_order_over_buckets_is_the_order_of_keys(spark, docs, monkeypatch):
    rows = [(i, "w " * (1 + i % 7), "en", "abc"[i % 3]) for i in range(900)]
    fields = ("doc_id", "taken")
    one = sorted(tuple(r) for r in mixing.mix(docs(rows)).select(*fields).collect())
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 10)
    assert sorted(tuple(r) for r in mixing.mix(docs(rows)).select(*fields).collect()) == one


def test_sample_repeats_whole_documents(spark, docs):
    rows = [(i, f"w{i} " * 10, "en", "a" if i % 10 else "b") for i in range(400)] + [(1000, "", "en", "a"), (1001, None, "en", None)]
    given = docs(rows, "_x")
    got = mixing.sample(given)
    assert got.columns == given.columns
    texts = [r.text for r in got.collect()]
    assert set(texts) <= {t for _, t, *_ in rows} and "" in texts and None in texts
    assert abs(sum(len((t or "").split()) for t in texts) - 6000) <= 20
    assert mixing.sample(docs([])).count() == 0


def test_sample_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(i, "a b c", f"s{i % 2}", 70 + i, "k") for i in range(40)], "doc_id bigint, text string, source string, _row int, _copies string")
    got = mixing.sample(rows).collect()
    assert got and all(r["_row"] == 70 + r.doc_id and r["_copies"] == "k" for r in got)
