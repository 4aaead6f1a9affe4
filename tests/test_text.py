import collections
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evitrace.functions import analyze, text
from evitrace.operators import rank, search
from evitrace.operators.facets import Facet
from evitrace.operators.search import Corpus, Request

SAMPLES = [
    "engagement__c.Status__c", "camelCaseName x", "Master-Detail--foo..bar", "Straße GROẞ ŁÓDŹ ǽ", "a.b-", "--", "ﬁne ½ x",
    "Semicolon-delimited list", "Is.", "x\x1cy", "Обзор.Тест", "İstanbul", "naïve_Fooß__mdt", "", "  ", "właściwej 'ok' (x|y)",
    "ns__Thing__c", "A.B.cD__R", "__c", "e-mail: a.b@c.de", "\u00a0nbsp\u2003em", "T\u0307 combining",
]


def test_fixed_token_expectations():
    count = collections.Counter(analyze.analyze_text("engagement__c.Status__c"))
    assert count == {"engagement__c.status__c": 1, "__c": 2, "engagement": 1, "status": 1}
    assert analyze.analyze_text("właściwej").count("wlasciwej") == 2
    assert set(analyze.analyze_text("master-detail")) == {"master-detail", "master", "detail"}
    assert analyze.analyze_text("the") == ["the", "the"]
    assert analyze.analyze_text("-.-") == []


def test_column_tokens_equal_driver_tokens(spark):
    rows = spark.createDataFrame([(s,) for s in SAMPLES], "s string").select("s", analyze.tokens(F.col("s")).alias("t")).collect()
    for row in rows:
        assert sorted(row.t) == sorted(analyze.analyze_text(row.s)), row.s


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aB1é_-.ß ,/Łzc'", max_size=30), min_size=40, max_size=60))
def test_column_tokens_on_generated_text(spark, texts):
    rows = spark.createDataFrame([(s,) for s in texts], "s string").select("s", analyze.tokens(F.col("s")).alias("t")).collect()
    assert all(sorted(r.t) == sorted(analyze.analyze_text(r.s)) for r in rows)


@pytest.mark.parametrize("message, shape", [
    ("Value {!$Record.Name}  exceeds\n20% ", "value ￼ exceeds 20%"), ("Straße", "strasse"), ("ﬁx {!a} {!b}", "fix ￼ ￼"), ("", ""),
])
def test_message_fingerprint(spark, message, shape):
    got = spark.createDataFrame([(message,)], "m string").select(text.message_fingerprint(F.col("m"))).first()[0]
    assert got == shape == text.fingerprint_text(message)


def test_plain_text_decodes_in_order_and_keeps_everything(spark):
    html = "<div>A&amp;lt;b<br/>- one</div><p>&nbsp; </p><li>2) two &quot;x&#39;</li>" + "<p>z</p>" * 30000
    row = spark.createDataFrame([(html,)], "h string").select(
        text.plain_text(F.col("h")).alias("t"), text.plain_text(F.col("h"), 20000).alias("cut"), text.clauses(F.col("h")).alias("c")
    ).first()
    assert row.t.split("\n")[:3] == ["A<b", "- one", "2) two \"x'"]
    assert row.t.count("z") == 30000 and len(row.cut) == 20000
    assert row.c == ["A<b", "one", "two \"x'"]


def test_value_shape_order(spark):
    cases = [
        (None, "null"), ("a" * 15, "salesforce-id"), ("A1" * 9, "salesforce-id"), ("2024-01-01T00:00", "datetime"),
        ("2024-01-01", "date"), ("a@b.c", "email-like"), ("abc", "text[3]"), ("", "text[0]"),
    ]
    df = spark.createDataFrame([(v,) for v, _ in cases], "v string")
    got = [r[0] for r in df.select(text.value_shape(F.col("v"), T.StringType())).collect()]
    assert got == [s for _, s in cases]
    other = spark.createDataFrame([([1, 2], {"a": 1}, True, 3)], "l array<int>, m map<string,int>, b boolean, n int")
    shapes = other.select(*[text.value_shape(F.col(f.name), f.dataType) for f in other.schema.fields]).first()
    assert list(shapes) == ["list[2]", "object[1]", "boolean", "number"]


def _corpus(spark, rows):
    df = spark.createDataFrame(
        [(f"T:c:{n}", n, "T", None, lane, purpose, kw) for n, lane, purpose, kw in rows],
        "identity string, full_name string, metadata_type string, namespace string, lane string, purpose string, kw string",
    )
    return Corpus(df, {}, {"identity": F.col("full_name"), "keyword": F.col("kw"), "purpose": F.col("purpose")})


def _by_hand(rows, query):
    weights, docs = {"identity": 6.0, "keyword": 3.0, "purpose": 2.0}, {}
    for name, _, purpose, kw in rows:
        docs[name] = {"identity": analyze.analyze_text(name), "keyword": analyze.analyze_text(kw or ""), "purpose": analyze.analyze_text(purpose)}
    mean = {f: sum(len(d[f]) for d in docs.values()) / len(docs) or 1.0 for f in weights}
    scores = {}
    for name, d in docs.items():
        for term in sorted(set(analyze.analyze_text(query))):
            df = sum(any(term in tokens for tokens in other.values()) for other in docs.values())
            idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
            w = sum(weights[f] * d[f].count(term) / (0.25 + 0.75 * (len(d[f]) or 1) / mean[f]) for f in weights)
            scores[name] = scores.get(name, 0.0) + idf * w * 2.2 / (w + 1.2)
    return {n: round(s, 4) for n, s in scores.items() if s}


ROWS = [
    ("Alpha__c", "approved-current", "routes the case queue", "routing"), ("Beta", "approved-current", "queue of the day", None),
    ("Gamma", "draft", "queue queue queue", "routing queue"), ("Delta", "approved-current", "nothing here", None),
    ("Eps", "revoked", "case routing", "x"),
]


def test_scores_match_hand_computation(spark):
    c = _corpus(spark, ROWS)
    got = {r.full_name: r.score for r in search.text_search(c, Request(text="case routing queue")).collect()}
    want = _by_hand(ROWS, "case routing queue")
    assert got == {n: want[n] for n in ("Alpha__c", "Beta")}
    draft = search.draft_search(c, Request(text="case routing queue")).collect()
    assert [(r.identity, r.score) for r in draft] == [("T:c:Gamma", want["Gamma"])]


def test_common_terms_alone_serve_nothing(spark):
    rows = [(f"N{i}", "approved-current", "the same words", None) for i in range(5)]
    assert search.text_search(_corpus(spark, rows), Request(text="the missing")).collect() == []
    # Below the corpus floor nothing saturates.
    assert len(search.text_search(_corpus(spark, rows[:3]), Request(text="the missing")).collect()) == 3


def test_term_statistics_ignore_filters(spark):
    c = _corpus(spark, ROWS)
    both = [search.query_terms(c, Request(text="queue zz", lanes=lanes)).sort("term").collect() for lanes in (("draft",), ("approved-current",))]
    assert both[0] == both[1] and [r.matched for r in both[0]] == [True, False]


def test_message_tiers(spark):
    declared = spark.createDataFrame([
        ("F:a", "E1", "Exact text", ""), ("F:b", "E2", "{!$Label.X}", "Resolved text"), ("F:c", "Exact text", "other", ""), ("F:d", "E4", "EXACT   TEXT", ""),
    ], "identity string, element string, template string, resolved string")
    needles = spark.createDataFrame([("n1", " Exact text "), ("n2", "Resolved text"), ("n3", "{!$Record.A}")], "needle_id string, needle string")
    got = {(r.needle_id, r.identity): r.match for r in search.expand_messages(search.message_search(declared, needles), declared, needles).collect()}
    assert got == {
        ("n1", "F:a"): "exact-source-message", ("n1", "F:c"): "element-api-name", ("n1", "F:d"): "safe-fingerprint",
        ("n2", "F:b"): "exact-resolved-label",
    }


def test_lanes_joined_after_the_texts(spark):
    joined = _corpus(spark, ROWS)
    facets = {"state": Facet("state", "string", F.col("lane"), True), "name": Facet("name", "string", F.col("full_name"))}
    split = Corpus(joined.entries, facets, joined.fields, joined.entries.drop("lane"), joined.entries.select("identity", "lane"))
    request = Request(text="gamma", lanes=("approved-current", "draft"), facets=["state=draft", "name:prefix=g"])
    assert [r.identity for r in search.text_search(split, request).collect()] == ["T:c:Gamma"]


def test_rank_of_no_terms_is_empty(spark):
    assert rank.distinct_terms([]) == []


def test_repeated_runs_are_expanded_once(spark, monkeypatch):
    from collections import Counter

    from pyspark.sql import functions as F

    from evitrace.functions import analyze
    from evitrace.operators import postings

    texts = ["Straße My_Field__c My_Field__c a.b ﬁn", "x " * 50, "", None]
    calls, expand = [], analyze._expand
    monkeypatch.setattr(analyze, "_expand", lambda raw: calls.append(raw) or expand(raw))
    for text in filter(None, texts):
        assert analyze.count_tokens(text, {})[0] == Counter(analyze.analyze_text(text))
    calls.clear()
    analyze.count_tokens("x " * 50, {})
    assert calls == ["x"]
    monkeypatch.undo()
    entries = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "identity string, t string")
    got = {(r.identity, r.token, r.tf, r.size) for r in postings.token_postings(entries, {"t": F.col("t")}).collect()}
    assert got == {(str(i), k, n, c.total()) for i, t in enumerate(texts) for c in [Counter(analyze.analyze_text(t or ""))] for k, n in c.items()}


def test_facets_without_a_list_and_with_lists_alone(spark):
    from pyspark.sql import functions as F

    from evitrace.operators import postings

    entries = spark.createDataFrame([("1", "A", ["X", None, "X"]), ("2", None, None)], "identity string, a string, l array<string>")
    rows = lambda facets: sorted((r.facet, r.value, r.identity) for r in postings.facet_postings(entries, facets).collect())
    assert rows({"a": F.col("a")}) == [("a", "a", "1")]
    assert rows({"l": F.col("l")}) == [("l", "x", "1")] * 2
    assert rows({"a": F.col("a"), "l": F.col("l")}) == [("a", "a", "1")] + [("l", "x", "1")] * 2


def test_texts_are_counted_together_as_one_by_one():
    from collections import Counter

    from evitrace.functions import analyze

    texts = ["", "Straße My_Field__c a.b ﬁn", "a\x1fb\x85c İstanbul A-b_c Foo__C ٣ é", "Été été ÉTÉ e\u0301te \u0301 ǰ", "x X x1Y 1Y getURL ... - _", "łódź Łódź æther \u2028 ß ẞ", "x " * 50]
    found = analyze.count_texts(texts)
    got = [Counter() for _ in texts]
    for token, at, n in zip(found.tokens.to_pylist(), found.text.tolist(), found.tf.tolist()):
        assert token not in got[at]
        got[at][token] = n
    assert got == [Counter(analyze.analyze_text(t)) for t in texts] and found.sizes.tolist() == [c.total() for c in got]
    assert found.text.tolist() == sorted(found.text.tolist())
    raws = [r for t in texts for r in analyze._split_raw(t)]
    assert analyze._expand_all(raws) == [analyze._expand(r) for r in raws]


def test_packed_postings_hold_what_rows_hold(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    from evitrace.operators import postings

    given = [("a", "x", "one two two", "Two é"), ("b", "y", None, "three"), (None, "x", "one", ""), ("e", None, "", None), ("a", "x", "one two two", "Two é")]
    given += [(f"k{i}", "x", f"one w{i} w{i % 7}", "hot") for i in range(300)]
    entries = spark.createDataFrame(given, "identity string, lane string, t string, u string").repartition(5)
    fields = {"t": F.col("t"), "u": F.col("u")}
    columns = ["token", "identity", "lane", "field", "tf", "size"]
    rows = lambda df: sorted(map(repr, df.select(columns).collect()))
    want = rows(postings.token_postings(entries, fields, keep=["lane"]))
    packed = postings.token_postings(entries, fields, keep=["lane"], packed=True)
    assert packed.count() == 304 and packed.agg(F.sum("n")).first()[0] == len(want)
    assert rows(postings.unpacked(packed, list(fields))) == want
    ordered = postings.sorted_postings(packed, list(fields))
    assert rows(ordered) == want
    for part in ordered.select("token").rdd.glom().collect():
        assert [r.token for r in part] == sorted(r.token for r in part)
    # A block for each token of a task's entries is sorted, not a row for each posting.
    assert postings.sorted_postings(packed.coalesce(1), list(fields)).select("token").distinct().count() < len(want) // 2
    row = np.array([2, 0, 1, 0])
    blocks = postings._blocks(pa.array(["y", "x", "y", "x"]), [pa.array(["i", None, "k"]), pa.array(["é", "", "l"])], row, [np.arange(4)])
    held = postings._numbers(blocks[-1]).reshape(-1, 3)
    assert blocks[0].to_pylist() == ["y", "x"] and blocks[1].to_pylist() == ["k", "i"] and blocks[2].to_pylist() == [2, 2]
    assert [c.to_pylist() for c in postings._opened(blocks[3:5], held)] == [["k", None, "i", "i"], ["l", "", "é", "é"]] and held[:, 2].tolist() == [0, 2, 1, 3]
    assert list(postings._portions(np.array([1, 5, 1, 1, 9]), 3)) == [(0, 1), (1, 2), (2, 4), (4, 5)]


def test_ordered_facets_are_the_same_rows(spark):
    from pyspark.sql import functions as F

    from evitrace.operators import postings

    given = [("1", "A", ["X", None, "x", "Y"]), ("2", None, None), (None, "b", ["x"]), ("4", "b", [])] + [(f"k{i}", "A", ["Hot", f"v{i % 9}"]) for i in range(100)]
    entries = spark.createDataFrame(given, "identity string, a string, l array<string>").repartition(3)
    facets = {"l": F.col("l"), "a": F.col("a"), "m": F.split("a", ",")}
    rows = lambda df: sorted(map(repr, df.select("facet", "value", "identity").collect()))
    ordered = postings.facet_postings(entries, facets, ordered=True)
    assert rows(ordered) == rows(postings.facet_postings(entries, facets))
    for part in ordered.rdd.glom().collect():
        assert [(r.facet, r.value) for r in part] == sorted((r.facet, r.value) for r in part)
    empty = entries.filter("identity = '2'")
    assert postings.facet_postings(empty, {"l": F.col("l")}, ordered=True).collect() == []
