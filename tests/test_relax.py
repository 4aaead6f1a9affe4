from itertools import combinations

from pyspark.sql import functions as F

from evitrace.operators import relax
from evitrace.operators.facets import Facet
from evitrace.operators.search import Corpus, Request

ROWS = [
    ("a", "Flow", "en", "approved-current", 5), ("b", "Flow", "fr", "approved-current", 50), ("c", "Apex", "en", "draft", 50),
    ("d", "Flow", "en", "draft", None), ("e", None, None, None, None), ("e", None, None, None, None), ("f", "Apex", "fr", "draft", 50),
]
SCHEMA = "identity string, metadata_type string, namespace string, lane string, size int"
REQUEST = Request(metadata_type="Flow", namespace="en", facets=["size:gte=10"])


def _served(spark, rows, most):
    facets = {"size": Facet("size", "number", F.col("size"))}
    df = spark.createDataFrame(rows, SCHEMA)
    found = relax.relaxations(Corpus(df, facets, {}), REQUEST, most).collect()
    return {r.dropped: (r.filters, r.served, r.needed) for r in found}


def _brute(rows, most):
    tests = {
        "lifecycle": lambda r: r[3] == "approved-current", "metadataType": lambda r: r[1] == "Flow",
        "scope": lambda r: r[2] == "en", "facet:size:gte=10": lambda r: r[4] is not None and r[4] >= 10,
    }
    count = lambda s: sum(all(t(r) for n, t in tests.items() if n not in s) for r in rows)
    return {
        " + ".join(s): (len(s), count(s), all(count(s) > count([x for x in s if x != n]) for n in s))
        for size in range(most + 1) for s in combinations(tests, size)
    }


def test_relaxations_against_filtering_again(spark):
    for most in (0, 2, 4):
        assert _served(spark, ROWS, most) == _brute(ROWS, most)
    assert _served(spark, ROWS, None) == _brute(ROWS, 4)
    assert _brute(ROWS, 1)["scope"] == (1, 1, True)


def test_relaxations_of_nothing(spark):
    assert set(_served(spark, [], 1).values()) == {(0, 0, True), (1, 0, False)}
