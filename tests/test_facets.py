import pytest
from pyspark.sql import functions as F

from evitrace.operators.facets import Facet, FacetError, matches, parse

TABLE = {  # operator and value -> rows (s, b, n, l) that match, by row number
    ("s", "eq", "FOO"): {0}, ("s", "in", "bar|foo"): {0, 1}, ("s", "exists", ""): {0, 1}, ("s", "prefix", "B"): {1}, ("s", "has", "oo"): {0},
    ("b", "eq", "True"): {0}, ("b", "has", "true"): set(), ("n", "eq", "80.0"): {0}, ("n", "gte", "80"): {0, 1}, ("n", "lte", "80"): {0},
    ("n", "in", "80"): set(), ("l", "eq", "x"): {0}, ("l", "has", "Y"): {0, 1}, ("l", "in", "x|q"): {0}, ("l", "prefix", "y"): {0, 1}, ("l", "gte", "1"): set(),
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(0, "Foo", True, 80, ["X", "y"]), (1, "bar", False, 90, ["Yz", "Y"]), (2, None, None, None, None)],
        "i int, s string, b boolean, n int, l array<string>",
    )


def facets():
    return {k: Facet(k, kind, F.col(k)) for k, kind in (("s", "string"), ("b", "boolean"), ("n", "number"), ("l", "list"))}


@pytest.mark.parametrize("key, op, value", sorted(TABLE))
def test_truth_table(rows, key, op, value):
    got = {r.i for r in rows.filter(matches(facets(), [f"{key}:{op}={value}"])).collect()}
    assert got == TABLE[(key, op, value)]


@pytest.mark.parametrize("expression", ["s", "s:near=1", "zz=1", "1s=2"])
def test_bad_expressions(spark, expression):
    with pytest.raises(FacetError):
        parse(expression, facets())


@pytest.mark.parametrize("expression", ["n:gte=ten", "s:gte=1"])
def test_bad_values(spark, expression):
    with pytest.raises(FacetError):
        matches(facets(), [expression])


def test_default_operator_is_equality(spark):
    assert parse("s=a=b", facets()).value == "a=b" and parse("s=a", facets()).op == "eq"


def test_names_fold_by_compatibility(spark):
    """Ligatures, full-width and Greek letters are equal to what they stand for."""
    from evitrace.functions.analyze import fold_key, fold_name, fold_names
    from pyspark.sql import functions as F

    pairs = [("\ufb01eld", "FIELD"), ("\uff26\uff49\uff45\uff4c\uff44", "field"), ("\u039f\u0394\u039f\u03a3", "\u03bf\u03b4\u03bf\u03c2"), ("Stra\u00dfe", "STRASSE")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert all(r.a == r.b == fold_key(y) for r, (_, y) in zip(df.select(fold_name(F.col("a")).alias("a"), fold_name(F.col("b")).alias("b")).collect(), pairs))
    assert all(len(set(r.f)) == 1 for r in df.select(fold_names(F.array("a", "b")).alias("f")).collect())
