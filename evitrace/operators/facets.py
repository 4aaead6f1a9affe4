"""Typed facet predicates: seven operators over string, boolean, number and list facets."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evitrace.functions.analyze import fold_key, fold_name, fold_names

OPERATORS = ("eq", "in", "exists", "prefix", "has", "gte", "lte")


class FacetError(ValueError):
    """The expression cannot be evaluated against the declared facets."""


@dataclass(frozen=True)
class Facet:
    key: str
    kind: str  # string, boolean, number or list
    column: Column
    needs_lane: bool = False  # reads the lane, which may be joined only after the texts are read


@dataclass(frozen=True)
class FacetTest:
    key: str
    op: str
    value: str


def parse(expression: str, facets: dict[str, Facet]) -> FacetTest:
    """``key[:op]=value``; ``eq`` is the default operator."""
    key_op, sep, value = expression.partition("=")
    key, _, op = key_op.partition(":")
    if not sep or not re.fullmatch(r"[A-Za-z][A-Za-z0-9_.]*", key):
        raise FacetError(f"expected key[:op]=value, got {expression!r}")
    op = op or "eq"
    if op not in OPERATORS:
        raise FacetError(f"unknown operator {op!r}; one of {', '.join(OPERATORS)}")
    if key not in facets:
        raise FacetError(f"unknown facet {key!r}")
    return FacetTest(key, op, value)


def predicate(facet: Facet, op: str, value: str) -> Column:
    """A null-free boolean column; a missing facet matches nothing but never errors."""
    column = facet.column
    if op == "exists":
        return column.isNotNull()
    folded = fold_key(value)
    options = [fold_key(part) for part in value.split("|")]
    if facet.kind == "boolean":
        hit = F.lower(column.cast("string")) == folded if op == "eq" else F.lit(False)
    elif facet.kind == "number":
        hit = _number(facet, op, value)
    elif facet.kind == "list":
        held = fold_names(column.cast("array<string>"))
        hit = {
            "eq": lambda: F.array_contains(held, folded),
            "has": lambda: F.array_contains(held, folded),
            "in": lambda: F.arrays_overlap(held, F.array(*[F.lit(o) for o in options])),
            "prefix": lambda: F.exists(held, lambda v: v.startswith(folded)),
        }.get(op, lambda: F.lit(False))()
    else:
        text = fold_name(column.cast("string"))
        tests = {
            "eq": lambda: text == folded,
            "in": lambda: text.isin(options),
            "prefix": lambda: text.startswith(folded),
            "has": lambda: text.contains(folded),
        }
        if op not in tests:
            raise FacetError(f"{op!r} does not apply to the text facet {facet.key}")
        hit = tests[op]()
    return F.coalesce(hit, F.lit(False))


def _number(facet: Facet, op: str, value: str) -> Column:
    try:
        bound = float(value)
    except ValueError:
        raise FacetError(f"facet {facet.key} expects a number, got {value!r}") from None
    column = facet.column
    if op == "eq":
        return column == bound
    if op == "gte":
        return column >= bound
    if op == "lte":
        return column <= bound
    return F.lit(False)


def matches(facets: dict[str, Facet], expressions: list[str]) -> Column:
    """All expressions hold."""
    test = F.lit(True)
    for expression in expressions:
        parsed = parse(expression, facets)
        test = test & predicate(facets[parsed.key], parsed.op, parsed.value)
    return test


def capabilities(df: DataFrame, facets: dict[str, Facet]) -> DataFrame:
    """The declared facets as rows, for introspection."""
    return df.sparkSession.createDataFrame(
        [(f.key, f.kind) for f in facets.values()], "facet string, kind string"
    )
