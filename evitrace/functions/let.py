"""Binding a value inside an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` over a value computed once; without it each mention would repeat the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
