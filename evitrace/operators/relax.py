"""Which filters empty an answer: what would be served if some of them were dropped."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evitrace.operators.search import Corpus, Request, stage_filters


def relaxations(corpus: Corpus, request: Request, most: int | None = 2) -> DataFrame:
    """Rows served for every set of at most ``most`` dropped filters (None: of any number).

    ``(dropped, filters, served, needed)``: the dropped filters in their order, joined by `` + ``
    (none: empty), how many they are, the rows served without them, and whether each of them is
    needed, so that keeping any one of them would serve fewer. The text of a request is no filter.

    One pass: a row becomes the bits of the filters it fails, which are counted with map-side
    combination. A set serves the rows whose bits lie within it, so rows that fail more filters
    than ``most`` are served by none. Everything after the count is bounded by the request.
    Filters treat nulls as failing; an empty table serves 0 rows for every set.
    """
    stages = stage_filters(corpus, request)
    names, tests = list(stages), list(stages.values())
    deepest = len(names) if most is None else min(most, len(names))
    sets = [s for size in range(deepest + 1) for s in combinations(range(len(names)), size)]
    masks = {s: sum(1 << i for i in s) for s in sets}

    failed = reduce(
        lambda mask, bit: mask.bitwiseOR(F.when(tests[bit], 0).otherwise(1 << bit).cast("bigint")),
        range(len(tests)), F.lit(0).cast("bigint"),
    )
    counts = corpus.entries.select(failed.alias("bits")).groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    # A sum per set over the few counts, all in one aggregate row.
    served = {s: F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(~masks[s]).cast("bigint")) == 0, F.col("n"))), F.lit(0)) for s in sets}
    sums = counts.agg(*[served[s].alias(f"s{masks[s]}") for s in sets])

    def row(s):
        here = F.col(f"s{masks[s]}")
        less = [F.col(f"s{masks[s] - (1 << i)}") for i in s]
        return F.struct(
            F.lit(" + ".join(names[i] for i in s)).alias("dropped"), F.lit(len(s)).alias("filters"), here.alias("served"),
            reduce(lambda a, b: a & b, [here > other for other in less], F.lit(True)).alias("needed"),
        )

    return sums.select(F.inline(F.array(*[row(s) for s in sets])))
