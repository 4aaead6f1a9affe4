"""Approximate nearest neighbours by balanced posting lists.

Vectors are lifted by one coordinate so that the largest inner product is the smallest distance.
Centroids of evenly filled lists are fitted to a bounded sample and tied into a neighbour graph
that fits into every worker. A vector joins the list of its nearest centroid and, near a
boundary, those of others about as near. A query walks the graph, takes all lists whose centroids
lie within a ratio of the nearest one, and meets those lists' vectors in tiles of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evitrace.llm.common import arrow_rows
from evitrace.session import cut_lineage


#: Centroids that a walk looks around at least.
BEAM = 16


@dataclass(frozen=True)
class Options:
    """``sample``: vectors the centroids are fitted to; ``list_size``: vectors a list aims at, up to
    ``lists`` lists; ``replicas`` and ``near``: lists of a vector, and how much farther than the
    nearest they may be; ``probe``: the same for the lists of a query; ``degree``: neighbours of a
    centroid in the graph; ``values``, ``queries``: components of all vectors and queries of a tile."""

    sample: int = 20_000
    list_size: int = 500
    lists: int = 4_096
    replicas: int = 4
    near: float = 0.1
    probe: float = 0.15
    degree: int = 16
    values: int = 1 << 20
    queries: int = 1_024
    top: int = 20


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None] - 2 * x @ centroids.T, 0))


@dataclass
class Lists:
    """Centroids, their graph, and where each list's vectors lie: its first tile and its tiles."""

    norm: float
    centroids: np.ndarray
    graph: np.ndarray
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    tiles: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))[:, None]), axis=1)

    def walk(self, x: np.ndarray, ratio: float) -> np.ndarray:
        """Distances to the centroids met by each walk, infinite for those not met.

        A walk starts at a few centroids, about the square root of their number, and visits the
        neighbours of every centroid within the ratio of the nearest one so far, and of the ``BEAM``
        nearest in any case, until none is left.
        """
        size = len(self.centroids)
        found = np.full((len(x), size), np.inf)
        visited = np.zeros((len(x), size), bool)
        beam = min(BEAM, size) - 1
        starts = np.arange(0, size, max(1, int(size**0.5)))
        found[:, starts] = distances(x, self.centroids[starts])
        while True:
            reach = np.maximum(found.min(1) * (1 + ratio), np.partition(found, beam, axis=1)[:, beam])
            row, node = np.nonzero((found <= reach[:, None]) & np.isfinite(found) & ~visited)
            if not len(row):
                return found
            visited[row, node] = True
            fresh = np.zeros_like(visited)
            fresh[np.repeat(row, self.graph.shape[1]), self.graph[node].ravel()] = True
            row, node = np.nonzero(fresh & np.isinf(found))
            for at in range(0, len(row), 1 << 16):
                r, n = row[at:at + (1 << 16)], node[at:at + (1 << 16)]
                found[r, n] = np.sqrt(((x[r] - self.centroids[n]) ** 2).sum(1))

    def assign(self, x: np.ndarray, options: Options) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every vector's lists."""
        found = self.walk(self.lift(x), options.near)
        most = min(options.replicas, found.shape[1])
        near = np.argsort(found, axis=1, kind="stable")[:, :most]
        far = np.take_along_axis(found, near, 1)
        row, col = np.nonzero(far <= far[:, :1] * (1 + options.near))
        return row, near[row, col]

    def select(self, q: np.ndarray, options: Options) -> np.ndarray:
        """Whether a query takes a list; it takes more of the next ones if those hold too few."""
        lifted = np.concatenate((q, np.zeros((len(q), 1))), axis=1)
        found = self.walk(lifted, options.probe)
        taken = found <= found.min(1, keepdims=True) * (1 + options.probe)
        for i in np.flatnonzero(taken @ self.counts < 4 * (options.top + 1) * options.replicas):
            order = np.argsort(distances(lifted[i:i + 1], self.centroids)[0], kind="stable")
            held = np.cumsum(self.counts[order])
            taken[i, order[:np.searchsorted(held, 4 * (options.top + 1) * options.replicas) + 1]] = True
        return taken

    def pack(self, counts: np.ndarray, options: Options) -> None:
        """Lays the lists out over tiles: small ones share a tile, large ones have several."""
        size = max(1, options.values // self.centroids.shape[1])
        self.counts = counts
        self.tiles = np.maximum(1, -(-counts // size))
        self.first = np.zeros(len(counts), np.int64)
        tile, room = -1, 0
        for i, n in enumerate(counts):
            if self.tiles[i] > 1:
                self.first[i] = tile + 1
                tile += int(self.tiles[i])
                room = 0
            else:
                if n > room:
                    tile, room = tile + 1, size
                self.first[i] = tile
                room -= int(n)


def fit(x: np.ndarray, norm: float, number: int, options: Options, rounds: int = 10) -> Lists:
    """Evenly filled centroids by k-means whose distances carry a price on full lists, and a graph
    of each centroid's nearest, both ways, along a ring so that every one can be reached."""
    lists = Lists(norm, np.zeros((0, 0)), np.zeros((0, 0), np.int64))
    x = lists.lift(x)
    number = max(1, min(number, len(x) // 4))
    centroids = x[np.random.default_rng(7).choice(len(x), number, replace=False)].copy()
    price = np.zeros(number)
    for _ in range(rounds if number > 1 else 0):
        away = distances(x, centroids) ** 2
        nearest = (away + price).argmin(1)
        size = np.bincount(nearest, minlength=number)
        price += 0.05 * away.min(1).mean() * (size / max(size.mean(), 1) - 1)
        sums = np.stack([np.bincount(nearest, x[:, k], number) for k in range(x.shape[1])], axis=1)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centroids)
    near = np.argsort(distances(centroids, centroids), axis=1, kind="stable")[:, 1:options.degree + 1]
    ring = np.arange(number)[:, None]
    graph = np.concatenate((near, (ring + 1) % number, (ring - 1) % number), axis=1)
    return Lists(norm, centroids, graph)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def build(classes: DataFrame, options: Options) -> tuple[Lists, DataFrame] | None:
    """The lists, and the postings (tile, list, ids, vec) of all vectors; None without vectors."""
    facts = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate(
        "vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))).alias("norm")).first()
    if not facts["n"]:
        return None
    taught = classes.orderBy(F.xxhash64("vec"), F.get("ids", F.lit(0))).limit(options.sample).select("vec").toArrow()
    number = min(options.lists, -(-facts["n"] // options.list_size))
    lists = fit(_matrix(taught.column(0).combine_chunks()), facts["norm"], number, options)
    sent = classes.sparkSession.sparkContext.broadcast(lists)  # at most ``lists`` centroids and their graph

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, found = sent.value.assign(_matrix(batch.column(0)), options)
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), batch.column(1).take(pa.array(row)), batch.column(0).take(pa.array(row))],
                                          ["list", "ids", "vec"])

    kind = classes.schema["vec"].dataType.simpleString()
    assigned = cut_lineage(arrow_rows(classes.select("vec", "ids"), f"list bigint, ids array<bigint>, vec {kind}", step))
    counts = np.zeros(len(lists.centroids), np.int64)
    for r in assigned.groupBy("list").count().collect():  # a row per list
        counts[r["list"]] = r["count"]
    lists.pack(counts, options)
    places = [(i, int(f), int(n)) for i, (f, n) in enumerate(zip(lists.first, lists.tiles))]
    where = classes.sparkSession.createDataFrame(places, "_list bigint, first bigint, tiles bigint")
    tile = F.col("first") + F.pmod(F.xxhash64("ids"), F.col("tiles"))
    postings = assigned.join(F.broadcast(where), F.col("list") == F.col("_list")).select(tile.alias("tile"), "list", "ids", "vec")
    return lists, postings


def search(table: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", options: Options = Options()) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found to every row that ``queries`` admits.

    Nearness is the inner product in double precision, ties go to the smaller id, a query's own id
    is left out. Null, zero and non-finite vectors take no part, nor do null ids and vectors of
    another length than most. Equal vectors are one posting with their smallest ids, of which a
    query can need no more than one beyond ``top``, so copies fill no list. Repeated rows count
    once; of an id with several vectors each is a candidate, and the id ranks by its best. An empty
    table, or one without usable vectors, gives no rows; other columns are ignored whatever their
    names.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), queries.alias("asks")).filter(
        F.col("id").isNotNull() & usable(F.col("vec")))
    length = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.filter(F.size("vec") == length["d"])
    first = Window.partitionBy("vec").orderBy("id")
    few = rows.select("id", "vec").distinct().withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= options.top + 1)
    classes = cut_lineage(few.groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids")))
    lists, postings = build(classes, options)
    sent = spark.sparkContext.broadcast(lists)
    kind = classes.schema["vec"].dataType.simpleString()

    def select(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = sent.value
        row, found = np.nonzero(known.select(_matrix(batch.column(1)), options))
        times = known.tiles[found]
        row, found = np.repeat(row, times), np.repeat(found, times)
        tile = known.first[found] + np.arange(len(found)) - np.repeat(np.cumsum(times) - times, times)
        order = np.lexsort((found, tile, row))
        row, tile, found = row[order], tile[order], found[order]
        begin = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (tile[1:] != tile[:-1])))) if len(row) else np.zeros(0, np.int64)
        taken = pa.array(row[begin])
        return pa.RecordBatch.from_arrays([
            pa.array(tile[begin], pa.int64()), batch.column(0).take(taken), batch.column(1).take(taken),
            pa.ListArray.from_arrays(pa.array(np.append(begin, len(row)), pa.int32()), pa.array(found, pa.int64()))], ["tile", "id", "vec", "lists"])

    asked = arrow_rows(rows.filter("asks").select("id", "vec").distinct(), f"tile bigint, id bigint, vec {kind}, lists array<bigint>", select)
    asked = cut_lineage(asked)
    # A row per tile: how many blocks its queries are dealt into, each meeting the tile's vectors.
    blocks = asked.groupBy(F.col("tile").alias("_tile")).agg(F.ceil(F.count(F.lit(1)) / options.queries).cast("int").alias("blocks"))
    blocks = cut_lineage(blocks)
    left = postings.join(blocks, F.col("tile") == F.col("_tile")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("tile", "block", "list", "ids", "vec")
    right = asked.join(blocks, F.col("tile") == F.col("_tile")).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("tile", "block", "id", "vec", "lists")

    def meet(vectors: pa.Table, questions: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_tile(vectors, questions, options.top), _FOUND)

    found = left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInArrow(
        meet, "query_id bigint, vec_id bigint, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= options.top).select("query_id", "rank", "vec_id", "score")


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _tile(vectors: pa.Table, questions: pa.Table, top: int) -> Iterator[pa.RecordBatch]:
    """The nearest of a tile's vectors for each of its queries, among the lists each has taken.

    A first product of whole lists picks more than enough; the scores of those are summed again in
    a fixed order, so that a pair has the same score in every tile.
    """
    if not vectors.num_rows or not questions.num_rows:
        return
    lists = vectors.column("list").to_numpy()
    order = np.argsort(lists, kind="stable")
    lists, vecs = lists[order], _matrix(vectors.column("vec").combine_chunks())[order]
    ids = [vectors.column("ids").combine_chunks()[int(i)].as_py() for i in order]
    asks, who = _matrix(questions.column("vec").combine_chunks()), questions.column("id").to_numpy()
    wanted = questions.column("lists").combine_chunks()
    owner = np.repeat(np.arange(len(who)), np.diff(wanted.offsets.to_numpy()))
    chosen = wanted.flatten().to_numpy()
    picks: list[list[int]] = [[] for _ in who]
    keep = top + 12
    for name in np.unique(lists):
        a, b = np.searchsorted(lists, name), np.searchsorted(lists, name, "right")
        asking = owner[chosen == name]
        if not len(asking):
            continue
        scores = asks[asking] @ vecs[a:b].T
        if b - a > keep:
            best = np.argpartition(-scores, keep, axis=1)[:, :keep]
        else:
            best = np.broadcast_to(np.arange(b - a), (len(asking), b - a))
        for q, row in zip(asking.tolist(), (best + a).tolist()):
            picks[q] += row
    out_q, out_v, out_s = [], [], []
    for q, found in enumerate(picks):
        if not found:
            continue
        exact = (asks[q] * vecs[found]).sum(axis=1)
        own = int(who[q])
        # A vector met in several lists has the same score in all.
        members = sorted({(-s, v) for s, i in zip(exact.tolist(), found) for v in ids[i] if v != own})[:top]
        out_q += [own] * len(members)
        out_v += [v for _, v in members]
        out_s += [-s for s, _ in members]
    yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], schema=_FOUND)
