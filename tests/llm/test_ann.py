import numpy as np
from pyspark.sql import functions as F

from evitrace.llm import ann
from evitrace.llm.queries import QUERIES


def brute(ids, vecs, query, top=20):
    found = {}
    for i, v in zip(ids, vecs):
        if i != query[0]:
            s = float((np.array(query[1], np.float64) * np.array(v, np.float64)).sum())
            found[i] = max(s, found.get(i, -np.inf))
    return sorted(found.items(), key=lambda x: (-x[1], x[0]))[:top]


def results(df):
    made = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        made.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(made[r.query_id])
    return made


def test_recall_against_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    vecs = np.array([r.embedding for r in rows], np.float64)
    ids = np.array([r.vec_id for r in rows])
    got = results(QUERIES["op6_nearest_neighbours"](spark, sf))
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        scores = vecs @ vecs[i]
        scores[i] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
        mine = got[int(ids[i])]
        hits.append(len(best & {v for v, _ in mine}) / 20)
        assert len(mine) == 20
    assert np.mean(hits) >= 0.9


def test_many_lists_and_tiles(spark):
    """Clusters of different norms, a vector that holds a third of the rows, several tiles."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16)) * rng.uniform(0.5, 3, (30, 1))
    vecs = (centres[rng.integers(0, 30, 3000)] + 0.15 * rng.normal(size=(3000, 16))).astype(np.float32)
    vecs[::3] = vecs[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    options = ann.Options(list_size=60, values=5_000, queries=20)
    got = results(ann.search(df, F.col("vec_id") % 50 == 0, options=options))
    hits = [len({i for i, _ in got[q]} & {i for i, _ in brute(range(3000), vecs, (q, vecs[q]))}) / 20 for q in range(0, 3000, 50)]
    assert len(got) == 60 and np.mean(hits) >= 0.9
    assert [i for i, _ in got[0]] == [i for i, _ in brute(range(3000), vecs, (0, vecs[0]))]  # ties by id


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (20, [1.0, 0.0], 2), (3, [0.5, 0.5], 3), (4, None, 4), (5, [0.0, 0.0], 5),
            (6, [nan, 1.0], 6), (7, [inf, 1.0], 7), (8, [None, 1.0], 8), (None, [1.0, 1.0], 9), (9, [1.0, 2.0, 3.0], 9), (40, [], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")
    got = results(ann.search(df, F.col("vec_id") % 20 == 0))
    assert got == {0: [(20, 1.0), (3, 0.5)], 20: [(0, 1.0), (3, 0.5)]}
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.filter("vec_id = 5"), F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_rows_take_no_places(spark):
    rows = [(i, [1.0, 2.0]) for i in range(30) for _ in range(2 if i else 25)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = results(ann.search(df, F.col("vec_id") % 20 == 0))
    assert {q: [i for i, _ in found] for q, found in got.items()} == {0: list(range(1, 21)), 20: list(range(20))}


def test_walk_finds_the_nearest_centroid():
    x = np.random.default_rng(1).normal(size=(2000, 8))
    lists = ann.fit(x, float(np.sqrt((x * x).sum(1)).max()), 100, ann.Options())
    lifted = lists.lift(x[:200])
    exact = ann.distances(lifted, lists.centroids)
    assert np.isclose(lists.walk(lifted, 0.1).min(1), exact.min(1)).mean() > 0.97
