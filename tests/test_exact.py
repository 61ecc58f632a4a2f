"""Exact operators against brute force, and their defined results on odd input."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from nearfold.functions import distance as D, vectors as V
from nearfold.operators import evaluate, exact


def frame(spark, vecs, ids=None):
    ids = range(len(vecs)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in zip(ids, vecs)], "id long, vec array<double>")


def brute(q, b, k, metric):
    out = []
    for i, x in enumerate(q):
        if metric == "l2":
            d = ((b - x) ** 2).sum(1)
        elif metric == "ip":
            d = -(b @ x)
        else:
            n = np.linalg.norm(b, axis=1) * np.linalg.norm(x)
            d = 1 - np.divide(b @ x, n, out=np.zeros(len(b)), where=n > 0)
        for r, j in enumerate(np.lexsort((np.arange(len(b)), np.round(d, 9)))[:k]):
            out.append((i, r + 1, int(j)))
    return out


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
@pytest.mark.parametrize("block", [7, 1000])
def test_knn_equals_brute_force(spark, metric, block):
    rng = np.random.default_rng(1)
    b = np.round(rng.standard_normal((300, 6)) * (8 if metric != "cosine" else 1e6)) / 8  # sums are exact in binary
    b[50:60] = b[40:50]  # ties
    b[3] = 0
    q = b[:20]
    got = exact.knn_join(frame(spark, q), frame(spark, b).repartition(5), 8, metric, block_rows=block)
    assert [(r.query_id, r.rank, r.id) for r in got.orderBy("query_id", "rank").collect()] == brute(q, b, 8, metric)


def test_grid_beyond_the_broadcast_blocks(spark, monkeypatch):
    b = np.random.default_rng(2).standard_normal((200, 4))
    monkeypatch.setattr(exact, "BROADCAST_BLOCKS", 2)
    got = exact.knn_join(frame(spark, b[:50]), frame(spark, b), 3, block_rows=10)
    assert [(r.query_id, r.rank, r.id) for r in got.orderBy("query_id", "rank").collect()] == brute(b[:50], b, 3, "l2")


@settings(max_examples=5, deadline=None)
@given(st.integers(1, 6), st.integers(1, 40), st.integers(0, 1000))
def test_knn_of_random_sizes(spark, k, n, seed):
    b = np.random.default_rng(seed).integers(0, 3, (n, 2)).astype(float)
    got = exact.knn_join(frame(spark, b[:5]), frame(spark, b), k)
    assert [(r.query_id, r.rank, r.id) for r in got.orderBy("query_id", "rank").collect()] == brute(b[:5], b, k, "l2")


def test_odd_input(spark):
    b = frame(spark, [[0, 0], None, [1, 1], [1, 1]], [5, 6, 7, 7]).selectExpr("id", "vec", "1 AS rank", "2 AS distance", "3 AS query_id")
    got = exact.knn_join(b, b, 10, skip_self=True)
    assert sorted((r.query_id, r.id) for r in got.collect()) == [(5, 7), (5, 7), (7, 5), (7, 5)]
    empty = frame(spark, [])
    assert exact.knn_join(b, empty, 3).count() == exact.knn_join(empty, b, 3).count() == exact.range_join(empty, b, 1.0).count() == 0
    assert exact.medoid(empty).count() == 0 and exact.centroid(empty).count() == 0
    with pytest.raises(Exception, match="one length"):
        exact.knn_join(frame(spark, [[1, 2]]), frame(spark, [[1, 2], [1]]).coalesce(1), 1).count()
    with pytest.raises(ValueError):
        exact.knn_join(b, b, 0)
    with pytest.raises(ValueError):
        exact.knn_join(b, b, 1, "manhattan")
    with pytest.raises(ValueError):
        D.metric("ip", "tinyint")


@pytest.mark.parametrize("blocks", [1, 16])
def test_range_join(spark, monkeypatch, blocks):
    monkeypatch.setattr(exact, "BROADCAST_BLOCKS", blocks)
    b = np.random.default_rng(3).standard_normal((100, 3))
    got = {(r.query_id, r.id) for r in exact.range_join(frame(spark, b[:10]), frame(spark, b), 1.0, skip_self=True, block_rows=4).collect()}
    assert got == {(i, j) for i in range(10) for j in range(100) if i != j and ((b[i] - b[j]) ** 2).sum() <= 1.0}


def test_transforms(spark):
    d = frame(spark, [[3, 4], [0, 0]])
    assert [list(r.v) for r in d.select(V.normalize("vec").alias("v")).collect()] == [[0.6, 0.8], [0, 0]]
    assert [round(r.c, 9) for r in d.select(D.cosine_distance("vec", "vec").alias("c")).collect()] == [0, 1]
    assert [list(r.v) for r in d.select(V.quantize_int8("vec", 0.0, 2.0).alias("v")).collect()] == [[127, 127], [0, 0]]
    m = [list(r.vec) for r in V.mips_base(d).orderBy("id").collect()]
    assert np.allclose(m, [[0.6, 0.8, 0], [0, 0, 1]])
    with pytest.raises(Exception, match="bad vector"):
        V.check_vectors(frame(spark, [[1, 2], None]), "vec", 2).collect()


def test_recall_counts_ties_and_live_rows(spark):
    truth = spark.createDataFrame([(1, 1, 10, 1.0), (1, 2, 11, 2.0), (1, 3, 12, 2.0), (1, 4, 13, 3.0)], "query_id long, rank int, id long, distance double")
    result = spark.createDataFrame([(1, 1, 10, 1.0), (1, 2, 12, 2.0)], "query_id long, rank int, id long, distance double")
    assert evaluate.recall_at(result, truth, 2).first().recall == 100.0
    live = spark.createDataFrame([(11,), (13,)], "id long")
    assert evaluate.active_recall(result, truth, live, 2).first().recall == 0.0
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    assert {r.query_id: r.recall for r in evaluate.range_recall(result, truth, q).collect()} == {1: 50.0, 2: 100.0}
    assert [r.recall for r in evaluate.recall_all_positions(result, truth, 2).orderBy("k").collect()] == [100.0, 100.0]


def test_percentiles_use_the_floor_rule(spark):
    d = spark.createDataFrame([(float(x),) for x in [5, 1, 1, 3]] + [(None,)], "v double")
    got = {r.p: r.value for r in evaluate.floor_percentiles(d, "v", [0.0, 0.5, 1.0]).collect()}
    assert got == {0.0: 1.0, 0.5: 3.0, 1.0: 5.0}


def test_rotate_there_and_back(spark):
    x = np.random.default_rng(1).standard_normal((30, 5))
    r, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((5, 5)))
    d = frame(spark, x)
    turned = V.rotate(d, r)
    assert np.allclose([t.vec for t in turned.orderBy("id").collect()], x @ r)
    assert np.allclose([t.vec for t in V.rotate(turned, r, transposed=True).orderBy("id").collect()], x)


def test_bfs_query_goes_beyond_16_levels(spark, monkeypatch):
    from nearfold.plans import exact_queries

    chain = spark.createDataFrame([(i, [i + 1]) for i in range(24)], "id long, nbrs array<long>")
    monkeypatch.setattr(exact_queries, "graph", lambda *_: chain)
    assert {(r.id, r.level) for r in exact_queries.bfs_levels(spark, "").collect()} == {(i, i) for i in range(25)}
