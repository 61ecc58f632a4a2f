"""Partitioning, codes, graphs, layouts, page-aware search, updates, whole indexes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.operators import cluster, disk, dynamic, evaluate, exact, graph as G, layout as L, pq
from nearfold.operators.kernels import BuildParams, padded_seeds, robust_prune
from nearfold.plans import index as I

from .test_exact import frame

P = BuildParams(degree=12, list_size=32)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6, 8))[rng.integers(0, 6, 400)] * 3 + rng.standard_normal((400, 8))
    b = frame(spark, x).cache()
    return x, b


@pytest.fixture(scope="module")
def built(spark, data):
    _, b = data
    centers = cluster.kmeans(b, 3, seed=2)
    members = cluster.shard_members(b, centers, 2).cache()
    return centers, members, G.build_sharded(b, members, P).cache()


def test_kmeans_repeats_and_lowers_the_residual(data):
    x, b = data
    a, c = cluster.kmeans(b, 4, seed=3), cluster.kmeans(b, 4, seed=3)
    assert np.allclose(a, c)
    start = cluster.plus_plus(x, 4, 3)
    assert cluster.kmeans_residual(b, a).first().residual <= cluster.kmeans_residual(b, start).first().residual


def test_empty_centres_stay_or_become_zero(data):
    _, b = data
    far = np.full((2, 8), 1e6)
    far[0] = 0
    keep, _ = cluster.lloyd_step(b, far)
    zero, _ = cluster.lloyd_step(b, far, empty="zero")
    assert (keep[1] == 1e6).all() and (zero[1] == 0).all()


def test_partition_fits_the_budget(data):
    _, b = data
    c = cluster.partition_for_budget(b, 8, 12, cluster.ram_estimate(200, 8, 12), replicas=1)
    assert cluster.shard_sizes(cluster.shard_members(b, c, 1)).agg(F.max("n")).first()[0] <= 200
    with pytest.raises(ValueError):
        cluster.partition_for_budget(b, 8, 12, 1.0, most=5)


def test_more_codes_and_rotation_reconstruct_better(data):
    x, b = data

    def loss(book):
        return ((book.decode(book.encode(x).astype(int)) - x) ** 2).sum()

    few, many = pq.train(b, 4, 4), pq.train(b, 4, 64)
    assert loss(many) < loss(few)
    assert loss(pq.train_rotated(b, 4, 16, rounds=6)) <= loss(pq.train(b, 4, 16)) * 1.1
    assert pq.chunk_offsets(10, 4) == [0, 3, 6, 8, 10]
    assert pq.chunk_count(1000, 100, 64) == 10 and pq.chunk_count(1, 100, 64) == 1
    codes = pq.encode(b, many)
    scan = pq.adc_scan(b.filter("id < 5"), codes, many, 10, block_rows=2)
    q, c = x[:5], many.encode(x).astype(int)
    want = many.distances(many.tables(q), c)
    for r in scan.collect():
        assert abs(r.distance - want[r.query_id, r.id]) < 1e-9
    assert scan.count() == 50


def test_graph_invariants(data, built):
    _, members, g = built
    rows = g.collect()
    known = {(r.shard, r.id) for r in members.collect()}
    assert {(r.shard, r.id) for r in rows} == known
    for r in rows:
        assert len(r.nbrs) <= P.degree and r.id not in r.nbrs and len(set(r.nbrs)) == len(r.nbrs)
        assert all((r.shard, n) in known for n in r.nbrs)
    assert all(sum(r.entry for r in rows if r.shard == s) == 1 for s in {r.shard for r in rows})


def test_search_finds_most_and_recall_grows_with_the_list(data, built):
    _, b = data
    centers, _, g = built
    q = b.filter("id % 10 = 0")
    truth = exact.knn_join(q, b, 5)
    r = [evaluate.recall_at(G.search(q, g, b, 5, size), truth, 5).first().recall for size in (5, 40)]
    assert r[1] >= 97 and r[1] >= r[0] - 1
    routes = cluster.nearest_centers(q, centers, 1).select(F.col("id").alias("query_id"), F.col("center").alias("shard"))
    assert evaluate.recall_at(G.search(q, g, b, 5, 40, routes), truth, 5).first().recall >= 80
    hidden = b.filter("id % 2 = 1").select("id")
    assert G.search(q, g, b, 5, 40, hidden=hidden).filter("id % 2 = 1").count() == 0
    with pytest.raises(ValueError):
        G.search(q, g, b, 50, 10)


def test_prune_respects_degree_and_keeps_the_nearest():
    x = np.random.default_rng(1).standard_normal((50, 3))
    d = ((x - x[0]) ** 2).sum(1)
    got = robust_prune(x, 0, np.arange(50), d, BuildParams(degree=5, list_size=5))
    assert len(got) <= 5 and 0 not in got and d[got].min() == np.sort(d)[1]


def test_merged_graph(spark, built):
    m = G.merge_shards(built[2], 8)
    assert m.count() == 400 and m.agg(F.max(F.size("nbrs"))).first()[0] <= 8


def test_page_aware_search_reads_no_more_pages_and_agrees(data, built):
    _, b = data
    _, _, g = built
    q = b.filter("id % 20 = 0")
    lay = L.identity_layout(b, 10)
    plain = disk.page_search(q, g, b, lay, 5, 30, 2)
    aware = disk.page_search(q, g, b, lay, 5, 30, 2, reuse_pages=True)
    key = lambda df: [(r.query_id, r.rank, r.id) for r in df.orderBy("query_id", "rank").collect()]
    assert key(plain) == key(aware)
    pages = [{r.query_id: r.pages for r in x.filter("rank = 1").collect()} for x in (plain, aware)]
    assert all(pages[1][k] <= v for k, v in pages[0].items()) and sum(pages[1].values()) < sum(pages[0].values())
    some = disk.page_search(q, g, b, lay, 5, 30, 2, page_limit=1)
    assert some.count() <= plain.count()
    everything = disk.page_search(q, g, b, lay, 5, 30, 2, cache=b.select("id"))
    assert everything.agg(F.max("pages")).first()[0] == 0


def test_range_search_and_tuner(data, built):
    _, b = data
    _, _, g = built
    q = b.filter("id % 40 = 0")
    truth = exact.range_join(q, b, 6.0)
    got = disk.range_search(q, g, b, L.identity_layout(b, 10), 6.0, 10, 400)
    assert got.filter("distance > 6").count() == 0
    assert got.select("query_id", "id").intersect(truth.select("query_id", "id")).count() >= 0.95 * truth.count()
    assert 1 <= disk.tune_beam(lambda w: [0.001] * 10, most=4) <= 4


def test_fast_l2_search(data, built):
    """Distances are norm - 2 x.q; seeds are the start's neighbours and random nodes, as many as the list is long."""
    x, b = data
    q = b.filter("id % 40 = 0")
    got = G.search(q, built[2], b, 5, 40, skip_self=True, metric="fast_l2")
    assert evaluate.recall_at(got, exact.knn_join(q, b, 5, skip_self=True), 5).first().recall >= 90
    vec = {r.id: np.array(r.vec) for r in b.collect()}
    rows = got.collect()
    assert all(abs(r.distance - (vec[r.id] @ vec[r.id] - 2 * vec[r.id] @ vec[r.query_id])) < 1e-4 for r in rows)
    assert min(r.comparisons for r in rows) >= 3 * 40
    nbrs = [np.array([3, 1]), np.array([0]), np.array([0]), np.array([0]), np.array([0])]
    seeds = padded_seeds(nbrs, np.array([0]), 4, 1)
    assert seeds[:2].tolist() == [3, 1] and len(set(seeds.tolist())) == 4
    assert padded_seeds(nbrs, np.array([0]), 1, 1).tolist() == [3] and sorted(padded_seeds(nbrs, np.array([0]), 9, 1).tolist()) == list(range(5))


def test_range_search_has_no_largest_result(data, built):
    """Far more rows within the radius than the largest list holds."""
    _, b = data
    _, _, g = built
    q = b.filter("id % 40 = 0")
    for skip in (False, True):
        got = disk.range_search(q, g, b, L.identity_layout(b, 10), 90.0, 10, 20, skip_self=skip).select("query_id", "id")
        truth = exact.range_join(q, b, 90.0, skip_self=skip).select("query_id", "id")
        assert truth.count() > 50 * q.count()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, truth.collect()))


def test_layouts_are_bijections(spark, data):
    _, b = data
    rng = np.random.default_rng(3)
    rows = [(p, i, int(n)) for p in range(30) for i, n in enumerate(rng.integers(0, 400, 9))]
    paths = L.paths_of(spark.createDataFrame([*rows, rows[0], (None, 1, 2), (1, None, 2), (1, 2, None)], "p long, o int, n long"), "p", "o", "n")
    assert paths.count() == len(set(rows))
    members = b.select((F.col("id") % 3).cast("int").alias("shard"), "id")
    w = L.covisit_weights(paths)
    inside = w.filter("a % 3 = b % 3").select((F.col("a") % 3).cast("int").alias("shard"), "a", "b", "weight")
    for lay in (L.identity_layout(b, 7), L.first_seen_layout(paths, b, 7), L.covisit_layout(inside, members, 7)):
        got = lay.orderBy("physical_id").collect()
        assert [r.physical_id for r in got] == list(range(400)) and {r.logical_id for r in got} == set(range(400))
        assert all(r.page_no == r.physical_id // 7 + 1 and r.slot == r.physical_id % 7 for r in got)
    with pytest.raises(ValueError):
        L.covisit_layout(inside, members, 7, shard_rows=10)
    assert L.covisit_weights(paths.filter("false")).count() == 0 and L.identity_layout(b.filter("false"), 7).count() == 0


def test_updates(spark, data, built):
    _, b = data
    _, members, g = built
    dead = b.filter("id % 5 = 0").select("id")
    fixed = dynamic.consolidate(g, b, dead, P)
    rows = fixed.collect()
    assert all(r.id % 5 and all(n % 5 for n in r.nbrs) and len(r.nbrs) <= P.degree for r in rows)
    live = b.join(dead, "id", "left_anti")
    q = b.filter("id % 10 = 1")
    assert evaluate.recall_at(G.search(q, fixed, live, 5, 40), exact.knn_join(q, live, 5), 5).first().recall >= 95
    back = dynamic.insert_rows(fixed, b, members, P)
    assert back.count() == g.count()
    assert evaluate.recall_at(G.search(q, back, b, 5, 40), exact.knn_join(q, b, 5), 5).first().recall >= 95
    log = spark.createDataFrame([(1, "insert", 7), (2, "delete", 7), (3, "delete", 7), (4, "insert", 0), (5, "insert", 8), (6, "insert", 8), (7, None, 9)], "seq long, op string, id long")
    assert sorted(r.id for r in dynamic.live_set(log).collect()) == [0, 8]
    assert [r.seq for r in dynamic.failed_deletes(log).collect()] == [3]
    assert sorted(r.seq for r in dynamic.failed_inserts(log).collect()) == [4, 6]
    m = dynamic.compaction_map(live)
    assert [r.new_id for r in m.orderBy("id").collect()] == list(range(320))
    c = dynamic.compact(G.merge_shards(fixed, 12), m).collect()
    assert len(c) == 320 and all(0 <= n < 320 for r in c for n in r.nbrs)


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_index_reports_the_metric_and_is_kept_in_versions(spark, data, metric, tmp_path):
    _, b = data
    index = I.build_index(b, I.IndexParams(8, metric, P, shards=2, chunks=4, codes=32, layout="covisit"), b.filter("id % 4 = 0"))
    q = b.filter("id % 10 = 0")
    truth = exact.knn_join(q, b, 5, metric)
    found = index.search(q, 5, 40)
    assert evaluate.recall_at(found, truth, 5).first().recall >= 90
    want = {(r.query_id, r.id): r.distance for r in truth.collect()}
    for r in found.collect():
        if (r.query_id, r.id) in want:
            assert abs(want[r.query_id, r.id] - r.distance) < 1e-6 * (1 + abs(r.distance))
    assert evaluate.recall_at(index.page_search(q, 5, 60), truth, 5).first().recall >= 80
    cat = I.Catalog(spark, str(tmp_path))
    assert cat.save("x", index) == 1 and cat.save("x", index) == 2 and cat.versions("x") == [1, 2]
    again = cat.load("x", 1).search(q, 5, 40)
    assert again.select("query_id", "id", "rank").exceptAll(found.select("query_id", "id", "rank")).count() == 0
    with pytest.raises(ValueError):
        cat.load("y")


def test_sweep(data):
    _, b = data
    q = b.filter("id % 20 = 0")
    index = I.build_index(b, I.IndexParams(8, build=P, shards=2))
    for pages in (False, True):
        t = I.sweep(index, q, exact.knn_join(q, b, 5), 5, [5, 40], pages).orderBy("L").collect()
        assert [r.L for r in t] == [5, 40] and t[1].recall >= 95 and t[1].comparisons >= t[0].comparisons and (t[0].pages is not None) == pages


def test_index_life_cycle(spark, data, tmp_path):
    _, b = data
    b = b.filter("id > 0")
    index = I.build_index(b.filter("id < 300"), I.IndexParams(8, build=P, shards=2))
    q = b.filter("id % 10 = 1")
    grown = index.insert(b.filter("id >= 300"))
    assert evaluate.recall_at(grown.search(q, 5, 40), exact.knn_join(q, b, 5), 5).first().recall >= 95
    with pytest.raises(ValueError):
        grown.insert(b.filter("id = 5"))
    gone = grown.delete(b.filter("id % 3 = 0"))
    assert gone.search(q, 5, 60).filter("id % 3 = 0").count() == 0
    with pytest.raises(ValueError):
        I.Catalog(spark, str(tmp_path)).save("x", gone)
    clean = gone.consolidate()
    live = b.filter("id % 3 <> 0")
    assert evaluate.recall_at(clean.search(q, 5, 40), exact.knn_join(q, live, 5), 5).first().recall >= 95
    assert clean.status().first().rows == live.count()
    assert clean.cache("levels").count() > 0 and clean.cache("queries", q).count() > 0 and clean.cache() is None
    with pytest.raises(ValueError):
        I.build_index(b.filter("false"), I.IndexParams(8))
    with pytest.raises(Exception, match="bad vector"):
        I.build_index(b, I.IndexParams(9))


def spark_routes(q):
    return q.select(F.col("id").alias("query_id"), F.lit(0).alias("shard"))


def test_queries_of_a_popular_shard_in_blocks(data, built, monkeypatch):
    _, b = data
    _, _, g = built
    q = b.filter("id % 3 = 0")
    lay = L.identity_layout(b, 10)
    whole, paged = (x.collect() for x in (G.search(q, g, b, 5, 20).orderBy("query_id", "rank"), disk.page_search(q, g, b, lay, 5, 20).orderBy("query_id", "rank")))
    routes = spark_routes(q)
    assert disk.page_search(q, g, b, lay, 5, 20, routes=routes).select("query_id").distinct().count() == q.count()
    monkeypatch.setattr(G.meet, "__defaults__", (7,))
    assert G.search(q, g, b, 5, 20).orderBy("query_id", "rank").collect() == whole
    assert disk.page_search(q, g, b, lay, 5, 20).orderBy("query_id", "rank").collect() == paged
    assert G.search(q.filter("false"), g, b, 5, 20).count() == 0


def test_comparisons_are_the_distances_computed(data, monkeypatch):
    """The guide is asked for each row once, when it is met, and for no other."""
    from nearfold.operators.kernels import beam_search, build_graph, distances

    x, _ = data
    nbrs, start = build_graph(x[:200], P)
    asked = []

    def guide(rows):
        asked.extend(rows.tolist())
        return distances(x, rows, x[3])

    _, _, s = beam_search(x[:200], nbrs, guide, np.array([start]), x[3], 20, 2, np.arange(200) // 5, np.zeros(200, bool), True)
    assert s.comparisons == len(asked) == len(set(asked)) < 200


def test_batch_stats_and_stored_codes(data, built):
    _, b = data
    _, _, g = built
    book = pq.train(b, 4, 32)
    q, lay = b.filter("id % 10 = 0"), L.identity_layout(b, 10)
    a = disk.page_search(q, g, b, lay, 5, 20, book=book, codes=pq.encode(b, book), timed=True)
    assert a.drop("us").exceptAll(disk.page_search(q, g, b, lay, 5, 20, book=book)).count() == 0
    s = disk.batch_stats(a).first()
    assert s.queries == 40 and 0 < s.mean_us <= s.p999_us and s.mean_pages > 0


def test_frozen_starts_code_distances_and_saturation(spark, data, built):
    _, b = data
    _, members, _ = built
    starts = G.start_points(8, 2.0, 2, 5)
    assert np.allclose(np.linalg.norm(starts, axis=1), 2.0) and np.array_equal(starts, G.start_points(8, 2.0, 2, 5))
    g = G.build_sharded(b, members, BuildParams(degree=12, list_size=32, saturate=True), starts=starts, book=pq.train(b, 8, 64))
    assert {(r.id, r.entry) for r in g.filter("entry or id < 0").collect()} == {(-1, True), (-2, True)}
    q, nodes = b.filter("id % 10 = 0"), b.unionByName(G.frozen_rows(spark, starts))
    found = G.search(q, g, nodes, 5, 40)
    assert found.filter("id < 0").count() == 0 and evaluate.recall_at(found, exact.knn_join(q, b, 5), 5).first().recall >= 90
    assert disk.page_search(q, g, nodes, L.identity_layout(nodes, 10), 5, 40).filter("id < 0").count() == 0
    full = g.agg(F.avg(F.size("nbrs"))).first()[0]
    assert full > G.build_sharded(b, members, P).agg(F.avg(F.size("nbrs"))).first()[0]
    index = I.build_index(b, I.IndexParams(8, build=P, shards=2, start_norm=1.5, chunks=4, codes=32, code_build=True))
    assert evaluate.recall_at(index.search(q, 5, 60), exact.knn_join(q, b, 5), 5).first().recall >= 90 and index.status().first().rows == 400
    paged = index.page_search(q, 5, 60)
    assert evaluate.recall_at(paged, exact.knn_join(q, b, 5), 5).first().recall >= 80 and paged.filter("id < 0").count() == 0
    assert index.range_search(q, 4.0).filter("id < 0").count() == 0 and index.cache("queries", q).filter("id < 0").count() == 0
    with pytest.raises(ValueError):
        I.IndexParams(8, code_build=True)


def test_merged_index_tags_and_report(spark, data):
    _, b = data
    index = I.build_index(b, I.IndexParams(8, build=P, shards=3))
    q = b.filter("id % 10 = 0")
    one = index.merged()
    assert one.graph.select("id").distinct().count() == one.graph.count() == 400 and one.graph.filter("entry").count() == 1
    assert evaluate.recall_at(one.search(q, 5, 60), exact.knn_join(q, b, 5), 5).first().recall >= 90
    with pytest.raises(ValueError):
        G.merged_graph(index.graph, b, 12, shard_rows=100)
    tags = b.filter("id % 4 <> 0").select("id", (F.col("id") * 2).alias("tag"))
    got = index.search_tags(q, tags, 5, 40, vectors=True)
    truth = exact.knn_join(q, b.filter("id % 4 <> 0"), 5)
    assert got.filter("tag <> id * 2 or id % 4 = 0 or vec is null").count() == 0 and evaluate.recall_at(got, truth, 5).first().recall >= 90
    gone = index.delete(spark.createDataFrame([(5,), (6,), (7777,), (None,)], "id long"))
    r = gone.consolidation_report(gone.consolidate()).first()
    assert (r.status, r.active, r.released, r.delete_set, r.unknown) == ("success", 398, 2, 3, 1) and r.repaired > 0
    assert gone.consolidation_report(index).first().status == "inconsistent_count"
    assert index.consolidation_report(index).first().repaired == 0


def test_tags_and_truth_sizes(spark):
    from nearfold.operators import tags as T

    found = spark.createDataFrame([(1, 1, 10, 0.5), (1, 2, 11, 0.7), (1, 3, 12, 0.9), (2, 1, 11, 0.1)], "query_id long, rank int, id long, distance double")
    known = spark.createDataFrame([(11, "b"), (12, "c")], "id long, tag string")
    assert sorted((r.query_id, r.rank, r.tag) for r in T.live_results(found, known, 1).collect()) == [(1, 1, "b"), (2, 1, "b")]
    with pytest.raises(Exception, match="no tag for id 10"):
        T.with_tags(found, known, strict=True).collect()
    q = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert tuple(T.truth_sizes(T.truth_within(found, 0.7), q).first()) == (3, 0, 2)
    rows = spark.createDataFrame([(11, [1.0]), (12, [2.0])], "id long, vec array<double>")
    wanted = spark.createDataFrame([("c",), ("x",), ("c",)], "tag string")
    assert {(r.tag, tuple(r.vec) if r.vec else None) for r in T.vectors_by_tag(known, rows, wanted).collect()} == {("c", (2.0,)), ("x", None)}


def test_many_queries_meet_codes_in_a_grid(data, monkeypatch):
    _, b = data
    book = pq.train(b, 4, 32)
    codes = pq.encode(b, book)
    for ties in (False, True):
        one = pq.adc_scan(b, codes, book, 5, skip_self=True, ties=ties).orderBy("query_id", "rank", "id").collect()
        assert pq.adc_scan(b, codes, book, 5, skip_self=True, block_rows=64, ties=ties).orderBy("query_id", "rank", "id").collect() == one
        monkeypatch.setattr(pq, "BROADCAST_BLOCKS", 1)
        assert pq.adc_scan(b, codes, book, 5, skip_self=True, block_rows=150, ties=ties).orderBy("query_id", "rank", "id").collect() == one
        monkeypatch.undo()


def test_numbers_are_dense_and_in_order(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 as x")
    for buckets in (None, 3):
        got = L.number_globally(rows, ["x"], "n", buckets).orderBy("x").collect()
        assert [(r.x, r.n) for r in got] == [(i, i) for i in range(1000)]
    assert L.number_globally(rows.filter("false"), ["x"], "n").count() == 0


def test_centres_are_trained_in_bounded_blocks():
    """Many centres for many rows: no matrix of all distances, and what one would give."""
    import tracemalloc

    x = np.round(np.random.default_rng(0).standard_normal((30_000, 8)) * 64) / 64
    tracemalloc.start()
    centers, near, residual = cluster.lloyd_local(x, cluster.plus_plus(x, 600, 1), 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000 * 600 * 8
    grid = ((x[:500, None] - centers) ** 2).sum(2)
    assert np.allclose(grid[np.arange(500), near[:500]], grid.min(1)) and np.isclose(residual, ((x - centers[near]) ** 2).sum())
