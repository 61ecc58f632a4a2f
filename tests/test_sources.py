"""Formats, text sources, the JSON service and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.operators import exact
from nearfold.plans import service
from nearfold.sources import text, vecfile
from nearfold.streaming import window

from .test_exact import frame


@pytest.mark.parametrize("element,values", [("float", [[0.5, -1], [2, 3], [4, 5]]), ("int8", [[-128, 1], [2, 127], [4, 5]]), ("uint8", [[0, 255], [2, 3], [4, 5]])])
def test_bin_round_trip(spark, tmp_path, element, values):
    p = str(tmp_path / "x.bin")
    vecfile.save_vectors(frame(spark, values), p, "bin", element)
    assert vecfile.header(p) == (3, 2)
    assert [list(r.vec) for r in vecfile.read_vectors(spark, p, "bin", element, rows_per_task=2).orderBy("id").collect()] == values
    assert [r.id for r in vecfile.read_rows(spark, p, 1, 2, element).orderBy("id").collect()] == [1, 2]
    with pytest.raises(ValueError):
        vecfile.read_rows(spark, p, 2, 2, element)
    with open(p, "r+b") as f:
        f.truncate(9)
    with pytest.raises(Exception, match="too short"):
        vecfile.read_vectors(spark, p, "bin", element).count()


def test_offset_and_empty(spark, tmp_path):
    p = tmp_path / "x.bin"
    p.write_bytes(b"skip" + np.array([2, 1], "<i4").tobytes() + np.array([7, 8], "<f4").tobytes())
    assert [r.vec[0] for r in vecfile.read_vectors(spark, str(p), offset=4).orderBy("id").collect()] == [7, 8]
    e = str(tmp_path / "e.bin")
    vecfile.save_vectors(frame(spark, []), e)
    assert vecfile.header(e) == (0, 0) and vecfile.read_vectors(spark, e).count() == 0


def test_conversions(spark, tmp_path):
    a, f, b, i = (str(tmp_path / x) for x in "afbi")
    values = [[float(x), float(x + 1)] for x in range(50)]
    vecfile.save_vectors(frame(spark, values), a)
    vecfile.convert(spark, a, f, "bin", "fvecs")
    vecfile.convert(spark, f, b, "fvecs", "bvecs")
    vecfile.convert(spark, f, i, "fvecs", "ivecs")
    for p, k in ((f, "fvecs"), (b, "bvecs"), (i, "ivecs")):
        assert [list(map(float, r.vec)) for r in vecfile.read_vectors(spark, p, k, rows_per_task=7).orderBy("id").collect()] == values


def test_truth_range_graph_permutation(spark, tmp_path):
    t = spark.createDataFrame([(0, 1, 5, 0.5), (0, 2, 6, 1.5), (1, 1, 7, 2.5), (1, 2, 8, 3.5)], "query_id long, rank int, id long, distance double")
    p = str(tmp_path / "t")
    vecfile.save_truth(t, p)
    assert sorted(map(tuple, vecfile.read_vectors(spark, p, "truth", rows_per_task=1).collect())) == sorted(map(tuple, t.collect()))
    with open(p, "r+b") as f:
        f.truncate(8 + 16)
    assert vecfile.read_vectors(spark, p, "truth").filter("distance is null").count() == 4
    r = tmp_path / "r"
    r.write_bytes(np.array([3, 3, 2, 0, 1], "<i4").tobytes() + np.array([4, 5, 6], "<u4").tobytes())
    assert sorted(map(tuple, vecfile.read_vectors(spark, str(r), "range_truth", rows_per_task=1).collect())) == [(0, 4), (0, 5), (2, 6)]
    g = tmp_path / "g"
    body = np.array([1, 1, 2, 0, 1], "<u4").tobytes()
    g.write_bytes(np.array([24 + len(body)], "<u8").tobytes() + np.array([2, 1], "<u4").tobytes() + np.array([0], "<u8").tobytes() + body)
    assert [(x.id, list(x.nbrs), x.entry) for x in vecfile.read_vectors(spark, str(g), "graph").orderBy("id").collect()] == [(0, [1], False), (1, [0, 1], True)]
    m = tmp_path / "m"
    m.write_bytes(np.array([3], "<u8").tobytes() + np.array([2, 0, 1], "<u4").tobytes())
    assert sorted(map(tuple, vecfile.read_vectors(spark, str(m), "permutation", rows_per_task=2).collect())) == [(0, 2), (1, 0), (2, 1)]


def test_side_files(spark, tmp_path):
    from nearfold.operators import pq
    from nearfold.sources import indexfiles as X

    p = str(tmp_path / "tags")
    X.save_ids(spark.createDataFrame([(0, 11), (1, 0), (2, 13), (3, 4_000_000_000)], "place long, id long"), p)
    assert sorted(map(tuple, X.read_tags(spark, p).collect())) == [(0, 11), (2, 13), (3, 4_000_000_000)]
    assert sorted(map(tuple, X.read_tags(spark, p, deleted=spark.createDataFrame([(2,)], "id long")).collect())) == [(0, 11), (3, 4_000_000_000)]
    assert sorted(map(tuple, X.read_shards(spark, {5: p}).filter("id < 12").collect())) == [(5, 0), (5, 11)]
    x = np.random.default_rng(2).standard_normal((300, 6))
    d = frame(spark, x)
    for book in (pq.train(d, 4, 256, rounds=2), pq.train_rotated(d, 3, 256, rounds=2)):
        c = str(tmp_path / f"book{len(book.offsets)}")
        X.save_codebook(book, c)
        again = X.read_codebook(c)
        assert again.offsets == book.offsets and np.allclose(again.encode(x), book.encode(x)) and (again.rotation is None) == (book.rotation is None)
        codes = pq.encode(d, book)
        X.save_codes(codes, c + ".codes")
        assert sorted(map(tuple, X.read_codes(spark, c + ".codes").collect())) == sorted(map(tuple, codes.collect()))
    with open(c, "r+b") as f:
        f.write(np.array([3, 1], "<i4").tobytes())
    with pytest.raises(ValueError, match="section offsets"):
        X.read_codebook(c)
    with pytest.raises(ValueError):
        X.save_codebook(pq.train(d, 2, 16), c)


def test_text(spark, tmp_path):
    p = tmp_path / "x.tsv"
    p.write_text("1 2\n\n 3\t4 \n")
    assert [(r.id, r.vec) for r in text.read_tsv(spark, str(p)).orderBy("id").collect()] == [(0, [1.0, 2.0]), (1, None), (2, [3.0, 4.0])]
    text.write_tsv(frame(spark, [[1, 2.5], [3, 4]]), str(tmp_path / "out"))
    assert [list(r.vec) for r in text.read_tsv(spark, str(tmp_path / "out")).orderBy("id").collect()] == [[1, 2.5], [3, 4]]
    lines = tmp_path / "l.txt"
    lines.write_text("".join(f"label {i}\n" for i in range(1000)))
    assert all(r.tag == f"label {r.id}" for r in text.read_labels(spark, str(lines)).collect())


def test_generated_rows(spark):
    a = {r.id: list(r.vec) for r in text.random_vectors(spark, 50, 8, 3.0, 7).collect()}
    b = {r.id: list(r.vec) for r in text.random_vectors(spark, 50, 8, 3.0, 7, partitions=3).collect()}
    assert a == b and all(abs(np.linalg.norm(v) - 3) < 1e-5 for v in a.values())
    u = text.random_vectors(spark, 20, 4, 50.0, element="uint8").agg(F.min(F.array_min("vec")), F.max(F.array_max("vec"))).first()
    assert 0 <= u[0] < 128 < u[1] <= 255
    rows = spark.range(2000)
    share = text.sample_rows(rows, 0.25, 3).count() / 2000
    assert 0.2 < share < 0.3 and text.sample_rows(rows, 5).count() == 2000
    assert text.warm_up(spark, 4, 10).count() == 10


def test_service(spark):
    rng = np.random.default_rng(12345)
    b = frame(spark, rng.random((300, 10)))
    q = [float(x) for x in rng.random(10)]
    asked = [{"query": q, "k": k, "Ls": 32, "query_id": k} for k in (1, 5, 10, 20)] + [{"query": q, "k": 0}, {"query": q, "k": -1}, {"query": [], "k": 3}, {"query": q, "k": 200}, {"k": 3}]
    rows = [(i, json.dumps(r)) for i, r in enumerate(asked)] + [(100, "no json"), (101, None)]
    tags = b.select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("tag"))
    got = {r.request_id: json.loads(r.response) for r in service.answer(spark.createDataFrame(rows, "request_id long, request string"), lambda x, k: exact.knn_join(x, b, k), tags).collect()}
    assert len(got) == len(rows)
    for i, k in enumerate((1, 5, 10, 20)):
        assert len(got[i]["indices"]) == len(got[i]["distances"]) == k and got[i]["query_id"] == k and got[i]["distances"] == sorted(got[i]["distances"])
        assert got[i]["tags"] == [f"t{x}" for x in got[i]["indices"]]
    assert all("error" in got[i] and "indices" not in got[i] for i in (4, 5, 6, 7, 8, 100, 101))
    two = service.answer(spark.createDataFrame(rows[:1], "request_id long, request string"), lambda x, k: exact.merge_results([exact.knn_join(x, b.filter(f"id % 2 = {r}"), k) for r in (0, 1)], k))
    one = json.loads(two.first().response)
    assert one["partition"] == [one["indices"][0] % 2]


def test_sliding_window_restarts(spark, tmp_path):
    src, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")
    rows = spark.range(100).selectExpr("id AS seq", "id % 30 AS id", "array(cast(id AS float)) AS vec")
    rows.filter("seq < 60").coalesce(1).write.parquet(src)
    stream = lambda: window.live_snapshots(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src), out, 20, at)
    window.run_available(stream())
    assert sorted(r.seq for r in window.latest(spark, out).collect()) == list(range(40, 60))
    rows.filter("seq >= 60").coalesce(1).write.mode("append").parquet(src)
    window.run_available(stream())
    assert sorted((r.seq, r.id) for r in window.latest(spark, out).collect()) == [(s, s % 30) for s in range(80, 100)]
    assert window.latest(spark, str(tmp_path / "none")) is None


def test_index_follows_a_stream(spark, tmp_path):
    from nearfold.operators import evaluate
    from nearfold.operators.kernels import BuildParams
    from nearfold.plans.index import Catalog, IndexParams
    from nearfold.streaming import updates

    x = np.random.default_rng(4).standard_normal((260, 6))
    rows = [(i, "insert", i, [float(y) for y in x[i]]) for i in range(260)]
    schema = "seq long, op string, id long, vec array<double>"
    src, at = str(tmp_path / "in"), str(tmp_path / "at")
    cat = Catalog(spark, str(tmp_path / "cat"))
    params = IndexParams(6, build=BuildParams(degree=10, list_size=24), shards=2)
    stream = lambda w: updates.maintain(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), cat, "x", params, at, w)
    spark.createDataFrame(rows[:150], schema).coalesce(1).write.parquet(src)
    window.run_available(stream(None))
    ops = [*rows[150:260], (1000, "delete", 7, None), (1001, "delete", 8, None), (1002, "insert", 8, [9.0] * 6), (1003, "delete", 5000, None)]
    spark.createDataFrame(ops, schema).coalesce(1).write.mode("append").parquet(src)
    window.run_available(stream(None))
    assert cat.versions("x") == [1, 2]
    index = cat.load("x")
    x[8] = 9
    live = [i for i in range(1, 260) if i != 7]
    b = frame(spark, x[live], live)
    assert sorted(r.id for r in index.rows.collect()) == live
    q = b.filter("id % 10 = 1")
    assert evaluate.recall_at(index.search(q, 5, 24), exact.knn_join(q, b, 5), 5).first().recall >= 95
    # A sliding window over the same rows, from its own start.
    cat2 = Catalog(spark, str(tmp_path / "cat2"))
    parts = str(tmp_path / "in2")
    for k in range(1, 261, 65):
        spark.createDataFrame([r for r in rows[k : k + 65]], schema).coalesce(1).write.mode("append").parquet(parts)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(parts)
    window.run_available(updates.maintain(s, cat2, "w", params, str(tmp_path / "at2"), 100))
    assert sorted(r.id for r in cat2.load("w").rows.collect()) == list(range(160, 260))


def test_folders_graphs_and_permutations(spark, tmp_path):
    x = [[float(i), i / 2] for i in range(50)]
    for kind in ("bin", "fvecs"):
        p = str(tmp_path / f"{kind}.parts")
        vecfile.save_vectors(frame(spark, x), p, kind, partitions=4, folder=True)
        assert [(r.id, list(r.vec)) for r in vecfile.read_vectors(spark, p, kind, rows_per_task=7).orderBy("id").collect()] == list(enumerate(x))
        assert [r.id for r in vecfile.read_vectors(spark, p, kind).filter("id >= 20 and id < 23").orderBy("id").collect()] == [20, 21, 22]
    assert vecfile.header(str(tmp_path / "bin.parts")) == (50, 2)
    with pytest.raises(Exception, match="a folder of bin files"):
        vecfile.read_vectors(spark, str(tmp_path / "bin.parts"), "fvecs").count()
    g = [(i, [(i + 1) % 30, (i * 7) % 30][: i % 3], i == 17) for i in range(30)]
    p = f"file://{tmp_path}/graph"
    vecfile.save_graph(spark.createDataFrame(g, "id long, nbrs array<long>, entry boolean"), p, partitions=3)
    assert sorted((r.id, list(r.nbrs), r.entry) for r in vecfile.read_vectors(spark, p, "graph").collect()) == g
    with pytest.raises(ValueError):
        vecfile.save_graph(spark.createDataFrame([(1, [2], True)], "id long, nbrs array<long>, entry boolean"), p)
    m = [(i, (i * 7) % 10) for i in range(10)]
    p = str(tmp_path / "permutation")
    vecfile.save_permutation(spark.createDataFrame(m, "logical_id long, physical_id long"), p, partitions=2)
    assert sorted(map(tuple, vecfile.read_permutation(spark, p).collect())) == m
    assert sorted(map(tuple, vecfile.read_permutation(spark, p + "-none", 3).collect())) == [(0, 0), (1, 1), (2, 2)]
    with pytest.raises(ValueError):
        vecfile.save_permutation(spark.createDataFrame([(0, 1)], "logical_id long, physical_id long"), p)


def test_server_and_client(spark):
    import threading

    b = frame(spark, np.eye(4).tolist())
    server = service.serve(spark, lambda q, k: exact.knn_join(q, b, k), tags=b.select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("tag")))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        one = service.ask(url, [1.0, 0, 0, 0], 2, query_id=9)
        assert one["indices"][0] == 0 and one["distances"][0] == 0 and one["tags"][0] == "t0" and one["query_id"] == 9 and one["time_taken_in_us"] > 0
        assert [x["indices"] for x in service.ask(url, [[0.0, 1, 0, 0], [0.0, 0, 0, 1]], 1)] == [[1], [3]]
        for k in (-1, 0):
            with pytest.raises(ValueError, match="k must be positive"):
                service.ask(url, [1.0, 0, 0, 0], k)
    finally:
        server.shutdown()
        server.server_close()
