"""Queries of sources, statistics of searches, whole indexes, the JSON service and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dynamic, evaluate, exact, layout
from ..operators.blocks import cut, shared_folder
from ..operators.kernels import BuildParams
from ..operators.sessions import table
from ..sources import text, vecfile
from ..streaming import window
from . import index as I, service
from .checks import REACHED, recall_reached
from .exact_queries import BASE, GRAPH, K, asked, graph as knn_graph_of, base, knn, rounded, sql_knn, sql_l2
from .registry import query

_DRAW = "CAST(('0x' || substr(md5('1:' || CAST(vec_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0"


@query(f"SELECT vec_id AS id FROM embeddings WHERE {_DRAW} < 0.1")
def sample_rows(spark, d):
    """A sampling operator: each row with probability 0.1."""
    return text.sample_rows(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), 0.1)


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, embedding AS vec FROM embeddings")
def vector_file_roundtrip(spark, d):
    """Written as a binary file and read back; ids are row numbers."""
    path = shared_folder(spark, "vectors")
    vecfile.save_vectors(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), path)
    return vecfile.read_vectors(spark, path)


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, embedding AS vec FROM embeddings")
def fvecs_roundtrip(spark, d):
    a, b = (shared_folder(spark, x) for x in ("bin", "fvecs"))
    vecfile.save_vectors(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), a)
    vecfile.convert(spark, a, b, "bin", "fvecs")
    return vecfile.read_vectors(spark, b, "fvecs")


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, embedding AS vec FROM embeddings")
def vector_folder_roundtrip(spark, d):
    """Written as a folder of parts, without a joining commit, and read back."""
    path = shared_folder(spark, "folder")
    vecfile.save_vectors(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), path, partitions=5, folder=True)
    return vecfile.read_vectors(spark, path)


@query("SELECT row_number() OVER (ORDER BY id) - 1 AS logical_id, row_number() OVER (ORDER BY id DESC) - 1 AS physical_id FROM (SELECT DISTINCT id FROM partition_rows WHERE id IS NOT NULL)")
def permutation_file_roundtrip(spark, d):
    path, ids = shared_folder(spark, "permutation"), table(spark, d, "partition_rows").select("id").filter("id is not null").distinct()
    up, down = layout.number_globally(ids, ["id"], "logical_id"), layout.number_globally(ids.withColumn("_d", -F.col("id")), ["_d"], "physical_id")
    vecfile.save_permutation(up.select("id", "logical_id").join(down.select("id", "physical_id"), "id"), path)
    return vecfile.read_permutation(spark, path)


@query(f"WITH {GRAPH}, m AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM base) SELECT m.n AS id, list(t.n ORDER BY t.n) AS nbrs, m.n = 0 AS entry FROM (SELECT id, unnest(nbrs) AS t FROM graph) e JOIN m ON m.id = e.id JOIN m t ON t.id = e.t GROUP BY 1")
def graph_file_roundtrip(spark, d):
    """The exact neighbour graph, renumbered, as a graph file and back."""
    path, g = shared_folder(spark, "graph"), knn_graph_of(spark, d)
    small = dynamic.compact(g, dynamic.compaction_map(g.select("id")))
    vecfile.save_graph(small.select("id", F.sort_array("nbrs").alias("nbrs"), (F.col("id") == 0).alias("entry")), path)
    return vecfile.read_vectors(spark, path, "graph")


@query(f"""WITH {BASE}, {sql_knn(sql_l2('q.vec', 'b.vec'))}
SELECT dense_rank() OVER (ORDER BY query_id) - 1 AS query_id, CAST(rank AS INTEGER) AS rank, id, round(CAST(distance AS FLOAT), 3) AS distance FROM knn""")
def truth_file_roundtrip(spark, d):
    path = shared_folder(spark, "truth")
    vecfile.save_truth(knn(spark, d), path)
    return vecfile.read_vectors(spark, path, "truth").withColumn("distance", F.round(F.col("distance").cast("float"), 3))


_STATS = "s AS (SELECT DISTINCT stat_id, index_tag, search_l, total_us, n_ios, n_cmps FROM percentile_stats WHERE stat_id IS NOT NULL)"
_VALID = "total_us IS NOT NULL AND NOT isnan(total_us) AND total_us >= 0"


def _stats(spark, d):
    s = table(spark, d, "percentile_stats").filter("stat_id is not null").select("stat_id", "index_tag", "search_l", "total_us", "n_ios", "n_cmps").distinct()
    return s.filter("total_us is not null and not isnan(total_us) and total_us >= 0")


@query(f"WITH {_STATS} SELECT index_tag, search_l, count(*) AS n, round(avg(CAST(total_us AS DOUBLE)), 4) AS mean_us, round(avg(n_cmps), 4) AS mean_cmps FROM s WHERE {_VALID} GROUP BY 1, 2")
def search_stats_mean(spark, d):
    g = _stats(spark, d).groupBy("index_tag", "search_l")
    return g.agg(F.count("*").alias("n"), F.round(F.avg(F.col("total_us").cast("double")), 4).alias("mean_us"), F.round(F.avg("n_cmps"), 4).alias("mean_cmps"))


@query(f"""WITH {_STATS}, o AS (SELECT index_tag, search_l, total_us, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY index_tag, search_l) AS n FROM s WHERE {_VALID} WINDOW w AS (PARTITION BY index_tag, search_l ORDER BY total_us))
SELECT index_tag, search_l, CAST(p AS DOUBLE) AS p, total_us AS value FROM o, (VALUES (0.5::DOUBLE), (0.999::DOUBLE)) t(p) WHERE i = least(CAST(floor(p * n) AS BIGINT), n - 1)""")
def search_stats_percentiles(spark, d):
    return evaluate.floor_percentiles(_stats(spark, d), "total_us", [0.5, 0.999], ["index_tag", "search_l"])


@query()
def aggregate_recall(spark, d):
    return evaluate.simulate_aggregate_recall(spark, 10, 5, 4, [1.0, 0.99, 0.98, 0.97, 0.96])


_JSON = """req AS (SELECT id AS request_id, vec FROM asked)"""


@query(f"""WITH {BASE}, {sql_knn(sql_l2('q.vec', 'b.vec'), skip=False)}
SELECT query_id AS request_id, id, CAST(rank AS INTEGER) AS rank, '' || query_id AS query_id FROM knn""")
def json_service(spark, d):
    """Requests as JSON text, answers parsed back into rows."""
    b = base(spark, d)
    requests = asked(b).select(F.col("id").alias("request_id"), F.to_json(F.struct(F.col("vec").alias("query"), F.lit(K).alias("k"), F.col("id").alias("query_id"))).alias("request"))
    out = service.answer(requests, lambda q, k: exact.knn_join(q, b, k))
    r = out.select("request_id", F.from_json("response", "indices array<bigint>, query_id bigint").alias("r"))
    return r.select("request_id", F.posexplode("r.indices").alias("p", "id"), F.col("r.query_id").cast("string").alias("query_id")).select("request_id", "id", (F.col("p") + 1).alias("rank"), "query_id")


@query(f"WITH {BASE}, {sql_knn(sql_l2('q.vec', 'b.vec'), 10, asked_='(SELECT * FROM asked WHERE id = 0)', skip=False)} SELECT id, round(distance, 6) AS distance FROM knn")
def search_table_function(spark, d):
    """The SQL table function, one query against the table partitioned by label."""
    service.register_search_function(spark)
    b = base(spark, d)
    b.createOrReplaceTempView("nearfold_base")
    q = ",".join(repr(float(x)) + "D" for x in b.filter("id = 0").first().vec)
    return rounded(spark.sql(f"SELECT * FROM vector_search(TABLE(SELECT id, vec, label FROM nearfold_base) PARTITION BY (label), array({q}), 10) ORDER BY distance, id LIMIT 10"), "distance")


PARAMS = BuildParams(degree=24, list_size=48)


def _workload(spark, d):
    return table(spark, d, "workload").filter("query_id is not null and vec is not null").groupBy(F.col("query_id").alias("id")).agg(F.min("vec").alias("vec"))


def _rows(spark, d):
    r = table(spark, d, "partition_rows").filter("id is not null").filter((F.size("cur_row") == 64) & ~F.exists("cur_row", lambda x: x.isNull() | F.isnan(x)))
    return r.groupBy("id").agg(F.min("cur_row").alias("vec"))


@query()
def workload_index_pages(spark, d):
    """A whole workload-aware index over partition_rows: mean pages per query with the identity and the co-visit layout."""
    work = cut(_workload(spark, d))
    p = I.IndexParams(64, build=BuildParams(degree=16, list_size=32), shards=max(2, table(spark, d, "partition_rows").count() // 1000), layout="covisit", shard_rows=20_000)
    index = I.build_index(_rows(spark, d), p, work)
    paths = cut(I.simulate_paths(index, work))
    per = I._per_page(p)
    out = None
    for name, lay in (("identity", layout.identity_layout(index.rows, per)), ("covisit", index.layout)):
        one = layout.unique_pages(paths, lay).agg(F.lit(name).alias("layout"), F.avg("pages").alias("pages"), F.avg("nodes").alias("nodes"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "pages", "nodes")


def _index_recall(spark, d, metric, build=PARAMS, list_size=48):
    b = base(spark, d).select("id", "vec")
    index = I.build_index(b, I.IndexParams(64, metric, build, shards=2))
    return recall_reached(index.search(asked(b), K, list_size, skip_self=True), knn(spark, d, metric), K, 90)


@query(f"""WITH {BASE} SELECT id AS query_id, 10 AS results, true AS tags_right, true AS vectors_right FROM asked""")
def index_search_tags(spark, d):
    """Search that returns tags and vectors: tag = id + 1, every fifth row has none and is passed over."""
    b = base(spark, d).select("id", "vec")
    index = I.build_index(b, I.IndexParams(64, "l2", PARAMS, shards=2))
    got = index.search_tags(asked(b), b.filter(F.col("id") % 5 != 0).select("id", (F.col("id") + 1).alias("tag")), K, 64, vectors=True, skip_self=True)
    held = got.join(b.select("id", F.col("vec").alias("_v")), "id")
    right = (F.col("tag") == F.col("id") + 1) & (F.col("id") % 5 != 0)
    return held.groupBy("query_id").agg(F.count("*").cast("int").alias("results"), F.min(right).alias("tags_right"), F.min(F.col("vec") == F.col("_v")).alias("vectors_right"))


@query(f"WITH {BASE} {REACHED}")
def index_recall_l2(spark, d):
    return _index_recall(spark, d, "l2")


@query(f"WITH {BASE} {REACHED}")
def index_recall_ip(spark, d):
    """Queries lie far from the transformed base, so lists are longer than for the other metrics."""
    return _index_recall(spark, d, "ip", BuildParams(degree=32, list_size=100), 300)


@query(f"WITH {BASE} {REACHED}")
def index_recall_cosine(spark, d):
    return _index_recall(spark, d, "cosine", list_size=64)


@query("SELECT vec_id AS seq, vec_id AS id FROM embeddings WHERE vec_id > (SELECT max(vec_id) FROM embeddings) - 200")
def streaming_window(spark, d):
    """The live rows of a count-based window after the whole stream was read."""
    root, at = shared_folder(spark, "window"), shared_folder(spark, "progress")
    arriving = shared_folder(spark, "arriving")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("seq"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    rows.repartitionByRange(4, "seq").write.parquet(arriving)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    window.run_available(window.live_snapshots(stream, root, 200, at))
    return window.latest(spark, root).select("seq", "id")


@query(f"""WITH {BASE}, {sql_knn(sql_l2('q.vec', 'b.vec'), 5).replace('base b', '(SELECT * FROM base WHERE id > (SELECT max(id) FROM base) - 200) b')}
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(distance, 6) AS distance FROM knn""")
def streaming_window_search(spark, d):
    """Exact search over the live rows of the window."""
    b = base(spark, d)
    live = b.join(streaming_window(spark, d).select("id"), "id", "left_semi")
    return rounded(exact.knn_join(asked(b), live, 5, skip_self=True), "distance")
