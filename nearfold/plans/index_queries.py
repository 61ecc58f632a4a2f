"""Queries of partitioning and product quantisation. Fixed centres and codebooks let SQL check them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession, functions as F

from ..functions.arrow import matrix
from ..operators import cluster, pq
from ..operators.sessions import table
from .checks import REACHED, recall_reached
from .exact_queries import BASE, K, _long, asked, base, knn, rounded, sql_l2
from .registry import query

CENTRES = [0, 50, 100, 150]
CODES, CHUNKS = 16, 8


def fixed_centres(spark: SparkSession, d: str) -> np.ndarray:
    return matrix(base(spark, d).filter(F.col("id").isin(CENTRES)).orderBy("id").select("vec").toArrow().column("vec"))


def fixed_book(spark: SparkSession, d: str) -> pq.Codebook:
    """The rows of ids below 16, cut into 8 chunks, as 16 centres each; no centring."""
    x = matrix(base(spark, d).filter(F.col("id") < CODES).orderBy("id").select("vec").toArrow().column("vec"))
    o = pq.chunk_offsets(x.shape[1], CHUNKS)
    return pq.Codebook(o, [x[:, a:b] for a, b in zip(o, o[1:])], np.zeros(x.shape[1]))


_C = BASE + ", c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS center, vec AS cvec FROM base WHERE id IN (0, 50, 100, 150))"
_NEAR = f"""{_C}, n AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY {sql_l2('vec', 'cvec')}, center) AS INTEGER) AS rank,
CAST(center AS INTEGER) AS center, {sql_l2('vec', 'cvec')} AS distance, vec, cvec FROM base, c)"""


@query(f"WITH {_NEAR} SELECT id, rank, center, round(distance, 6) AS distance FROM n WHERE rank <= 1")
def nearest_center(spark, d):
    return rounded(cluster.nearest_centers(base(spark, d), fixed_centres(spark, d)), "distance")


@query(f"WITH {_NEAR} SELECT center AS shard, id FROM n WHERE rank <= 2")
def top2_shards(spark, d):
    return cluster.shard_members(base(spark, d), fixed_centres(spark, d), 2)


@query(f"WITH {_NEAR} SELECT center AS shard, count(*) AS n FROM n WHERE rank <= 2 GROUP BY 1")
def shard_sizes(spark, d):
    return cluster.shard_sizes(top2_shards(spark, d))


@query(f"WITH {_NEAR} SELECT count(DISTINCT center) AS shards, count(*) AS rows, count(*) / count(DISTINCT id) AS replication FROM n WHERE rank <= 2")
def replication_factor(spark, d):
    return cluster.replication_factor(top2_shards(spark, d))


@query(f"WITH {_NEAR} SELECT center AS shard, id, label FROM n JOIN base USING (id) WHERE rank <= 2")
def shard_data(spark, d):
    """Rows brought to their shards by an equi-join on the id."""
    b = base(spark, d)
    return cluster.shard_data(b, top2_shards(spark, d)).join(b.select("id", "label"), "id").select("shard", "id", "label")


@query(f"WITH {_NEAR} SELECT center AS shard, round(1.1::DOUBLE * (count(*) * 64 * 4 + count(*) * 64 * 4 * 1.3::DOUBLE + count(*) * 8 + count(*) * 24), 3) AS bytes FROM n WHERE rank <= 2 GROUP BY 1")
def ram_estimate(spark, d):
    return shard_sizes(spark, d).select("shard", F.round(cluster.ram_estimate(F.col("n"), 64, 64), 3).alias("bytes"))


@query(f"WITH {_NEAR} SELECT center AS shard, CAST(greatest(1, least(floor(4096.0 / count(*)), 64)) AS BIGINT) AS chunks FROM n WHERE rank <= 2 GROUP BY 1")
def pq_chunk_count(spark, d):
    """Chunks per shard that 4,096 bytes of codes allow."""
    return shard_sizes(spark, d).select("shard", pq.chunk_count(4096.0, F.col("n"), 64).alias("chunks"))


@query(f"""WITH {_NEAR}, m AS (SELECT center, pos, avg(x) AS x FROM (SELECT center, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM n WHERE rank = 1) GROUP BY 1, 2)
SELECT CAST(center AS INTEGER) AS center, CAST(pos AS INTEGER) AS pos, round(x, 6) AS x FROM m""")
def lloyd_one_iteration(spark, d):
    new, _ = cluster.lloyd_step(base(spark, d), fixed_centres(spark, d))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(new)]
    return rounded(spark.createDataFrame(rows, "center int, c array<double>").select("center", F.posexplode("c").alias("pos", "x")), "x")


@query(f"WITH {_NEAR} SELECT round(sum(distance), 4) AS residual FROM n WHERE rank = 1")
def kmeans_residual(spark, d):
    return cluster.kmeans_residual(base(spark, d), fixed_centres(spark, d)).select(F.round("residual", 4).alias("residual"))


@query(f"WITH {_NEAR} SELECT id, center, list_transform(list_zip(vec, cvec), lambda x: round(x[1] - x[2], 6)) AS vec FROM n WHERE rank = 1")
def residual_vectors(spark, d):
    r = cluster.residuals(base(spark, d), fixed_centres(spark, d))
    return r.select("id", "center", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query(f"""WITH {_NEAR}, p AS (SELECT q.id AS query_id, b.id AS id, {sql_l2('q.vec', 'b.vec')} AS distance FROM n q JOIN n b ON q.center = b.center
WHERE q.rank <= 2 AND b.rank = 1 AND q.id % 100 = 0 AND q.id <> b.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, id, round(distance, 6) AS distance FROM r WHERE rank <= {K}""")
def shard_pruned_knn(spark, d):
    """Each query looks only into its two nearest shards."""
    b = base(spark, d)
    return rounded(cluster.shard_pruned_knn(asked(b), b, fixed_centres(spark, d), K, probes=2), "distance")


@query(f"WITH {BASE} SELECT 8 AS shards, 2 * count(*) AS n, true AS none_empty FROM base")
def kmeans_partition(spark, d):
    """Shards of centres trained on the base itself: each row in two of eight, none empty."""
    b = base(spark, d)
    sizes = cluster.shard_sizes(cluster.shard_members(b, cluster.kmeans(b, 8, 10, seed=7), 2))
    return sizes.agg(F.count("*").cast("int").alias("shards"), F.sum("n").alias("n"), F.min(F.col("n") > 0).alias("none_empty"))


@query("SELECT 2 * count(DISTINCT id) AS n, true AS within_budget FROM partition_rows WHERE id IS NOT NULL AND len(cur_row) = 64 AND len([x FOR x IN cur_row IF x IS NULL OR isnan(x)]) = 0")
def query_aware_partition(spark, d):
    """Centres trained on the sampled workload, as many as bring every shard below 0.6 of the whole index; each row in two shards."""
    rows = table(spark, d, "partition_rows").filter((F.size("cur_row") == 64) & ~F.exists("cur_row", lambda x: x.isNull() | F.isnan(x)))
    rows = rows.select("id", F.col("cur_row").alias("vec")).filter("id is not null").dropDuplicates(["id"])
    work = table(spark, d, "workload").filter("query_id is not null and vec is not null").select(F.col("query_id").alias("id"), "vec").dropDuplicates(["id"])
    n = rows.count()
    centers = cluster.partition_for_budget(rows, 64, 32, cluster.ram_estimate(n, 64, 32) * 0.6, train_on=work)
    sizes = cluster.shard_sizes(cluster.shard_members(rows, centers, 2))
    return sizes.agg(F.sum("n").alias("n"), F.min(cluster.ram_estimate(F.col("n"), 64, 32) <= cluster.ram_estimate(n, 64, 32) * 0.6).alias("within_budget"))


_BOOK = f"""book AS (SELECT id AS code, j AS chunk, vec[8 * j + 1 : 8 * j + 8] AS center FROM base, (SELECT unnest(range(0, {CHUNKS})) AS j) WHERE id < {CODES}),
part AS (SELECT id, j AS chunk, vec[8 * j + 1 : 8 * j + 8] AS v FROM base, (SELECT unnest(range(0, {CHUNKS})) AS j)),
code AS (SELECT id, chunk, code, center FROM (SELECT part.id, part.chunk, code, center, row_number() OVER (PARTITION BY part.id, part.chunk ORDER BY {sql_l2('v', 'center')}, code) AS r
FROM part JOIN book ON part.chunk = book.chunk) WHERE r = 1)"""
_ADC = f"""adc AS (SELECT q.id AS query_id, code.id, sum({sql_l2('q.v', 'code.center')}) AS distance FROM part q JOIN code ON code.chunk = q.chunk WHERE q.id % 100 = 0 AND q.id <> code.id GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM adc))"""


@query(f"WITH {BASE}, {_BOOK} SELECT id, list(CAST(code AS SMALLINT) ORDER BY chunk) AS codes FROM code GROUP BY 1")
def pq_encode_fixed(spark, d):
    return pq.encode(base(spark, d), fixed_book(spark, d))


@query(f"WITH {BASE}, {_BOOK} SELECT id, list_transform(flatten(list(center ORDER BY chunk)), lambda x: round(x, 6)) AS vec FROM code GROUP BY 1")
def pq_decode(spark, d):
    book = fixed_book(spark, d)
    return _long(pq.decode(pq.encode(base(spark, d), book), book))


@query(f"WITH {BASE}, {_BOOK}, {_ADC} SELECT query_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= {K}")
def adc_topk(spark, d):
    """Ranks and distances of the scan over codes; ids are left out, as rows of equal codes tie."""
    b, book = base(spark, d), fixed_book(spark, d)
    return rounded(pq.adc_scan(asked(b), pq.encode(b, book), book, K, skip_self=True).select("query_id", "distance", "rank"), "distance")


@query(f"""WITH {BASE}, {_BOOK}, {_ADC}, e AS (SELECT query_id, max(distance) AS e FROM top WHERE rank <= {3 * K} GROUP BY 1),
s AS (SELECT top.query_id, top.id FROM top JOIN e USING (query_id) WHERE top.distance <= e + 1e-9),
f AS (SELECT s.query_id, s.id, {sql_l2('q.vec', 'b.vec')} AS distance FROM s JOIN base q ON q.id = s.query_id JOIN base b ON b.id = s.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM f)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(distance, 6) AS distance FROM r WHERE rank <= {K}""")
def adc_rerank(spark, d):
    """The 3k best of the scan, ties of the last one included, ordered by full vectors."""
    b, book = base(spark, d), fixed_book(spark, d)
    near = pq.adc_scan(asked(b), pq.encode(b, book), book, 3 * K, skip_self=True, ties=True)
    return rounded(pq.rerank(near, asked(b), b, K), "distance")


def _quantised(spark, d, book):
    b = base(spark, d)
    found = pq.rerank(pq.adc_scan(asked(b), pq.encode(b, book), book, 3 * K, skip_self=True), asked(b), b, K)
    return recall_reached(found, knn(spark, d), K, 90)


@query(f"WITH {BASE} {REACHED}")
def pq_search_recall(spark, d):
    """Whether trained codes of 32 bytes a row, with re-ranking of three times as many, have a recall of 90."""
    return _quantised(spark, d, pq.train(base(spark, d), 32, 64, seed=3))


@query(f"WITH {BASE} {REACHED}")
def opq_search_recall(spark, d):
    """The same with a learned rotation."""
    return _quantised(spark, d, pq.train_rotated(base(spark, d), 32, 64, rounds=6, seed=3))
