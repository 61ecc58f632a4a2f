"""Queries of graphs, layouts, page-aware search and updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import cluster, disk, dynamic, graph as G, layout, pq
from ..operators.kernels import BuildParams
from ..operators.sessions import table
from .checks import REACHED, recall_reached, results_right, sql_right
from .exact_queries import BASE, GRAPH, K, asked, base, graph as knn_graph_of, knn, rounded, sql_l2
from .index_queries import _NEAR, fixed_centres, top2_shards
from .registry import query

PARAMS = BuildParams(degree=24, list_size=48)


def built(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from ..operators.blocks import cut

    b = base(spark, d).select("id", "vec")
    return b, cut(G.build_sharded(b, top2_shards(spark, d), PARAMS))


@query(f"WITH {BASE} {REACHED}")
def graph_search_recall(spark, d):
    """Whether greedy search in sharded graphs, every query in every shard, has a recall of 90."""
    b, g = built(spark, d)
    return recall_reached(G.search(asked(b), g, b, K, 48, skip_self=True), knn(spark, d), K, 90)


@query(f"WITH {BASE} {sql_right(K)}")
def graph_search_routed(spark, d):
    """Results when each query looks into its two nearest shards only."""
    b, g = built(spark, d)
    routes = cluster.nearest_centers(asked(b), fixed_centres(spark, d), 2).select(F.col("id").alias("query_id"), F.col("center").alias("shard"))
    return results_right(G.search(asked(b), g, b, K, 48, routes, skip_self=True), b, asked(b), K)


@query(f"WITH {BASE} SELECT count(*) AS nodes, true AS within_degree, true AS no_loops, true AS every_node_leads_on FROM base")
def merged_graph_degrees(spark, d):
    """The shards' graphs merged into one: every row once, no list above the degree, no edge to itself, no empty list."""
    g = G.merge_shards(built(spark, d)[1], PARAMS.degree)
    return g.agg(
        F.countDistinct("id").alias("nodes"), F.min(F.size("nbrs") <= PARAMS.degree).alias("within_degree"), F.min(~F.array_contains("nbrs", F.col("id"))).alias("no_loops"),
        F.min(F.size("nbrs") > 0).alias("every_node_leads_on"),
    )


@query(f"WITH {BASE} {REACHED}")
def merged_graph_recall(spark, d):
    """Whether the merged graph, searched from the medoid of all rows, has a recall of 90."""
    b, g = built(spark, d)
    one = G.merged_graph(g, b, PARAMS.degree * 2)
    return recall_reached(G.search(asked(b), one, b, K, 100, skip_self=True), knn(spark, d), K, 90)


@query(f"WITH {BASE} {REACHED}")
def bulk_graph_recall(spark, d):
    """Whether graphs built in blocks instead of by insertion have a recall of 90."""
    b = base(spark, d).select("id", "vec")
    g = G.build_bulk(b, top2_shards(spark, d), PARAMS)
    return recall_reached(G.search(asked(b), g, b, K, 48, skip_self=True), knn(spark, d), K, 90)


@query(f"WITH {BASE} {REACHED}")
def fast_l2_graph_recall(spark, d):
    """Whether graph search by norm - 2 x.q, from padded seeds, has a recall of 90."""
    b, g = built(spark, d)
    return recall_reached(G.search(asked(b), g, b, K, 48, skip_self=True, metric="fast_l2"), knn(spark, d), K, 90)


@query(f"WITH {BASE} {REACHED}")
def code_built_graph_recall(spark, d):
    """Whether graphs built on distances between codes, with a frozen start point and saturated lists, have a recall of 90."""
    b = base(spark, d).select("id", "vec")
    starts = G.start_points(64, 5.0)
    params = BuildParams(degree=24, list_size=48, saturate=True)
    g = G.build_sharded(b, top2_shards(spark, d), params, starts=starts, book=pq.train(b, 32, 64, seed=3))
    return recall_reached(G.search(asked(b), g, b.unionByName(G.frozen_rows(spark, starts)), K, 64, skip_self=True), knn(spark, d), K, 90)


_KNN_SHARDS = f"""{_NEAR}, m AS (SELECT center AS shard, id, vec FROM n WHERE rank <= 2),
e AS (SELECT a.shard, a.id, b.id AS t, row_number() OVER (PARTITION BY a.shard, a.id ORDER BY {sql_l2('a.vec', 'b.vec')}, b.id) AS r FROM m a JOIN m b ON a.shard = b.shard AND a.id <> b.id)"""


@query(f"WITH {_KNN_SHARDS} SELECT base.id, coalesce((SELECT list(t ORDER BY t) FROM (SELECT DISTINCT t FROM e WHERE e.id = base.id AND r <= 4)), []) AS nbrs FROM base")
def merge_shards_union(spark, d):
    """The 4-nearest graphs of the shards, each id's neighbours united."""
    from ..operators import exact

    b, members = base(spark, d).select("id", "vec"), top2_shards(spark, d)
    graphs = None
    for s in range(4):
        own = b.join(members.filter(F.col("shard") == s).select("id"), "id")
        one = exact.knn_graph(own, 4).groupBy(F.col("query_id").alias("id")).agg(F.collect_list(F.struct("rank", "id")).alias("x")).select("id", F.transform("x", lambda x: x["id"]).alias("nbrs"))
        graphs = one if graphs is None else graphs.unionByName(one)
    return G.merge_shards(graphs, 8)


def paths(spark: SparkSession, d: str) -> DataFrame:
    """The search logs of ``neighbor`` as paths."""
    return layout.paths_of(table(spark, d, "neighbor"), "search_id", "pos", "id")


PATHS = "paths AS (SELECT DISTINCT search_id AS path_id, pos, id FROM neighbor WHERE search_id IS NOT NULL AND pos IS NOT NULL AND id IS NOT NULL)"
_COVISIT = PATHS + """, w AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, sum(1.0::DOUBLE / (1 + y.pos - x.pos)) AS weight
FROM paths x JOIN paths y ON x.path_id = y.path_id AND y.pos - x.pos BETWEEN 1 AND 3 AND x.id <> y.id GROUP BY 1, 2)"""


@query(f"WITH {_COVISIT} SELECT a, b, round(weight, 6) AS weight FROM w")
def covisit_weights(spark, d):
    return rounded(layout.covisit_weights(paths(spark, d)), "weight")


@query(f"WITH {_COVISIT} SELECT id, round(sum(weight), 6) AS strength FROM (SELECT a AS id, weight FROM w UNION ALL SELECT b, weight FROM w) GROUP BY 1")
def covisit_strength(spark, d):
    return rounded(layout.covisit_strength(layout.covisit_weights(paths(spark, d))), "strength")


@query(f"WITH {PATHS} SELECT id, count(DISTINCT path_id) AS visits FROM paths GROUP BY 1")
def visit_counts(spark, d):
    return layout.visit_counts(paths(spark, d))


@query(f"WITH {PATHS} SELECT id, count(DISTINCT path_id) AS visits FROM paths GROUP BY 1 ORDER BY visits DESC, id LIMIT 100")
def hot_nodes(spark, d):
    return layout.hot_nodes(paths(spark, d), 100)


@query(f"WITH {PATHS}, p AS (SELECT path_id, count(*) AS n FROM paths GROUP BY 1) SELECT count(*) AS paths, avg(n) AS avg_length, max(n) AS max_length, (SELECT count(DISTINCT id) FROM paths) AS nodes FROM p")
def path_stats(spark, d):
    return layout.path_stats(paths(spark, d))


PER_PAGE = layout.nodes_per_page(24, 64)
_IDS = "ids AS (SELECT DISTINCT id FROM partition_rows WHERE id IS NOT NULL)"
_PAGES = f"CAST(floor(physical_id / {PER_PAGE}) AS BIGINT) + 1 AS page_no, CAST(physical_id % {PER_PAGE} AS INTEGER) AS slot"
_FIRST = f"""{PATHS}, {_IDS}, f AS (SELECT id, path_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY path_id, pos) AS r FROM paths) WHERE r = 1),
o AS (SELECT ids.id AS logical_id, row_number() OVER (ORDER BY f.id IS NULL, path_id, pos, ids.id) - 1 AS physical_id FROM ids LEFT JOIN f USING (id))"""


def all_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "partition_rows").select("id").filter("id is not null").distinct()


@query(f"WITH {_IDS}, o AS (SELECT id AS logical_id, row_number() OVER (ORDER BY id) - 1 AS physical_id FROM ids) SELECT *, {_PAGES} FROM o")
def identity_pages(spark, d):
    return layout.identity_layout(all_ids(spark, d), PER_PAGE)


@query(f"WITH {_FIRST} SELECT *, {_PAGES} FROM o")
def first_seen_layout(spark, d):
    return layout.first_seen_layout(paths(spark, d), all_ids(spark, d), PER_PAGE)


@query(f"WITH {_FIRST} SELECT path_id, count(DISTINCT id) AS nodes, count(DISTINCT floor(physical_id / {PER_PAGE})) AS pages FROM paths JOIN o ON logical_id = id GROUP BY 1")
def unique_pages(spark, d):
    return layout.unique_pages(paths(spark, d), layout.first_seen_layout(paths(spark, d), all_ids(spark, d), PER_PAGE))


@query(f"WITH {_IDS} SELECT count(*) AS nodes, count(*) AS places, 0 AS first, count(*) - 1 AS last, true AS pages_right FROM ids")
def covisit_layout_bijection(spark, d):
    """The layout of ``covisit_layout`` gives every id a place of its own, without gaps, and pages by place."""
    lay = covisit_layout(spark, d)
    page = (F.col("page_no") == F.floor(F.col("physical_id") / PER_PAGE) + 1) & (F.col("slot") == F.col("physical_id") % PER_PAGE)
    p = F.col("physical_id")
    return lay.agg(F.countDistinct("logical_id").alias("nodes"), F.countDistinct(p).alias("places"), F.min(p).cast("int").alias("first"), F.max(p).alias("last"), F.min(page).alias("pages_right"))


@query()
def covisit_layout(spark, d):
    """Breadth-first layout over the co-visit edges of each shard's searches; an id goes to the shard that visits it most."""
    logs = table(spark, d, "neighbor").filter("id is not null")
    home = logs.groupBy("id", "shard").agg(F.count("*").alias("n")).groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "shard")).alias("h")).select("id", "h.shard")
    members = all_ids(spark, d).join(home, "id", "left").fillna(-1, ["shard"]).select("shard", "id")
    w = layout.covisit_weights(paths(spark, d))
    a, b = (members.select(F.col("id").alias(c), F.col("shard").alias(f"_{c}")) for c in "ab")
    inside = w.join(a, "a").join(b, "b").filter("_a = _b").select(F.col("_a").alias("shard"), "a", "b", "weight")
    return layout.covisit_layout(inside, members, PER_PAGE)


def _disk(spark, d, reuse: bool, cached: bool = False) -> DataFrame:
    b, g = built(spark, d)
    lay = layout.identity_layout(b, PER_PAGE)
    book = pq.train(b, 32, 64, seed=3)
    cache = layout.cache_by_levels(g.select("id", "nbrs"), g.filter("entry").select("id"), 0.1) if cached else None
    return disk.page_search(asked(b), g, b, lay, K, 64, 2, book, reuse, cache, skip_self=True, codes=pq.encode(b, book))


@query(f"WITH {BASE} {sql_right(K)}")
def beam_search(spark, d):
    b = base(spark, d)
    return results_right(_disk(spark, d, False), b, asked(b), K)


@query(f"WITH {BASE} {sql_right(K)}")
def page_aware_search(spark, d):
    b = base(spark, d)
    return results_right(_disk(spark, d, True), b, asked(b), K)


@query(f"WITH {BASE} {sql_right(K)}")
def cached_page_search(spark, d):
    b = base(spark, d)
    return results_right(_disk(spark, d, True, True), b, asked(b), K)


@query(f"WITH {BASE} SELECT count(*) AS queries, true AS reached, true AS counted, true AS same_results FROM asked")
def page_search_costs(spark, d):
    """Page-aware search: a recall of 90; with reuse the same results and no more pages; every query has read a page and compared rows, fewer than all."""
    from ..operators.blocks import cut

    plain, reuse = (cut(_disk(spark, d, x)) for x in (False, True))
    n = base(spark, d).count()
    one, two = (x.filter("rank = 1").select("query_id", F.col("pages").alias(f"p{i}"), F.col("comparisons").alias(f"c{i}")) for i, x in enumerate((plain, reuse)))
    key = ["query_id", "rank", "id"]
    other = plain.select(*key).exceptAll(reuse.select(*key)).agg((F.count("*") == 0).alias("same_results"))
    counted = (F.col("p1") > 0) & (F.col("p1") <= F.col("p0")) & (F.col("c1") > K) & (F.col("c1") < 2 * n)
    costs = one.join(two, "query_id").agg(F.min(counted).alias("counted"))
    return recall_reached(reuse, knn(spark, d), K, 90).join(F.broadcast(costs)).join(F.broadcast(other))  # one row each


@query(f"WITH {BASE}, d AS (SELECT q.id AS query_id, b.id AS id FROM asked q, base b WHERE q.id <> b.id AND {sql_l2('q.vec', 'b.vec')} <= 30) SELECT count(DISTINCT query_id) AS queries, true AS reached, true AS within FROM d")
def range_graph_search(spark, d):
    """Range search in the graphs: 90 of 100 rows within the radius, and none beyond it."""
    b, g = built(spark, d)
    found = disk.range_search(asked(b), g, b, layout.identity_layout(b, PER_PAGE), 30.0, 50, 500, skip_self=True)
    from ..operators import exact

    truth = exact.range_join(asked(b), b, 30.0, skip_self=True).select("query_id", "id")
    hits = truth.join(found.select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("_share"))
    inside = found.agg(F.coalesce(F.max("distance") <= 30, F.lit(True)).alias("within"))
    return hits.agg(F.count("*").alias("queries"), (F.avg("_share") >= 0.9).alias("reached")).join(F.broadcast(inside))  # one row


LOG = """log AS (SELECT vec_id AS seq, 'insert' AS op, vec_id AS id FROM embeddings
UNION ALL SELECT vec_id + 1000000, 'delete', vec_id FROM embeddings WHERE vec_id % 7 = 0
UNION ALL SELECT vec_id + 2000000, 'delete', vec_id FROM embeddings WHERE vec_id % 14 = 0
UNION ALL SELECT vec_id + 3000000, 'insert', vec_id FROM embeddings WHERE vec_id % 21 = 0)"""


def log(spark: SparkSession, d: str) -> DataFrame:
    """Every row inserted, each seventh deleted, each fourteenth deleted again, each 21st inserted again."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    steps = [(0, "insert", 1), (1_000_000, "delete", 7), (2_000_000, "delete", 14), (3_000_000, "insert", 21)]
    out = None
    for start, op, each in steps:
        one = e.filter(F.col("id") % each == 0).select((F.col("id") + start).alias("seq"), F.lit(op).alias("op"), "id")
        out = one if out is None else out.unionByName(one)
    return out


_LAST = "last AS (SELECT id, op FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM log) WHERE r = 1)"
_BEFORE = "b AS (SELECT *, lag(op) OVER (PARTITION BY id ORDER BY seq) AS before FROM log)"


@query(f"WITH {LOG}, {_LAST} SELECT id FROM last WHERE op = 'insert'")
def live_set(spark, d):
    return dynamic.live_set(log(spark, d))


@query(f"WITH {LOG}, {_BEFORE} SELECT seq, id FROM b WHERE op = 'delete' AND (before IS NULL OR before = 'delete')")
def failed_deletes(spark, d):
    return dynamic.failed_deletes(log(spark, d))


@query(f"WITH {LOG}, {_BEFORE} SELECT seq, id FROM b WHERE op = 'insert' AND (id = 0 OR before = 'insert')")
def failed_inserts(spark, d):
    return dynamic.failed_inserts(log(spark, d))


@query(f"""WITH {GRAPH}, e AS (SELECT id, unnest(nbrs) AS t FROM graph), dead AS (SELECT id FROM base WHERE id % 7 = 0),
live AS (SELECT * FROM e ANTI JOIN dead USING (id)), broken AS (SELECT id, t AS via FROM live WHERE t IN (SELECT id FROM dead)),
u AS (SELECT id, t FROM live WHERE id IN (SELECT id FROM broken) UNION SELECT broken.id, e.t FROM broken JOIN e ON e.id = broken.via)
SELECT id, t AS "to" FROM u WHERE id <> t AND t NOT IN (SELECT id FROM dead)""")
def delete_repair_candidates(spark, d):
    return dynamic.repair_candidates(knn_graph_of(spark, d), base(spark, d).filter(F.col("id") % 7 == 0))


_MAP = f"{LOG}, {_LAST}, live AS (SELECT id FROM last WHERE op = 'insert'), map AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM live)"


@query(f"WITH {_MAP} SELECT id, new_id FROM map")
def compaction_remap(spark, d):
    return dynamic.compaction_map(dynamic.live_set(log(spark, d)))


@query(f"""WITH {GRAPH}, {_MAP}, e AS (SELECT id, unnest(nbrs) AS t, generate_subscripts(nbrs, 1) AS pos FROM graph)
SELECT m.new_id AS id, coalesce(list(t.new_id ORDER BY e.pos) FILTER (t.new_id IS NOT NULL), []) AS nbrs FROM e JOIN map m ON m.id = e.id LEFT JOIN map t ON t.id = e.t GROUP BY 1""")
def compacted_graph(spark, d):
    return dynamic.compact(knn_graph_of(spark, d), dynamic.compaction_map(dynamic.live_set(log(spark, d))))


@query("SELECT vec_id AS seq, vec_id AS id FROM embeddings WHERE vec_id > (SELECT max(vec_id) FROM embeddings) - 200")
def sliding_window_live(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("seq"), F.lit("insert").alias("op"), F.col("vec_id").alias("id"))
    return dynamic.sliding_window(e, 200)


@query(f"WITH {BASE} SELECT 'success' AS status, count(*) FILTER (id % 7 <> 0) AS active, count(*) FILTER (id % 7 = 0) AS released, count(*) FILTER (id % 7 = 0) + 1 AS delete_set, 1 AS unknown FROM base")
def consolidation_report(spark, d):
    """What a consolidation did, with one id deleted that never was there."""
    b, g = built(spark, d)
    dead = b.filter(F.col("id") % 7 == 0).select("id").unionByName(spark.range(1).selectExpr("9999999L as id"))
    return dynamic.consolidation_report(g, dynamic.consolidate(g, b, dead, PARAMS), dead).drop("repaired")


@query(f"WITH {BASE} SELECT count(*) FILTER (id % 100 = 0) AS queries, true AS reached FROM base")
def consolidated_search_recall(spark, d):
    """Whether the recall against the live rows is 90 after deleting each seventh row and repairing the graph."""
    b, g = built(spark, d)
    dead = b.filter(F.col("id") % 7 == 0).select("id")
    live = b.join(dead, "id", "left_anti")
    from ..operators import exact

    repaired = dynamic.consolidate(g, b, dead, PARAMS)
    return recall_reached(G.search(asked(b), repaired, live, K, 64, skip_self=True), exact.knn_join(asked(b), live, K, skip_self=True), K, 90)


@query(f"WITH {BASE} {REACHED}")
def inserted_search_recall(spark, d):
    """Whether the recall is 90 after building on the even ids and inserting the odd ones."""
    b, members = base(spark, d).select("id", "vec"), top2_shards(spark, d)
    g = G.build_sharded(b, members.filter(F.col("id") % 2 == 0), PARAMS)
    grown = dynamic.insert_rows(g, b, members, PARAMS)
    return recall_reached(G.search(asked(b), grown, b, K, 48, skip_self=True), knn(spark, d), K, 90)
