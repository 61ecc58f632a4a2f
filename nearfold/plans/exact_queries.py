"""Queries of exact search, transforms, statistics and set operations, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import distance as D, vectors as V
from ..operators import evaluate, exact
from ..operators.sessions import table
from ..operators.tags import live_results, truth_sizes, truth_within, vectors_by_tag, with_tags
from .registry import query

K = 10


def base(spark: SparkSession, d: str) -> DataFrame:
    """(id, vec, label): embeddings scaled by 1 + label, so that metrics rank differently."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), V.scale("embedding", F.col("label") + F.lit(1.0)).alias("vec"), "label")


def asked(b: DataFrame) -> DataFrame:
    """The stated query set: ids divisible by 100."""
    return b.filter(F.col("id") % 100 == 0)


BASE = """base AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 + label)) AS vec, label FROM embeddings),
asked AS (SELECT * FROM base WHERE id % 100 = 0)"""


def sql_l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"


def sql_norm2(a: str) -> str:
    return f"list_sum(list_transform({a}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"


def sql_ip(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1] * x[2]))"


def sql_cos(a: str, b: str) -> str:
    return f"(1 - {sql_ip(a, b)} / (sqrt({sql_norm2(a)}) * sqrt({sql_norm2(b)})))"


def sql_knn(distance: str, k: int = K, order: str = "ASC", asked_: str = "asked", skip: bool = True) -> str:
    return f"""d AS (SELECT q.id AS query_id, b.id AS id, {distance} AS distance FROM {asked_} q, base b {"WHERE q.id <> b.id" if skip else ""}),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance {order}, id) AS rank FROM d) WHERE rank <= {k})"""


ROUND = "SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(distance, 6) AS distance FROM knn"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def knn(spark: SparkSession, d: str, metric: str = "l2", k: int = K) -> DataFrame:
    b = base(spark, d)
    return exact.knn_join(asked(b), b, k, metric, skip_self=True)


@query(f"WITH {BASE}, {sql_knn(sql_l2('q.vec', 'b.vec'))} {ROUND}")
def knn_l2(spark, d):
    return rounded(knn(spark, d), "distance")


@query(f"WITH {BASE}, {sql_knn(sql_ip('q.vec', 'b.vec'), order='DESC')} {ROUND}")
def knn_ip(spark, d):
    return rounded(knn(spark, d, "ip"), "distance")


@query(f"WITH {BASE}, {sql_knn(sql_cos('q.vec', 'b.vec'))} {ROUND}")
def knn_cosine(spark, d):
    return rounded(knn(spark, d, "cosine"), "distance")


@query(f"WITH {BASE}, {sql_knn('(' + sql_norm2('b.vec') + ' - 2 * ' + sql_ip('b.vec', 'q.vec') + ')')} SELECT query_id, CAST(rank AS INTEGER) AS rank, id FROM knn")
def fast_l2_rank(spark, d):
    b = base(spark, d)
    return exact.fast_l2_rank(asked(b), b, K)


_IN = f"d AS (SELECT q.id AS query_id, b.id AS id, {sql_l2('q.vec', 'b.vec')} AS distance FROM asked q, base b WHERE q.id <> b.id)"


@query(f"WITH {BASE}, {_IN} SELECT query_id, id, round(distance, 6) AS distance FROM d WHERE distance <= 30")
def range_join(spark, d):
    b = base(spark, d)
    return rounded(exact.range_join(asked(b), b, 30.0, skip_self=True), "distance")


@query(f"WITH {BASE}, {_IN} SELECT a.id AS query_id, count(d.id) AS n FROM asked a LEFT JOIN d ON d.query_id = a.id AND distance <= 30 GROUP BY 1")
def range_count(spark, d):
    b = base(spark, d)
    near = exact.range_join(asked(b), b, 30.0, skip_self=True).groupBy("query_id").agg(F.count("*").alias("n"))
    return asked(b).select(F.col("id").alias("query_id")).join(near, "query_id", "left").fillna(0, ["n"])


def graph(spark: SparkSession, d: str, k: int = 8) -> DataFrame:
    """(id, nbrs): the exact k-nearest graph of all rows."""
    g = exact.knn_graph(base(spark, d), k)
    return g.groupBy(F.col("query_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("nbrs"))


GRAPH = BASE + ", " + sql_knn(sql_l2("q.vec", "b.vec"), 8, asked_="base") + ", graph AS (SELECT query_id AS id, list(id ORDER BY rank) AS nbrs FROM knn GROUP BY 1)"


@query(f"WITH {GRAPH} SELECT id, nbrs FROM graph")
def knn_self_graph(spark, d):
    return graph(spark, d)


@query(f"WITH {GRAPH} SELECT CAST(max(len(nbrs)) AS INTEGER) AS max_degree, avg(len(nbrs)) AS avg_degree, CAST(min(len(nbrs)) AS INTEGER) AS min_degree, count(*) FILTER (len(nbrs) < 2) AS below_two FROM graph")
def degree_stats(spark, d):
    return evaluate.degree_stats(graph(spark, d))


@query(f"WITH {GRAPH} SELECT e.id, count(*) AS in_degree FROM (SELECT unnest(nbrs) AS id FROM graph) e GROUP BY 1")
def reverse_edges(spark, d):
    return evaluate.reverse_edges(graph(spark, d))


_LEVELS = ",\n".join(
    f"l{i} AS (SELECT * FROM l{i - 1} UNION ALL SELECT DISTINCT e.t AS id, {i} AS level FROM e JOIN l{i - 1} p ON p.id = e.id AND p.level = {i - 1} WHERE e.t NOT IN (SELECT id FROM l{i - 1}))"
    for i in range(1, 17)
)


@query(f"WITH {GRAPH}, e AS (SELECT id, unnest(nbrs) AS t FROM graph), l0 AS (SELECT min(id) AS id, 0 AS level FROM graph),\n{_LEVELS}\nSELECT id, level FROM l16")
def bfs_levels(spark, d):
    g = graph(spark, d)
    return evaluate.bfs_levels(g, g.agg(F.min("id").alias("id")))


_CENTRE = "c AS (SELECT list(m ORDER BY pos) AS c FROM (SELECT pos, avg(x) AS m FROM (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM base) GROUP BY pos))"


@query(f"WITH {BASE} SELECT CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS mean FROM (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM base) GROUP BY pos")
def centroid(spark, d):
    return rounded(exact.centroid(base(spark, d)), "mean")


@query(f"WITH {BASE}, {_CENTRE} SELECT id, round({sql_l2('vec', 'c')}, 6) AS distance FROM base, c ORDER BY {sql_l2('vec', 'c')}, id LIMIT 1")
def medoid(spark, d):
    return rounded(exact.medoid(base(spark, d)), "distance")


@query(f"WITH {BASE} SELECT id, round({sql_norm2('vec')}, 6) AS norm2, round(sqrt({sql_norm2('vec')}), 6) AS norm FROM base")
def norms(spark, d):
    return rounded(exact.norms(base(spark, d)), "norm2", "norm")


@query(f"WITH {BASE} SELECT round(sqrt(max({sql_norm2('vec')})), 6) AS max_norm FROM base")
def max_norm(spark, d):
    return base(spark, d).agg(F.round(F.max(D.norm("vec")), 6).alias("max_norm"))


_P = [i / 20 for i in range(20)] + [1.0]


@query(f"""WITH {BASE}, v AS (SELECT round(sqrt({sql_norm2('vec')}), 6) AS v FROM base), o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM v)
SELECT CAST(p AS DOUBLE) AS p, v AS value FROM o, (SELECT unnest([{', '.join(f'{p!r}::DOUBLE' for p in _P)}]) AS p) WHERE i = least(CAST(floor(p * n) AS BIGINT), n - 1)""")
def norm_percentiles(spark, d):
    return evaluate.floor_percentiles(rounded(exact.norms(base(spark, d)), "norm"), "norm", _P)


def _long(df: DataFrame, vec: str = "vec") -> DataFrame:
    return df.select("id", F.transform(vec, lambda x: F.round(x, 6)).alias("vec"))


_R6 = "lambda y: round(y, 6)"


@query(f"WITH {BASE} SELECT id, list_transform(list_transform(vec, lambda x: x / sqrt({sql_norm2('vec')})), {_R6}) AS vec FROM base")
def normalize(spark, d):
    return _long(base(spark, d).select("id", V.normalize("vec").alias("vec")))


@query(f"WITH {BASE} SELECT id, list_transform(list_transform(vec, lambda x: x / sqrt({sql_norm2('vec')} + 1.1920929e-07)), {_R6}) AS vec FROM base")
def normalize_eps(spark, d):
    return _long(base(spark, d).select("id", V.normalize_eps("vec").alias("vec")))


_MIPS = f"m AS (SELECT sqrt(max({sql_norm2('vec')})) AS m FROM base), t AS (SELECT id, list_append(list_transform(vec, lambda x: x / m), sqrt(greatest(0, 1 - {sql_norm2('vec')} / (m * m)))) AS vec FROM base, m)"


@query(f"WITH {BASE}, {_MIPS} SELECT id, list_transform(vec, {_R6}) AS vec FROM t")
def mips_base_transform(spark, d):
    return _long(V.mips_base(base(spark, d)))


@query(f"WITH {BASE} SELECT id, list_transform(list_append(list_transform(vec, lambda x: x / sqrt({sql_norm2('vec')})), 0.0::DOUBLE), {_R6}) AS vec FROM asked")
def mips_query_transform(spark, d):
    return _long(asked(base(spark, d)).select("id", V.mips_query("vec").alias("vec")))


@query(f"WITH {BASE}, {sql_knn(sql_ip('q.vec', 'b.vec'), order='DESC')} SELECT query_id, CAST(rank AS INTEGER) AS rank, id FROM knn")
def mips_equals_ip_rank(spark, d):
    """Inner-product ranking through L2 on the transformed vectors; the SQL ranks by inner product itself."""
    b = base(spark, d)
    q = asked(b).select("id", V.mips_query("vec").alias("vec"))
    return exact.knn_join(q, V.mips_base(b), K, "l2", skip_self=True).select("query_id", "rank", "id")


_I8 = "list_transform(vec, lambda x: CAST(greatest(-128, least(127, trunc((x - 0.0) * 254.0 / 4.0))) AS TINYINT))"


@query(f"WITH {BASE} SELECT id, {_I8} AS vec FROM base")
def quantize_int8(spark, d):
    return base(spark, d).select("id", V.quantize_int8("vec", 0.0, 4.0).alias("vec"))


@query(f"WITH {BASE} SELECT id, list_transform(list_transform({_I8}, lambda x: (CAST(x AS DOUBLE) - 0.0) * 0.015748031496062992), {_R6}) AS vec FROM base")
def dequantize_int8(spark, d):
    return _long(base(spark, d).select("id", V.dequantize_int8(V.quantize_int8("vec", 0.0, 4.0), 0.0, 4.0 / 254.0).alias("vec")))


@query(f"""WITH {BASE}, i AS (SELECT id, list_transform({_I8}, lambda x: CAST(x AS BIGINT)) AS vec FROM base),
d AS (SELECT q.id AS query_id, b.id, {sql_l2('q.vec', 'b.vec')} AS distance FROM i q, i b WHERE q.id % 100 = 0 AND q.id <> b.id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, id, CAST(distance AS DOUBLE) AS distance FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 10""")
def int8_l2(spark, d):
    """Nearest neighbours of byte vectors; sums of squares of bytes are exact in a double."""
    i = base(spark, d).select("id", V.quantize_int8("vec", 0.0, 4.0).alias("vec"))
    return exact.knn_join(asked(i), i, K, "l2", skip_self=True)


@query(f"WITH {BASE} SELECT id, list_transform(vec, lambda x: CAST(trunc(x) AS INTEGER)) AS vec FROM base")
def cast_elements(spark, d):
    return base(spark, d).select("id", V.cast_elements("vec", "int").alias("vec"))


@query("SELECT vec_id AS id, embedding AS vec FROM embeddings")
def tsv_parse(spark, d):
    """Vectors written as text lines and parsed back."""
    lines = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), V.format_tsv("embedding").alias("line"))
    return lines.select("id", V.parse_tsv("line", "float").alias("vec"))


_APPROX = f"{sql_knn(sql_cos('q.vec', 'b.vec'), 10)}, t AS (SELECT * FROM (SELECT q.id AS query_id, b.id AS id, {sql_l2('q.vec', 'b.vec')} AS distance, row_number() OVER (PARTITION BY q.id ORDER BY {sql_l2('q.vec', 'b.vec')}, b.id) AS rank FROM asked q, base b WHERE q.id <> b.id) WHERE rank <= 30)"


@query(f"""WITH {BASE}, {_APPROX}, e AS (SELECT query_id, max(distance) AS e FROM t WHERE rank <= 10 GROUP BY 1),
w AS (SELECT t.query_id, t.id FROM t JOIN e USING (query_id) WHERE rank <= 10 OR distance = e)
SELECT q.id AS query_id, count(knn.id) * 100.0 / 10 AS recall FROM asked q LEFT JOIN w ON w.query_id = q.id LEFT JOIN knn ON knn.query_id = w.query_id AND knn.id = w.id GROUP BY 1""")
def recall_at_k_ties(spark, d):
    """Recall of the cosine ranking against L2 truth, the truth extended over ties at the k-th distance."""
    return evaluate.recall_per_query(knn(spark, d, "cosine", 10), knn(spark, d, "l2", 30), 10)


@query(f"""WITH {BASE}, {_APPROX}, ks AS (SELECT unnest(range(1, 11)) AS k), e AS (SELECT k, query_id, max(distance) AS e FROM t, ks WHERE rank <= k GROUP BY 1, 2),
w AS (SELECT DISTINCT k, t.query_id, t.id FROM t JOIN e USING (query_id) WHERE rank <= k OR distance = e)
SELECT CAST(w.k AS INTEGER) AS k, round(count(knn.id) * 100.0 / (w.k * (SELECT count(*) FROM asked)), 6) AS recall FROM w LEFT JOIN knn ON knn.query_id = w.query_id AND knn.id = w.id AND knn.rank <= w.k GROUP BY w.k""")
def recall_all_positions(spark, d):
    return rounded(evaluate.recall_all_positions(knn(spark, d, "cosine", 10), knn(spark, d, "l2", 30), 10), "recall")


@query(f"""WITH {BASE}, {_APPROX}, live AS (SELECT id FROM base WHERE id % 7 <> 0),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM t SEMI JOIN live USING (id))
SELECT 10 AS k, round(sum(h) * 10.0 / count(*), 6) AS recall FROM (SELECT a.query_id, count(knn.id) AS h FROM a LEFT JOIN knn ON knn.query_id = a.query_id AND knn.id = a.id WHERE r <= 10 GROUP BY 1)""")
def active_recall(spark, d):
    live = base(spark, d).filter(F.col("id") % 7 != 0).select("id")
    return rounded(evaluate.active_recall(knn(spark, d, "cosine", 10), knn(spark, d, "l2", 30), live, 10), "recall")


@query(f"""WITH {BASE}, {_IN}, {_APPROX.replace('d AS (', 'dc AS (', 1).replace('FROM d)', 'FROM dc)')}, tr AS (SELECT * FROM d WHERE distance <= 30)
SELECT q.id AS query_id, CASE WHEN count(tr.id) = 0 THEN 100.0 ELSE round(count(knn.id) * 100.0 / count(tr.id), 6) END AS recall
FROM asked q LEFT JOIN tr ON tr.query_id = q.id LEFT JOIN knn ON knn.query_id = tr.query_id AND knn.id = tr.id GROUP BY 1""")
def range_recall(spark, d):
    b = base(spark, d)
    truth = exact.range_join(asked(b), b, 30.0, skip_self=True)
    return rounded(evaluate.range_recall(knn(spark, d, "cosine", 10), truth, asked(b).select(F.col("id").alias("query_id"))), "recall")


@query(f"""WITH {BASE}, {_IN}, {_APPROX.replace('d AS (', 'dc AS (', 1).replace('FROM d)', 'FROM dc)')}, tr AS (SELECT * FROM d WHERE distance <= 30),
s AS (SELECT (SELECT count(*) FROM knn) AS returned, (SELECT count(*) FROM knn JOIN tr USING (query_id, id)) AS hits, (SELECT count(*) FROM tr) AS wanted)
SELECT returned, hits, wanted, round(returned / wanted, 6) AS returned_ratio, round(hits / wanted, 6) AS hit_ratio FROM s""")
def range_ratio(spark, d):
    b = base(spark, d)
    truth = exact.range_join(asked(b), b, 30.0, skip_self=True)
    return rounded(evaluate.range_ratio(knn(spark, d, "cosine", 10), truth), "returned_ratio", "hit_ratio")


@query(f"WITH {BASE}, {sql_knn(sql_l2('q.vec', 'b.vec'))} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(distance, 6) AS distance, CAST(id % 2 AS INTEGER) AS partition FROM knn")
def multi_index_merge(spark, d):
    """Two indexes over the even and the odd ids, their results merged."""
    b = base(spark, d)
    parts = [exact.knn_join(asked(b), b.filter(F.col("id") % 2 == r), K, "l2", skip_self=True) for r in (0, 1)]
    return rounded(exact.merge_results(parts, K), "distance")


@query(f"""WITH {BASE}, {sql_knn(sql_l2('q.vec', 'b.vec'))} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, 'tag_' || CAST(label AS VARCHAR) || '_' || CAST(id AS VARCHAR) AS tag
FROM knn JOIN base USING (id)""")
def tag_lookup(spark, d):
    b = base(spark, d)
    tags = b.select("id", F.concat(F.lit("tag_"), F.col("label").cast("string"), F.lit("_"), F.col("id").cast("string")).alias("tag"))
    return with_tags(knn(spark, d), tags, strict=True).select("query_id", "rank", "id", "tag")


@query(f"WITH {BASE}, {sql_knn(sql_l2('q.vec', 'b.vec'), 30)} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(distance, 6) AS distance FROM knn WHERE distance <= 30")
def truth_pruned(spark, d):
    """A k-NN truth set cut at a radius."""
    return rounded(truth_within(knn(spark, d, "l2", 30), 30), "distance")


@query(f"WITH {BASE}, {sql_knn(sql_l2('q.vec', 'b.vec'), 30)} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, id + 1 AS tag FROM knn WHERE id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10")
def search_live_tags(spark, d):
    """Results whose tag is live, in order, cut at k; tag = id + 1, as 0 is reserved."""
    live = base(spark, d).filter(F.col("id") % 7 != 0).select("id", (F.col("id") + 1).alias("tag"))
    return live_results(knn(spark, d, "l2", 30), live, 10)


@query(f"WITH {BASE}, {sql_knn(sql_l2('q.vec', 'b.vec'), 30)}, c AS (SELECT a.id, count(k.id) AS n FROM base a LEFT JOIN knn k ON k.query_id = a.id AND k.distance <= 30 WHERE a.id % 100 = 0 GROUP BY 1) SELECT count(*) AS queries, min(n) AS least, max(n) AS most FROM c")
def truth_pruned_sizes(spark, d):
    """How many rows the queries keep when a truth set is cut at a radius."""
    return truth_sizes(truth_within(knn(spark, d, "l2", 30), 30), asked(base(spark, d)))


@query(f"WITH {BASE} SELECT id + 1 AS tag, list_transform(vec, lambda x: round(x, 6)) AS vec FROM base WHERE id % 50 = 0")
def vectors_of_tags(spark, d):
    """The vectors that carry given tags; tag = id + 1."""
    b = base(spark, d)
    tags = b.select("id", (F.col("id") + 1).alias("tag"))
    got = vectors_by_tag(tags, b, tags.filter(F.col("id") % 50 == 0))
    return got.select("tag", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query(f"""WITH {BASE}, {sql_knn(sql_l2('q.vec', 'b.vec'))}, t AS (SELECT query_id, rank, id % 5 * 1000 + id AS tag, id % 5 AS h, distance FROM knn)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank, tag AS id, round(distance, 6) AS distance FROM t WHERE h <> 0""")
def truth_by_tags(spark, d):
    """A truth set with places replaced by tags; tag 0 is hidden."""
    i = F.col("id")
    tags = base(spark, d).select("id", F.when(i % 5 == 0, 0).otherwise(i % 5 * 1000 + i).cast("long").alias("tag"))
    return rounded(evaluate.remap_truth(knn(spark, d), tags), "distance")


@query(f"WITH {BASE} SELECT id, list_transform(list_zip(vec, list_transform(vec, lambda x: 0.5::DOUBLE * x)), lambda x: round(x[1] - x[2], 6)) AS vec FROM base")
def vector_arithmetic(spark, d):
    """Elementwise difference of two vectors of a row."""
    b = base(spark, d)
    return _long(b.select("id", V.scale("vec", 0.5).alias("half"), "vec").select("id", F.zip_with("vec", "half", lambda x, y: x - y).alias("vec")))
