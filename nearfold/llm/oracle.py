"""DuckDB SQL of the pN_ queries that SQL can express over whole tables."""

_PAIRS = """
WITH e AS (SELECT DISTINCT shard, search_id, id FROM neighbor
           WHERE expanded AND id IS NOT NULL AND shard IS NOT NULL AND search_id IS NOT NULL),
n AS (SELECT shard, count(DISTINCT search_id) AS n FROM neighbor GROUP BY shard),
c AS (SELECT shard, id, count(*) AS n_i FROM e GROUP BY shard, id),
p AS (SELECT a.shard, a.id AS id_a, b.id AS id_b, count(*) AS n_ab
      FROM e a JOIN e b ON a.shard = b.shard AND a.search_id = b.search_id AND a.id < b.id GROUP BY ALL),
r AS (SELECT p.shard, id_a, id_b, n_ab, ca.n_i AS n_a, cb.n_i AS n_b, n.n
      FROM p JOIN n ON n.shard = p.shard JOIN c ca ON ca.shard = p.shard AND ca.id = id_a
      JOIN c cb ON cb.shard = p.shard AND cb.id = id_b
      WHERE n_ab >= 5 AND n_ab * n.n >= 3 * ca.n_i * cb.n_i)
"""

_STATS = """
WITH s AS (SELECT DISTINCT stat_id, index_tag, search_l,
             CAST(floor(date_diff('day', DATE '1970-01-05', CAST(searched_at AT TIME ZONE 'UTC' AS DATE)) / 7) AS BIGINT) AS week_no,
             CAST(total_us AS DOUBLE) AS total_us, CAST(io_us AS DOUBLE) AS io_us, CAST(n_ios AS DOUBLE) AS n_ios
           FROM percentile_stats),
l AS (SELECT index_tag, search_l, week_no, 'total_us' AS metric, total_us AS v FROM s
      UNION ALL SELECT index_tag, search_l, week_no, 'io_us', io_us FROM s
      UNION ALL SELECT index_tag, search_l, week_no, 'n_ios', n_ios FROM s),
g AS (SELECT * FROM l WHERE v IS NOT NULL AND NOT isnan(v) AND v >= 0)
"""


def _ranked(keys: str) -> str:
    return f"""{_STATS},
o AS (SELECT {keys}, v, row_number() OVER (PARTITION BY {keys} ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM g)
"""


def _points(keys: str) -> str:
    return f"""{_ranked(keys)}
SELECT {keys}, n, CAST(p AS DOUBLE) AS p, v AS value FROM o, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) t(p)
WHERE i = least(CAST(floor(p * n) AS BIGINT), n - 1)"""


_TOP = """
WITH b AS (SELECT query_id, id, min(distance) AS distance FROM neighbor
           WHERE query_id IS NOT NULL AND id IS NOT NULL AND distance IS NOT NULL AND NOT isnan(distance) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM b)
"""

_LINKED = """
WITH RECURSIVE held AS (SELECT DISTINCT unnest(shard_ids) AS id FROM partition_shards),
u AS (SELECT id, any_value(CAST(cur_row AS DOUBLE[])) AS v FROM partition_rows JOIN held USING (id)
      WHERE len(cur_row) = 64 AND len([x FOR x IN cur_row IF x IS NULL OR isnan(x)]) = 0
        AND len([x FOR x IN cur_row IF x <> 0]) > 0 GROUP BY id),
e AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND list_distance(a.v, b.v) * list_distance(a.v, b.v) <= 0.4),
r AS (SELECT id AS root, id FROM u UNION SELECT r.root, e.b FROM r JOIN e ON r.id = e.a)
"""

ORACLE = {
    "p1_found": _PAIRS + "SELECT shard, id_a, id_b FROM r",
    "p1_pairs": _PAIRS + "SELECT *, round(n_ab * n / (n_a * n_b), 6) AS lift, round(ln(n_ab * n / (n_a * n_b)), 6) AS pmi FROM r",
    "p3_found": _ranked("index_tag, search_l, week_no, metric")
    + """SELECT index_tag, search_l, week_no, metric FROM o GROUP BY ALL
HAVING max(n) >= 20 AND max(v) FILTER (i = CAST(floor(0.95::DOUBLE * n) AS BIGINT)) >= 4 * max(v) FILTER (i = CAST(floor(0.5::DOUBLE * n) AS BIGINT))""",
    "p3_percentiles": _points("index_tag, search_l, week_no, metric"),
    "p3_merged": _points("index_tag, metric"),
    "p5_found": _LINKED + "SELECT min(root) AS cluster_id, id FROM r GROUP BY id HAVING count(*) > 1",
    "p4_found": _TOP + "SELECT query_id, id FROM r WHERE rank <= 10",
    "p4_top": _TOP + "SELECT query_id, id, distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10",
}
