"""Search requests as JSON, answered in a DataFrame; and a table function for SQL."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.blocks import cut

REQUEST = "query array<double>, k int, Ls int, query_id bigint"
DEFAULT_LS = 100


def parse_requests(requests: DataFrame, column: str = "request") -> DataFrame:
    """(request_id, query_id, query, k, Ls, error): error is null for a good request.

    Ls defaults to 100 and query_id to -1. Bad: not JSON, an empty or missing query, k not in 1..Ls. ``requests`` has
    (request_id, request).
    """
    p = requests.select("request_id", F.from_json(column, REQUEST).alias("r")).select("request_id", "r.*")
    p = p.withColumns({"Ls": F.coalesce("Ls", F.lit(DEFAULT_LS)), "query_id": F.coalesce("query_id", F.lit(-1).cast("bigint"))})
    bad = (
        F.when(F.col("query").isNull() | (F.coalesce(F.size("query"), F.lit(0)) < 1), "query is missing or empty")
        .when(F.exists("query", lambda x: x.isNull() | F.isnan(x)), "query holds something else than numbers")
        .when(F.col("k").isNull() | (F.col("k") <= 0), "k must be positive")
        .when(F.col("k") > F.col("Ls"), "k must not exceed Ls")
    )
    return p.withColumn("error", bad)


def answer(
    requests: DataFrame, search: Callable[[DataFrame, int], DataFrame], tags: DataFrame | None = None, largest_k: int = 1000, digits: int = 6, timed: bool = False
) -> DataFrame:
    """(request_id, response): the JSON answer of each request: indices, distances, tags, partition, k, query_id, or error.

    With ``timed`` the search runs at once and answers carry time_taken_in_us, the batch's time for each of its requests alike.

    ``search(queries, k)`` takes (id, vec), id the request's, and returns (query_id, rank, id, distance), with partition if
    several indexes were searched. ``tags`` (id, tag) labels results. Requests above ``largest_k`` get an error.
    """
    p = parse_requests(requests).withColumn("error", F.coalesce("error", F.when(F.col("k") > largest_k, F.lit(f"k must not exceed {largest_k}"))))
    good = p.filter("error is null")
    k = good.agg(F.max("k")).first()[0] or 1
    found = search(good.select(F.col("request_id").alias("id"), F.col("query").alias("vec")), k)
    taken = []
    if timed:
        begin = time.perf_counter()
        found = cut(found)
        taken = [F.lit(int(1e6 * (time.perf_counter() - begin))).alias("time_taken_in_us")]
    fields = [c for c in ("partition",) if c in found.columns]
    if tags is not None:
        found, fields = found.join(tags.select("id", "tag"), "id", "left"), ["tag", *fields]
    hits = found.withColumnRenamed("query_id", "request_id").join(good.select("request_id", F.col("k").alias("_k")), "request_id").filter(F.col("rank") <= F.col("_k"))
    rows = hits.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", F.round("distance", digits).alias("distance"), *fields))).alias("x"))
    pick = lambda f: F.transform("x", lambda s: s[f])
    out = [pick("id").alias("indices"), pick("distance").alias("distances")]
    out += [pick("tag").alias("tags")] * ("tag" in fields) + [pick("partition").alias("partition")] * ("partition" in fields)
    body = p.join(rows, "request_id", "left").select(
        "request_id",
        F.when(F.col("error").isNotNull(), F.to_json(F.struct("query_id", "error"))).otherwise(F.to_json(F.struct(*out, "k", "query_id", *taken))).alias("response"),
    )
    return body


def serve(spark: SparkSession, search: Callable[[DataFrame, int], DataFrame], host: str = "127.0.0.1", port: int = 0, tags: DataFrame | None = None) -> ThreadingHTTPServer:
    """An HTTP server that is not running yet: each POST of a request, or of a list of them, is one batch through ``answer``.

    Answers have status 200, or 500 if the (only) request is in error. Call serve_forever on it, shutdown to end it; port 0 picks a free one.
    """

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            raw = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode("utf-8", "replace")
            try:
                parsed = json.loads(raw)
            except ValueError:
                parsed = None
            many = parsed if isinstance(parsed, list) else None
            texts = [json.dumps(x) for x in many] if many is not None else [raw]
            rows = spark.createDataFrame(list(enumerate(texts)), "request_id long, request string")
            got = {r.request_id: json.loads(r.response) for r in answer(rows, search, tags, timed=True).collect()}
            body = [got[i] for i in range(len(texts))]
            failed = many is None and "error" in body[0]
            data = json.dumps(body if many is not None else body[0]).encode()
            self.send_response(500 if failed else 200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def ask(url: str, query: list[float] | list[list[float]], k: int, Ls: int = DEFAULT_LS, query_id: int = -1, timeout: float = 600.0) -> dict | list[dict]:
    """The client's side: the answer to one vector, or the answers to several in one request. Raises ValueError with the server's error."""
    several = bool(query) and isinstance(query[0], (list, tuple))
    one = lambda q, i: {"query": [float(x) for x in q], "k": k, "Ls": Ls, "query_id": i}
    body = [one(q, i) for i, q in enumerate(query)] if several else one(query, query_id)
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return json.loads(response.read())
    except urllib.error.HTTPError as e:
        raise ValueError(json.loads(e.read()).get("error", str(e))) from None


def register_search_function(spark: SparkSession, name: str = "vector_search") -> None:
    """SQL: ``SELECT * FROM vector_search(TABLE(base) PARTITION BY (shard), array(...), 10)`` with base (id, vec, ...).

    Each partition gives its k nearest rows as (id, distance); order and limit them for the whole. Rows are taken in blocks of 1,024.
    """
    from pyspark.sql.functions import udtf

    @udtf(returnType="id bigint, distance double")
    class Search:
        def __init__(self):
            self.ids, self.vecs, self.best, self.query, self.k = [], [], [], None, 0

        def eval(self, row, query, k):
            if row["id"] is None or row["vec"] is None:
                return
            if len(row["vec"]) != len(query):
                raise ValueError("vectors of another length than the query")
            self.query, self.k = query, k
            self.ids.append(row["id"])
            self.vecs.append(row["vec"])
            if len(self.ids) == 1024:
                self._fold()

        def _fold(self):
            import numpy as np

            if self.ids:
                d = ((np.array(self.vecs, np.float64) - np.array(self.query, np.float64)) ** 2).sum(1)
                self.best = sorted([*self.best, *zip(d.tolist(), self.ids)])[: self.k]
                self.ids, self.vecs = [], []

        def terminate(self):
            self._fold()
            for d, i in self.best:
                yield i, d

    spark.udtf.register(name, Search)
