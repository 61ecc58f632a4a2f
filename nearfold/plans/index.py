"""Whole indexes: built by one plan, stored as versioned tables, loaded and searched.

A version is a directory that is never changed: readers of an older one are not disturbed by updates. It becomes
visible when its ``meta`` table is written, which is the last step.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vectors as V
from ..operators import cluster, disk, dynamic, evaluate, graph as G, layout as L, pq, tags as T
from ..operators.blocks import cut
from ..operators.exact import select_vectors
from ..operators.kernels import BuildParams


@dataclass(frozen=True)
class IndexParams:
    """metric l2, ip or cosine; ``shards`` 0 lets ``build_ram_bytes`` decide; chunks 0 does without codes; layout identity,
    first_seen or covisit (the last two need a workload). ``start_norm`` above 0 freezes a random start point of that length into every shard, with which
    searches begin; ``code_build`` builds graphs on distances between codes; codes are centred but for ip."""

    dim: int
    metric: str = "l2"
    build: BuildParams = field(default_factory=BuildParams)
    shards: int = 0
    replicas: int = 2
    build_ram_bytes: float = 4 * 2**30
    chunks: int = 0
    codes: int = 256
    rotate: bool = False
    layout: str = "identity"
    seed: int = 1
    shard_rows: int = G.SHARD_ROWS
    start_norm: float = 0.0
    code_build: bool = False

    def __post_init__(self) -> None:
        if self.metric not in ("l2", "ip", "cosine"):
            raise ValueError(f"metric {self.metric!r} has no graph index")
        if self.layout not in ("identity", "first_seen", "covisit"):
            raise ValueError(f"unknown layout {self.layout!r}")
        if self.code_build and not self.chunks:
            raise ValueError("code_build needs chunks")
        if self.start_norm and self.layout != "identity":
            raise ValueError("start points go with the identity layout")


@dataclass
class Index:
    params: IndexParams
    rows: DataFrame  # (id, vec): what the graph was built on
    members: DataFrame  # (shard, id)
    graph: DataFrame  # (shard, id, nbrs, entry)
    layout: DataFrame  # (logical_id, physical_id, page_no, slot)
    centers: np.ndarray
    book: pq.Codebook | None = None
    hidden: DataFrame | None = None
    codes: DataFrame | None = None  # (id, codes) of the book

    def prepared(self, queries: DataFrame) -> DataFrame:
        return prepare_queries(queries, self.params.metric)

    def search(self, queries: DataFrame, k: int, list_size: int = 100, probes: int | None = None, skip_self: bool = False) -> DataFrame:
        """(query_id, rank, id, distance, hops, comparisons); queries (id, vec). ``probes`` nearest shards, by default all."""
        q = self.prepared(queries)
        routes = self._routes(q, probes)
        return self._reported(G.search(q, self.graph, self.nodes(), k, list_size, routes, self.hidden, skip_self), queries)

    def _routes(self, q: DataFrame, probes: int | None) -> DataFrame | None:
        if probes is None:
            return None
        return cluster.nearest_centers(q, self.centers, probes).select(F.col("id").alias("query_id"), F.col("center").alias("shard"))

    def nodes(self) -> DataFrame:
        """(id, vec) of everything a graph links: the rows and the frozen start points."""
        starts = self.starts()
        return self.rows if starts is None else self.rows.unionByName(G.frozen_rows(self.rows.sparkSession, starts))

    def _paged(self) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """Nodes, their pages and codes for a page search; start points lie on page 0, with the header."""
        starts = self.starts()
        if starts is None:
            return self.rows, self.layout, self.codes
        spark = self.rows.sparkSession
        pages = self.layout.select("logical_id", F.col("page_no").cast("long").alias("page_no")).unionByName(
            spark.createDataFrame([(-1 - i, 0) for i in range(len(starts))], "logical_id long, page_no long")
        )
        codes = None if self.codes is None else self.codes.unionByName(pq.encode(G.frozen_rows(spark, starts), self.book))
        return self.nodes(), pages, codes

    def starts(self) -> np.ndarray | None:
        p = self.params
        return G.start_points(self.centers.shape[1], p.start_norm, 1, p.seed) if p.start_norm else None

    def search_tags(self, queries: DataFrame, tags: DataFrame, k: int, list_size: int = 100, vectors: bool = False, **options) -> DataFrame:
        """(query_id, rank, id, distance, tag, ...): results that carry a tag of (id, tag), ranked anew, k at most; with ``vectors`` also vec.

        Ids without a tag are passed over, so up to ``list_size`` results are looked at.
        """
        from pyspark.sql import Window

        found = T.with_tags(self.search(queries, list_size, list_size, **options), tags)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        kept = found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance", "tag")
        return T.with_vectors(kept, self.rows) if vectors else kept

    def merged(self) -> "Index":
        """The shards' graphs merged into one that is searched from the medoid. For up to ``shard_rows`` rows."""
        graph = cut(G.merged_graph(self.graph, self.rows, self.params.build.degree, self.params.shard_rows, self.params.seed))
        members = graph.select("shard", "id")
        return Index(**{**self.__dict__, "graph": graph, "members": members, "centers": self.centers.mean(0, keepdims=True)})

    def page_search(
        self, queries: DataFrame, k: int, list_size: int = 100, beam: int = 2, reuse_pages: bool = True, cache: DataFrame | None = None, skip_self: bool = False, timed: bool = False,
        probes: int | None = None,
    ) -> DataFrame:
        """The same with page reads counted; codes guide the search if the index has them. With ``timed`` also us, for ``disk.batch_stats``."""
        q = self.prepared(queries)
        nodes, pages, codes = self._paged()
        found = disk.page_search(q, self.graph, nodes, pages, k, list_size, beam, self.book, reuse_pages, cache, self.hidden, None, skip_self, codes, timed, self._routes(q, probes))
        return self._reported(found, queries)

    def range_search(self, queries: DataFrame, radius: float, **options) -> DataFrame:
        if self.params.metric != "l2":
            raise ValueError("range search is defined for l2")
        nodes, pages, codes = self._paged()
        return disk.range_search(queries, self.graph, nodes, pages, radius, book=self.book, codes=codes, **options)

    def cache(self, kind: str = "none", sample: DataFrame | None = None, share: float = 0.1, list_size: int = 15, beam: int = 4) -> DataFrame | None:
        """(id) of nodes to keep at hand: none, levels (nearest to the entries by edges), or queries (most visited by a sample)."""
        if kind == "none":
            return None
        if kind == "levels":
            return L.cache_by_levels(self.graph.select("id", "nbrs"), self.graph.filter("entry").select("id"), share)
        if kind == "queries" and sample is not None:
            n = int(self.rows.count() * share)
            return L.hot_nodes(simulate_paths(self, sample, list_size), n).select("id")
        raise ValueError("cache is none, levels, or queries with a sample")

    def _reported(self, found: DataFrame, queries: DataFrame) -> DataFrame:
        """Distances of the metric itself: the graph is over transformed vectors, on which L2 has the same order."""
        if self.params.metric == "l2":
            return found
        half = F.col("distance") / 2  # both sides have length 1
        if self.params.metric == "cosine":
            return found.withColumn("distance", half)
        scale = self.rows.sparkSession.createDataFrame([(self.largest_norm,)], "m double")
        q = select_vectors(queries, "id", "vec").select(F.col("id").alias("query_id"), F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("_q"))
        return found.join(q, "query_id").join(F.broadcast(scale)).withColumn("distance", (1 - half) * F.col("_q") * F.col("m")).drop("_q", "m")

    largest_norm: float = 1.0

    def delete(self, ids: DataFrame) -> "Index":
        """Lazy: hidden from results until ``consolidate``."""
        gone = ids.select("id") if self.hidden is None else self.hidden.select("id").unionByName(ids.select("id"))
        return Index(**{**self.__dict__, "hidden": gone.distinct()})

    def consolidate(self) -> "Index":
        """Deleted nodes leave the graph, and edges to them are repaired."""
        if self.hidden is None:
            return self
        dead = cut(self.hidden)
        graph = cut(dynamic.consolidate(self.graph, self.nodes(), dead, self.params.build))
        rows, members = (x.join(dead, "id", "left_anti") for x in (self.rows, self.members))
        return Index(**{**self.__dict__, "graph": graph, "rows": cut(rows), "members": cut(members), "hidden": None, "layout": L.identity_layout(rows, _per_page(self.params))})

    def consolidation_report(self, after: "Index") -> DataFrame:
        """What ``consolidate`` did, from this index to ``after``; see ``dynamic.consolidation_report``."""
        deleted = self.rows.limit(0).select("id") if self.hidden is None else self.hidden
        return dynamic.consolidation_report(self.graph, after.graph, deleted)

    def insert(self, new: DataFrame) -> "Index":
        """(id, vec) added to the shards of their nearest centres. Ids already there, and 0, are refused. Not for ip, whose base scale is fixed."""
        if self.params.metric == "ip":
            raise ValueError("an inner-product index is static: its scale is the largest norm at build time")
        added = cut(prepare_base(new, self.params.metric)[0])
        clash = added.filter("id = 0").count() + added.join(self.rows, "id", "left_semi").count()
        if clash:
            raise ValueError(f"{clash} ids are reserved or taken")
        members = cut(self.members.unionByName(cluster.shard_members(added, self.centers, min(self.params.replicas, len(self.centers)))))
        rows = cut(self.rows.unionByName(added))
        starts = self.starts()
        every = rows if starts is None else rows.unionByName(G.frozen_rows(rows.sparkSession, starts))
        graph = cut(dynamic.insert_rows(self.graph, every, members, self.params.build, self.params.shard_rows))
        codes = None if self.codes is None else cut(self.codes.unionByName(pq.encode(added, self.book)))
        return Index(**{**self.__dict__, "graph": graph, "rows": rows, "members": members, "codes": codes, "layout": L.identity_layout(rows, _per_page(self.params))})

    def status(self) -> DataFrame:
        """(rows, hidden, shards, max_degree, avg_degree, min_degree, below_two)."""
        hidden = 0 if self.hidden is None else self.hidden.join(self.rows, "id", "left_semi").count()
        counts = self.graph.filter("id >= 0").agg(F.countDistinct("id").alias("rows"), F.lit(hidden).cast("long").alias("hidden"), F.countDistinct("shard").alias("shards"))
        return counts.join(F.broadcast(evaluate.degree_stats(self.graph)))  # one row each


def _per_page(p: IndexParams) -> int:
    return L.nodes_per_page(p.build.degree, p.dim)


def prepare_base(rows: DataFrame, metric: str) -> tuple[DataFrame, float]:
    """The rows that the graph is built on, and the largest norm."""
    v = select_vectors(rows, "id", "vec")
    if metric == "cosine":
        return v.select("id", V.normalize("vec").alias("vec")), 1.0
    if metric == "ip":
        from ..functions.distance import norm

        top = v.agg(F.max(norm("vec"))).first()[0] or 1.0
        return V.mips_base(v), float(top)
    return v, 1.0


def prepare_queries(queries: DataFrame, metric: str) -> DataFrame:
    v = select_vectors(queries, "id", "vec")
    if metric == "cosine":
        return v.select("id", V.normalize("vec").alias("vec"))
    return v.select("id", V.mips_query("vec").alias("vec")) if metric == "ip" else v


def build_index(rows: DataFrame, params: IndexParams, workload: DataFrame | None = None) -> Index:
    """An index over (id, vec). ``workload`` (id, vec) are sampled queries: they train the shard centres and shape the layout.

    One shard if its RAM estimate fits the budget, else as many as bring every shard below it, each row in its
    ``replicas`` nearest. Vectors of another length, with nulls or NaN, and an empty table are errors.
    """
    checked = V.check_vectors(rows.select("id", "vec"), "vec", params.dim)
    base, top = prepare_base(checked, params.metric)
    base = cut(base)
    n = base.count()
    if not n:
        raise ValueError("no rows to index")
    work = None if workload is None else cut(prepare_queries(workload, params.metric))
    if params.shards > 1:
        sample = cluster.training_rows(base if work is None else work)
        centers, _, _ = cluster.lloyd_local(sample, cluster.plus_plus(sample, params.shards, params.seed), 10)
    elif params.shards == 1 or cluster.ram_estimate(n, params.dim, params.build.degree) <= params.build_ram_bytes and n <= params.shard_rows:
        centers = cluster.training_rows(base, 1000).mean(0, keepdims=True)
    else:
        budget = min(params.build_ram_bytes, cluster.ram_estimate(params.shard_rows, params.dim, params.build.degree))
        centers = cluster.partition_for_budget(base, params.dim, params.build.degree, budget, work, params.replicas, seed=params.seed)
    members = cut(cluster.shard_members(base, centers, min(params.replicas, len(centers))))
    book, codes = None, None
    if params.chunks:
        trainer = pq.train_rotated if params.rotate else pq.train
        book = trainer(base, params.chunks, min(params.codes, n), centre=params.metric != "ip", seed=params.seed)
        codes = cut(pq.encode(base, book))
    starts = G.start_points(centers.shape[1], params.start_norm, 1, params.seed) if params.start_norm else None
    graph = cut(G.build_sharded(base, members, params.build, params.shard_rows, starts, book if params.code_build else None))
    index = Index(params, base, members, graph, L.identity_layout(base, _per_page(params)), centers, book, codes=codes)
    index.largest_norm = top
    if params.layout != "identity":
        if work is None:
            raise ValueError("this layout needs a workload")
        index.layout = workload_layout(index, work)
    return index


def simulate_paths(index: Index, queries: DataFrame, list_size: int = 64, most: int = 8) -> DataFrame:
    """(path_id, pos, id, shard): what each query visits: up to ``most`` expansions per shard, in order."""
    import pyarrow as pa

    from ..functions.arrow import matrix
    from ..operators.graph import _by_id, local_graph
    from ..operators.kernels import greedy_search

    held = index.graph.join(index.nodes(), "id").select("shard", "id", "vec", "nbrs", "entry")
    routes = cluster.nearest_centers(queries, index.centers, 1).select("id", F.col("center").alias("shard"))
    q = select_vectors(queries, "id", "vec").join(routes, "id")

    def walk(qs, t):
        path, pos, node, shard = [], [], [], []
        if qs.num_rows and t.num_rows:
            t = _by_id(t)
            ids, vecs, nbrs, starts = local_graph(t)
            s = t.column("shard")[0].as_py()
            for qid, v in zip(qs.column("id").to_pylist(), matrix(qs.column("vec"))):
                seen = greedy_search(vecs, nbrs, starts, v, list_size)[1]
                seen = seen[ids[seen] >= 0][:most]
                path += [qid] * len(seen)
                pos += range(len(seen))
                node += ids[seen].tolist()
                shard += [s] * len(seen)
        return pa.table({"path_id": pa.array(path, pa.int64()), "pos": pa.array(pos, pa.int32()), "id": pa.array(node, pa.int64()), "shard": pa.array(shard, pa.int32())})

    return q.select("shard", "id", "vec").groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(walk, "path_id long, pos int, id long, shard int")


def workload_layout(index: Index, queries: DataFrame) -> DataFrame:
    """The layout that the parameters name, from simulated paths. An id belongs to the first of its shards."""
    paths = cut(simulate_paths(index, queries))
    per_page = _per_page(index.params)
    if index.params.layout == "first_seen":
        return L.first_seen_layout(paths, index.rows, per_page)
    home = index.members.groupBy("id").agg(F.min("shard").alias("shard"))
    weights = L.covisit_weights(paths.select("path_id", "pos", "id"))
    a, b = (home.select(F.col("id").alias(c), F.col("shard").alias(f"_{c}")) for c in "ab")
    inside = weights.join(a, "a").join(b, "b").filter("_a = _b").select(F.col("_a").alias("shard"), "a", "b", "weight")
    return L.covisit_layout(inside, home.select("shard", "id"), per_page)


_TABLES = ("rows", "members", "graph", "layout")


class Catalog:
    """Versions of named indexes under one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self, name: str) -> list[int]:
        """The complete versions, oldest first."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [f.getPath().getName() for f in fs.listStatus(path)]
        good = [int(x[2:]) for x in found if x.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{x}/meta/_SUCCESS"))]
        return sorted(good)

    def meta(self, name: str, version: int | None = None) -> dict:
        """What was stored beside a version's tables; {} if there is no version."""
        all_ = self.versions(name)
        if not all_:
            return {}
        return json.loads(self.spark.read.parquet(f"{self.root}/{name}/v={version or all_[-1]}/meta").first().meta)

    def save(self, name: str, index: Index, **notes) -> int:
        """A new version, with ``notes`` in its meta. Refused while deletes wait for consolidation."""
        if index.hidden is not None:
            raise ValueError("consolidate before saving")
        version = (self.versions(name) or [0])[-1] + 1
        at = f"{self.root}/{name}/v={version}"
        for t in _TABLES:
            getattr(index, t).write.mode("overwrite").parquet(f"{at}/{t}")
        book = None
        if index.book:
            b = index.book
            book = {"offsets": b.offsets, "centers": [c.tolist() for c in b.centers], "centroid": b.centroid.tolist(), "rotation": None if b.rotation is None else b.rotation.tolist()}
        meta = {"params": asdict(index.params), "centers": index.centers.tolist(), "book": book, "largest_norm": index.largest_norm, "rows": index.rows.count(), **notes}
        self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{at}/meta")
        return version

    def load(self, name: str, version: int | None = None) -> Index:
        """The latest or a given version; counts of rows, graph and layout must agree, and the layout must be a bijection."""
        all_ = self.versions(name)
        if not all_ or version is not None and version not in all_:
            raise ValueError(f"no such version of {name}; there are {all_}")
        at = f"{self.root}/{name}/v={version or all_[-1]}"
        meta = self.meta(name, version)
        t = {x: self.spark.read.parquet(f"{at}/{x}") for x in _TABLES}
        n = t["rows"].count()
        lay = t["layout"].agg(F.count("*"), F.countDistinct("logical_id"), F.countDistinct("physical_id"), F.min("physical_id"), F.max("physical_id")).first()
        nodes = t["graph"].filter("id >= 0").agg(F.countDistinct("id")).first()[0]
        if n != meta["rows"] or nodes != n:
            raise ValueError(f"{name}: {n} rows, {nodes} graph nodes, {meta['rows']} expected")
        if tuple(lay) != (n, n, n, 0, n - 1):
            raise ValueError(f"{name}: the layout is no bijection onto 0..{n - 1}")
        params = IndexParams(**{**meta["params"], "build": BuildParams(**meta["params"]["build"])})
        b = meta["book"]
        book = b and pq.Codebook(b["offsets"], [np.array(c) for c in b["centers"]], np.array(b["centroid"]), None if b["rotation"] is None else np.array(b["rotation"]))
        index = Index(params, centers=np.array(meta["centers"]), book=book, codes=pq.encode(t["rows"], book) if book else None, **t)
        index.largest_norm = meta["largest_norm"]
        return index


def sweep(index: Index, queries: DataFrame, truth: DataFrame, k: int, sizes: list[int], pages: bool = False, **options) -> DataFrame:
    """(L, queries_per_second, comparisons, hops, pages, recall): a search of all queries per list size, timed on the driver.

    ``truth`` as of ``exact.knn_join`` (ties at the k-th count). pages is null unless ``pages`` asks for page search. Times
    hold the start of the job, so they compare batches, not single queries.
    """
    import time

    n, out = queries.count(), []
    for size in sizes:
        begin = time.perf_counter()
        found = cut((index.page_search if pages else index.search)(queries, k, size, **options))
        took = time.perf_counter() - begin
        first = found.filter("rank = 1").agg(F.avg("comparisons"), F.avg("hops"), F.avg("pages") if pages else F.lit(None).cast("double")).first()
        recall = evaluate.recall_at(found, truth, k).first().recall
        out.append((size, n / took, *first, recall))
    return index.rows.sparkSession.createDataFrame(out, "L int, queries_per_second double, comparisons double, hops double, pages double, recall double")
