"""Grouping records into similarity clusters by bisecting k-means.

The tree is grown across the cluster: every round splits all nodes that are neither compact nor small enough for
a task, each by a few 2-means passes over all rows, in which a task reduces its rows to sums per child. Nodes that
have become small enough are finished inside one task each, by the same rule, down to the compactness
limit: a node of too large a dispersion is split until every leaf is compact or tiny.

Chains of links (``linked_clusters``) are found on the leaves of the same tree, without comparing all rows. Rows of a leaf are
compared in the task that made it. Rows of two leaves can only be linked if the leaves' balls (centre and radius)
come within the link distance t of each other; such pairs of leaves are found by sending each ball down the tree to every node
within its radius and t, and only rows within t of the other leaf's ball are sent to the pair's cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.blocks import cut, release
from .blocks import block_pairs
from .vectors import distinct_rows, group_bounds, join_hot, matrix, sorted_groups

LOCAL_ROWS = 50_000
#: Splits of one broadcast tree, about 10 MB at 64 dimensions. Nodes still too large then are the roots of further trees.
MOST_NODES = 20_000
#: Planes tried for a node, in a task and across the cluster: the seeds' and those of three Lloyd steps.
CLUSTER_PLANES = 4
#: Rows of two sides of leaf pairs are filtered by a broadcast of up to so many rows (about 600 bytes each at 64 dimensions).
BROADCAST_SIDES = 20_000
SALTS = 16
#: For links, leaves with a row at more than so many times the dispersion from their centre (squared) are split further: a few far rows would let a ball meet many others.
WIDEST = 4.0
#: Rows of a cell, and of a block of the distance grid.
CELL_ROWS = 8_192
GRID_ROWS = 512


#: Split nodes: node -> (normal, offset, low); rows with normal . x <= offset go to node low, others to low + 1. The root is 1.
Planes = dict[int, tuple[np.ndarray, float, int]]


def descend(planes: Planes, vecs: np.ndarray, nodes: np.ndarray, margin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of the unsplit nodes that hold each row, which begins at its node of ``nodes``; with ``margin`` also those within so much of it."""
    rows, done = np.arange(len(vecs)), []
    while len(rows):
        order = np.argsort(nodes, kind="stable")
        rows, nodes = rows[order], nodes[order]
        starts = np.append(np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1])), len(nodes))
        todo = []
        for lo, hi in zip(starts[:-1], starts[1:]):
            r, node = rows[lo:hi], int(nodes[lo])
            if node not in planes:
                done.append((r, nodes[lo:hi]))
                continue
            normal, offset, low = planes[node]
            side = vecs[r] @ normal - offset
            left, right = side <= 0, side > 0
            if margin is not None:
                near = np.abs(side) <= margin[r] * (1 + 1e-9)
                left, right = left | near, right | near
            todo.append((r[left], np.full(left.sum(), low)))
            todo.append((r[right], np.full(right.sum(), low + 1)))
        rows, nodes = (np.concatenate(x) for x in zip(*todo)) if todo else (np.zeros(0, int), np.zeros(0, np.int64))
    if not done:
        return rows, nodes
    return tuple(np.concatenate(x) for x in zip(*done))


def plane(c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, float]:
    """The hyperplane of unit normal halfway between two centres."""
    normal = c1 - c0
    normal = normal / np.linalg.norm(normal)
    return normal, float(normal @ (c0 + c1) / 2)


def seeds(mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two starting centres on the axis of the largest variance."""
    axis = np.zeros(len(mean))
    axis[int(var.argmax())] = np.sqrt(max(var.max(), 0))
    return mean - axis, mean + axis


def node_stats(rows: DataFrame, dim: int, planes: Planes, wanted: set[int]) -> dict[int, dict]:
    """Rows n, weight (copies count), mean and variance of the ``wanted`` nodes, from a row of sums per node and task."""
    sums = [f"s{i}" for i in range(dim)] + [f"q{i}" for i in range(dim)]
    shared = rows.sparkSession.sparkContext.broadcast((planes, wanted))

    def reduce(batches):
        tree, some = shared.value
        held: dict[int, list] = {}
        for b in batches:
            vecs, copies = matrix(b.column("vec"), dim).astype(np.float64), b.column("copies").to_numpy()
            r, nodes = descend(tree, vecs, b.column("node").to_numpy())
            bounds = np.append(np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1])), len(nodes)) if len(nodes) else np.zeros(1, int)
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if int(nodes[lo]) in some:
                    v, w = vecs[r[lo:hi]], copies[r[lo:hi]]
                    h = held.setdefault(int(nodes[lo]), [0, 0, np.zeros(dim), np.zeros(dim)])
                    h[0] += int(w.sum())
                    h[1] += hi - lo
                    h[2] += w @ v
                    h[3] += w @ (v * v)
        if held:
            h = list(held.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held)), pa.array([int(x[0]) for x in h]), pa.array([int(x[1]) for x in h])]
                + [pa.array([x[2][i] for x in h]) for i in range(dim)] + [pa.array([x[3][i] for x in h]) for i in range(dim)],
                ["child", "weight", "n", *sums],
            )

    schema = "child long, weight long, n long, " + ", ".join(f"{c} double" for c in sums)
    got = rows.select("vec", "copies", "node").mapInArrow(reduce, schema).groupBy("child").agg(*[F.sum(c).alias(c) for c in ("weight", "n", *sums)]).toPandas()
    shared.unpersist()
    out = {}
    for x in got.itertuples(index=False):
        mean = np.array(x[3 : 3 + dim]) / x.weight
        out[int(x.child)] = {"n": int(x.n), "weight": int(x.weight), "mean": mean, "var": np.maximum(np.array(x[3 + dim :]) / x.weight - mean**2, 0)}
    return out


def grow(rows: DataFrame, dim: int, local_rows: int, dispersion: float, roots: list[int], free: int, most_nodes: int = MOST_NODES):
    """Split nodes of more than ``local_rows`` distinct rows whose mean squared distance to the centre exceeds ``dispersion``.

    ``rows`` are (vec, copies, node) with node one of ``roots``; ``free`` is the first unused number of a node. Returns the
    planes, the centres of the large nodes that are leaves (compact ones, and those no plane separates), the nodes
    still to be split when the tree is full, and the next free number.
    """
    planes, whole = {}, {}
    nodes = node_stats(rows, dim, planes, set(roots))
    while True:
        large = {k: v for k, v in nodes.items() if v["n"] > local_rows}
        ended = {k for k, v in large.items() if v["var"].sum() <= dispersion or v["var"].max() <= 0}
        whole |= {k: large.pop(k)["mean"] for k in ended}
        if not large or len(planes) >= most_nodes:
            return planes, whole, list(large), free
        # Twins of 2-means: seeds, then means of the two sides.
        centres = {k: seeds(v["mean"], v["var"]) for k, v in large.items()}
        low = {k: free + 2 * i for i, k in enumerate(large)}
        free += 2 * len(large)
        good: dict[int, tuple] = {}
        for step in range(CLUSTER_PLANES):
            trial = planes | {k: (*plane(*c), low[k]) for k, c in centres.items()}
            kids = node_stats(rows, dim, trial, {low[k] + s for k in large for s in (0, 1)})
            for k in large:
                two = [kids.get(low[k] + s) for s in (0, 1)]
                if all(two):
                    good[k] = trial[k], two
                    if step < CLUSTER_PLANES - 1 and np.linalg.norm(two[0]["mean"] - two[1]["mean"]) > 0:
                        centres[k] = two[0]["mean"], two[1]["mean"]
        whole |= {k: v["mean"] for k, v in large.items() if k not in good}
        nodes = {}
        for k, (split, two) in good.items():
            planes[k] = split
            nodes |= {low[k] + s: x for s, x in enumerate(two)}


def locate(df: DataFrame, vec: str, dim: int, forest: list[Planes], margin: str | None = None, only: list[set[int] | None] | None = None) -> DataFrame:
    """Move each row from its ``node`` to the unsplit nodes that hold it, or with the column ``margin`` are within so much of it."""
    for k, planes in enumerate(forest):
        shared = df.sparkSession.sparkContext.broadcast((planes, only[k] if only else None))

        def step(batches, shared=shared):
            tree, some = shared.value
            for b in batches:
                vecs, node = matrix(b.column(vec), dim).astype(np.float64), b.column("node").to_numpy()
                r, nodes = descend(tree, vecs, node, None if margin is None else b.column(margin).to_numpy())
                if some is not None:
                    keep = np.isin(nodes, list(some))
                    r, nodes = r[keep], nodes[keep]
                yield pa.RecordBatch.from_arrays([pa.array(nodes) if c == "node" else b.column(c).take(pa.array(r)) for c in b.schema.names], b.schema.names)

        df = df.mapInArrow(step, df.schema)
    return df


def build_tree(distinct: DataFrame, dim: int, local_rows: int, dispersion: float, most_nodes: int = MOST_NODES) -> tuple[list[Planes], dict[int, np.ndarray]]:
    """The trees, each from nodes the ones before it left too large, and the centres of large leaves.

    The driver holds a plane (8 * dim bytes) per ``local_rows`` rows or so; a broadcast holds one tree.
    """
    rows = distinct.select("vec", "copies", F.lit(1).cast("long").alias("node"))
    forest, whole, roots, free = [], {}, [1], 2
    while roots:
        step, after, grown = max(1, most_nodes // 10), [], []
        for lo in range(0, len(roots), step):
            some = roots[lo : lo + step]
            part = rows if len(roots) <= step else rows.filter(F.col("node").isin(some))
            planes, ends, left, free = grow(part, dim, local_rows, dispersion, some, free, most_nodes)
            grown.append(planes)
            whole |= ends
            after += left
        if after:
            # Nodes without a plane of their own tree pass through; the last step keeps those still to be split.
            rows = cut(locate(rows, "vec", dim, grown, only=[None] * (len(grown) - 1) + [set(after)]))
        forest += grown
        roots = after
    return forest, whole


def bisect_local(
    vecs: np.ndarray, leaf_rows: int, dispersion: float, weights: np.ndarray | None = None, passes: int = CLUSTER_PLANES, widest: float = np.inf
) -> np.ndarray:
    """Leaf numbers of a small set: split by 2-means while a node has more than ``leaf_rows`` rows and its
    mean squared distance to the centre exceeds ``dispersion``, or its largest one ``widest``."""
    n = len(vecs)
    leaf, count = np.zeros(n, np.int64), 0
    w = np.ones(n) if weights is None else weights.astype(np.float64)
    stack = [np.arange(n)]
    while stack:
        rows = stack.pop()
        v, wr = vecs[rows], w[rows]
        total = wr.sum()
        mean = (wr @ v) / total
        var = np.maximum(wr @ (v * v) / total - mean**2, 0)
        if len(rows) <= leaf_rows or var.sum() <= dispersion and (widest == np.inf or ((v - mean) ** 2).sum(1).max() <= widest):
            leaf[rows] = count
            count += 1
            continue
        c0, c1 = seeds(mean, var)
        left = None
        for _ in range(passes):
            if not np.linalg.norm(c1 - c0) > 0:
                break
            normal, offset = plane(c0, c1)
            new = v @ normal <= offset
            if new.all() or not new.any() or left is not None and (new == left).all():
                break
            left = new
            c0, c1 = ((wr[s] @ v[s]) / wr[s].sum() for s in (left, ~left))
        if left is None:
            leaf[rows] = count
            count += 1
        else:
            stack += [rows[left], rows[~left]]
    return leaf


def link_labels(vecs: np.ndarray, limit: float) -> np.ndarray:
    """For each row of a small set the number of a row it is linked to, directly or through others: the same for all that are; exact.

    Squared distances come from a single-precision grid around the mean, in blocks; those too near the limit for it are computed again.
    """
    n = len(vecs)
    centred = vecs - vecs.mean(0)
    if 4 * (centred * centred).sum(1).max() <= limit * (1 - 1e-9):
        return np.zeros(n, np.int64)
    x = centred.astype(np.float32)
    sq = (x * x).sum(1)
    slack = np.float32(3e-5 * (4 * sq.max() + limit))
    label = np.arange(n)

    def find(a: int) -> int:
        while label[a] != a:
            label[a] = label[label[a]]
            a = int(label[a])
        return a

    def join(a: np.ndarray, b: np.ndarray) -> None:
        for p, q in zip(a.tolist(), b.tolist()):
            p, q = find(p), find(q)
            if p != q:
                label[max(p, q)] = min(p, q)
        while (label[label] != label).any():
            label[:] = label[label]

    for lo in range(0, n, GRID_ROWS):
        hi = min(n, lo + GRID_ROWS)
        grid = x[lo:hi] @ x[lo:].T
        grid *= -2
        grid += sq[lo:hi, None]
        grid += sq[lo:]
        near = grid <= limit + slack
        a, b = np.nonzero(near & (grid > limit - slack))
        if len(a):
            near[a, b] = ((vecs[lo + a] - vecs[lo + b]) ** 2).sum(1) <= limit
        # Each row joins the first of the block that it is linked to; few links between different sets remain then.
        first, some = near.argmax(0), np.flatnonzero(near.any(0))
        some = some[label[lo + some] != label[lo + first[some]]]
        join(lo + some, lo + first[some])
        near &= label[lo:hi, None] != label[lo:]
        a, b = np.nonzero(near)
        if len(a):
            rest = np.unique(np.stack([label[lo + a], label[lo + b]]), axis=1)
            join(rest[0], rest[1])
    return label


def _assigned(distinct: DataFrame, dim: int, dispersion: float, min_rows: int, local_rows: int, tree_dispersion: float, limit: float | None):
    """The leaf of each distinct row, and the trees.

    (id, vec, node, leaf, distance, root, centre, radius): leaf is the leaf's smallest id, root the smallest id that links within the leaf lead
    to (id itself without ``limit``, and in leaves finished across the cluster); the row that names a leaf carries its ball.
    """
    forest, whole = build_tree(distinct, dim, max(local_rows, min_rows), tree_dispersion)
    shared = distinct.sparkSession.sparkContext.broadcast(whole)
    schema = "id long, vec binary, node long, leaf long, distance double, root long, centre array<double>, radius double"

    def finish(batches):
        for t in sorted_groups(batches, ["node"]):
            ids, vecs, copies = t.column("id").to_numpy(), matrix(t.column("vec"), dim).astype(np.float64), t.column("copies").to_numpy()
            label, dist, root = np.empty(len(ids), np.int64), np.empty(len(ids)), ids.copy()
            centres, radii = [None] * len(ids), np.zeros(len(ids))
            bounds = group_bounds(t, ["node"])
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                leaf = bisect_local(vecs[lo:hi], min_rows, dispersion, copies[lo:hi], widest=np.inf if limit is None else WIDEST * dispersion)
                order = lo + np.argsort(leaf, kind="stable")
                ends = np.append(np.searchsorted(leaf[order - lo], np.arange(leaf.max() + 1)), hi - lo)
                for x, y in zip(ends[:-1], ends[1:]):
                    here = order[x:y]
                    v, w = vecs[here], copies[here].astype(np.float64)
                    centre = (w @ v) / w.sum()
                    name = here[int(ids[here].argmin())]
                    label[here] = ids[name]
                    dist[here] = ((v - centre) ** 2).sum(1)
                    centres[name], radii[name] = centre, np.sqrt(dist[here].max())
                    if limit is not None and len(here) > 1:
                        sets = link_labels(v, limit)
                        least = np.full(len(here), np.iinfo(np.int64).max)
                        np.minimum.at(least, sets, ids[here])
                        root[here] = least[sets]
            yield pa.RecordBatch.from_arrays(
                [*(t.column(c).combine_chunks() for c in ("id", "vec", "node")), pa.array(label), pa.array(dist), pa.array(root), pa.array(centres, pa.list_(pa.float64())), pa.array(radii)],
                schema_names,
            )

    schema_names = [x.strip().split(" ")[0] for x in schema.split(",")]
    placed = locate(distinct.select("id", "vec", "copies", F.lit(1).cast("long").alias("node")), "vec", dim, forest)
    if not whole:
        return placed.repartition("node").sortWithinPartitions("node").mapInArrow(finish, schema), forest

    def measure(batches):
        for b in batches:
            node, vecs, centres = b.column("node").to_numpy(), matrix(b.column("vec"), dim).astype(np.float64), shared.value
            dist = np.full(len(node), np.nan)
            for k in np.unique(node).tolist():
                if k in centres:
                    here = node == k
                    dist[here] = ((vecs[here] - centres[k]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dist)], [*b.schema.names, "distance"])

    # Large leaves are never gathered: their names and balls, a row each, go to their rows.
    both = cut(placed.mapInArrow(measure, "id long, vec binary, copies long, node long, distance double"))
    small = both.filter(F.isnan("distance")).drop("distance").repartition("node").sortWithinPartitions("node").mapInArrow(finish, schema)
    large = both.filter(~F.isnan("distance"))
    centres = distinct.sparkSession.createDataFrame([(k, c.tolist()) for k, c in whole.items()], "node long, _c array<double>")
    names = large.groupBy("node").agg(F.min("id").alias("leaf"), F.sqrt(F.max("distance")).alias("_r")).join(centres, "node")
    mine = F.col("id") == F.col("leaf")
    named = large.join(F.broadcast(names), "node").select(
        "id", "vec", "node", "leaf", "distance", F.col("id").alias("root"), F.when(mine, F.col("_c")).alias("centre"), F.when(mine, F.col("_r")).otherwise(0.0).alias("radius")
    )
    return small.unionByName(named), forest


def bisecting_clusters(
    rows: DataFrame, row_id: str = "id", vec: str = "vec", dim: int = 64, max_dispersion: float = 2.0,
    min_rows: int = 1, local_rows: int = LOCAL_ROWS, held: DataFrame | None = None,
) -> DataFrame:
    """(id, cluster_id, distance): every usable row, with ``held`` (id) every one of those ids, its leaf and its squared distance to the leaf's centre.

    A leaf is compact: its mean squared distance to the centre is at most ``max_dispersion``, or it has at
    most ``min_rows`` distinct vectors. cluster_id is the smallest id of the leaf. Identical vectors count as
    often as they occur and share a leaf. Unusable rows (null id; null, wrong-length, NaN or zero vectors) are left out;
    repeated ids count once. An empty table gives no rows. The limit decides alone: ``local_rows``
    only says where a node is finished, in a task of its own or across the cluster.
    """
    distinct, members = distinct_rows(rows, row_id, vec, dim, held)
    leaves = cut(_assigned(distinct, dim, max_dispersion, min_rows, local_rows, max_dispersion, None)[0].select("id", F.col("leaf").alias("cluster_id"), "distance"))
    others = members.filter("id <> rep").join(leaves.withColumnRenamed("id", "rep"), "rep").select("id", "cluster_id", "distance")
    return leaves.unionByName(others)


def describe_clusters(assigned: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster_id, size, dispersion, typical_ids): the ``typical`` members nearest the centre, ties to the smaller id."""
    order = Window.partitionBy("cluster_id").orderBy("distance", "id")
    stats = assigned.groupBy("cluster_id").agg(F.count("*").alias("size"), F.avg("distance").alias("dispersion"))
    best = assigned.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= typical)
    lists_ = best.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "id"))), lambda x: x["id"]).alias("typical_ids"))
    return stats.join(lists_, "cluster_id")


def connect(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable over ``edges`` (a, b), for every id in them.

    Alternates the large-star and small-star steps until the star graph no longer changes; each round
    is written to the shared checkpoint folder. Neither edges nor components come to the driver, and
    hubs are joined by broadcast of a row each.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("_n"))
        large = join_hot(both.filter("b > a"), low, ["a"], "_n").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low2.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        )
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        before = now


def near_leaves(leaves: DataFrame, dim: int, forest: list[Planes], reach: float) -> DataFrame:
    """(a, b), a < b: pairs of leaves whose balls come within ``reach`` of each other. leaves: (leaf, node, centre, radius).

    A ball is sent to every node within its radius and ``reach``; there it meets the leaves that lie in the node, in blocks.
    """
    start = leaves.select("leaf", F.col("node").alias("home"), "centre", "radius", (F.col("radius") + reach).alias("margin"), F.lit(1).cast("long").alias("node"))
    visits = cut(locate(start, "centre", dim, forest, "margin"))
    by = ["node", "block_a", "block_b"]

    def meet(batches):
        for t in sorted_groups(batches, by):
            names, home = t.column("leaf").to_numpy(), t.column("home").to_numpy() == t.column("node").to_numpy()
            centres, radii, bounds = matrix(t.column("centre"), dim), t.column("radius").to_numpy(), group_bounds(t, by)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                own = lo + np.flatnonzero(home[lo:hi])
                c, r = centres[lo:hi], radii[lo:hi]
                norms = (c * c).sum(1)
                for x in range(0, len(own), GRID_ROWS):
                    o = own[x : x + GRID_ROWS]
                    gap = norms[o - lo][:, None] + norms - 2 * (centres[o] @ c.T)
                    far = radii[o][:, None] + r + reach
                    i, j = np.nonzero(gap <= far * far + 1e-9 * (1 + norms))
                    p, q = names[o[i]], names[lo + j]
                    a.append(np.minimum(p, q)[p != q])
                    b.append(np.maximum(p, q)[p != q])
            yield pa.RecordBatch.from_arrays([np.concatenate(a), np.concatenate(b)], ["a", "b"])

    cells = block_pairs(visits.drop("margin"), "node", "leaf", CELL_ROWS).repartition(*by).sortWithinPartitions(*by)
    return cells.mapInArrow(meet, "a long, b long").distinct()


def _cell_links(cells: DataFrame, dim: int, limit: float) -> DataFrame:
    """Stars (a, b) of the links within cells (cell, id, vec)."""
    by = ["cell", "block_a", "block_b"]

    def link(batches):
        for t in sorted_groups(batches, by):
            ids, vecs = t.column("id").to_numpy(), matrix(t.column("vec"), dim).astype(np.float64)
            bounds, root = group_bounds(t, by), np.empty(len(ids), np.int64)
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                sets = link_labels(vecs[lo:hi], limit)
                least = np.full(hi - lo, np.iinfo(np.int64).max)
                np.minimum.at(least, sets, ids[lo:hi])
                root[lo:hi] = least[sets]
            tied = root != ids
            yield pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(root[tied])], ["a", "b"])

    return block_pairs(cells, "cell", "id", CELL_ROWS).repartition(*by).sortWithinPartitions(*by).mapInArrow(link, "a long, b long")


def _large_leaf_links(leaves: DataFrame, balls: DataFrame, dim: int, limit: float, local_rows: int) -> DataFrame | None:
    """Edges (a, b) within leaves finished across the cluster: rows within half the reach of the centre are all linked, others meet them in blocks."""
    counts = leaves.groupBy("leaf").agg(F.count("*").alias("_n")).filter(F.col("_n") > local_rows)
    names = cut(counts.join(balls, "leaf").select("leaf", (F.col("radius") > np.sqrt(limit) / 2 * (1 - 1e-9)).alias("_wide")))
    if names.isEmpty():
        return None
    big = leaves.join(F.broadcast(names), "leaf")
    inner = big.filter(F.col("distance") <= limit / 4 * (1 - 1e-9))
    least = inner.groupBy("leaf").agg(F.min("id").alias("b"))
    edges = inner.join(F.broadcast(least), "leaf").select(F.col("id").alias("a"), "b").filter("a <> b")
    return cut(edges.unionByName(_cell_links(big.filter("_wide").select(F.col("leaf").alias("cell"), "id", "vec"), dim, limit)))


def linked_clusters(
    rows: DataFrame, row_id: str = "id", vec: str = "vec", dim: int = 64, limit: float = 0.4, local_rows: int = LOCAL_ROWS, max_dispersion: float | None = None,
    held: DataFrame | None = None,
) -> DataFrame:
    """(cluster_id, id): the members of each cluster of two or more rows that links of at most ``limit`` hold together.

    Two usable rows are linked if their squared L2 distance is at most ``limit``; clusters are the connected
    components, named by their smallest id. Exact: see the module's text. The tree's leaves have a dispersion of at most
    ``max_dispersion`` (20 * ``limit`` if not given), which decides the work, not the result; nodes too large for a task are split further, down to
    limit / 8. Identical vectors are linked; only one of them takes part in comparisons. Unusable rows and, with ``held`` (id), all other ids are left out; an
    empty table gives no rows.
    """
    spark = rows.sparkSession
    distinct, members = distinct_rows(rows, row_id, vec, dim, held)
    reach = float(np.sqrt(limit))
    leaves, forest = _assigned(distinct, dim, 20 * limit if max_dispersion is None else max_dispersion, 1, local_rows, limit / 8, limit)
    leaves = cut(leaves)
    del distinct
    release(spark)
    edges = cut(leaves.filter("root <> id").select(F.col("id").alias("a"), F.col("root").alias("b")))
    edges = edges.unionByName(members.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    balls = cut(leaves.filter("id = leaf").select("leaf", "node", "centre", "radius"))
    inside = _large_leaf_links(leaves, balls, dim, limit, local_rows)
    edges = edges if inside is None else edges.unionByName(inside)

    pairs = near_leaves(balls, dim, forest, reach)
    one, two = (balls.select(F.col("leaf").alias(x), F.col("centre").alias(f"_c{x}"), F.col("radius").alias(f"_r{x}")) for x in ("a", "b"))
    sides = pairs.join(one, "a").join(two, "b").withColumn("cell", F.xxhash64("a", "b"))
    sides = cut(
        sides.select(F.col("a").alias("leaf"), "cell", F.col("_cb").alias("other"), F.col("_rb").alias("wide"))
        .unionByName(sides.select(F.col("b").alias("leaf"), "cell", F.col("_ca").alias("other"), F.col("_ra").alias("wide")))
    )
    few = sides.count()
    del pairs
    release(spark)
    if few:
        narrow = leaves.select("id", "vec", "leaf")
        if few <= BROADCAST_SIDES:
            met = narrow.join(F.broadcast(sides), "leaf")
        else:
            salted = sides.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = narrow.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["leaf", "_salt"])

        def within(batches):
            for b in batches:
                d = np.sqrt(((matrix(b.column("vec"), dim).astype(np.float64) - matrix(b.column("other"), dim)) ** 2).sum(1))
                keep = pa.array(d <= (b.column("wide").to_numpy() + reach) * (1 + 1e-9) + 1e-9)
                yield pa.RecordBatch.from_arrays([b.column(c).filter(keep) for c in ("cell", "id", "vec")], ["cell", "id", "vec"])

        cells = cut(met.select("cell", "id", "vec", "other", "wide").mapInArrow(within, "cell long, id long, vec binary"))
        # Cells and edges are all that is needed from here on.
        del leaves, narrow, met, sides, balls, one, two
        release(spark)
        edges = edges.unionByName(_cell_links(cells, dim, limit))
    return connect(edges).select(F.col("root").alias("cluster_id"), "id")
