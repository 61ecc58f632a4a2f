"""Inserts, deletes, consolidation and compaction over immutable snapshots.

A log is (seq, op, id, vec): op is 'insert' or 'delete', seq orders it. The last operation of an id decides. Tag 0 is
reserved and refused.
"""

from __future__ import annotations

from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .exact import select_vectors
from .graph import GRAPH, _by_id, check_shards, local_graph, ragged
from .kernels import BuildParams, distances, insert_node, medoid_of, robust_prune
from .layout import number_globally


def last_operations(log: DataFrame) -> DataFrame:
    """(id, op, seq): each id's last operation. Null ids or operations do not count."""
    last = log.filter("id is not null and op is not null").groupBy("id").agg(F.max(F.struct("seq", "op")).alias("_o"))
    return last.select("id", "_o.op", "_o.seq")


def live_set(log: DataFrame) -> DataFrame:
    """(id): inserted and not deleted since."""
    return last_operations(log).filter("op = 'insert'").select("id")


def failed_deletes(log: DataFrame) -> DataFrame:
    """(seq, id): deletes of ids that were not there: never inserted before, or already deleted."""
    w = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("op").over(w)
    ops = log.filter("id is not null and op is not null").select("seq", "op", "id").withColumn("_before", before)
    return ops.filter("op = 'delete' and (_before is null or _before = 'delete')").select("seq", "id")


def failed_inserts(log: DataFrame) -> DataFrame:
    """(seq, id): inserts of a reserved tag (0) or of an id that is there already."""
    w = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ops = log.filter("id is not null and op is not null").select("seq", "op", "id").withColumn("_before", F.last("op").over(w))
    return ops.filter("op = 'insert' and (id = 0 or _before = 'insert')").select("seq", "id")


def repair_candidates(graph: DataFrame, deleted: DataFrame) -> DataFrame:
    """(id, to): for each live node with a deleted neighbour, its live neighbours and those of its deleted ones.

    Two equi-joins on edges; deleted nodes are removed on both sides.
    """
    edges = graph.select("id", F.explode("nbrs").alias("to")).filter("to is not null").distinct()
    dead = deleted.select("id").distinct()
    live = edges.join(dead, "id", "left_anti")
    broken = live.join(dead.select(F.col("id").alias("to")), "to", "left_semi").select("id", F.col("to").alias("via"))
    beyond = broken.join(edges.select(F.col("id").alias("via"), "to"), "via").select("id", "to")
    own = live.join(broken.select("id").distinct(), "id", "left_semi").select("id", "to")
    gone = dead.select(F.col("id").alias("to"))
    return own.unionByName(beyond).filter("id <> to").distinct().join(gone, "to", "left_anti").select("id", "to")


def consolidate(graph: DataFrame, rows: DataFrame, deleted: DataFrame, params: BuildParams = BuildParams()) -> DataFrame:
    """The graph (shard, id, nbrs, entry) without the deleted nodes: edges to them are replaced by theirs, pruned above the degree.

    Untouched nodes keep their lists. If an entry node is deleted, the live row nearest to the shard's mean takes over.
    A shard left without rows disappears. Each shard is one task.
    """
    kept = asdict(params)

    def repair(key, t):
        p = BuildParams(**kept)
        t = _by_id(t)
        ids, vecs, nbrs, entries = local_graph(t)
        dead = t.column("dead").to_numpy(zero_copy_only=False)
        keep = np.flatnonzero(~dead)
        out = []
        for i in keep:
            own = nbrs[i]
            lost = own[dead[own]]
            if len(lost):
                c = np.unique(np.concatenate([own, *[nbrs[x] for x in lost]]))
                own = c[~dead[c] & (c != i)]
                if len(own) > p.degree:
                    own = robust_prune(vecs, i, own, distances(vecs, own, vecs[i]), p, dead)
            out.append(ids[own])
        entry = np.isin(keep, entries)
        if len(keep) and not entry.any():
            entry[medoid_of(vecs[keep])] = True
        return pa.table({"shard": t.column("shard").take(pa.array(keep)), "id": ids[keep], "nbrs": ragged(out), "entry": entry})

    marks = deleted.select("id", F.lit(True).alias("dead")).distinct()
    held = graph.join(select_vectors(rows, "id", "vec"), "id").join(marks, "id", "left").fillna(False, ["dead"])
    return held.select("shard", "id", "vec", "nbrs", "entry", "dead").groupBy("shard").applyInArrow(repair, GRAPH)


def consolidation_report(before: DataFrame, after: DataFrame, deleted: DataFrame) -> DataFrame:
    """(status, active, released, delete_set, unknown, repaired): what a consolidation from graph ``before`` to ``after`` did; one row.

    released are the deleted ids that were in the graph, unknown those that were not, repaired the nodes that remain with other
    neighbours. status is success, or inconsistent_count where the remaining nodes are not those before without the released ones.
    """
    dead = deleted.select("id").filter("id is not null").distinct()
    old, new = (g.filter("id >= 0").select("id").distinct() for g in (before, after))
    marked = old.withColumn("_old", F.lit(1)).join(new.withColumn("_new", F.lit(1)), "id", "full").join(dead.withColumn("_dead", F.lit(1)), "id", "full")
    counts = marked.agg(
        F.count("_new").alias("active"), F.count_if(F.expr("_old = 1 and _dead = 1")).alias("released"), F.count("_dead").alias("delete_set"),
        F.count_if(F.expr("_dead = 1 and _old is null")).alias("unknown"), F.count_if(F.expr("(_old = 1 and _dead is null) <> (_new is not null)")).alias("_wrong"),
    )
    key = ["shard", "id"]
    changed = before.select(*key, F.array_sort("nbrs").alias("_o")).join(after.select(*key, F.array_sort("nbrs").alias("_n")), key).filter("_o <> _n")
    repaired = changed.agg(F.countDistinct("id").alias("repaired"))
    status = F.when(F.col("_wrong") == 0, "success").otherwise("inconsistent_count").alias("status")
    return counts.join(F.broadcast(repaired)).select(status, "active", "released", "delete_set", "unknown", "repaired")  # one row each


def insert_rows(graph: DataFrame, rows: DataFrame, members: DataFrame, params: BuildParams = BuildParams(), shard_rows: int = 50_000) -> DataFrame:
    """The graph with the rows of ``members`` (shard, id) that it lacks inserted, in id order. ``rows`` (id, vec) holds old and new."""
    kept = asdict(params)
    both = graph.select("shard", "id", "nbrs", "entry").join(members.select(F.col("shard").cast("int"), "id").distinct(), ["shard", "id"], "full")
    check_shards(both, shard_rows)

    def add(key, t):
        p = BuildParams(**kept)
        t = _by_id(t)
        ids, vecs, nbrs, entries = local_graph(t)
        new = np.flatnonzero(t.column("nbrs").is_null().to_numpy(zero_copy_only=False))
        start = int(entries[0]) if len(entries) else medoid_of(vecs)
        for i in new:
            insert_node(vecs, nbrs, int(i), start, p)
        entry = np.zeros(len(ids), bool)
        entry[start] = True
        return pa.table({"shard": t.column("shard"), "id": ids, "nbrs": ragged([ids[x] for x in nbrs]), "entry": entry})

    held = both.withColumn("entry", F.coalesce("entry", F.lit(False))).join(select_vectors(rows, "id", "vec"), "id")
    return held.select("shard", "id", "vec", "nbrs", "entry").groupBy("shard").applyInArrow(add, GRAPH)


def compaction_map(ids: DataFrame) -> DataFrame:
    """(id, new_id): live ids numbered densely from 0 in their order."""
    return number_globally(ids.select("id").distinct(), ["id"], "new_id").select("id", "new_id")


def compact(graph: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, nbrs) renumbered by ``mapping`` (id, new_id); nodes and edges outside it drop out."""
    edges = graph.select("id", F.posexplode_outer("nbrs").alias("pos", "to"))
    to = mapping.select(F.col("id").alias("to"), F.col("new_id").alias("_to"))
    own = edges.join(mapping, "id").join(to, "to", "left")
    nbrs = F.transform(F.array_sort(F.collect_list(F.when(F.col("_to").isNotNull(), F.struct("pos", "_to")))), lambda x: x["_to"])
    return own.groupBy(F.col("new_id").alias("id")).agg(nbrs.alias("nbrs"))


def sliding_window(log: DataFrame, window: int) -> DataFrame:
    """(seq, id): the inserts among the last ``window`` of the sequence, by count of seq."""
    inserts = log.filter("op = 'insert'")
    top = inserts.agg(F.max("seq").alias("_top"))
    return inserts.join(F.broadcast(top)).filter(F.col("seq") > F.col("_top") - window).select("seq", "id")  # one row
