"""An index kept up to date from a stream of operations, one immutable version per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import dynamic
from ..operators.blocks import cut
from ..plans.index import Catalog, Index, IndexParams, build_index


def apply_operations(index: Index | None, ops: DataFrame, params: IndexParams) -> Index | None:
    """The index after (seq, op, id, vec): an id's last operation decides; then deletes are consolidated.

    Inserting an id that is there replaces it; deleting one that is not there has no effect; id 0 is reserved and is
    passed over. None if nothing is left.
    """
    last = cut(dynamic.last_operations(ops.filter("id <> 0")).join(ops.select("seq", "id", "vec"), ["seq", "id"]).dropDuplicates(["id"]))
    added = last.filter("op = 'insert'").select("id", "vec")
    if index is None:
        return build_index(added, params) if not added.isEmpty() else None
    leaving = last.select("id").join(index.rows.select("id"), "id", "left_semi")
    if not leaving.isEmpty():
        if index.rows.join(leaving, "id", "left_anti").isEmpty():
            return build_index(added, params) if not added.isEmpty() else None
        index = index.delete(leaving).consolidate()
    return index if added.isEmpty() else index.insert(added)


def maintain(source: DataFrame, catalog: Catalog, name: str, params: IndexParams, checkpoint: str, window: int | None = None):
    """A streaming query over (seq, op, id, vec) that saves a version of ``name`` after each micro-batch.

    With ``window`` rows whose id lies that many places before the newest seq leave by themselves; ids must then be given
    in the order of seq (id = seq), as in a log of insertions. The batch's number is stored with the version, so a batch that is
    repeated after a failure is not applied twice. Searches read the version they loaded and are never disturbed.
    """

    def step(batch: DataFrame, number: int) -> None:
        meta = catalog.meta(name)
        if meta.get("batch", -1) >= number:
            return
        index = catalog.load(name) if meta else None
        ops = batch.select("seq", "op", "id", "vec")
        if window is not None:
            top = batch.agg(F.max("seq")).first()[0]
            if top is not None:
                ops = ops.filter(F.col("seq") > top - window)
                if index is not None:
                    old = index.rows.filter(F.col("id") <= top - window)
                    ops = ops.unionByName(old.select(F.lit(top).cast("long").alias("seq"), F.lit("delete").alias("op"), "id", F.lit(None).cast("array<double>").alias("vec")))
        after = apply_operations(index, ops, params)
        if after is not None:
            catalog.save(name, after, batch=number)

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
