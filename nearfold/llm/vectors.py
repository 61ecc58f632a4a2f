"""Shared steps on vector tables: usable rows, exact copies, Arrow conversion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..operators.blocks import cut, release

#: Rows of one key above which ``join_hot`` broadcasts it, and the most keys it broadcasts.
HOT = 100_000
MOST_HOT = 100_000


def packed_rows(rows: DataFrame, row_id: str, vec: str, dim: int) -> DataFrame:
    """(id, vec) of rows with an id and a usable vector: exactly ``dim`` elements, none null, NaN or infinite, not all zero.

    vec is the vector's single-precision elements as bytes (see ``packed``), which Spark moves and hands to tasks without touching elements.
    """
    named = rows.select(F.col(row_id).cast("bigint").alias("id"), F.col(vec).cast("array<float>").alias("vec"))

    def pack(batches):
        for b in batches:
            column = b.column("vec")
            keep = pc.and_(b.column("id").is_valid(), pc.equal(column.value_lengths().fill_null(0), dim))
            kept = column.filter(keep)
            x = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim) + np.float32(0)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            yield pa.RecordBatch.from_arrays([b.column("id").filter(keep).filter(pa.array(good)), packed(x[good])], ["id", "vec"])

    return named.mapInArrow(pack, "id long, vec binary")


def packed(x: np.ndarray) -> pa.Array:
    """A (rows, dim) array as an Arrow column of its single-precision rows as bytes, without loss.

    A row takes the shortest of three forms that holds its elements exactly, told apart by their lengths: signed bytes times a power of two, whose
    exponent is the last byte; half precision; single precision. Equal rows have equal bytes.
    """
    x = np.ascontiguousarray(x, np.float32)
    n, dim = x.shape
    # The power of two by which each row's elements become integers of a byte, as its largest one needs it.
    exponent = np.clip(np.frexp(np.abs(x).max(1, initial=0))[1] - 7, -126, 120)
    whole = x * np.ldexp(np.float32(1), -exponent)[:, None]
    form = np.full(n, 2)
    if dim > 1:
        with np.errstate(over="ignore"):
            half = x.astype(np.float16)
        form[(half.astype(np.float32) == x).all(1)] = 1
        form[((whole == np.rint(whole)) & (np.abs(whole) <= 127) & ((whole != 0) | (x == 0))).all(1)] = 0
    offsets = np.append(0, np.cumsum(np.array([dim + 1, 2 * dim, 4 * dim])[form]))
    if offsets[-1] > np.iinfo(np.int32).max:
        raise ValueError("a batch of vectors must be below 2 GiB")
    out = np.empty(offsets[-1], np.uint8)
    for k in np.unique(form).tolist():
        here = np.flatnonzero(form == k)
        if k == 0:
            rows = np.concatenate([whole[here].astype(np.int8), exponent[here, None].astype(np.int8)], 1).view(np.uint8)
        else:
            rows = (half if k == 1 else x)[here].view(np.uint8)
        if len(here) == n:
            out[:] = rows.ravel()
        else:
            out[offsets[here][:, None] + np.arange(rows.shape[1])] = rows
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def unpacked(data: np.ndarray, at: np.ndarray, dim: int) -> np.ndarray:
    """The (rows, dim) single-precision array of rows that ``packed`` made; row i is data[at[i]:at[i + 1]]."""
    lengths = np.diff(at)
    out = np.empty((len(lengths), dim), np.float32)
    for width in np.unique(lengths).tolist():
        here = np.flatnonzero(lengths == width)
        if len(here) == len(lengths):
            rows = data[at[0] : at[-1]].reshape(-1, width)
        else:
            rows = data[at[here][:, None] + np.arange(width)]
        if width == 4 * dim:
            out[here] = rows.view(np.float32)
        elif width == 2 * dim:
            out[here] = rows.view(np.float16)
        elif width == dim + 1:
            signed = rows.view(np.int8)
            out[here] = signed[:, :dim] * np.ldexp(np.float32(1), signed[:, dim:].astype(np.int32))
        else:
            raise ValueError(f"{width} bytes are no vector of {dim} elements")
    return out


def distinct_rows(rows: DataFrame, row_id: str, vec: str, dim: int, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, vec, copies), one row per distinct vector (packed), and (id, rep) of the ids that share a vector with others.

    id of a distinct vector is the smallest of the ids that carry it, which is the rep of them all. Unusable
    vectors and null ids are left out, repeated rows count once. An id is expected to carry one vector; if it came with
    several, the one of the smallest fingerprint stays. Vectors are told apart by 128-bit fingerprints, so that ids and
    fingerprints are exchanged instead of vectors; each vector is exchanged once, copies are reduced before it. With ``held`` (id), each id once,
    only its ids count; it meets the fingerprints, not the vectors.
    """
    kept = packed_rows(rows, row_id, vec, dim).withColumns({"_h": F.xxhash64("vec"), "_g": F.xxhash64(F.lit(7), "vec")})
    marks = kept.select("id", "_h", "_g")
    marks = cut((marks if held is None else marks.join(held, "id", "left_semi")).distinct())
    release(rows.sparkSession)
    several = marks.groupBy("id").count().filter("count > 1")
    if not several.isEmpty():
        marks = cut(marks.groupBy("id").agg(F.min(F.struct("_h", "_g")).alias("_m")).select("id", "_m._h", "_m._g"))
    groups = marks.groupBy("_h", "_g").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    vectors = kept.groupBy("_h", "_g").agg(F.first("vec").alias("vec"))
    distinct = cut(vectors.join(groups, ["_h", "_g"]).select(F.col("rep").alias("id"), "vec", "copies"))
    release(rows.sparkSession)
    members = join_hot(marks, groups.filter("copies > 1"), ["_h", "_g"], "copies").select("id", "rep")
    return distinct, members


def join_hot(rows: DataFrame, unique: DataFrame, keys: list[str], weight: str, hot: int = HOT) -> DataFrame:
    """Inner join of ``rows`` with the unique keys of ``unique``, whose column ``weight`` counts the rows of a key.

    Keys of more than ``hot`` rows are at most rows / ``hot`` and are broadcast (about 40 bytes each), so that no task gets a hot key whole.
    """
    large = cut(unique.filter(F.col(weight) > hot))
    if not 0 < large.count() <= MOST_HOT:
        return rows.join(unique, keys)
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(unique.filter(F.col(weight) <= hot), keys)
    return rest.unionByName(rows.join(F.broadcast(large), keys))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """An Arrow column of lists of ``dim`` numbers, or of packed vectors, as a (rows, dim) array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        if not len(column):
            return np.zeros((0, dim), np.float32)
        width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1]
        return unpacked(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at.astype(np.int64), dim)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def lists(flat: np.ndarray, per_row: int) -> pa.Array:
    """A (rows * per_row) array as an Arrow column of lists."""
    return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, per_row, dtype=np.int32), pa.array(flat))


def sample_matrix(rows: DataFrame, dim: int, size: int, n: int) -> np.ndarray:
    """Up to ``size`` of the ``n`` vectors, those with the smallest id hashes, in that order, on the driver: size * dim * 4 bytes at most.

    A threshold on the hash comes first, so that tasks send about 1.5 * size rows in all, not size rows each.
    """
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 53))
    few = rows.filter(draw < int(min(1.0, (1.5 * size + 100) / max(n, 1)) * (1 << 53)))
    picked = few.select(draw.alias("_h"), "id", "vec").orderBy("_h", "id").limit(size).select("vec").toArrow()
    return matrix(picked.column("vec"), dim).astype(np.float64) if picked.num_rows else np.zeros((0, dim))


def sorted_groups(batches, columns: list[str]):
    """Whole groups out of batches sorted by ``columns``: yields tables that end at a group's end.

    Rows of the group still open are carried to the next batch, so the memory needed is a batch and
    the largest group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        change = np.zeros(n, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        if held:
            last = held[-1]
            change[0] = any(last.column(c)[last.num_rows - 1].as_py() != k[0] for c, k in zip(columns, keys))
        starts = np.flatnonzero(change)
        if len(starts):
            cut = int(starts[-1])
            whole = [*held, batch.slice(0, cut)] if cut else held
            if whole and sum(b.num_rows for b in whole):
                yield pa.Table.from_batches(whole).combine_chunks()
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_bounds(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Start offsets of the groups of a table sorted by ``columns``, and its length."""
    change = np.zeros(table.num_rows, bool)
    if len(change):
        change[0] = True
    for c in columns:
        k = table.column(c).to_numpy()
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)
