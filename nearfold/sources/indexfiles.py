"""Side files of an index: tags, id lists, codebooks and codes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.pq import Codebook
from . import files
from .vecfile import read_vectors, save_vectors

#: Fixed values of the codebook format: room for the section table, and the rotation's file name.
SECTION_TABLE_BYTES = 4096
ROTATION_SUFFIX = "_rotation_matrix.bin"


def read_ids(spark: SparkSession, path: str, element: str = "uint32") -> DataFrame:
    """(place, id) of a one-column bin file: delete lists, medoids, the id map of a shard."""
    return read_vectors(spark, path, "bin", element).select(F.col("id").alias("place"), F.col("vec")[0].cast("long").alias("id"))


def read_tags(spark: SparkSession, path: str, element: str = "uint32", deleted: DataFrame | None = None) -> DataFrame:
    """(id, tag) of a tag file. Tag 0 is the hidden start's and drops out, as do places in ``deleted`` (id)."""
    tags = read_ids(spark, path, element).select(F.col("place").alias("id"), F.col("id").alias("tag")).filter("tag <> 0")
    return tags if deleted is None else tags.join(deleted.select("id").distinct(), "id", "left_anti")


def read_shards(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """(shard, id) of the id maps of several shards."""
    out = None
    for shard, path in sorted(paths.items()):
        one = read_ids(spark, path).select(F.lit(shard).alias("shard"), "id")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no id maps given")
    return out


def save_ids(ids: DataFrame, path: str, element: str = "uint32") -> None:
    """Write (place, id) as a one-column bin file in order of place."""
    save_vectors(ids.select(F.col("place").alias("id"), F.array("id").alias("vec")), path, "bin", element)


def _section(f: files.ByteFile, at: int, kind: str) -> np.ndarray:
    n, d = (int(x) for x in f.array("<i4", 2, at))
    return f.array(kind, n * d, at + 8).reshape(n, d)


def read_codebook(path: str) -> Codebook:
    """A codebook of 256 codes: a table of section offsets, then centres, centroid and chunk starts, each a bin section.

    With five offsets, as older files have, the chunk starts are the fourth section. The rotation comes from the file of the
    same name and ``ROTATION_SUFFIX`` if there is one.
    """
    with files.ByteFile(path) as f:
        offsets = _section(f, 0, "<u8").ravel()
        if len(offsets) not in (4, 5):
            raise ValueError(f"{path}: {len(offsets)} section offsets, expected 4 or 5")
        centers, centroid = _section(f, int(offsets[0]), "<f4"), _section(f, int(offsets[1]), "<f4")
        starts = _section(f, int(offsets[len(offsets) - 2]), "<u4").ravel().astype(int).tolist()
    dim = centers.shape[1]
    if len(centers) != 256 or centroid.shape != (dim, 1) or len(starts) < 2 or starts[0] != 0 or starts[-1] != dim:
        raise ValueError(f"{path}: sections don't fit together")
    rotation = None
    if files.exists(path + ROTATION_SUFFIX):
        with files.ByteFile(path + ROTATION_SUFFIX) as f:
            rotation = _section(f, 0, "<f4").astype(np.float64)
        if rotation.shape != (dim, dim):
            raise ValueError(f"{path}: the rotation is no {dim} x {dim} matrix")
    return Codebook(starts, [centers[:, a:b].astype(np.float64) for a, b in zip(starts, starts[1:])], centroid.ravel().astype(np.float64), rotation)


def save_codebook(book: Codebook, path: str) -> None:
    """The file that ``read_codebook`` reads; needs 256 codes per chunk."""
    if any(len(c) != 256 for c in book.centers):
        raise ValueError("the format holds 256 codes per chunk")

    def section(x: np.ndarray, kind: str) -> bytes:
        x = x.reshape(len(x), -1)
        return np.array(x.shape, "<i4").tobytes() + x.astype(kind).tobytes()

    parts = [section(np.concatenate(book.centers, 1), "<f4"), section(book.centroid, "<f4"), section(np.array(book.offsets), "<u4")]
    offsets = np.cumsum([SECTION_TABLE_BYTES, *map(len, parts)])
    with files.write(path) as f:
        f.write(section(offsets, "<u8").ljust(SECTION_TABLE_BYTES, b"\0") + b"".join(parts))
    if book.rotation is not None:
        with files.write(path + ROTATION_SUFFIX) as f:
            f.write(section(book.rotation, "<f4"))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """(id, codes) of a codes file: a byte per chunk."""
    return read_vectors(spark, path, "bin", "uint8").select("id", F.col("vec").alias("codes"))


def save_codes(codes: DataFrame, path: str) -> None:
    save_vectors(codes.select("id", F.col("codes").alias("vec")), path, "bin", "uint8")
