"""Volume files (NIfTI-1, plain or gzipped) and array bundles (.npy, .npz) as DataFrames, and back.

Files are listed and read by Spark's binary source, so any store that Spark reads will do; decoding runs in Arrow batches, a slab of
planes at a time, so a volume is never turned into rows whole.
"""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Data type codes of the NIfTI-1 header.
DATATYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def decode_nifti(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(values[x, y, z, ...], 4 x 4 affine)."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", data[:4])[0] != 348:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack(order + "8h", data[40:56])
    code = struct.unpack(order + "h", data[70:72])[0]
    zooms = struct.unpack(order + "8f", data[76:108])
    offset, slope, inter = struct.unpack(order + "3f", data[108:120])
    if code not in DATATYPES:
        raise ValueError(f"data type {code} isn't supported")
    shape = dim[1 : dim[0] + 1]
    raw = np.frombuffer(data, order + DATATYPES[code], int(np.prod(shape)), int(offset)).reshape(shape, order="F").astype(np.float64)
    values = raw * slope + inter if slope not in (0.0,) and np.isfinite(slope) else raw
    affine = np.eye(4)
    if struct.unpack(order + "h", data[254:256])[0] > 0:
        affine[:3] = np.array(struct.unpack(order + "12f", data[280:328])).reshape(3, 4)
    else:
        affine[:3, :3] = np.diag(zooms[1:4])
    return values, affine


def encode_nifti(values: np.ndarray, affine: np.ndarray, compress: bool = True) -> bytes:
    """A NIfTI-1 file of 32-bit floats."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, values.ndim, *values.shape, *([1] * (7 - values.ndim)))
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1.0, *np.sqrt((affine[:3, :3] ** 2).sum(0)), 1.0, 1.0, 1.0, 1.0)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    head[344:348] = b"n+1\0"
    data = bytes(head) + values.astype("<f4").tobytes(order="F")
    return gzip.compress(data, 1) if compress else data


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, modificationTime of files under ``path``; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).drop("content")


def read_nifti(spark: SparkSession, path: str, glob: str = "*.nii*", skip_zero: bool = False) -> DataFrame:
    """(path, x, y, z, t, value) of every voxel; t is 0 in volumes of three dimensions. Files that can't be read fail the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values, _ = decode_nifti(data.as_py())
                values = values.reshape(*values.shape[:3], -1) if values.ndim >= 3 else values.reshape(*values.shape, *[1] * (3 - values.ndim), 1)
                for t in range(values.shape[3]):
                    for z in range(values.shape[2]):
                        plane = values[:, :, z, t]
                        x, y = (np.nonzero(plane) if skip_zero else np.indices(plane.shape).reshape(2, -1))
                        columns = [pa.array([name] * len(x)), pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(np.full(len(x), z), pa.int32()), pa.array(np.full(len(x), t), pa.int32()), pa.array(plane[x, y])]
                        yield pa.RecordBatch.from_arrays(columns, ["path", "x", "y", "z", "t", "value"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInArrow(run, "path string, x int, y int, z int, t int, value double")


def volume_headers(spark: SparkSession, path: str, glob: str = "*.nii*") -> DataFrame:
    """(path, shape, affine) of every volume."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode_nifti(data.as_py()) for data in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(v.shape) for v, _ in found], pa.list_(pa.int32())), pa.array([a.tolist() for _, a in found], pa.list_(pa.list_(pa.float64())))], ["path", "shape", "affine"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInArrow(run, "path string, shape array<int>, affine array<array<double>>")


def nifti_files(voxels: DataFrame, recording: str, shape: tuple[int, int, int], affine: list[list[float]], value: str = "value") -> DataFrame:
    """(recording, file): one encoded volume a recording, made where the recording's voxels meet. A volume has a bounded size, its grid."""
    matrix = np.array(affine, np.float64)

    def build(group: pa.Table) -> pa.Table:
        grid = np.zeros(shape)
        x, y, z, v = (group.column(c).to_numpy() for c in ("x", "y", "z", value))
        grid[x, y, z] = v
        return pa.table({recording: group.column(recording)[:1], "file": pa.array([encode_nifti(grid, matrix)], pa.binary())})

    kind = voxels.schema[recording].dataType.simpleString()
    return voxels.select(recording, "x", "y", "z", value).groupBy(recording).applyInArrow(build, f"`{recording}` {kind}, file binary")


def read_arrays(spark: SparkSession, path: str, glob: str = "*.np[yz]") -> DataFrame:
    """(path, member, index, value) of numeric arrays in .npy files and .npz bundles, row by row in C order. Pickled members are refused."""

    def members(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
        if data[:2] == b"PK":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for name in z.namelist():
                    yield name.removesuffix(".npy"), np.load(io.BytesIO(z.read(name)), allow_pickle=False)
        else:
            yield "", np.load(io.BytesIO(data), allow_pickle=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for member, a in members(data.as_py()):
                    flat = np.asarray(a, np.float64).ravel()
                    for at in range(0, len(flat), 65536):
                        some = flat[at : at + 65536]
                        where = np.stack(np.unravel_index(np.arange(at, at + len(some)), a.shape or (1,)), 1)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array([member] * len(some)), pa.array(where.tolist(), pa.list_(pa.int64())), pa.array(some)], ["path", "member", "index", "value"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInArrow(run, "path string, member string, index array<bigint>, value double")


def write_stack(voxels: DataFrame, path: str, by: str) -> None:
    """A stack as Parquet, one folder a key."""
    voxels.write.partitionBy(by).parquet(path)


def color_of(label_id) -> Column:
    """A colour that depends on the id alone."""
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(label_id), F.lit(16777216)))), 6, "0"))
