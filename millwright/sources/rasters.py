"""Rasters: compressed blobs to long tables and back, archives, and tiles.

A blob holds whole rows of 16-bit numbers, each the difference from its left neighbour, or of
8-bit numbers, compressed with zlib. Decoding streams a blob row by row, so a task holds one
blob and never a table.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def encode_i16(values: np.ndarray) -> bytes:
    """A 2-D array as a blob of row-wise differences, modulo 2^16."""
    wide = values.astype(np.int64)
    return zlib.compress(np.diff(wide, axis=1, prepend=0).astype("<i2").tobytes())


def decode_i16(blob: bytes, width: int) -> np.ndarray:
    """The array again; sums wrap like the differences did."""
    deltas = np.frombuffer(zlib.decompress(blob), "<i2").reshape(-1, width)
    return np.cumsum(deltas, axis=1, dtype=np.int16)


def decode_u8(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), np.uint8).reshape(-1, width)


def raster(blobs: DataFrame, width: int, kind: str = "i16", nodata: int | None = None, stride: int = 1) -> DataFrame:
    """(tile, r, c, value) of blobs (tile, first_row, blob); `nodata` becomes null, and only
    every `stride`-th row and column is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tile, first, blob in zip(*(b[c].to_pylist() for c in ("tile", "first_row", "blob")), strict=True):
                grid = decode_i16(blob, width) if kind == "i16" else decode_u8(blob, width)
                for k, row in enumerate(grid):
                    if (first + k) % stride == 0:
                        v = row[::stride].astype(np.int32)
                        at = np.arange(0, width, stride, dtype=np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array([tile] * len(v)), pa.array(np.full(len(v), first + k, np.int32)), pa.array(at), pa.array(v, mask=None if nodata is None else v == nodata)], names=["tile", "r", "c", "value"])

    return blobs.select(F.col("tile").cast("long"), F.col("first_row").cast("int"), "blob").mapInArrow(run, "tile long, r int, c int, value int")


def blobs(cells: DataFrame, rows_per_tile: int, value: str = "value") -> DataFrame:
    """(tile, first_row, blob) of a long table (r, c, value) whose rows are whole."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        grid = rows.pivot(index="r", columns="c", values=value).to_numpy()
        return pd.DataFrame({"tile": [int(rows["tile"].iloc[0])], "first_row": [int(rows["r"].min())], "blob": [encode_i16(grid)]})

    tiled = cells.withColumn("tile", F.floor(F.col("r") / rows_per_tile).cast("long")).select("tile", "r", "c", value)
    return tiled.groupBy("tile").applyInPandas(run, "tile long, first_row int, blob binary")


def archived(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, content) of the members of ZIP files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if not n.endswith("/")):
                        yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([name]), pa.array([z.read(name)], pa.binary())], names=["archive", "name", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, name string, content binary")


def chunked(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    """(path, body) of files made of zlib chunks, each found by a magic word."""

    @F.pandas_udf("binary")
    def body(contents: pd.Series) -> pd.Series:
        def one(data: bytes) -> bytes:
            out, at = [], data.find(magic)
            while at >= 0:
                d = zlib.decompressobj()
                out.append(d.decompress(data[at + len(magic) :]))
                at = data.find(magic, len(data) - len(d.unused_data))
            return b"".join(out)

        return contents.map(one)

    return spark.read.format("binaryFile").load(path).select("path", body("content").alias("body"))
