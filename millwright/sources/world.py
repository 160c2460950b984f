"""World data: manifests, array archives, label rasters, placed parts, places and graph shards.

All files are read through Spark's file systems; a file that is not what it says is refused by
name. Arrays are streamed row by row from one archive member, so a task holds one member.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.operators.guards import Refusal, refuse, require_no_orphans, require_one, require_unique
from millwright.sources.rasters import archived
from millwright.sources.tables import SCHEMAS, read_records, read_table


def arrays(spark: SparkSession, path: str, shape: tuple[int, int] | None = None) -> DataFrame:
    """(name, r, c, value) of the two-dimensional arrays in NumPy archives; another shape than the
    one expected is refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b["name"].to_pylist(), b["content"].to_pylist(), strict=True):
                grid = np.load(io.BytesIO(content), allow_pickle=False)
                if grid.ndim != 2 or shape and grid.shape != shape:
                    raise Refusal(f"array {name} of shape {grid.shape}", 1, [str(shape)])
                for r, row in enumerate(grid):
                    yield pa.RecordBatch.from_arrays([pa.array([name.removesuffix(".npy")] * len(row)), pa.array(np.full(len(row), r, np.int32)), pa.array(np.arange(len(row), dtype=np.int32)), pa.array(row.astype(np.float64))], names=["name", "r", "c", "value"])

    return archived(spark, path).mapInArrow(run, "name string, r int, c int, value double")


def world(spark: SparkSession, manifest: str, root: str) -> DataFrame:
    """(layer, r, c, value) of the layers that a manifest names, each of the manifest's shape."""
    stated = require_one(read_records(spark, manifest, "world STRING, rows INT, columns INT, layers MAP<STRING, STRING>"), "one manifest").first()
    out = None
    for layer, file in sorted(stated["layers"].items()):
        rows = arrays(spark, f"{root}/{file}", (stated["rows"], stated["columns"])).select(F.lit(layer).alias("layer"), "r", "c", "value")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise Refusal("manifest without layers", 0, [])
    return out


def labelled(cells: DataFrame, names: DataFrame) -> DataFrame:
    """Cells (r, c, value) with the name of their label; 0 is no label, an unknown one is refused."""
    known = require_unique(names, ["label"], "label named twice")
    rows = cells.select("r", "c", F.col("value").cast("int").alias("label")).where("label <> 0")
    require_no_orphans(rows.select("label"), known, ["label"], "unknown label")
    return rows.join(F.broadcast(known), "label")  # a legend


def variants(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (resolution, tolerance) that a folder partitioned by them offers."""
    return spark.read.parquet(path).select("resolution", "tolerance").distinct().orderBy("resolution", "tolerance")


def membership(spark: SparkSession, path: str, resolution: int, tolerance: int) -> DataFrame:
    """The one variant asked for; only its partition is read, and a missing one is refused."""
    rows = spark.read.parquet(path).where((F.col("resolution") == resolution) & (F.col("tolerance") == tolerance))
    if rows.isEmpty():
        raise Refusal(f"no variant {resolution}/{tolerance}", 0, [])
    return rows.drop("resolution", "tolerance")


def shards_meeting(spark: SparkSession, path: str, rmin: int, rmax: int, cmin: int, cmax: int) -> DataFrame:
    """Edges of the shards whose box (rmin, rmax, cmin, cmax) meets a window. The bounds are columns
    of the files, so their statistics let the reader skip the others."""
    return spark.read.parquet(path).where((F.col("rmax") >= rmin) & (F.col("rmin") <= rmax) & (F.col("cmax") >= cmin) & (F.col("cmin") <= cmax))


#: A placed part: class, east, north, height, turn.
PART = "<Iffff"


def placed(spark: SparkSession, path: str) -> DataFrame:
    """(path, class_id, east, north, elevation, yaw) of files that hold a count and so many placed
    parts, in centimetres; returned in metres, north up. A file of another length is refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                count = int.from_bytes(data[:4], "little")
                if len(data) != 4 + count * struct.calcsize(PART):
                    raise Refusal("placed parts cut short", len(data), [file])
                if count:
                    ids, x, y, z, yaw = (np.array(v) for v in zip(*struct.iter_unpack(PART, data[4:]), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([file] * count), pa.array(ids.astype(np.int64)), pa.array(x / 100), pa.array(-y / 100 + 0.0), pa.array(z / 100), pa.array(yaw)], names=["path", "class_id", "east", "north", "elevation", "yaw"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, class_id long, east double, north double, elevation double, yaw double")


def foundations(parts: DataFrame, class_id: int, height: float) -> DataFrame:
    """(east, north, top) of one class of placed parts."""
    return parts.where(F.col("class_id") == class_id).select("east", "north", (F.col("elevation") + height / 2).alias("top"))


def pois(spark: SparkSession, path: str, kinds: list[str]) -> DataFrame:
    """Places of the given kinds in order of id; an unknown kind or an id that comes twice is
    refused."""
    rows = read_table(spark, path, SCHEMAS["exploration_pois"])
    refuse(spark.createDataFrame([(k,) for k in kinds], "poi_type string").join(rows.select("poi_type").distinct(), "poi_type", "left_anti"), "unknown kind of place", ["poi_type"])
    return require_unique(rows.where(F.col("poi_type").isin(kinds)), ["poi_id"], "place twice").orderBy("poi_id")


def hazards(spark: SparkSession, path: str) -> DataFrame:
    """(poi_id, kind, radius) of JSON lines that name a place's hazards; places without any are left
    out."""
    rows = spark.read.schema("poi_id STRING, hazards ARRAY<STRUCT<kind: STRING, radius_cm: DOUBLE>>").json(path)
    return rows.select("poi_id", F.explode("hazards").alias("h")).select("poi_id", "h.kind", F.round(F.col("h.radius_cm") / 100, 3).alias("radius"))


def foot_facts(rows: DataFrame) -> DataFrame:
    """poi_id and facts (east, north, gap) of each place that could be snapped, else null."""
    facts = F.struct("snap_east", "snap_north", F.round("snap_gap", 3).alias("snap_gap"))
    return rows.select("poi_id", F.when(F.col("status") == "SNAPPED", facts).alias("facts"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes, edges and the edges' points as tables; an edge's path is "r:c;r:c"."""
    require_no_orphans(edges.select(F.explode(F.array("a", "b")).alias("id")), nodes, ["id"], "edge without a node")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.drop("path").write.mode("overwrite").parquet(f"{path}/edges")
    points = edges.select("edge", F.posexplode(F.split("path", ";")).alias("step", "p"))
    at = F.split("p", ":")
    points.select("edge", "step", at[0].cast("int").alias("r"), at[1].cast("int").alias("c")).write.mode("overwrite").parquet(f"{path}/points")


def write_route(route: DataFrame, path: str) -> None:
    """A route (step, east, north, length) in order, and one JSON line that sums it up."""
    route.coalesce(1).orderBy("step").write.mode("overwrite").option("header", True).csv(f"{path}/route")
    summary = route.agg(F.count("*").alias("points"), F.round(F.sum("length"), 3).alias("length"))
    summary.select(F.to_json(F.struct(F.lit("route/1").alias("schema"), "points", "length")).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/summary")


def pinned(rows: DataFrame, stamps: DataFrame) -> DataFrame:
    """(path, state) of files (path, sha256) held against stamps: pinned, changed, missing."""
    both = stamps.select("path", F.col("sha256").alias("pinned")).join(rows.select("path", "sha256"), "path", "left")
    return both.select("path", F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("pinned"), "pinned").otherwise("changed").alias("state"))
