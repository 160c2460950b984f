"""Reference tables from CSV and JSON under explicit schemas, with named refusals.

Nothing is inferred: a table states its columns, a missing table or column is refused, and a
value that does not fit its type is refused with its row. Readers and writers go through
Spark's file systems only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from millwright.operators.guards import Refusal, refuse

#: The columns of the planning tables, as DDL.
SCHEMAS = {
    "recipes": "recipe_id STRING, display_name STRING, is_alternate BOOLEAN, manufacturing_duration_sec DOUBLE, game_build_id STRING",
    "recipe_io": "recipe_id STRING, direction STRING, item_id STRING, rate_per_min DOUBLE, amount_per_cycle DOUBLE, unit STRING",
    "items": "item_id STRING, display_name STRING, form STRING, category STRING, cached_stack_size INT, sink_points STRING",
    "recipe_producers": "recipe_id STRING, producer_class STRING, producer_name STRING, game_build_id STRING",
    "recipe_variable_power": "recipe_id STRING, producer_class STRING, power_min_mw DOUBLE, power_max_mw DOUBLE, power_mean_mw DOUBLE",
    "extraction_rates": "extractor_class STRING, purity STRING, nominal_rate_min DOUBLE, max_250_rate_min DOUBLE, unit STRING",
    "extraction_buildings": "extractor_class STRING, base_power_mw DOUBLE, power_exponent DOUBLE",
    "generator_fuels": "generator_class STRING, fuel_item_id STRING, energy_mj_per_unit DOUBLE, burn_rate_per_min DOUBLE, power_production_mw DOUBLE",
    "power_buildings": "generator_class STRING, power_model STRING, power_production_mw DOUBLE",
    "logistics_capabilities": "capability_id STRING, capability_type STRING, mark STRING, capacity_per_min DOUBLE, unit STRING, unlock STRING",
    "project_assembly_requirements": "phase INT, phase_name STRING, item_name STRING, quantity_default_1x DOUBLE, delivery_unlocks STRING",
    "schematics": "schematic_id STRING, display_name STRING, schematic_type STRING, tech_tier INT",
    "schematic_recipe_unlocks": "schematic_id STRING, recipe_id STRING",
    "schematic_costs": "schematic_id STRING, item_id STRING, amount DOUBLE",
    "building_recipes": "recipe_id STRING, display_name STRING, building_class STRING",
    "world_resource_sockets": "socket_id STRING, source_kind STRING, east_m DOUBLE, north_m DOUBLE, elevation_m DOUBLE",
    "resource_extraction_map": "item_id STRING, display_name STRING, form STRING, extractor_class STRING, extractor_name STRING, requires_activator BOOLEAN",
    "progression_clusters": "progression_cluster_id STRING, display_name STRING, sort_order INT, notes STRING",
    "alternate_recipe_unlocks": "recipe_id STRING, recipe_name STRING, progression_cluster_id STRING, eligibility_type STRING",
    "exploration_pois": "poi_id STRING, poi_type STRING, source_object_id STRING, source_cell STRING, east_m DOUBLE, north_m DOUBLE, elevation_m DOUBLE",
    "resource_assignments": "world_config_id STRING, socket_id STRING, resource_id STRING, purity STRING",
}


def read_table(spark: SparkSession, path: str, schema: str, ordered: bool = False) -> DataFrame:
    """A CSV table with a header, its columns in any order; others are left out. Empty fields
    are nulls. With `ordered`, a column `row_no` rises with
    the order of the rows."""
    want = T.StructType.fromDDL(schema)
    try:
        raw = spark.read.option("header", True).option("mode", "FAILFAST").option("nullValue", "").csv(path)
    except AnalysisException as e:
        raise Refusal(f"missing table {path}", 1, []) from e
    missing = [f.name for f in want if f.name not in raw.columns]
    if missing:
        raise Refusal(f"missing columns in {path}", len(missing), missing)
    if ordered:
        raw = raw.withColumn("row_no", F.monotonically_increasing_id())
    bad = None
    for f in want:
        fails = F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()
        bad = fails if bad is None else bad | fails
    refuse(raw.where(bad), f"values of another type in {path}", [want[0].name])
    out = raw.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in want), *(["row_no"] if ordered else []))
    return out


def read_records(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """JSON documents, one a file, in any encoding; a document with unknown or missing keys is
    refused."""
    text = spark.read.format("binaryFile").load(path).select("path", F.decode("content", encoding).alias("t"))
    text = text.withColumn("t", F.regexp_replace("t", "^﻿", ""))
    keys = sorted(f.name for f in T.StructType.fromDDL(schema))
    have = F.array_sort(F.json_object_keys("t"))
    refuse(text.where(have.isNull() | (have != F.array(*(F.lit(k) for k in keys)))), "keys of another record", ["path"])
    return text.select("path", F.from_json("t", schema).alias("r")).select("path", "r.*")


def parsed_amounts(text: str) -> Column:
    """Pairs out of a nested text like ((ItemClass="…Desc_X_C",Amount=3),…) as an array of
    (item, amount)."""
    c = F.col(text)
    items = F.regexp_extract_all(c, F.lit(r"([A-Za-z]+_[A-Za-z0-9_]+_C)"), 1)
    amounts = F.regexp_extract_all(c, F.lit(r"Amount=(\d+)"), 1)
    return F.transform(F.arrays_zip(items.alias("item"), amounts.alias("amount")), lambda p: F.struct(p["item"].alias("item"), p["amount"].cast("long").alias("amount")))


def write_table(rows: DataFrame, path: str, order: list[str]) -> None:
    """CSV in order of the key columns, lines ended by a line feed."""
    rows.orderBy(*order).write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def write_record(rows: DataFrame, path: str) -> None:
    """Rows as JSON documents with sorted keys, one a line; equal input gives equal bytes."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).orderBy("value").write.mode("overwrite").text(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a path, text line ends as line feeds."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    plain = F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n", "\n")
    return files.select("path", F.length("content").alias("bytes"), F.sha2(F.encode(plain, "ISO-8859-1"), 256).alias("sha256"))
