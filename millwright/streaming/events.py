"""Streaming forms over an event table: an extension, as the planning domain is batch only.

The same functions take a streaming or a batch table, so a stream's result can be held against
a batch run. State is bounded by the watermark, or by the number of keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.session import table, work_folder


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are left out."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sums = at.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("total"))
    return sums.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def stock_levels(events: DataFrame) -> DataFrame:
    """Per user a running stock, fed by values and drained by purchases, and its low point:
    state kept from batch to batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        stock, low, n = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind, value in zip(rows["event_type"], rows["value"], strict=True):
            stock += -int(value) if kind == "purchase" else int(value) // 4
            low, n = min(low, stock), n + 1
        state.update((int(stock), int(low), int(n)))
        yield pd.DataFrame({"user_id": [key[0]], "stock": [stock], "low": [low], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, stock long, low long, n long", "stock long, low long, n long", "update", "NoTimeout")


def drained(spark: SparkSession, stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over all there is and gives its last batch's rows, from the shared folder."""
    at = work_folder(spark, name)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{at}/rows")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{at}/rows")


def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events by day and type, through a stream."""
    events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
    return drained(spark, windowed(events), "stream-daily", "complete")


QUERIES = {"stream_daily_counts": stream_daily_counts}

SQL = {"stream_daily_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(floor(value))::BIGINT AS total FROM events GROUP BY 1, 2"}
