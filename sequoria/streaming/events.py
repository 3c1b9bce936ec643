"""Streams over event files, as an extension: windowed counts and first events of a key, run until all files are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequoria.functions.plan import scratch


def stream(spark: SparkSession, path: str, like: str) -> DataFrame:
    """A stream of the Parquet files under a folder or pattern, with the schema of `like`; ts as an instant."""
    return spark.readStream.schema(spark.read.parquet(like).schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total): events of each window; those later than `late` are left out."""
    each = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return each.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def first_events(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Events whose key was not seen within the watermark: the incremental form of keeping first rows."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_all(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all files that are there, then gives its result as a table. A run that is cut off goes on from
    its checkpoint in the shared folder; each batch replaces its own folder, so none counts twice."""
    spark = result.sparkSession
    at = scratch(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    if mode == "complete":  # the last batch holds all
        last = out.agg(F.max("batch")).first()[0]
        out = out.filter(F.col("batch") == last)
    return out.drop("batch")
