"""Resumable processing: what a run has finished is not repeated by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reclink.sources import scratch


def drain(source: DataFrame, out: str, state: str) -> None:
    """Process all files there are (availableNow) and stop. Batches are written by number, so a batch that a
    lost driver repeats overwrites itself; the checkpoint remembers the files that are done."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    source.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def event_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed into batches, twice (the second run finds nothing new), then added up."""
    folder = scratch.folder(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # One table of the folder: the stream's files are named by a glob, as a stream reads folders.
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("event_type", "value")
    for _ in range(2):
        drain(stream, f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
