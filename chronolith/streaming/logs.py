"""Streams of log entries: windows, sessions, and idempotent inserts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stages import shared_dir


def entries(spark: SparkSession, sf_dir: str, per_trigger: int | None = None) -> DataFrame:
    """The events as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Entries by kind and window; later ones than `late` behind the newest are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("entries"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "entries", "total")


def sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """Runs of a user's entries with no gap as long as `gap`."""
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("entries")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "entries")


def finished(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now and returns its output as a table of the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        out = batch.write.mode("overwrite")  # a batch that runs again replaces what it wrote
        out.parquet(f"{path}/out" if mode == "complete" else f"{path}/out/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def put_stream(stream: DataFrame, store: str) -> None:
    """Inserts (oid, ...) rows that the store doesn't have yet, once each however often a batch, or the whole call, runs.
    Each call writes under a run of its own, so that none replaces what an earlier one put there."""
    run = uuid.uuid4().hex

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["oid"])
        mine = f"{store}/run={run}/epoch={epoch}"
        try:
            there = spark.read.option("basePath", store).parquet(f"{store}/run=*/epoch=*")
            known = there.where((F.col("run").cast("string") != run) | (F.col("epoch") < epoch)).select("oid")
            new = new.join(known, "oid", "left_anti")
        except Exception as e:  # the first batch finds no store
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("overwrite").parquet(mine)

    spark = stream.sparkSession
    state = f"{shared_dir(spark)}/put-{run}"
    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
