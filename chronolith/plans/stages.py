"""Cutting lineage: tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a temporary folder is made and set in local mode; on a cluster, where each
    machine would have its own, it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="chronolith-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


@contextmanager
def no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of a write made within as soon as it ends, not when the driver happens to collect
    garbage. Only for writes: their plan is their own and isn't run again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def staged(df: DataFrame, tag: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    with no_shuffle_left(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def staged_by(df: DataFrame, tag: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """staged, in buckets by `keys`: joins and groupings on these and further columns are then made within the buckets,
    without a shuffle, also from one such table to the next. Without keys it is `staged`."""
    if not keys:
        return staged(df, tag)
    spark = df.sparkSession
    # By default a join on more columns than the buckets' would be shuffled anew.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    name = f"{tag.replace('-', '_')}_{uuid.uuid4().hex}"
    at = f"{shared_dir(spark)}/{name}"
    with no_shuffle_left(spark):
        df.write.format("parquet").bucketBy(buckets, *keys).option("path", at).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def buckets_for(spark: SparkSession, rows: int, rows_each: int = 20_000) -> int:
    """At least as many as a shuffle's partitions; more for many rows, so that a bucket stays small."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))
