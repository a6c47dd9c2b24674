"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a 60-bit hash of doc_id. A bucket (depth, prefix) that holds
more than `max_bytes` splits on the next bit, and only such buckets do, until every shard fits. Each round
looks `step` bits further: the rows of the buckets that are still too large are summed into cells of `step`
more bits, and the cells into every shorter prefix; so a round is two aggregations, whatever the sizes.

Rules for odd input: a null or empty text has 0 bytes. A null doc_id is hashed as the text 'null'. Rows with
one hash can't be told apart: a bucket of one hash is a shard even when it is larger than max_bytes, and is
marked oversize. An empty table has no shards. Column names other than doc_id and text are free.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, staged

BITS = 60


def hash60(doc_id: Column) -> Column:
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, BITS // 4)
    return F.conv(digits, 16, 10).cast("bigint")


def prefix(h: Column, depth: int | Column) -> Column:
    """The first `depth` bits of a 60-bit hash, as a number."""
    return F.call_function("shiftrightunsigned", h, (F.lit(BITS) - depth).cast("int"))


def directory(sizes: DataFrame, max_bytes: int, step: int = 6) -> DataFrame:
    """sizes: (h, bytes), read once a round. Returns shards: depth int, prefix long, shard_bytes, shard_docs,
    oversize boolean."""
    found: list[DataFrame] = []
    active, depth = None, 0
    while depth <= BITS:
        upto = min(depth + step, BITS)
        rows = sizes.withColumn("top", prefix(F.col("h"), depth))
        if active is not None:
            rows = rows.join(active, "top", "left_semi")
        cell = rows.groupBy(prefix(F.col("h"), upto).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("docs"), F.min("h").alias("lo"), F.max("h").alias("hi")
        )
        levels = F.explode(F.sequence(F.lit(depth), F.lit(upto))).alias("depth")
        sums = (
            cell.select("*", levels)
            .groupBy("depth", F.call_function("shiftrightunsigned", F.col("cell"), (F.lit(upto) - F.col("depth")).cast("int")).alias("prefix"))
            .agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        )
        small = F.col("shard_bytes") <= max_bytes
        sums = staged(sums.withColumn("fits", small | (F.col("lo") == F.col("hi")) | (F.col("depth") == BITS)), "shard-level")
        above = sums.where("NOT fits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        fits = sums.where("fits").withColumn("up", F.expr("CASE WHEN depth = 0 THEN NULL ELSE shiftright(prefix, 1) END"))
        # A fitting bucket is a shard if its parent doesn't fit; the topmost one of the round has no parent here.
        first = fits.where(F.col("depth") == depth) if depth == 0 else fits.where(F.lit(False))
        shards = first.unionByName(fits.join(above, ["depth", "up"], "left_semi").select(*fits.columns))
        found.append(shards.select(F.col("depth").cast("int"), "prefix", "shard_bytes", "shard_docs", (~small).alias("oversize")))
        active = sums.where((F.col("depth") == upto) & ~F.col("fits")).select(F.col("prefix").alias("top"))
        if active.isEmpty():
            break
        depth = upto
    return staged(reduce(DataFrame.unionByName, found), "shard-directory")


def shard(docs: DataFrame, max_bytes: int) -> DataFrame:
    """One row per row of docs: doc_id, bytes, depth, prefix, shard (the bits as text), shard_bytes, shard_docs, oversize."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    sizes = staged(docs.select("doc_id", hash60(F.col("doc_id")).alias("h"), size.alias("bytes")), "shard-sizes")
    dirs = directory(sizes, max_bytes)
    return placed(sizes, dirs).select(
        "doc_id",
        "bytes",
        "depth",
        "prefix",
        F.expr("CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END").alias("shard"),
        "shard_bytes",
        "shard_docs",
        "oversize",
    )


def placed(sizes: DataFrame, dirs: DataFrame) -> DataFrame:
    """Joins each row to its one shard: an equi-join for each depth that occurs (60 at most, a handful in
    practice), so that no join is a range join."""
    depths = [r[0] for r in dirs.select("depth").distinct().orderBy("depth").collect()]
    parts = [
        sizes.withColumn("prefix", prefix(F.col("h"), d)).join(dirs.where(F.col("depth") == d), "prefix") for d in depths
    ]
    return reduce(DataFrame.unionByName, parts) if parts else sizes.withColumn("prefix", F.lit(0).cast("bigint")).join(dirs, "prefix")


def write_shards(docs: DataFrame, max_bytes: int) -> str:
    """Writes the rows of docs, all columns, to one folder a shard; returns the path."""
    key = {"__h": hash60(F.col("doc_id"))}
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes")
    dirs = directory(staged(docs.select(hash60(F.col("doc_id")).alias("h"), size), "shard-sizes"), max_bytes)
    depths = [r[0] for r in dirs.select("depth").distinct().orderBy("depth").collect()]
    path = new_path(docs.sparkSession, "shards")
    for d in depths:
        rows = docs.withColumns(key).withColumn("__prefix", prefix(F.col("__h"), d))
        of = dirs.where(F.col("depth") == d).select(F.col("prefix").alias("__prefix"), F.expr(f"lpad(bin(prefix), {d}, '0')").alias("shard"))
        out = rows.join(of, "__prefix").drop("__prefix", "__h")
        out.repartition("shard").write.mode("append").partitionBy("shard").parquet(path)
    return path
