"""Line dedup with levelled sorted runs of line hashes; DataFrame functions only.

Documents come in batches of descending doc_id, so the first batch that shows a key holds its largest
document. A run is a bucketed, sorted table (h1, h2, n_docs, last_doc). Each new batch merge-anti-joins the
runs on the keys that have already reached `min_docs` there (their fate is settled), and adds the rest as
a run of level 0. When a level holds `fan_out` runs they are merged into one of the next level: counts are
summed, the largest document kept. At the end all runs are merged.

Rules for odd input: a null or empty text is one empty line. Rows that share a doc_id count as one document,
and each row is cleaned by itself. A null doc_id counts as one document below every other. Column names
other than doc_id and text are free. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, shuffle_width, staged

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
RUN = "h1 bigint, h2 bigint, n_docs bigint, last_doc bigint"
#: Stands for a null doc_id.
NO_DOC = -(2**63)


def ascii_lower(x: Column) -> Column:
    """lower() is the same as lowering A-Z where all characters are ASCII, and much faster than translate()."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, of_text, pos, h1, h2): lines whose key has min_chars code points at least, with 128 bits of key
    hash. of_text tells apart rows that share a doc_id."""
    key = ascii_lower(F.btrim("line", F.lit(SPACE)))
    return (
        docs.select(F.coalesce("doc_id", F.lit(NO_DOC)).alias("doc"), F.xxhash64("text").alias("of_text"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .where(F.char_length("line") >= min_chars)
        .select("doc", "of_text", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc", "of_text", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )


class Runs:
    """Levelled sorted runs. Each run is an external table in the shared folder, bucketed and sorted by key,
    so that anti-joins with runs are merge joins that shuffle the new batch only."""

    def __init__(self, spark, fan_out: int, min_docs: int):
        self.spark, self.fan_out, self.min_docs = spark, fan_out, min_docs
        self.buckets = shuffle_width(spark)
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, "runs")
        (
            df.repartition(self.buckets, *KEY)
            .write.bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .option("path", self.paths[name])
            .saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fan_out:
            names, self.levels[level] = self.levels[level], []
            self.write(self.merged(names), level + 1)
            self.drop(names)

    def drop(self, names: list[str]) -> None:
        for n in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")

    def merged(self, names: list[str]) -> DataFrame:
        # Read as files: Spark 4.1 takes a union of bucketed scans to be dealt by bucket, and then doesn't bring
        # the same key of two runs together.
        rows = reduce(DataFrame.unionByName, [self.spark.read.schema(RUN).parquet(self.paths[n]) for n in names])
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, n_docs, last_doc). Keys that a run has settled are dropped, the others added."""
        new = batch
        for n in self.names():
            new = new.join(self.spark.table(n).where(F.col("n_docs") >= self.min_docs).select(*KEY), KEY, "left_anti")
        self.write(new, 0)


def repeated_lines(keys: DataFrame, bounds: list, min_docs: int, fan_out: int) -> DataFrame:
    """(h1, h2, last_doc) of the keys found in min_docs documents at least. keys: (doc, h1, h2, batch)."""
    runs = Runs(keys.sparkSession, fan_out, min_docs)
    for b in range(len(bounds) + 1):
        in_doc = keys.where(F.col("batch") == b).groupBy(*KEY, "doc").agg(F.lit(1).alias("one"))
        runs.add(in_doc.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc")))
    return runs.merged(runs.names()).where(F.col("n_docs") >= min_docs).select(*KEY, "last_doc")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fan_out: int = 2) -> DataFrame:
    """doc_id, lines, kept_lines (arrays): lines whose key stands in min_docs documents at least are dropped
    everywhere but in the largest doc_id. The bounds of the batches only steer the work, not the result."""
    docs = docs.select("doc_id", "text")
    at = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx("doc_id", at, 1000)).first()[0] if at else None
    bounds = sorted(set(found or []), reverse=True)
    batch = sum((F.when(F.col("doc") < b, 1).otherwise(0) for b in bounds), F.lit(0))
    keys = staged(line_keys(docs, min_chars).withColumn("batch", batch), "line-keys")
    # Staged, so that both sides of the next join are shuffled and a key of very many lines can be split there.
    hot = staged(repeated_lines(keys, bounds, min_docs, fan_out), "repeated-lines")
    gone = (
        keys.join(hot, KEY)
        .where(F.col("doc") != F.col("last_doc"))
        .groupBy("doc", "of_text")
        .agg(F.collect_set("pos").alias("gone"))
    )
    single = docs.withColumns({"doc": F.coalesce("doc_id", F.lit(NO_DOC)), "of_text": F.xxhash64("text")}).join(gone, ["doc", "of_text"], "left")
    lines = lines_of(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    return single.select("doc_id", lines.alias("lines"), "gone").select(
        "doc_id",
        "lines",
        F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(kept, lambda i: F.get("lines", i))).alias("kept_lines"),
    )
