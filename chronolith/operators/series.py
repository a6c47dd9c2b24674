"""Comparing two series of patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .trees import spans


def range_diff(patches: DataFrame, least: int = 24_000) -> DataFrame:
    """patches (key, side, pos, text), side 'old' or 'new'. One row per pair or lone patch of each key: old_pos,
    new_pos, state: '=' for equal texts, '!' for a pair of alike patches, '<' and '>' for lone ones. Equal texts pair
    first, in order; the rest pair where each is the other's best by shared span bytes (x 60000 div the larger size,
    `least` at least). Candidates meet on shared spans, not by all pairs."""
    rows = patches.withColumn("hash", F.sha1("text")).withColumn("rn", F.row_number().over(Window.partitionBy("key", "side", F.sha1("text")).orderBy("pos")))
    old = rows.where("side = 'old'").select("key", "hash", "rn", F.col("pos").alias("old_pos"))
    new = rows.where("side = 'new'").select("key", "hash", "rn", F.col("pos").alias("new_pos"))
    equal = old.join(new, ["key", "hash", "rn"]).select("key", "old_pos", "new_pos", F.lit("=").alias("state"))
    left = old.select("key", "old_pos").join(equal, ["key", "old_pos"], "left_anti")
    right = new.select("key", "new_pos").join(equal, ["key", "new_pos"], "left_anti")
    pieces = spans(patches.select(F.struct("key", "side", "pos").alias("id"), "text")).select("id.*", "bucket", "bytes")
    sizes = patches.select("key", "side", "pos", F.octet_length("text").alias("size"))

    def side(name: str, at: str, alone: DataFrame) -> DataFrame:
        mine = pieces.where(F.col("side") == name).select("key", F.col("pos").alias(at), "bucket", F.col("bytes").alias(f"{name}_bytes"))
        return mine.join(alone, ["key", at], "left_semi")

    common = side("old", "old_pos", left).join(side("new", "new_pos", right), ["key", "bucket"]).groupBy("key", "old_pos", "new_pos").agg(F.sum(F.least("old_bytes", "new_bytes")).alias("common"))
    scored = common
    for name in ("old", "new"):
        scored = scored.join(sizes.where(F.col("side") == name).select("key", F.col("pos").alias(f"{name}_pos"), F.col("size").alias(f"{name}_size")), ["key", f"{name}_pos"])
    scored = scored.withColumn("score", F.expr("common * 60000 div greatest(old_size, new_size)")).where(F.col("score") >= least)
    by = lambda at, other: F.row_number().over(Window.partitionBy("key", at).orderBy(F.desc("score"), other))
    best = scored.withColumn("a", by("old_pos", "new_pos")).withColumn("b", by("new_pos", "old_pos")).where("a = 1 AND b = 1")
    alike = best.select("key", "old_pos", "new_pos", F.lit("!").alias("state"))
    gone = left.join(alike, ["key", "old_pos"], "left_anti").select("key", "old_pos", F.lit(None).cast("int").alias("new_pos"), F.lit("<").alias("state"))
    came = right.join(alike, ["key", "new_pos"], "left_anti").select("key", F.lit(None).cast("int").alias("old_pos"), "new_pos", F.lit(">").alias("state"))
    return equal.unionByName(alike).unionByName(gone).unionByName(came)
