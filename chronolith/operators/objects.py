"""The content-addressed store as relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def put(store: DataFrame, new: DataFrame) -> DataFrame:
    """The rows that an idempotent insert adds: one for each oid that the store doesn't have."""
    return new.dropDuplicates(["oid"]).join(store.select("oid"), "oid", "left_anti")


def existing(store: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(store.select("oid"), "oid", "left_semi")


def missing(store: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select("oid").distinct().join(store.select("oid"), "oid", "left_anti")


def union_of_stores(*stores: DataFrame) -> DataFrame:
    """Alternates: an object that several stores hold counts once, from the first of them."""
    ranked = reduce(DataFrame.unionByName, [s.withColumn("store", F.lit(i)) for i, s in enumerate(stores)])
    first = ranked.groupBy("oid").agg(F.min("store").alias("store"))
    return ranked.join(first, ["oid", "store"], "left_semi").dropDuplicates(["oid", "store"])


def by_prefix(store: DataFrame, prefixes: DataFrame, least: int = 4) -> DataFrame:
    """prefixes: (prefix). matches, and the oid where it is the only one. Oids are counted by their starts of each length
    that is asked for, then looked up; prefixes shorter than `least` find nothing."""
    asked = prefixes.distinct()
    lengths = sorted(r[0] for r in asked.select(F.length("prefix")).distinct().collect() if r[0] is not None and r[0] >= least)
    starts = F.array(*[F.when(F.length("oid") >= n, F.substring("oid", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    found = store.select("oid").distinct().select("oid", F.explode(starts).alias("prefix")).where("prefix IS NOT NULL").groupBy("prefix").agg(F.count("*").alias("n"), F.max("oid").alias("any"))
    return asked.join(found, "prefix", "left").select("prefix", F.coalesce("n", F.lit(0)).alias("matches"), F.when(F.col("n") == 1, F.col("any")).alias("oid"))


def verify(store: DataFrame) -> DataFrame:
    """Objects (oid, kind, content) whose stored bytes don't hash to their name."""
    header = F.concat(F.encode(F.concat("kind", F.lit(" "), F.octet_length("content").cast("string")), "UTF-8"), F.lit(b"\x00"))
    return store.withColumn("actual", F.sha1(F.concat(header, "content"))).where("actual <> oid").select("oid", "actual")


def unreachable(store: DataFrame, reached: DataFrame, before=None) -> DataFrame:
    """What a prune removes: stored, not reached, and older than `before` if the store has mtimes."""
    old = store if before is None else store.where(F.col("mtime") < before)
    return old.join(reached.select("oid").distinct(), "oid", "left_anti")


def counts_by_kind(store: DataFrame) -> DataFrame:
    return store.groupBy("kind").agg(F.countDistinct("oid").alias("objects"))


def filtered(objects: DataFrame, spec: str) -> DataFrame:
    """objects: (oid, kind, size, depth) under an object filter: blob:none, blob:limit=n[kmg], tree:depth, object:type=t,
    or combine:a+b."""
    if spec.startswith("combine:"):
        return reduce(filtered, spec[len("combine:") :].split("+"), objects)
    if spec == "blob:none":
        return objects.where("kind <> 'blob'")
    if spec.startswith("blob:limit="):
        number = spec.split("=", 1)[1].lower()
        scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(number[-1:], 1)
        return objects.where((F.col("kind") != "blob") | (F.col("size") < int(number.rstrip("kmg"), 0) * scale))
    if spec.startswith("tree:"):
        return objects.where((F.col("kind").isin("commit", "tag")) | (F.col("depth") < int(spec[5:])))
    if spec.startswith("object:type="):
        return objects.where(F.col("kind") == spec.split("=", 1)[1])
    raise ValueError(f"unknown filter {spec}")


def fsck_messages(blobs: DataFrame) -> DataFrame:
    """Problems of text blobs as (oid, id, level), one row each."""
    found = {
        ("nulInText", "warn"): F.contains("text", F.lit("\x00")),
        ("emptyText", "info"): F.col("text") == "",
        ("missingEnd", "info"): (F.col("text") != "") & ~F.col("text").endswith("\n"),
        ("crlfText", "info"): F.contains("text", F.lit("\r\n")),
        ("badOid", "error"): F.sha1("text") != F.col("oid"),
        ("largeText", "warn"): F.length("text") > 50_000,
    }
    rows = F.array(*[F.when(test, F.struct(F.lit(i).alias("id"), F.lit(level).alias("level"))) for (i, level), test in found.items()])
    return blobs.select("oid", F.explode(F.array_compact(rows)).alias("m")).select("oid", "m.id", "m.level")


def large_pointers(blobs: DataFrame) -> DataFrame:
    p = text.large_pointer(F.col("text"))
    return blobs.select(F.col("oid").alias("blob"), p["oid"].alias("oid"), p["size"].alias("size")).where("oid IS NOT NULL")
