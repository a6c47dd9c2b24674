"""Rules for stored commits and trees: problems as rows (oid, id, level)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def problems(rows: DataFrame, rules: Mapping[str, tuple[str, Column]], levels: Mapping[str, str] | None = None, skip: DataFrame | None = None) -> DataFrame:
    """One row for each rule that holds; `levels` overrides severities (ignore drops a rule), `skip` (oid) exempts."""
    levels = levels or {}
    found = [F.when(test, F.struct(F.lit(i).alias("id"), F.lit(levels.get(i, level)).alias("level"))) for i, (level, test) in rules.items() if levels.get(i, level) != "ignore"]
    out = rows.select("oid", F.explode(F.array_compact(F.array(*found))).alias("m")).select("oid", "m.id", "m.level")
    return out if skip is None else out.join(skip.select("oid"), "oid", "left_anti")


def commit_rules() -> dict[str, tuple[str, Column]]:
    author, committer = F.col("author"), F.col("committer")
    return {
        "missingTree": ("error", F.coalesce(F.col("tree"), F.lit("")) == ""),
        "badParentSha1": ("error", F.exists("parents", lambda p: ~p.rlike("^[0-9a-f]{40}([0-9a-f]{24})?$"))),
        "missingAuthor": ("error", author.isNull()),
        "missingEmail": ("error", F.coalesce(author["email"], F.lit("")) == ""),
        "missingNameBeforeEmail": ("error", F.coalesce(author["name"], F.lit("")) == ""),
        "badDate": ("error", F.coalesce(author["when_secs"] < 0, F.lit(False))),
        "badTimezone": ("error", F.abs(author["offset_minutes"]) > 14 * 60),
        "missingCommitter": ("error", committer.isNull()),
        "nulInCommit": ("warn", F.contains("message", F.lit("\x00"))),
        "duplicateParents": ("warn", F.size("parents") != F.size(F.array_distinct("parents"))),
    }


def tree_rules() -> dict[str, tuple[str, Column]]:
    """Over entries (oid of the tree, name, mode, entry_oid)."""
    return {
        "nullSha1": ("warn", F.col("entry_oid").rlike("^0+$")),
        "emptyName": ("warn", F.col("name") == ""),
        "fullPathname": ("warn", F.contains("name", F.lit("/"))),
        "hasDot": ("warn", F.col("name") == "."),
        "hasDotdot": ("warn", F.col("name") == ".."),
        "hasDotgit": ("warn", ~text.safe_path(F.col("name")) & F.lower("name").rlike(r"^(\.git|git~1)[ .]*$")),
        "zeroPaddedFilemode": ("warn", F.col("mode").rlike("^0[0-9]{5}$") & (F.col("mode") != "040000")),
        "badFilemode": ("info", ~F.col("mode").isin("100644", "100755", "120000", "040000", "40000", "160000")),
    }


def tree_order_problems(entries: DataFrame) -> DataFrame:
    """Entries (oid, pos, name, mode) that don't follow the one before, or repeat its name."""
    from pyspark.sql.window import Window

    by = Window.partitionBy("oid").orderBy("pos")
    key = F.encode(F.concat("name", F.when(F.col("mode").isin("040000", "40000"), "/").otherwise("")), "UTF-8")
    rows = entries.withColumn("key", key).withColumn("before", F.lag("key").over(by)).withColumn("name_before", F.lag("name").over(by))
    kind = F.when(F.col("name") == F.col("name_before"), "duplicateEntries").when(F.col("key") < F.col("before"), "treeNotSorted")
    return rows.select("oid", kind.alias("id")).where("id IS NOT NULL").distinct()
