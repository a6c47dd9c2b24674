"""Grouping commits, and computations by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text


def shortlog(commits: DataFrame, groups: Sequence[Column]) -> DataFrame:
    """(key, commits): commits (oid, ...) counted once for each distinct key that any of the groupings gives them."""
    keys = F.explode(F.array_distinct(F.array_compact(F.array(*[F.trim(g) for g in groups])))).alias("key")
    return commits.select("oid", keys).groupBy("key").agg(F.count("*").alias("commits"))


def shortlog_subjects(commits: DataFrame, key: Column, subject: Column, most: int | None = None) -> DataFrame:
    """Subjects of each group, oldest first and `most` of them if that is set; `[PATCH ...]` is stripped, an empty subject
    is <none>."""
    clean = F.regexp_replace(subject, r"^\[PATCH[^\]]*\]\s*", "")
    rows = commits.select(F.trim(key).alias("key"), "committed", "oid", F.when(clean == "", "<none>").otherwise(clean).alias("subject"))
    group = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("committed", "oid", "subject"))).alias("all"))
    subjects = F.col("all.subject")
    return group.select("key", F.size("all").alias("commits"), (subjects if most is None else F.slice(subjects, 1, most)).alias("subjects"))


def canonical(people: DataFrame, mailmap: DataFrame) -> DataFrame:
    """people (name, email) through mailmap (name, email, old_name, old_email): (e-mail, name) first, then e-mail
    alone, without case."""
    low = text.ascii_lower
    full = mailmap.where("old_name IS NOT NULL").select(low(F.col("old_name")).alias("k1"), low(F.col("old_email")).alias("k2"), F.col("name").alias("n1"), F.col("email").alias("e1"))
    mail = mailmap.where("old_name IS NULL").select(low(F.col("old_email")).alias("k3"), F.col("name").alias("n2"), F.col("email").alias("e2"))
    return (
        people.join(full, (low(F.col("name")) == F.col("k1")) & (low(F.col("email")) == F.col("k2")), "left")
        .join(mail, low(F.col("email")) == F.col("k3"), "left")
        .select(*people.columns, F.coalesce("n1", "n2", "name").alias("canonical_name"), F.coalesce("e1", "e2", "email").alias("canonical_email"))
    )


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line), lines from 1."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "line")).select("doc_id", (F.col("at") + 1).alias("line_no"), "line")


def grep(docs: DataFrame, test: Column, before: int = 0, after: int = 0, most: int | None = None) -> DataFrame:
    """Lines that pass the test (a Column over `line`) with context, and the number of their hunk in the document.
    Windows are within one document."""
    by = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines(docs).withColumn("hit", test)
    if most is not None:
        rows = rows.withColumn("hit", F.col("hit") & (F.sum(F.col("hit").cast("int")).over(by) <= most))
    near = F.max(F.col("hit").cast("int")).over(by.rowsBetween(-after, before)) == 1
    shown = rows.withColumn("near", near).where("near")
    new = F.coalesce((F.col("line_no") - F.lag("line_no").over(by) > 1).cast("int"), F.lit(1))
    return shown.withColumn("hunk", F.sum(new).over(by)).select("doc_id", "line_no", "line", "hit", "hunk")


def grep_files(docs: DataFrame, all_match: Sequence[Column], none_match: Sequence[Column] = ()) -> DataFrame:
    """Documents in which each test holds for some line and no excluded test does, with counts of lines."""
    rows = lines(docs)
    tests = [F.bool_or(t) for t in all_match]
    excluded = [~F.bool_or(t) for t in none_match]
    out = rows.groupBy("doc_id").agg(F.count("*").alias("lines"), *[t.alias(f"t{i}") for i, t in enumerate([*tests, *excluded])])
    for i in range(len(tests) + len(excluded)):
        out = out.where(f"t{i}")
    return out.select("doc_id", "lines")


def headings(docs: DataFrame, pattern: str) -> DataFrame:
    """Each line with the nearest earlier line that matches the heading pattern."""
    by = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines(docs).withColumn("heading", F.last(F.when(F.col("line").rlike(pattern), F.col("line")), ignorenulls=True).over(by))


def islands(rows: DataFrame, keys: Sequence[str], position: str, same: Sequence[str]) -> DataFrame:
    """Runs of consecutive positions whose `same` columns agree: first, count."""
    group = Window.partitionBy(*keys, *same).orderBy(position)
    numbered = rows.withColumn("__run", F.col(position) - F.row_number().over(group))
    return numbered.groupBy(*keys, *same, "__run").agg(F.min(position).alias("first"), F.count("*").alias("count")).drop("__run")


def reflog_back(log: DataFrame, n: int) -> DataFrame:
    """ref@{n}: 0 is the newest new value, n the old value of the n-th newest entry."""
    by = Window.partitionBy("ref").orderBy(F.desc("seq"))
    place = max(n, 1)
    return log.withColumn("rn", F.row_number().over(by)).where(F.col("rn") == place).select("ref", (F.col("new_oid") if n == 0 else F.col("old_oid")).alias("oid")).where("oid IS NOT NULL")


def reflog_as_of(log: DataFrame, when: Column) -> DataFrame:
    """The value of each ref at a time: the newest entry not after it."""
    return log.where(F.col("ts") <= when).groupBy("ref").agg(F.max_by("new_oid", "seq").alias("oid"), F.max("seq").alias("seq"))


def reflog_gaps(log: DataFrame) -> DataFrame:
    """Entries whose old value isn't the new value of the one before."""
    by = Window.partitionBy("ref").orderBy("seq")
    before = F.lag("new_oid").over(by)
    return log.withColumn("before", before).where("seq > 1 AND NOT (before <=> old_oid)").select("ref", "seq", "before", "old_oid")


def series(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Ordinal and size of the series that a row is in."""
    group = Window.partitionBy(*keys)
    return rows.withColumn("ordinal", F.row_number().over(group.orderBy(*order))).withColumn("total", F.count("*").over(group))


def geometry(packs: DataFrame, factor: int = 2) -> DataFrame:
    """packs (repo, pack, objects): roll_up marks the smallest packs up to the last that holds fewer than `factor`
    times the objects of all before it."""
    up = Window.partitionBy("repo").orderBy("objects", "pack")
    before = F.coalesce(F.sum("objects").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = packs.withColumn("before", before).withColumn("place", F.row_number().over(up))
    bad = F.max(F.when((F.col("before") > 0) & (F.col("objects") < factor * F.col("before")), F.col("place"))).over(Window.partitionBy("repo"))
    return rows.withColumn("split", F.coalesce(bad, F.lit(0))).select("repo", "pack", "objects", (F.col("place") <= F.col("split")).alias("roll_up"))


def moved_lines(changes: DataFrame, least: int = 2) -> DataFrame:
    """changes: (file, side, line_no, line), side 'old' for deleted and 'new' for added lines. Blocks of at least
    `least` lines that went from one place to another: (old_file, new_file, old_start, new_start, lines). Lines pair
    up by their text without white space where it is unique on both sides; runs on one diagonal are blocks."""
    key = F.regexp_replace("line", r"\s+", "")
    rows = changes.withColumn("key", F.xxhash64(key)).where(key != "")

    def once(side: str) -> DataFrame:
        mine = rows.where(F.col("side") == side).groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("file", "line_no")).alias("at")).where("n = 1")
        return mine.select("key", F.col("at.file").alias(f"{side}_file"), F.col("at.line_no").alias(f"{side}_line"))

    pairs = once("old").join(once("new"), "key").withColumn("diagonal", F.col("new_line") - F.col("old_line"))
    runs = islands(pairs, ["old_file", "new_file"], "old_line", ["diagonal"])
    return runs.where(F.col("count") >= least).select("old_file", "new_file", F.col("first").alias("old_start"), (F.col("first") + F.col("diagonal")).alias("new_start"), F.col("count").alias("lines"))


def recorded_resolutions(conflicts: DataFrame, records: DataFrame) -> DataFrame:
    """conflicts (id, ours, theirs) joined with records (ours, theirs, resolution): the key is the hash of both sides
    in byte order, so either direction of a merge finds the record."""

    def key() -> Column:
        return F.sha1(F.concat_ws("\x00", F.least("ours", "theirs"), F.greatest("ours", "theirs"))).alias("key")

    known = records.select(key(), "resolution").groupBy("key").agg(F.min("resolution").alias("resolution"))
    return conflicts.select("id", key()).join(known, "key", "left").select("id", "resolution")


def snapshot_changes(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """What a monitor reports between two snapshots: added, changed and removed keys."""
    both = before.select(*keys, F.col(value).alias("__b")).join(after.select(*keys, F.col(value).alias("__a")), list(keys), "full_outer")
    kind = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").when(F.col("__a") != F.col("__b"), "changed")
    return both.select(*keys, kind.alias("change")).where("change IS NOT NULL")


def best_url(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url) with the most specific of rules (prefix, value): same scheme and host, longest path that is a whole
    prefix of the url's. An equi-join on scheme and host."""
    parts = lambda c: F.regexp_extract(c, r"^([a-z]+://[^/]*)", 1)
    asked = urls.select("url", parts("url").alias("site"))
    known = rules.select(parts("prefix").alias("site"), F.regexp_replace("prefix", "/+$", "").alias("prefix"), "value")
    fits = (F.col("url") == F.col("prefix")) | F.col("url").startswith(F.concat("prefix", F.lit("/")))
    hits = asked.join(known, "site").where(fits)
    return asked.select("url").join(hits.groupBy("url").agg(F.max_by("value", F.length("prefix")).alias("value")), "url", "left")
