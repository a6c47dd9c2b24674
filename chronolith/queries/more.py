"""Further queries: combined changes, path walk, rebase plans, moved lines, recorded resolutions, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import grouping, history, objects
from ..plans.buckets import BY, commits, entries
from ..plans.relations import relation
from ..registry import query
from .graph import CHANGES, changes_of, named

PATCHES = """p AS MATERIALIZED (SELECT commit_oid AS oid, sha1(string_agg(path || '|' || status || '|' || coalesce(old_oid, '') || '|' || coalesce(new_oid, ''), chr(10) ORDER BY path || '|' || status || '|' || coalesce(old_oid, '') || '|' || coalesce(new_oid, ''))) AS patch FROM ch GROUP BY 1)"""


@query("WITH c AS MATERIALIZED (SELECT * FROM @commits x WHERE parent2 IS NOT NULL), t AS MATERIALIZED (SELECT * FROM @tree_entries y), d AS (SELECT oid AS c, unnest([parent1, parent2]) AS p FROM c), q AS (SELECT c, p, path FROM d JOIN t ON commit_oid = c UNION SELECT c, p, path FROM d JOIN t ON commit_oid = p), f AS (SELECT q.*, a.oid AS n, b.oid AS o FROM q LEFT JOIN t a ON a.commit_oid = q.c AND a.path = q.path LEFT JOIN t b ON b.commit_oid = q.p AND b.path = q.path) SELECT c AS commit_oid, path FROM f WHERE n IS DISTINCT FROM o GROUP BY 1, 2 HAVING count(*) = 2")
def combined_diff(spark, sf_dir):
    return named(history.combined_changes(commits(spark, sf_dir)[0], entries(spark, sf_dir), BY), "commit_oid")


@query("SELECT path, count(*) AS objects FROM (SELECT oid, min(path) AS path FROM @tree_entries t GROUP BY 1) GROUP BY 1")
def path_walk(spark, sf_dir):
    return history.path_walk(relation(spark, sf_dir, "tree_entries"))


@query(f"WITH {CHANGES}, {PATCHES} SELECT c.repo AS key, c.oid, patch FROM c JOIN p ON p.oid = c.oid WHERE c.author % 4 <> 0 AND c.parent2 IS NULL AND NOT EXISTS (SELECT 1 FROM c u JOIN p q ON q.oid = u.oid WHERE u.repo = c.repo AND u.author % 4 = 0 AND q.patch = p.patch)")
def rebase_plan(spark, sf_dir):
    """Upstream is the first line of each repository, ours the others."""
    rows, _, changes = changes_of(spark, sf_dir)
    ranges = rows.select("within", F.col("repo").alias("key"), F.when(F.col("author") % 4 == 0, "upstream").otherwise("ours").alias("side"), "oid")
    return named(history.rebase_plan(rows, changes, ranges, BY).where("patch IS NOT NULL"), "oid")


@query("SELECT CAST(author AS VARCHAR) AS author, CASE WHEN seq % 10 = 0 THEN sha1(oid) WHEN seq % 10 = 1 THEN sha1(sha1(oid)) ELSE oid END AS oid FROM @commits c")
def replaced_objects(spark, sf_dir):
    c = relation(spark, sf_dir, "commits")
    once, twice = c.where("seq % 10 = 0"), c.where("seq % 10 = 1")
    table = once.select("oid", F.sha1("oid").alias("by_oid")).unionByName(twice.select("oid", F.sha1("oid").alias("by_oid"))).unionByName(twice.select(F.sha1("oid").alias("oid"), F.sha1(F.sha1("oid")).alias("by_oid")))
    return history.replaced(c.select("oid", F.col("author").cast("string").alias("author")), table)


@query("SELECT user_id, event_type, CASE WHEN b IS NULL THEN 'added' WHEN a IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT user_id, event_type, max(event_id) AS b FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2) FULL JOIN (SELECT user_id, event_type, max(event_id) AS a FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2) USING (user_id, event_type) WHERE a IS DISTINCT FROM b")
def monitor_changes(spark, sf_dir):
    e = relation(spark, sf_dir, "events")
    snap = lambda test: e.where(test).groupBy("user_id", "event_type").agg(F.max("event_id").alias("v"))
    return grouping.snapshot_changes(snap("event_id % 2 = 0"), snap("event_id % 3 = 0"), ["user_id", "event_type"], "v")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'kept ' || least(o_orderpriority, o_orderstatus) || greatest(o_orderpriority, o_orderstatus) END AS resolution FROM orders")
def recorded_resolutions(spark, sf_dir):
    """Even orders conflict in the other direction than recorded, odd ones have no record."""
    o = relation(spark, sf_dir, "orders")
    conflicts = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("x").alias("ours"), F.col("o_orderstatus").alias("theirs"))
    records = o.select(F.col("o_orderstatus").alias("ours"), F.col("o_orderpriority").alias("theirs")).distinct()
    records = records.withColumn("resolution", F.concat(F.lit("kept "), F.least("ours", "theirs"), F.greatest("ours", "theirs")))
    return grouping.recorded_resolutions(conflicts, records)


@query("SELECT l.commits, l.key FROM (SELECT c_mktsegment AS key, count(*) AS commits FROM @commits c JOIN customer ON c_custkey = author GROUP BY 1) l ORDER BY commits DESC, key LIMIT 3")
def shortlog_by_number(spark, sf_dir):
    c = relation(spark, sf_dir, "commits").join(relation(spark, sf_dir, "customer"), F.col("author") == F.col("c_custkey"))
    return grouping.shortlog(c, [F.col("c_mktsegment")]).orderBy(F.desc("commits"), "key").limit(3)


@query("SELECT url, regexp_matches(url, '^https://[^/]*/') AS known FROM (SELECT DISTINCT url FROM pages)")
def url_rules(spark, sf_dir):
    """Each site with a path has a rule for the whole site."""
    urls = relation(spark, sf_dir, "pages").select("url").distinct()
    rules = urls.where(F.col("url").rlike("^https://[^/]*/")).select(F.concat(F.regexp_extract("url", "^(https://[^/]*)", 1), F.lit("/")).alias("prefix"), F.lit("v").alias("value")).distinct()
    return grouping.best_url(urls, rules).select("url", F.col("value").isNotNull().alias("known"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+01:30' AS iso, strftime(ts, '%a, %-d %b %Y %H:%M:%S ') || '+0130' AS rfc FROM (SELECT event_id, date_trunc('second', ts) + INTERVAL 90 MINUTE AS ts FROM events)")
def shown_dates(spark, sf_dir):
    secs, minutes = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000), F.lit(90)
    local = F.timestamp_seconds(secs + minutes * 60)
    zone = text.offset_text(minutes)
    return relation(spark, sf_dir, "events").select("event_id", F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(zone, r"(\d\d)$", ":$1")).alias("iso"), F.concat(F.date_format(local, "EEE, d MMM yyyy HH:mm:ss "), zone).alias("rfc"))


@query("SELECT oid, size FROM (SELECT sha256('large' || CAST(doc_id AS VARCHAR)) AS oid, doc_id * 3 AS size, doc_id FROM documents) WHERE doc_id % 4 <> 0")
def missing_large_objects(spark, sf_dir):
    """Pointers whose large object isn't stored."""
    d = relation(spark, sf_dir, "documents")
    oid = F.sha2(F.encode(F.concat(F.lit("large"), F.col("doc_id").cast("string")), "UTF-8"), 256)
    pointer = F.concat(F.lit("version https://example.org/spec/v1\noid sha256:"), oid, F.lit("\nsize "), (F.col("doc_id") * 3).cast("string"), F.lit("\n"))
    found = objects.large_pointers(d.select(F.col("doc_id").cast("string").alias("oid"), pointer.alias("text")))
    stored = d.where("doc_id % 4 = 0").select(oid.alias("oid"))
    return found.join(stored, "oid", "left_anti").select("oid", "size")


@query()
def moved_lines(spark, sf_dir):
    """Blocks of lines that documents of one source lost to documents of another."""
    rows = grouping.lines(relation(spark, sf_dir, "documents")).withColumnRenamed("doc_id", "file")
    side = F.when(F.col("file") % 2 == 0, "old").otherwise("new")
    return grouping.moved_lines(rows.withColumn("side", side))
