"""Queries over people, messages and dates, and further graph questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import blame, checks, formatting, grouping, history, objects, trees
from ..plans.buckets import BY, commits, entries, shown
from ..plans.relations import relation
from ..plans.stages import staged_by
from ..registry import query
from .graph import CHANGES, CLOSURE, changes_of, index_of, named, tip_pairs, tips

NOW = 1_800_000_000


def full_commits(spark, sf_dir):
    """Commits with people and messages."""
    c = relation(spark, sf_dir, "commits").join(relation(spark, sf_dir, "orders"), F.col("seq") == F.col("o_orderkey")).join(relation(spark, sf_dir, "customer"), F.col("author") == F.col("c_custkey"))
    secs = F.floor(F.unix_micros(F.col("committed").cast("timestamp")) / 1_000_000)
    person = F.struct(F.col("c_name").alias("name"), F.concat(F.lit("u"), F.col("author").cast("string"), F.lit("@x.org")).alias("email"), secs.alias("when_secs"), ((F.col("author") % 3 - 1) * 90).cast("int").alias("offset_minutes"))
    message = F.concat(F.lit("Change "), "o_orderpriority", F.lit("\nof status "), "o_orderstatus", F.lit("\n\nBody line.\n\nReviewed-by: R "), (F.col("seq") % 5).cast("string"), F.lit("\nRefs:\n  #"), F.col("seq").cast("string"), F.lit("\n"))
    return c.select("oid", F.sha1(F.concat(F.lit("t"), "oid")).alias("tree"), F.array_compact(F.array("parent1", "parent2")).alias("parents"), person.alias("author"), person.alias("committer"), message.alias("message"), "committed", "seq")


@query("SELECT oid, substr(oid, 1, 7) || '|' || substr(sha1('t' || oid), 1, 7) || '|' || coalesce(concat_ws(' ', parent1, parent2), '') || '|' || c_name || ' <u' || CAST(c.author AS VARCHAR) || '@x.org>|' || strftime(committed + to_minutes(CAST((c.author % 3 - 1) * 90 AS INT)), '%Y-%m-%d %H:%M:%S ') || CASE c.author % 3 WHEN 0 THEN '-0130' WHEN 1 THEN '+0000' ELSE '+0130' END || '|Change ' || o_orderpriority || ' of status ' || o_orderstatus || '|Change-' || regexp_replace(o_orderpriority, '[^A-Za-z0-9._]+', '-', 'g') || '-of-status-' || o_orderstatus AS entry FROM @commits c JOIN orders ON o_orderkey = seq JOIN customer ON c_custkey = c.author")
def formatted_commits(spark, sf_dir):
    return formatting.format_commits(full_commits(spark, sf_dir), "%h|%t|%P|%an <%ae>|%ai|%s|%f")


@query("SELECT key, value, count(*) AS n FROM (SELECT unnest([{'key': 'Reviewed-by', 'value': 'R ' || CAST(o_orderkey % 5 AS VARCHAR)}, {'key': 'Refs', 'value': '#' || CAST(o_orderkey AS VARCHAR)}], recursive := true) FROM orders) GROUP BY 1, 2")
def trailers(spark, sf_dir):
    return full_commits(spark, sf_dir).select(F.inline(text.trailers(F.col("message")))).groupBy("key", "value").agg(F.count("*").alias("n"))


@query("SELECT 'R ' || CAST(o_orderkey % 5 AS VARCHAR) AS key, count(*) AS commits FROM orders GROUP BY 1")
def shortlog_by_trailer(spark, sf_dir):
    found = F.filter(text.trailers(F.col("message")), lambda t: t["key"] == "Reviewed-by")
    return grouping.shortlog(full_commits(spark, sf_dir), [F.get(found, F.lit(0))["value"]])


@query("SELECT o_orderkey, CASE WHEN d < 0 THEN 'in the future' WHEN d < 90 THEN CAST(d AS VARCHAR) || ' seconds ago' WHEN mi < 90 THEN CAST(mi AS VARCHAR) || ' minutes ago' WHEN h < 36 THEN CAST(h AS VARCHAR) || ' hours ago' WHEN dy < 14 THEN CAST(dy AS VARCHAR) || ' days ago' WHEN dy < 70 THEN CAST((dy + 3) // 7 AS VARCHAR) || ' weeks ago' WHEN dy < 365 THEN CAST((dy + 15) // 30 AS VARCHAR) || ' months ago' WHEN dy < 1825 THEN CAST(mo // 12 AS VARCHAR) || CASE WHEN mo // 12 = 1 THEN ' year' ELSE ' years' END || CASE WHEN mo % 12 = 0 THEN '' WHEN mo % 12 = 1 THEN ', 1 month' ELSE ', ' || CAST(mo % 12 AS VARCHAR) || ' months' END || ' ago' ELSE CAST((dy + 183) // 365 AS VARCHAR) || ' years ago' END AS ago FROM (SELECT *, (dy * 24 + 365) // 730 AS mo FROM (SELECT *, (h + 12) // 24 AS dy FROM (SELECT *, (mi + 30) // 60 AS h FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey * 7 AS BIGINT) AS d, (CAST(o_orderkey * o_orderkey * 7 AS BIGINT) + 30) // 60 AS mi FROM orders WHERE o_orderkey > 3))))")
def relative_dates(spark, sf_dir):
    return relation(spark, sf_dir, "orders").where("o_orderkey > 3").select("o_orderkey", text.relative_date(F.col("o_orderkey") * F.col("o_orderkey") * 7).alias("ago"))


@query("SELECT l_orderkey, l_linenumber, v, CASE lower(v) WHEN 'yes' THEN true WHEN 'off' THEN false WHEN '2k' THEN true WHEN '0x0' THEN false WHEN '' THEN false END AS as_bool, CASE lower(v) WHEN '2k' THEN 2048 WHEN '0x0' THEN 0 END AS as_int, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, (['Yes', 'OFF', '2k', '0x0', '', 'maybe'])[1 + (l_partkey % 6)::INT] AS v FROM lineitem) GROUP BY 1, 2, 3")
def config_values(spark, sf_dir):
    v = F.get(F.array(*map(F.lit, ["Yes", "OFF", "2k", "0x0", "", "maybe"])), (F.col("l_partkey") % 6).cast("int"))
    rows = relation(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v")).groupBy("l_orderkey", "l_linenumber", "v").agg(F.count("*").alias("n"))
    return rows.select("l_orderkey", "l_linenumber", "v", text.parse_bool(F.col("v")).alias("as_bool"), text.parse_int(F.col("v")).alias("as_int"), "n")


@query("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'Region Office' WHEN c_nationkey < 10 AND c_custkey % 2 = 0 THEN 'Even Desk' ELSE c_name END AS canonical_name FROM customer")
def mailmap(spark, sf_dir):
    people = relation(spark, sf_dir, "customer").select("c_custkey", F.upper("c_name").alias("name0"), F.col("c_name").alias("name"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit("@x.org")).alias("email"), F.col("c_nationkey").alias("k"))
    office = relation(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.lit("Region Office").alias("name"), F.lit("o@x.org").alias("email"), F.lit(None).cast("string").alias("old_name"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit("@X.org")).alias("old_email"))
    desk = people.where("k BETWEEN 5 AND 9 AND c_custkey % 2 = 0").select(F.lit("Even Desk").alias("name"), F.lit("d@x.org").alias("email"), F.col("name0").alias("old_name"), F.col("email").alias("old_email"))
    return grouping.canonical(people, office.unionByName(desk)).select("c_custkey", "canonical_name")


@query(f"WITH {CHANGES}, d AS (SELECT commit_oid, path, old_oid AS oid, row_number() OVER (PARTITION BY commit_oid, old_oid ORDER BY path) AS rn FROM ch WHERE status = 'D'), a AS (SELECT commit_oid, path, new_oid AS oid, row_number() OVER (PARTITION BY commit_oid, new_oid ORDER BY path) AS rn FROM ch WHERE status = 'A') SELECT d.commit_oid, d.oid, d.path AS old_path, a.path AS new_path FROM d JOIN a USING (commit_oid, oid, rn)")
def exact_renames(spark, sf_dir):
    """No base names agree here, so pairs of equal content are made by path."""
    return named(trees.exact_renames(changes_of(spark, sf_dir)[2], [*BY, "commit_oid"]), "commit_oid")


@query("WITH r AS (SELECT 'd' || CAST(l_suppkey % 9 AS VARCHAR) AS old_dir, 'e' || CAST(l_partkey % 4 AS VARCHAR) AS new_dir FROM lineitem), n AS (SELECT old_dir, new_dir, count(*) AS votes FROM r GROUP BY 1, 2), b AS (SELECT old_dir, max(votes) AS votes FROM n GROUP BY 1) SELECT old_dir, CASE WHEN count(*) = 1 THEN min(new_dir) END AS new_dir, votes FROM n JOIN b USING (old_dir, votes) GROUP BY 1, 3")
def directory_renames(spark, sf_dir):
    r = relation(spark, sf_dir, "lineitem").select(F.concat(F.lit("d"), (F.col("l_suppkey") % 9).cast("string"), F.lit("/f")).alias("old_path"), F.concat(F.lit("e"), (F.col("l_partkey") % 4).cast("string"), F.lit("/f")).alias("new_path"))
    return trees.directory_votes(r)


@query(f"""WITH {CLOSURE}, n AS (SELECT author, oid FROM tips WHERE author % 4 = 1), x AS (SELECT DISTINCT ancestor FROM reach JOIN tips ON node = oid WHERE author % 4 = 2),
d AS (SELECT DISTINCT ancestor AS oid FROM reach JOIN n ON node = oid WHERE ancestor NOT IN (SELECT ancestor FROM x)), t AS MATERIALIZED (SELECT * FROM @tree_entries y),
o AS (SELECT 'commit' AS kind, oid FROM d UNION SELECT 'blob', t.oid FROM t JOIN d ON d.oid = t.commit_oid EXCEPT SELECT 'blob', t.oid FROM t JOIN x ON x.ancestor = t.commit_oid)
SELECT kind, count(*) AS objects FROM o GROUP BY 1""")
def object_difference(spark, sf_dir):
    """Objects that some tips reach and others don't, by kind."""
    reach, t, held, buckets = index_of(spark, sf_dir), tips(spark, sf_dir), entries(spark, sf_dir), commits(spark, sf_dir)[1]
    key = F.lit("all").alias("key")
    wanted, had = t.where("author % 4 = 1").select("within", key, "oid"), t.where("author % 4 = 2").select("within", key, "oid")
    new = staged_by(history.walk(reach, wanted, had, BY), "difference", BY, buckets)
    known = had.join(reach.withColumnRenamed("node", "oid"), [*BY, "oid"]).select("within", F.col("ancestor").alias("commit_oid")).distinct()
    # A blob's 20 bytes; one row a blob, with whether any known commit has it.
    of = lambda of_commits, has: held.join(of_commits, [*BY, "commit_oid"]).select(F.unhex("oid").alias("oid"), F.lit(has).alias("has"))
    both = of(new.select("within", F.col("oid").alias("commit_oid")), False).unionByName(of(known, True))
    blobs = both.groupBy("oid").agg(F.max("has").alias("has")).where("NOT has")
    return objects.counts_by_kind(new.select(F.lit("commit").alias("kind"), F.unhex(shown(F.col("oid"))).alias("oid")).unionByName(blobs.select(F.lit("blob").alias("kind"), "oid")))


@query(f"WITH {CLOSURE}, m AS (SELECT a, b, min(base) AS base FROM bases GROUP BY 1, 2 HAVING count(*) = 1) SELECT m.a, m.b, m.base FROM m JOIN c l ON l.oid = m.base JOIN c k ON k.oid = m.b WHERE l.author = k.author")
def fork_points(spark, sf_dir):
    """The log of a line's ref is all commits of the line."""
    log = tips(spark, sf_dir).select("within", "author", F.col("oid").alias("b")).join(commits(spark, sf_dir)[0].select("within", "author", "oid"), ["within", "author"]).select("within", "b", "oid")
    return named(history.fork_points(index_of(spark, sf_dir), tip_pairs(spark, sf_dir), log, BY), "a", "b", "base")


@query(f"WITH {CLOSURE} SELECT DISTINCT t.oid AS tip, r.ancestor AS oid FROM tips t JOIN reach r ON r.node = t.oid JOIN c k ON k.repo = t.repo AND k.seq % 10 = 0 JOIN reach u ON u.node = r.ancestor AND u.ancestor = k.oid")
def ancestry_path(spark, sf_dir):
    """Of each tip's history, the commits that descend from one of the repository's commits with seq % 10 = 0."""
    reach, t = index_of(spark, sf_dir), tips(spark, sf_dir)
    marks = commits(spark, sf_dir)[0].where("seq % 10 = 0 AND repo IS NOT NULL").select("within", F.col("oid").alias("ancestor"))
    above = reach.join(marks, [*BY, "ancestor"]).select("within", F.col("node").alias("oid")).distinct()
    below = t.select("within", F.col("oid").alias("tip")).join(reach.withColumnRenamed("node", "tip"), [*BY, "tip"]).select("within", "tip", F.col("ancestor").alias("oid"))
    return named(below.join(above, [*BY, "oid"], "left_semi").select("within", "tip", "oid"), "tip", "oid")


@query("SELECT oid, 'missingEmail' AS id, 'error' AS level FROM @commits c WHERE author % 50 = 0 UNION ALL SELECT oid, 'duplicateParents', 'info' FROM @commits c WHERE seq % 40 = 0 AND parent1 IS NOT NULL")
def check_commits(spark, sf_dir):
    """Some commits are damaged first; one rule's level is changed."""
    c = full_commits(spark, sf_dir)
    bad = c.withColumn("author", F.when(F.expr("CAST(substring_index(substring(author.email, 2), '@', 1) AS BIGINT) % 50 = 0"), F.col("author").withField("email", F.lit(""))).otherwise(F.col("author")))
    bad = bad.withColumn("parents", F.when(F.col("seq") % 40 == 0, F.concat("parents", "parents")).otherwise(F.col("parents")))
    return checks.problems(bad, checks.commit_rules(), {"duplicateParents": "info"})


@query()
def line_blame(spark, sf_dir):
    """Lines of the newest of documents of a source and language that begin alike, through the earlier ones."""
    from pyspark.sql.window import Window

    d = relation(spark, sf_dir, "documents")
    by = Window.partitionBy("lang", F.substring("text", 1, 12))
    versions = d.select(F.min("doc_id").over(by).alias("file"), F.row_number().over(by.orderBy("doc_id")).cast("bigint").alias("seq"), "text")
    return blame.blame_hunks(blame.line_origins(versions))
