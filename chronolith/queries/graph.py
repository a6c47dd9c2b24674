"""Queries over the commit graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grouping, history, trees
from ..plans.buckets import BY, ORDERS, commits, entries, kept, shown
from ..plans.relations import relation
from ..plans.stages import staged_by
from ..registry import query

def index_of(spark: SparkSession, sf_dir: str, first_parent: bool = False) -> DataFrame:
    """The reachability index of a data set (within, node, ancestor, far), built once a session as a table in the shared
    folder, and again where the commits have changed."""
    rows, buckets = commits(spark, sf_dir)
    return kept(spark, sf_dir, f"reach {first_parent}", {"orders": ORDERS}, lambda _: history.closure(rows, first_parent, within=BY, buckets=buckets))[0]


def tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(within, repo, author, oid, committed) of each line's newest commit."""
    last = F.max_by("oid", F.struct("committed", "seq"))
    return commits(spark, sf_dir)[0].groupBy("within", "repo", "author").agg(last.alias("oid"), F.max("committed").alias("committed"))


def tip_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(within, a, b): pairs of tips of neighbouring lines in a repository."""
    t = tips(spark, sf_dir)
    other = t.select("within", (F.col("author") - 1).alias("author"), "repo", F.col("oid").alias("b"))
    return t.select("within", "repo", "author", F.col("oid").alias("a")).join(other, ["within", "repo", "author"]).select("within", "a", "b")


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(within, name, oid) of the branches."""
    c = relation(spark, sf_dir, "customer").select((F.col("c_custkey") - F.col("c_custkey") % 4).alias("within"), F.col("c_custkey").alias("author"), F.concat(F.lit("refs/heads/"), F.lower("c_mktsegment"), F.lit("/"), F.col("c_custkey").cast("string")).alias("name"))
    return c.join(tips(spark, sf_dir).select("within", "author", "oid"), ["within", "author"]).select("within", "name", "oid")


def named(df: DataFrame, *columns: str) -> DataFrame:
    """df without the bucket's column, with the names of the commits in `columns`."""
    return df.drop(*BY).withColumns({c: shown(F.col(c)) for c in columns})


CLOSURE = """RECURSIVE c AS MATERIALIZED (SELECT * FROM @commits x),
e AS MATERIALIZED (SELECT oid AS child, 0 AS pos, parent1 AS parent FROM c WHERE parent1 IS NOT NULL UNION ALL SELECT oid, 1, parent2 FROM c WHERE parent2 IS NOT NULL),
reach AS (SELECT oid AS node, oid AS ancestor FROM c UNION SELECT r.node, e.parent FROM reach r JOIN e ON e.child = r.ancestor),
tips AS MATERIALIZED (SELECT repo, author, max_by(oid, (committed, seq)) AS oid, max(committed) AS committed FROM c GROUP BY ALL),
pairs AS MATERIALIZED (SELECT x.oid AS a, y.oid AS b FROM tips x JOIN tips y ON y.repo = x.repo AND y.author = x.author + 1),
commons AS MATERIALIZED (SELECT a, b, x.ancestor AS base FROM pairs JOIN reach x ON x.node = a JOIN reach y ON y.node = b AND y.ancestor = x.ancestor),
bases AS MATERIALIZED (SELECT * FROM commons k WHERE NOT EXISTS (SELECT 1 FROM commons o JOIN reach r ON r.node = o.base AND r.ancestor = k.base AND o.base <> k.base WHERE o.a = k.a AND o.b = k.b))"""


@query("SELECT c_mktsegment || '/' || CAST(author AS VARCHAR) AS key, count(*) AS commits FROM @commits c JOIN customer ON c_custkey = author GROUP BY 1")
def shortlog_by_author(spark, sf_dir):
    commits = relation(spark, sf_dir, "commits").join(relation(spark, sf_dir, "customer"), F.col("author") == F.col("c_custkey"))
    return grouping.shortlog(commits, [F.concat_ws("/", "c_mktsegment", F.col("author").cast("string"))])


@query("SELECT k AS key, count(*) AS commits FROM (SELECT DISTINCT oid, unnest([CAST(author AS VARCHAR), CAST(repo AS VARCHAR), strftime(committed, '%Y-%m')]) AS k FROM @commits c) GROUP BY 1")
def shortlog_by_several_keys(spark, sf_dir):
    keys = [F.col("author").cast("string"), F.col("repo").cast("string"), F.date_format("committed", "yyyy-MM")]
    return grouping.shortlog(relation(spark, sf_dir, "commits"), keys)


@query("SELECT CAST(author AS VARCHAR) AS key, count(*)::INT AS commits, string_agg(o_orderpriority, ',' ORDER BY committed, oid) AS subjects FROM @commits c JOIN orders ON o_orderkey = seq GROUP BY 1")
def shortlog_subjects(spark, sf_dir):
    commits = relation(spark, sf_dir, "commits").join(relation(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("seq"))
    out = grouping.shortlog_subjects(commits, F.col("author").cast("string"), F.concat(F.lit("[PATCH 1/2] "), "o_orderpriority"))
    return out.withColumn("subjects", F.array_join("subjects", ","))


@query(f"WITH {CLOSURE} SELECT node AS oid, count(*) AS ancestors FROM reach GROUP BY 1")
def ancestor_counts(spark, sf_dir):
    return named(index_of(spark, sf_dir).groupBy("within", F.col("node").alias("oid")).agg(F.count("*").alias("ancestors")), "oid")


@query(f"""WITH {CLOSURE}, lv AS (SELECT oid, 1 AS g FROM c WHERE parent1 IS NULL UNION SELECT e.child, g + 1 FROM lv JOIN e ON e.parent = lv.oid)
SELECT oid, max(g)::BIGINT AS generation FROM lv GROUP BY 1""")
def generation_numbers(spark, sf_dir):
    return named(history.generations(index_of(spark, sf_dir), BY), "oid")


@query(f"WITH {CLOSURE} SELECT a, b, base FROM bases")
def merge_bases(spark, sf_dir):
    return named(history.merge_bases(index_of(spark, sf_dir), tip_pairs(spark, sf_dir), BY), "a", "b", "base")


@query(f"""WITH {CLOSURE}, n AS (SELECT node, count(*) AS n FROM reach GROUP BY 1), k AS (SELECT a, b, count(*) AS k FROM commons GROUP BY 1, 2)
SELECT a, b, x.n - coalesce(k, 0) AS ahead, y.n - coalesce(k, 0) AS behind FROM pairs LEFT JOIN k USING (a, b) JOIN n x ON x.node = a JOIN n y ON y.node = b""")
def ahead_behind(spark, sf_dir):
    return named(history.ahead_behind(index_of(spark, sf_dir), tip_pairs(spark, sf_dir), BY), "a", "b")


@query(f"WITH {CLOSURE} SELECT a, b, EXISTS (SELECT 1 FROM reach WHERE node = b AND ancestor = a) AS is_ancestor FROM (SELECT DISTINCT base AS a, a AS b FROM bases UNION SELECT a, b FROM pairs)")
def is_ancestor(spark, sf_dir):
    reach, pairs = index_of(spark, sf_dir), tip_pairs(spark, sf_dir)
    buckets = commits(spark, sf_dir)[1]
    bases = history.merge_bases(reach, pairs, BY).select("within", F.col("base").alias("a"), F.col("a").alias("b"))
    asked = staged_by(bases.unionByName(pairs).repartition(buckets, *BY), "ancestor-pairs", BY, buckets)
    return named(history.is_ancestor(reach, asked.distinct(), BY), "a", "b")


@query(f"WITH {CLOSURE} SELECT DISTINCT CAST(p.author AS VARCHAR) AS key, r.ancestor AS oid FROM tips p JOIN reach r ON r.node = p.oid WHERE NOT EXISTS (SELECT 1 FROM tips q JOIN reach s ON s.node = q.oid WHERE q.author = p.author - 1 AND q.repo = p.repo AND s.ancestor = r.ancestor)")
def revision_range(spark, sf_dir):
    """A..B of each line against the line before it."""
    t = tips(spark, sf_dir)
    include = t.select("within", F.col("author").cast("string").alias("key"), "oid")
    exclude = t.select("within", (F.col("author") + 1).alias("next"), "oid", "repo")
    exclude = exclude.join(t.select("within", F.col("author").alias("next"), "repo"), ["within", "next", "repo"], "left_semi")
    return named(history.walk(index_of(spark, sf_dir), include, exclude.select("within", F.col("next").cast("string").alias("key"), "oid"), BY), "oid")


@query(f"WITH {CLOSURE} SELECT r.name FROM @branches r WHERE EXISTS (SELECT 1 FROM reach JOIN c ON c.oid = ancestor WHERE node = r.oid AND c.seq % 100 = 0)")
def refs_that_contain(spark, sf_dir):
    wanted = commits(spark, sf_dir)[0].where("seq % 100 = 0")
    return history.refs_containing(index_of(spark, sf_dir), branches(spark, sf_dir), wanted, BY).select("name")


@query(f"WITH {CLOSURE} SELECT r.name FROM @branches r WHERE EXISTS (SELECT 1 FROM reach JOIN tips t ON t.oid = node WHERE ancestor = r.oid AND t.author % 4 = 1)")
def refs_merged_into(spark, sf_dir):
    into = tips(spark, sf_dir).where("author % 4 = 1")
    return history.refs_merged(index_of(spark, sf_dir), branches(spark, sf_dir), into, BY).select("name")


NAMES = "names AS MATERIALIZED (SELECT 'v' || CAST(seq AS VARCHAR) AS name, oid, committed FROM c WHERE seq % 7 = 0)"


def names_of(rows: DataFrame) -> DataFrame:
    return rows.where("seq % 7 = 0").select("within", F.concat(F.lit("v"), F.col("seq").cast("string")).alias("name"), "oid", "committed")


@query(f"""WITH {CLOSURE}, {NAMES}, n AS (SELECT node, count(*) AS n FROM reach GROUP BY 1),
h AS (SELECT t.oid AS node, k.name, k.oid AS at, row_number() OVER (PARTITION BY t.oid ORDER BY k.committed DESC, k.name) AS rank FROM tips t JOIN reach r ON r.node = t.oid JOIN names k ON k.oid = r.ancestor),
d AS (SELECT h.node, h.name, rank, x.n - y.n AS depth FROM h JOIN n x ON x.node = h.node JOIN n y ON y.node = h.at WHERE rank <= 10),
f AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, rank) AS best FROM d)
SELECT node AS oid, name, depth, CASE WHEN depth = 0 THEN name ELSE name || '-' || CAST(depth AS VARCHAR) || '-g' || substr(node, 1, 7) END AS description FROM f WHERE best = 1""")
def describe(spark, sf_dir):
    names = names_of(commits(spark, sf_dir)[0])
    return named(history.describe(index_of(spark, sf_dir), tips(spark, sf_dir), names, within=BY, shown=shown), "oid")


@query(f"""WITH {CLOSURE}, {NAMES}, p AS (SELECT oid AS node, oid AS ancestor, 0 AS far FROM c UNION SELECT p.node, e.parent, far + 1 FROM p JOIN e ON e.child = p.ancestor),
m AS (SELECT node, ancestor, max(far) AS far FROM p GROUP BY 1, 2),
w AS (SELECT ancestor, far, name, row_number() OVER (PARTITION BY ancestor ORDER BY far, name) AS rn FROM m JOIN names k ON k.oid = m.node)
SELECT ancestor AS oid, name, far::BIGINT AS distance FROM w WHERE rn = 1""")
def name_rev(spark, sf_dir):
    return named(history.nearest_name(index_of(spark, sf_dir), names_of(commits(spark, sf_dir)[0]), BY), "oid")


@query(f"""WITH {CLOSURE}, s AS MATERIALIZED (SELECT DISTINCT p.repo AS key, r.ancestor AS oid FROM tips p JOIN reach r ON r.node = p.oid WHERE p.author % 4 <> 0
  EXCEPT SELECT DISTINCT p.repo, r.ancestor FROM tips p JOIN reach r ON r.node = p.oid WHERE p.author % 4 = 0),
w AS (SELECT s.key, s.oid, count(*) AS weight FROM s JOIN reach r ON r.node = s.oid JOIN s i ON i.key = s.key AND i.oid = r.ancestor GROUP BY 1, 2),
n AS (SELECT key, count(*) AS commits FROM s GROUP BY 1),
f AS (SELECT *, row_number() OVER (PARTITION BY w.key ORDER BY least(weight, commits - weight) DESC, w.oid) AS rn FROM w JOIN n USING (key))
SELECT key, oid, weight, commits FROM f WHERE rn = 1""")
def bisect(spark, sf_dir):
    t = tips(spark, sf_dir).select("within", F.col("repo").alias("key"), "author", "oid")
    bad, good = t.where("author % 4 <> 0").drop("author"), t.where("author % 4 = 0").drop("author")
    return named(history.bisect(index_of(spark, sf_dir), bad, good, BY, commits(spark, sf_dir)[1], shown), "oid")


@query("SELECT oid AS child, parent1 AS parent FROM @commits c WHERE parent1 NOT IN (SELECT oid FROM @commits d WHERE d.seq % 3 <> 0) AND seq % 3 <> 0 UNION ALL SELECT oid, parent2 FROM @commits c WHERE parent2 NOT IN (SELECT oid FROM @commits d WHERE d.seq % 3 <> 0) AND seq % 3 <> 0")
def connectivity(spark, sf_dir):
    """Missing parents in a store that lost every third commit."""
    return history.dangling(relation(spark, sf_dir, "commits").where("seq % 3 <> 0")).select("child", "parent")


@query("WITH RECURSIVE c AS MATERIALIZED (SELECT * FROM @commits x), t AS (SELECT author, max_by(oid, (committed, seq)) AS tip FROM c GROUP BY 1), w AS (SELECT author, tip AS oid, 0 AS back FROM t UNION ALL SELECT w.author, c.parent1, back + 1 FROM w JOIN c ON c.oid = w.oid WHERE c.parent1 IS NOT NULL) SELECT author, oid, back::BIGINT AS back FROM w")
def first_parent_walk(spark, sf_dir):
    t = tips(spark, sf_dir).select("within", "author", F.col("oid").alias("node"))
    return named(t.join(index_of(spark, sf_dir, True), ["within", "node"]).select("within", "author", F.col("ancestor").alias("oid"), F.col("far").alias("back")), "oid")


@query("WITH RECURSIVE c AS MATERIALIZED (SELECT oid, CASE WHEN month(committed) = 1 THEN NULL ELSE parent1 END AS parent1, CASE WHEN month(committed) = 1 THEN NULL ELSE parent2 END AS parent2, seq FROM @commits x), e AS (SELECT oid AS child, parent1 AS parent FROM c WHERE parent1 IS NOT NULL UNION ALL SELECT oid, parent2 FROM c WHERE parent2 IS NOT NULL), r AS (SELECT oid FROM c WHERE seq % 500 = 0 UNION SELECT e.parent FROM r JOIN e ON e.child = r.oid) SELECT oid FROM r")
def shallow_walk(spark, sf_dir):
    """What some commits reach when those of January are a shallow boundary; walked by frontier."""
    rows, buckets = commits(spark, sf_dir)
    cut = history.shallow(rows, rows.where(F.month("committed") == 1), BY)
    steps = staged_by(history.edges(cut, BY), "steps", BY, buckets)
    return named(history.reachable(steps, cut.where("seq % 500 = 0"), within=BY, buckets=buckets), "oid")


CHANGES = """c AS MATERIALIZED (SELECT * FROM @commits x), t AS MATERIALIZED (SELECT * FROM @tree_entries y),
o AS (SELECT c.oid AS commit_oid, t.path, t.oid AS old_oid FROM c JOIN t ON t.commit_oid = c.parent1),
ch AS MATERIALIZED (SELECT coalesce(n.commit_oid, o.commit_oid) AS commit_oid, coalesce(n.path, o.path) AS path, CASE WHEN o.old_oid IS NULL THEN 'A' WHEN n.oid IS NULL THEN 'D' ELSE 'M' END AS status, old_oid, n.oid AS new_oid
  FROM (SELECT t.* FROM t JOIN c ON c.oid = t.commit_oid) n FULL JOIN o ON o.commit_oid = n.commit_oid AND o.path = n.path WHERE o.old_oid IS DISTINCT FROM n.oid)"""


def changes_of(spark, sf_dir):
    """Commits, tree entries and changes within a bucket; see plans.buckets."""
    rows, trees_ = commits(spark, sf_dir)[0], entries(spark, sf_dir)
    return rows, trees_, history.path_changes(rows, trees_, BY)


@query(f"WITH {CHANGES} SELECT * FROM ch")
def tree_diff_to_parent(spark, sf_dir):
    return named(changes_of(spark, sf_dir)[2], "commit_oid")


@query(f"WITH RECURSIVE {CHANGES}, l AS (SELECT author, max_by(oid, (committed, seq)) AS tip FROM c GROUP BY 1), w AS (SELECT tip, tip AS oid, 0 AS back FROM l UNION ALL SELECT tip, c.parent1, back + 1 FROM w JOIN c ON c.oid = w.oid WHERE c.parent1 IS NOT NULL), m AS (SELECT tip, ch.path, ch.commit_oid, back, row_number() OVER (PARTITION BY tip, ch.path ORDER BY back) AS rn FROM w JOIN ch ON ch.commit_oid = w.oid) SELECT m.tip, m.path, m.commit_oid, back::BIGINT AS back FROM m JOIN t ON t.commit_oid = m.tip AND t.path = m.path WHERE rn = 1")
def last_modified(spark, sf_dir):
    _, held, changes = changes_of(spark, sf_dir)
    return named(history.last_modified(index_of(spark, sf_dir, True), tips(spark, sf_dir), held, changes, BY), "tip", "commit_oid")


@query(f"WITH {CHANGES} SELECT commit_oid, path FROM ch WHERE path LIKE 'd1/%' AND status <> 'A'")
def path_limited_history(spark, sf_dir):
    from ..functions import globs

    changes = changes_of(spark, sf_dir)[2]
    return changes.where(globs.pathspec(F.col("path"), ["d1/", ":(exclude)d0"]) & (F.col("status") != "A")).select(shown(F.col("commit_oid")).alias("commit_oid"), "path")


@query(f"WITH {CHANGES}, g AS (SELECT commit_oid, path AS old_path, old_oid AS oid, regexp_extract(path, '[^/]*$') AS base FROM ch WHERE status = 'D'), k AS (SELECT commit_oid, path AS new_path, new_oid AS oid, regexp_extract(path, '[^/]*$') AS base FROM ch WHERE status = 'A'), gu AS (SELECT commit_oid, base, min(old_path) AS old_path FROM g GROUP BY 1, 2 HAVING count(*) = 1), ku AS (SELECT commit_oid, base, min(new_path) AS new_path FROM k GROUP BY 1, 2 HAVING count(*) = 1) SELECT * FROM gu JOIN ku USING (commit_oid, base)")
def basename_renames(spark, sf_dir):
    return named(trees.basename_candidates(changes_of(spark, sf_dir)[2], [*BY, "commit_oid"]), "commit_oid")


@query(f"""WITH {CLOSURE}, t AS MATERIALIZED (SELECT * FROM @tree_entries y), p AS (SELECT a, b, min(base) AS base FROM bases GROUP BY 1, 2),
tb AS (SELECT a, path, oid FROM p JOIN t ON t.commit_oid = p.base), ta AS (SELECT a, path, oid FROM p JOIN t ON t.commit_oid = p.a), tt AS (SELECT a, path, oid FROM p JOIN t ON t.commit_oid = p.b),
j AS (SELECT a, path, tb.oid AS b, ta.oid AS o, tt.oid AS t FROM tb FULL JOIN ta USING (a, path) FULL JOIN tt USING (a, path))
SELECT a, path, CASE WHEN o IS NOT DISTINCT FROM t THEN o WHEN o IS NOT DISTINCT FROM b THEN t WHEN t IS NOT DISTINCT FROM b THEN o END AS oid,
  CASE WHEN o IS NOT DISTINCT FROM t OR o IS NOT DISTINCT FROM b OR t IS NOT DISTINCT FROM b THEN NULL WHEN b IS NULL THEN 'both_added' WHEN o IS NULL OR t IS NULL THEN 'modify_delete' ELSE 'both_modified' END AS conflict FROM j""")
def three_way_merge(spark, sf_dir):
    """Merges the trees of neighbouring tips over their merge base (the least by name)."""
    reach, held, buckets = index_of(spark, sf_dir), entries(spark, sf_dir), commits(spark, sf_dir)[1]
    bases = history.merge_bases(reach, tip_pairs(spark, sf_dir), BY)
    one = staged_by(bases.groupBy("within", "a", "b").agg(F.min_by("base", shown(F.col("base"))).alias("base")), "merge-pairs", BY, buckets)

    def side(column: str) -> DataFrame:
        return one.select("within", "a", F.col(column).alias("commit_oid")).join(held, ["within", "commit_oid"]).select("within", "a", "path", "oid")

    return named(trees.three_way(side("base"), side("a"), side("b"), [*BY, "a"]), "a")
