"""Tables in buckets by repository: the same closure, and no shuffle where a query follows edges."""

from __future__ import annotations

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chronolith import registry
from chronolith.operators import history, objects, trees
from chronolith.plans import stages
from chronolith.plans.buckets import BY, commits, entries_of, lines_by_commit, shown
from chronolith.plans.relations import relation
from chronolith.plans.stages import staged_by

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_closure_within_buckets(spark):
    rng, rows = random.Random(3), []
    for group in range(7):
        for i in range(25):
            parents = [group * 100 + p for p in rng.sample(range(i), min(i, rng.randint(0, 2)))]
            rows.append((group, group * 100 + i, *(parents + [None] * (2 - len(parents)))))
    rows.append((9, 900, 899, None))  # a parent that isn't stored
    df = spark.createDataFrame(rows, "within bigint, oid bigint, parent1 bigint, parent2 bigint")
    held = staged_by(df.repartition(4, "within"), "t", BY, 4)
    near = history.closure(held, within=BY, buckets=4)
    assert rows_of(near.select("node", "ancestor", "far")) == rows_of(history.closure(df).select("node", "ancestor", "far"))
    start = held.where("oid % 100 = 24")
    walked = history.reachable(history.edges(held, BY), start, within=BY, buckets=4)
    assert rows_of(walked.select("oid")) == rows_of(history.reachable(history.edges(df), df.where("oid % 100 = 24")))


def test_relations_agree(spark):
    got = commits(spark, DATA)[0].select(shown(F.col("oid")).alias("oid"), "seq", "author", "repo", "committed")
    assert rows_of(got) == rows_of(relation(spark, DATA, "commits").select("oid", "seq", "author", "repo", "committed"))
    lines = entries_of(lines_by_commit(spark, DATA)[0], ["commit_oid"])
    assert rows_of(lines.select("path", "oid")) == rows_of(relation(spark, DATA, "tree_entries").select("path", "oid"))


def test_no_shuffle_along_edges(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(keep, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        for name in ("ancestor_counts", "merge_bases", "describe", "name_rev", "bisect", "first_parent_walk", "last_modified", "tree_diff_to_parent", "exact_renames", "rebase_plan"):
            plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning" not in plan, name
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_similarity_of_large_texts(spark):
    line = "".join(f"{i:063d}\n" for i in range(2000))
    blobs = spark.createDataFrame([(1, line), (2, line + "x"), (3, "y")], "id bigint, text string")
    pairs = spark.createDataFrame([(1, 2), (3, 2)], "old_id bigint, new_id bigint")
    assert [(r["old_id"], r["new_id"]) for r in trees.similarity(pairs, blobs).collect()] == [(1, 2)]


def test_prefixes_meet_only_their_own_starts(spark):
    store = spark.createDataFrame([(x,) for x in ("abcd1", "abcd2", "abcd2", "abce", "fff")], "oid string")
    asked = spark.createDataFrame([(x,) for x in ("abcd", "abcd2", "abce", "fff", "00000")], "prefix string")
    got = objects.by_prefix(store, asked)
    assert rows_of(got) == [("00000", 0, None), ("abcd", 2, None), ("abcd2", 1, "abcd2"), ("abce", 1, "abce"), ("fff", 0, None)]
    assert "startswith" not in got._jdf.queryExecution().executedPlan().toString().lower()


def test_rounds_of_the_closure_leave_one_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "shared_dir", lambda _: f"file://{tmp_path}")
    rows = [(i % 3, i, i - 3 if i >= 3 else None, None) for i in range(60)]
    df = spark.createDataFrame(rows, "within bigint, oid bigint, parent1 bigint, parent2 bigint")
    near = history.closure(df, within=BY, buckets=2)
    assert near.count() == 3 * 20 * 21 // 2
    assert len(list(tmp_path.glob("closure*/*.parquet"))) > 0 and len(list(tmp_path.glob("closure*"))) == 1


def test_writes_leave_no_shuffle_files(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f.name for d in local for f in Path(d).rglob("shuffle_*.data")}
    before = files()
    df = spark.range(1000).selectExpr("id % 9 AS within", "id AS oid").repartition(4, "within")
    held = staged_by(df, "t", BY, 4), stages.staged(df, "t")
    for _ in range(100):  # executors are told, not waited for
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert [x.count() for x in held] == [1000, 1000]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"  # an action's plan may run again


def test_buckets_stay_small(spark):
    assert stages.buckets_for(spark, 9_000_000) >= 450


def test_walk_leaves_one_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "shared_dir", lambda _: f"file://{tmp_path}")
    steps = spark.createDataFrame([(i % 3, i, i - 3) for i in range(3, 30)], "within bigint, child bigint, parent bigint")
    start = spark.createDataFrame([(0, 27), (1, 10)], "within bigint, oid bigint")
    assert sorted(r["oid"] for r in history.reachable(steps, start, within=BY, buckets=2).collect()) == sorted([*range(0, 28, 3), *range(1, 11, 3)])
    assert len(list(tmp_path.glob("reached*"))) == 1 and not list(tmp_path.glob("frontier*/*.parquet"))  # the last is empty


def test_parents_agree(spark):
    got = commits(spark, DATA)[0].select("seq", shown(F.col("parent1")), shown(F.col("parent2")))
    assert rows_of(got) == rows_of(relation(spark, DATA, "commits").select("seq", "parent1", "parent2"))


def test_renames_and_rebase_read_the_changes_once(spark):
    rng = random.Random(5)
    rows = {(k, f"{rng.choice('abc')}/{rng.choice('xyz')}{i % 3}"): (rng.choice("AD"), rng.choice("pq")) for k in range(9) for i in range(14)}
    held = spark.createDataFrame([(k, p, s, o if s == "D" else None, o if s == "A" else None) for (k, p), (s, o) in rows.items()], "k bigint, path string, status string, old_oid string, new_oid string")
    want = []
    for k in range(9):
        for oid in "pq":
            gone, came = (sorted(p for (j, p), (s, o) in rows.items() if (j, s, o) == (k, side, oid)) for side in "DA")
            pairs = []
            for base in {p.split("/")[1] for p in gone}:
                pairs += zip([p for p in gone if p.endswith("/" + base)], [p for p in came if p.endswith("/" + base)], strict=False)
            used = {p for pair in pairs for p in pair}
            pairs += zip([p for p in gone if p not in used], [p for p in came if p not in used], strict=False)
            want += [(k, oid, *pair) for pair in pairs]
    got = trees.exact_renames(held, ["k"])
    assert rows_of(got) == sorted(want, key=str)
    assert got._jdf.queryExecution().analyzed().toString().count("LogicalRDD") == 1
    changes = spark.createDataFrame([(1, "a", "M", "x", "y"), (2, "a", "M", "x", "y"), (3, "a", "M", "x", "z"), (5, "a", "M", "x", "w")], "commit_oid bigint, path string, status string, old_oid string, new_oid string")
    ranges = spark.createDataFrame([("r", "upstream", 1), ("r", "ours", 2), ("r", "ours", 3), ("r", "ours", 4), ("r", "ours", 5), ("s", "ours", 2), ("r", "upstream", 6)], "key string, side string, oid bigint")
    lone = spark.createDataFrame([(i, 1 if i == 5 else None) for i in range(7)], "oid bigint, parent2 bigint")
    plan = history.rebase_plan(lone, changes, ranges)
    assert sorted((r["key"], r["oid"]) for r in plan.collect()) == [("r", 3), ("r", 4), ("s", 2)]


def test_rounds_of_the_closure_join_few_rows(spark, monkeypatch):
    """The last rounds joined every pair with every ancestor of its ancestor: 34,848 rows for this line, all its pairs being 2080."""
    joined, put = [], history.staged_by

    def counted(df, *args):
        plan = df._jdf.queryExecution().analyzed().children().head()
        joined.append(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan).count())
        return put(df, *args)

    monkeypatch.setattr(history, "staged_by", counted)
    line = spark.createDataFrame([(0, i, i - 1 if i else None, None) for i in range(64)], "within bigint, oid bigint, parent1 bigint, parent2 bigint")
    far = {(r["node"], r["ancestor"]): r["far"] for r in history.closure(line, within=BY, buckets=2).collect()}
    assert far == {(a, b): a - b for a in range(64) for b in range(a + 1)}
    assert max(joined) <= 2 * len(far)


def test_closure_names_a_cycle_at_once(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 3, None) for i in range(3)], "oid bigint, parent1 bigint, parent2 bigint")
    with pytest.raises(RuntimeError, match="cycle"):
        history.closure(ring)
