"""Queries that run as streams over the events, with the batch result as oracle; and text comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text_diff, trees
from ..plans.relations import relation
from ..registry import query
from ..streaming import logs


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS entries FROM events GROUP BY 1, 2")
def daily_entries(spark, sf_dir):
    out = logs.finished(logs.windowed_counts(logs.entries(spark, sf_dir), "1 day", "10 days"))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "entries")


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, epoch_us(min(ts)) // 1000000 AS start, count(*) AS entries FROM s GROUP BY user_id, k")
def log_sessions(spark, sf_dir):
    out = logs.finished(logs.sessions(logs.entries(spark, sf_dir), "6 hours", "400 days"))
    return out.select("user_id", F.floor(F.unix_micros("start") / 1_000_000).alias("start"), "entries")


def text_pairs(spark, sf_dir):
    """Documents of one language that begin alike, each with the next by id."""
    d = relation(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    from pyspark.sql.window import Window

    by = Window.partitionBy("lang", F.substring("text", 1, 12)).orderBy("doc_id")
    pairs = d.select(F.col("doc_id").alias("new_id"), F.lag("doc_id").over(by).alias("old_id"), F.col("text").alias("new_text"), F.lag("text").over(by).alias("old_text"))
    return pairs.where("old_id IS NOT NULL")


@query()
def line_numstat(spark, sf_dir):
    return text_diff.on_pairs(text_pairs(spark, sf_dir), text_diff.numstat, ["old_text", "new_text"], "added int, deleted int", ["old_id", "new_id"])


@query()
def unified_diffs(spark, sf_dir):
    return text_diff.on_pairs(text_pairs(spark, sf_dir), text_diff.unified, ["old_text", "new_text"], "patch string", ["old_id", "new_id"])


@query()
def patch_ids(spark, sf_dir):
    return text_diff.on_pairs(text_pairs(spark, sf_dir), text_diff.patch_id, ["old_text", "new_text"], "patch_id string", ["old_id", "new_id"])


@query()
def word_diffs(spark, sf_dir):
    return text_diff.on_pairs(text_pairs(spark, sf_dir), text_diff.word_diff, ["old_text", "new_text"], "words string", ["old_id", "new_id"])


@query()
def line_merges(spark, sf_dir):
    """Each pair merged over their common start."""
    base = text_pairs(spark, sf_dir).withColumn("base", F.substring_index("old_text", "\n", 2))
    return text_diff.on_pairs(base, text_diff.merge_lines, ["base", "old_text", "new_text"], "merged string, conflicts int", ["old_id", "new_id"])


@query()
def rename_similarity(spark, sf_dir):
    pairs = text_pairs(spark, sf_dir).select("old_id", "new_id")
    blobs = relation(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return trees.best_sources(trees.similarity(pairs, blobs))
