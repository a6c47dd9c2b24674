"""The history relations, derived from the star-schema tables.

Each is a SQL text over those tables that Spark and DuckDB both run, so that a query and its oracle start from
the same rows. `{orders}` and the like stand for the tables. An order is a commit, a customer's orders are a
first-parent line, and every fifth order may merge an earlier order of a neighbour in its group of four
customers, which is a repository. An order's lines are the commit's tree. A user's events are a ref's log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TEXT = "VARCHAR(20)"

SQL: dict[str, str] = {
    "commits": f"""
SELECT sha1(concat('commit|', CAST(o.k AS {_TEXT}))) AS oid, o.k AS seq, o.c AS author, o.g AS repo,
  CASE WHEN o.p1 IS NULL THEN NULL ELSE sha1(concat('commit|', CAST(o.p1 AS {_TEXT}))) END AS parent1,
  CASE WHEN o.p1 IS NULL OR m.p2 IS NULL THEN NULL ELSE sha1(concat('commit|', CAST(m.p2 AS {_TEXT}))) END AS parent2,
  o.d AS committed
FROM (SELECT o_orderkey k, o_custkey c, o_custkey - o_custkey % 4 g, o_orderdate d,
        lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) p1 FROM {{orders}}) o
LEFT JOIN (
  SELECT a.o_orderkey k, b.o_orderkey p2,
    row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate DESC, b.o_orderkey DESC) rn
  FROM {{orders}} a JOIN {{orders}} b
    ON b.o_custkey = a.o_custkey - a.o_custkey % 4 + (a.o_custkey - (a.o_custkey - a.o_custkey % 4) + 1 + a.o_custkey - a.o_custkey % 4) % 4
   AND (b.o_orderdate < a.o_orderdate OR (b.o_orderdate = a.o_orderdate AND b.o_orderkey < a.o_orderkey))
  WHERE a.o_orderkey % 5 = 0) m ON m.k = o.k AND m.rn = 1""",
    "tree_entries": f"""
SELECT sha1(concat('commit|', CAST(l_orderkey AS {_TEXT}))) AS commit_oid,
  concat('d', CAST(l_partkey % 2 AS {_TEXT}), '/p', CAST(l_partkey % 8 AS {_TEXT})) AS path,
  max(sha1(concat_ws('|', CAST(CAST(l_quantity AS BIGINT) AS {_TEXT}), CAST(l_partkey AS {_TEXT})))) AS oid
FROM {{lineitem}} GROUP BY 1, 2""",
    "reflog": f"""
SELECT concat('refs/u/', CAST(user_id AS {_TEXT})) AS ref,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  lag(sha1(CAST(event_id AS {_TEXT}))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_oid,
  sha1(CAST(event_id AS {_TEXT})) AS new_oid, ts, event_type AS message FROM {{events}}""",
    "tags": f"""
SELECT concat('refs/tags/', replace(p_brand, '#', '-'), '/', CAST(p_partkey AS {_TEXT})) AS name,
  sha1(concat_ws('|', 'tag', CAST(p_partkey AS {_TEXT}))) AS oid, 'tag' AS kind FROM {{part}}""",
    "branches": f"""
SELECT concat('refs/heads/', lower(c_mktsegment), '/', CAST(c_custkey AS {_TEXT})) AS name, t.oid, 'branch' AS kind
FROM {{customer}} JOIN (
  SELECT o_custkey, sha1(concat('commit|', CAST(o_orderkey AS {_TEXT}))) AS oid,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM {{orders}}) t
  ON t.o_custkey = c_custkey AND t.rn = 1""",
    "blobs": """
SELECT doc_id, text, source, lang, sha1(text) AS oid, CAST(length(text) AS BIGINT) AS chars FROM {documents}""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation, or a table by its name."""
    if name not in SQL:
        return table(spark, sf_dir, name)
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in SQL[name]}
    return spark.sql(SQL[name], **used)


def oracle(sql: str) -> str:
    """sql with each `@relation` replaced by that relation's definition over the tables."""
    for name, text in SQL.items():
        sql = sql.replace(f"@{name}", "(" + text.format(**{t: t for t in TABLES}) + ")")
    return sql
