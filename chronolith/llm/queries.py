"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, line_dedup, minhash, mixing, sharding, substrings, token_files, topk, warc
from .common import table

SHARD_BYTES = 8 << 20


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where(F.col("vec_id") % 20 == 0), vectors, k=20, every_row=True)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_tokens(table(spark, sf_dir, "documents"))
    return token_files.read_tokens(spark, path)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("kept_lines")).cast("bigint").alias("n_dropped"),
        F.sha2(F.array_join("kept_lines", "\n"), 256).alias("kept_sha256"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(table(spark, sf_dir, "pages"))
    out = warc.read_archive(spark, path)
    return out.select("page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", "refers_to")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)
    return out.select("doc_id", "bytes", "depth", "prefix", "shard_bytes", "shard_docs", "oversize")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_substrings, op3_topk, op4_token_files, op5_line_dedup, op6_mixing, op7_language, op8_warc, op9_minhash, op10_sharding)}

SQL = {
    "op3_topk": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         list_sum(list_transform(list_zip(q.c, d.c), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::BIGINT AS score
  FROM v q JOIN v d ON d.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op5_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, pos, line, last_doc IS NOT NULL AND doc_id <> last_doc AS gone FROM keyed LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op6_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT % 3]::DOUBLE AS w FROM d GROUP BY source),
r AS (
  SELECT *, 3.0::DOUBLE * source_size AS most,
         coalesce(sum(3.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
         sum(source_size::DOUBLE) OVER () AS total, row_number() OVER o AS k
  FROM s WHERE source_size > 0 WINDOW o AS (ORDER BY 3.0 * source_size / w, source NULLS LAST)),
f AS (SELECT min(k) AS k FROM r WHERE (total - below) * w / w_left <= most),
t AS (
  SELECT r.source, r.source_size,
         CASE WHEN r.k < f.k THEN r.most ELSE (g.total - g.below) * r.w / g.w_left END AS target
  FROM r, f, r AS g WHERE g.k = f.k),
q AS (
  SELECT *, round_even(target, 0)::BIGINT AS quota FROM t),
p AS (
  SELECT *, CASE WHEN quota // source_size >= 3 THEN 2 ELSE quota // source_size END AS base FROM q),
c AS (
  SELECT d.*, p.source_size, p.target, p.base, p.quota - p.base * p.source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix-1|' || d.doc_id), d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (base + CASE WHEN 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c""",
    "op8_warc": r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (
  SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to FROM g""",
    "op9_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 4 THEN array_to_string(words, ' ')
         ELSE array_to_string(words[i : i + 3], ' ') END AS sh
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r AS (
  SELECT x AS node, least(x, y) AS comp FROM l
  UNION
  SELECT l.y, r.comp FROM r JOIN l ON l.x = r.node),
m AS (SELECT node, min(comp) AS comp FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.comp, d.doc_id) AS component_id,
       d.doc_id = coalesce(m.comp, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = d.doc_id""",
    "op10_sharding": rf"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS h FROM documents),
e AS (SELECT *, unnest(range(0, 61)) AS depth FROM d),
b AS (
  SELECT depth, h >> (60 - depth) AS prefix, sum(bytes) AS shard_bytes, count(*) AS shard_docs, min(h) AS lo, max(h) AS hi
  FROM e GROUP BY ALL),
m AS (
  SELECT e.doc_id, e.bytes, b.depth, b.prefix, b.shard_bytes, b.shard_docs,
         row_number() OVER (PARTITION BY e.doc_id ORDER BY b.depth) AS rn
  FROM e JOIN b ON b.depth = e.depth AND b.prefix = e.h >> (60 - e.depth)
  WHERE b.shard_bytes <= {SHARD_BYTES} OR b.lo = b.hi OR b.depth = 60)
SELECT doc_id, bytes, depth::INT AS depth, prefix::BIGINT AS prefix, shard_bytes::BIGINT AS shard_bytes,
       shard_docs::BIGINT AS shard_docs, shard_bytes > {SHARD_BYTES} AS oversize FROM m WHERE rn = 1""",
}
