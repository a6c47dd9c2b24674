"""Content-addressed web archive.

An archive is two Parquet tables in one folder: `payloads` holds payload bytes once for each content, under
their SHA-256 and length, and `headers` holds the exact WARC header block of every record. Original records
come back by joining the two; the digest is computed again from the stored bytes and must agree.

Of records with equal payloads of at least `min_bytes` bytes, the one with the largest page_id is the
response and the others are revisits of it; smaller payloads are all responses.

Rules for odd input: a null html is an empty payload, a null url an empty target. Rows that share the largest
page_id are all responses. A null page_id is below every other; where all are null, all are responses. An
empty table gives an empty archive. Column names other than page_id, url and html are free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, staged

CRLF = "\r\n"


def typed(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Adds payload, digest (SHA-256), payload_sha1, payload_bytes, record_type and refers_to."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    return rows.select("*", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("payload_sha1"), F.octet_length("payload").cast("bigint").alias("payload_bytes"))


def header_block() -> F.Column:
    """The record's header block, as WARC writes it. A revisit has no content of its own."""
    revisit = F.col("record_type") == "revisit"

    def line(name: str, value) -> F.Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    def urn(page) -> F.Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))

    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        F.when(revisit, line("WARC-Refers-To", urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_sha1"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, min_bytes: int = 1000, path: str | None = None) -> str:
    """Writes the archive and returns its path."""
    path = path or new_path(pages.sparkSession, "archive")
    rows = typed(pages, min_bytes)
    narrow = staged(rows.drop("payload"), "warc-rows")
    one = narrow.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    first = F.when(F.col("n") > 1, F.col("first"))
    records = narrow.join(one, "digest", "left").withColumn("first", first)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    records = records.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first")))
    records.select("digest", header_block().alias("header")).write.parquet(f"{path}/headers")
    # One copy of each content: the rows that hold it are found by the narrow table, and equal bytes within a
    # digest are then one row. min() of equal payloads is any of them.
    rows.groupBy("digest").agg(F.min("payload").alias("payload")).write.parquet(f"{path}/payloads")
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: header, payload (whole, for revisits too), and the fields that the header names.
    A payload whose bytes don't have its digest fails the read."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")

    def field(name: str) -> F.Column:
        return F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)", 1)

    def page(name: str) -> F.Column:
        return F.expr("try_cast(nullif(regexp_extract(header, '(?m)^" + name + ": <urn:page:([^>]*)>', 1), '') AS bigint)")

    checked = payloads.select(
        "digest",
        "payload",
        F.sha1("payload").alias("payload_sha1"),
        F.when(F.sha2("payload", 256) == F.col("digest"), F.octet_length("payload").cast("bigint"))
        .otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("digest"))).cast("bigint"))
        .alias("payload_bytes"),
    )
    return headers.join(checked, "digest").select(
        page("WARC-Record-ID").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        "payload_bytes",
        "payload_sha1",
        field("WARC-Payload-Digest").alias("header_digest"),
        "digest",
        "header",
        "payload",
    )


def records(archive: DataFrame) -> DataFrame:
    """The bytes of each original record: header block, content, two line ends."""
    content = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return archive.select("page_id", F.concat(F.encode("header", "UTF-8"), content, F.lit(b"\r\n\r\n")).alias("record"))
