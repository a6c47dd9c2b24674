"""Reading a history store's files into relations, and writing them.

Text files are read by Spark's text reader and taken apart by expressions; binary ones come through `binaryFile`,
a file a row, and are decoded in Arrow batches.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

OBJECTS = "oid string, kind string, size bigint, content binary"
TREES = "tree string, pos int, mode string, name string, oid string"


def packed_refs(spark: SparkSession, path: str) -> DataFrame:
    """(name, oid, peeled) of packed-refs files; a line with ^ peels the ref before it."""
    whole = spark.read.text(path, wholetext=True)
    entry = F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^[0-9a-f]{40,64} [^\n]+(?:\n\^[0-9a-f]{40,64})?"), F.lit(0))).alias("e")
    shape = r"^([0-9a-f]+) ([^\n]+?)\r?(?:\n\^([0-9a-f]+))?$"
    return whole.select(entry).select(F.regexp_extract("e", shape, 2).alias("name"), F.regexp_extract("e", shape, 1).alias("oid"), F.nullif(F.regexp_extract("e", shape, 3), F.lit("")).alias("peeled"))


def write_packed_refs(refs: DataFrame, path: str) -> None:
    """Sorted by name, one part file a range."""
    line = F.concat(F.concat_ws(" ", "oid", "name"), F.when(F.col("peeled").isNotNull(), F.concat(F.lit("\n^"), "peeled")).otherwise(""))
    refs.orderBy("name").select(line.alias("value")).write.text(path)


def reflogs(spark: SparkSession, path: str, root: str) -> DataFrame:
    """(ref, seq, old_oid, new_oid, name, email, when_secs, offset_minutes, message, malformed); root is the folder
    that ref names start below."""
    shape = r"^([0-9a-f]{40,64}) ([0-9a-f]{40,64}) (.*?) ?<([^>]*)> (\d+) ([+-]\d{4})(?:\t(.*))?$"
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    ref = F.regexp_replace("file", "^.*" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    rows = files.select(ref.alias("ref"), F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("seq", "line"))
    part = lambda i: F.regexp_extract("line", shape, i)
    return rows.select(
        "ref",
        (F.col("seq") + 1).alias("seq"),
        *[F.nullif(part(i), F.lit("")).alias(n) for i, n in ((1, "old_oid"), (2, "new_oid"))],
        part(3).alias("name"),
        part(4).alias("email"),
        F.expr("try_cast(nullif('', '') AS BIGINT)").alias("none"),
        F.nullif(part(5), F.lit("")).cast("bigint").alias("when_secs"),
        text.offset_minutes(part(6)).alias("offset_minutes"),
        part(7).alias("message"),
        (~F.col("line").rlike(shape)).alias("malformed"),
    ).drop("none")


def config(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(level, seq, section, subsection, key, value) of configuration files, least important first. A key without
    a value is true."""
    out = None
    for level, path in enumerate(paths):
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\\\n", ""), "\n")).alias("seq", "line"))
        head = r'^\s*\[\s*([A-Za-z0-9.-]+)(?:\s+"((?:[^"\\]|\\.)*)")?\s*\]'
        from pyspark.sql.window import Window

        by = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)  # the lines of one small file
        is_head = F.col("line").rlike(head)
        section = F.last(F.when(is_head, F.struct(F.lower(F.regexp_extract("line", head, 1)).alias("s"), F.regexp_extract("line", head, 2).alias("b"))), ignorenulls=True).over(by)
        body = F.regexp_replace("line", head, "")
        pair = r"^\s*([A-Za-z][A-Za-z0-9-]*)\s*(=)?\s*(.*?)\s*$"
        value = F.regexp_replace(F.regexp_replace(F.regexp_extract("body", pair, 3), r'\s*[#;](?=(?:[^"]*"[^"]*")*[^"]*$).*$', ""), '"', "")
        rows = lines.withColumn("section", section).withColumn("body", body).where(F.col("body").rlike(pair) & ~F.col("body").rlike(r"^\s*[#;]"))
        rows = rows.select(F.lit(level).alias("level"), "seq", F.col("section.s").alias("section"), F.nullif(F.col("section.b"), F.lit("")).alias("subsection"), F.lower(F.regexp_extract("body", pair, 1)).alias("key"), F.when(F.regexp_extract("body", pair, 2) == "", "true").otherwise(value).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def effective(entries: DataFrame) -> DataFrame:
    """The value in force of each key: of the last level and line that sets it."""
    return entries.groupBy("section", "subsection", "key").agg(F.max_by("value", F.struct("level", "seq")).alias("value"))


def mailbox(spark: SparkSession, path: str) -> DataFrame:
    """(seq, author, date, subject, body, patch) of the mails of mbox files; [PATCH ...] and Re: are stripped."""
    whole = spark.read.text(path, wholetext=True)
    mails = whole.select(F.posexplode(F.split("value", r"(?m)^From (?=[^\n]*\d{4}\s*$)")).alias("seq", "mail")).where("mail <> ''")
    head = F.regexp_replace(F.regexp_extract("mail", r"(?s)^[^\n]*\n(.*?)\n\n", 1), r"\n[ \t]+", " ")
    rest = F.regexp_extract("mail", r"(?s)^.*?\n\n(.*)$", 1)
    field = lambda n: F.regexp_extract(head, rf"(?mi)^{n}:[ ]*(.*)$", 1)
    subject = F.regexp_replace(field("Subject"), r"^(?:(?i:re):\s*|\[[^\]]*\]\s*)+", "")
    cut = r"(?s)^(.*?)(?:\n---\n|(?=(?:^|\n)diff --git )|$)"
    return mails.select("seq", field("From").alias("author"), field("Date").alias("date"), subject.alias("subject"), F.regexp_extract(rest, cut, 1).alias("body"), F.regexp_extract(rest, r"(?s)((?:diff --git |--- ).*?)(?:\n-- \n.*)?$", 1).alias("patch"))


def _apply_delta(base: bytes, delta: bytes) -> bytes:
    """Copies from the base and inserts new bytes, as a delta says."""
    i = 0
    for _ in range(2):  # both sizes
        while delta[i] & 128:
            i += 1
        i += 1
    out = bytearray()
    while i < len(delta):
        op = delta[i]
        i += 1
        if op & 128:
            place = size = 0
            for k in range(4):
                if op >> k & 1:
                    place |= delta[i] << 8 * k
                    i += 1
            for k in range(3):
                if op >> (4 + k) & 1:
                    size |= delta[i] << 8 * k
                    i += 1
            out += base[place : place + (size or 1 << 16)]
        else:
            out += delta[i : i + op]
            i += op
    return bytes(out)


KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}


def pack_entries(data: bytes) -> Iterator[tuple[str, str, bytes]]:
    """(oid, kind, content) of the objects of a pack file; deltas are resolved against objects of the same pack."""
    if data[:4] != b"PACK":
        raise ValueError("not a pack")
    n = struct.unpack(">I", data[8:12])[0]
    at, by_place, by_oid, waiting = 12, {}, {}, []
    for _ in range(n):
        start, byte = at, data[at]
        at += 1
        kind = byte >> 4 & 7
        while byte & 128:
            byte = data[at]
            at += 1
        base = None
        if kind == 6:
            byte = data[at]
            at += 1
            back = byte & 127
            while byte & 128:
                byte = data[at]
                at += 1
                back = (back + 1) << 7 | byte & 127
            base = start - back
        elif kind == 7:
            base, at = data[at : at + 20].hex(), at + 20
        z = zlib.decompressobj()
        body = z.decompress(data[at:])
        at = len(data) - len(z.unused_data)
        waiting.append((start, kind, base, body))
    while waiting:
        left = []
        for start, kind, base, body in waiting:
            if kind in KINDS:
                got = KINDS[kind], body
            else:
                of = by_place.get(base) if kind == 6 else by_oid.get(base)
                if of is None:
                    left.append((start, kind, base, body))
                    continue
                got = of[0], _apply_delta(of[1], body)
            oid = hashlib.sha1(f"{got[0]} {len(got[1])}".encode() + b"\0" + got[1]).hexdigest()
            by_place[start] = by_oid[oid] = got
            yield oid, *got
        if len(left) == len(waiting):
            raise ValueError("a delta's base isn't in the pack")
        waiting = left


def _objects(decode):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content").to_pylist():
                rows = list(decode(content))
                cols = [[r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows], [r[2] for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["oid", "kind", "size", "content"])

    return run


def _loose(data: bytes) -> Iterator[tuple[str, str, bytes]]:
    raw = zlib.decompress(data)
    head, _, body = raw.partition(b"\0")
    yield hashlib.sha1(raw).hexdigest(), head.split()[0].decode(), body


def loose_objects(spark: SparkSession, path: str) -> DataFrame:
    """(oid, kind, size, content) of loose object files; oid is computed from the bytes."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_objects(_loose), OBJECTS)


def packs(spark: SparkSession, path: str) -> DataFrame:
    """The objects of pack files, one file a row of a task."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_objects(pack_entries), OBJECTS)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for tree, data in zip(b.column("oid").to_pylist(), b.column("content").to_pylist(), strict=True):
            at = pos = 0
            while at < len(data):
                space = data.index(b" ", at)
                end = data.index(b"\0", space)
                rows.append((tree, pos, data[at:space].decode().zfill(6), data[space + 1 : end].decode("utf-8", "replace"), data[end + 1 : end + 21].hex()))
                at, pos = end + 21, pos + 1
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], ["tree", "pos", "mode", "name", "oid"])


def tree_entries(objects: DataFrame) -> DataFrame:
    return objects.where("kind = 'tree'").select("oid", "content").mapInArrow(_entries, TREES)


def commits(objects: DataFrame) -> DataFrame:
    """(oid, tree, parents, author, committer, message) of commit objects."""
    raw = F.decode("content", "UTF-8")
    head, message = F.substring_index(raw, "\n\n", 1), F.regexp_extract(raw, r"(?s)^.*?\n\n(.*)$", 1)

    def person(name: str):
        line = F.regexp_extract(head, rf"(?m)^{name} (.*)$", 1)
        p = text.identity(line)
        return F.struct(*[v.alias(k) for k, v in p.items()]).alias(name)

    return objects.where("kind = 'commit'").select(
        "oid", F.regexp_extract(head, r"(?m)^tree ([0-9a-f]+)$", 1).alias("tree"), F.regexp_extract_all(head, F.lit(r"(?m)^parent ([0-9a-f]+)$"), F.lit(1)).alias("parents"), person("author"), person("committer"), message.alias("message")
    )
