"""Helpers that every corpus operator uses: tables, the shared folder, checkpoints, hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset a temporary folder
    is made and set in local mode, where every task can see it; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="chronolith-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of a write made within as soon as it ends, not when the driver happens to collect
    garbage. Only for writes: their plan is their own and isn't run again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends there, and losing an
    executor costs nothing that was computed before."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    with no_shuffle_left(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, tag: str, key: str) -> DataFrame:
    """staged, in buckets by `key`: joins on it deal out the other side only, however often the table is read."""
    spark = df.sparkSession
    buckets, name = shuffle_width(spark), f"{tag.replace('-', '_')}_{uuid.uuid4().hex}"
    with no_shuffle_left(spark):
        df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def discard(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers whose bits look independent."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * U64(2) + U64(1)


#: A-Z lower-cased and [\x09-\x0D] made spaces, byte by byte.
_plain_bytes = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
#: A random number for each byte at each of 64 places.
_table = np.random.default_rng(7).integers(0, 2**63, 64 * 256, dtype=np.uint64) * U64(2) + U64(1)


def many_word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of all texts, A-Z lower-cased, one text after the other, and
    where those of each text begin and end. A word's hash is the mixed sum of its bytes' numbers at their places."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]].tobytes().translate(_plain_bytes)
    data, offsets = np.frombuffer(raw, np.uint8), offsets - offsets[0]
    inside = data != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]  # a text's first word begins there even when the text before ends in a word
    letters = data[inside]
    starts = np.flatnonzero(begins[inside])
    if not len(starts):
        return np.empty(0, U64), np.zeros(len(offsets), np.int64)
    sizes = np.diff(starts, append=len(letters))
    place = np.arange(len(letters), dtype=np.int32)
    place -= np.repeat(starts.astype(np.int32), sizes)
    value = _table.take((place & 63) << 8 | letters)
    if sizes.max() > 64:
        late = np.flatnonzero(place > 63)
        value[late] = mix(value[late] + (place[late] >> 6).astype(U64))
    at = np.concatenate(([0], np.cumsum(begins, dtype=np.int64)))[offsets]
    return mix(np.add.reduceat(value, starts) + sizes.astype(U64)), at


def word_ids(text: str | None) -> np.ndarray:
    return many_word_ids(pa.array([text], pa.large_string()))[0]


_place = odd_constants(64, 11)


def shingles(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words at each position, in order; with fewer words, the one whole sequence."""
    n = len(ids)
    if n == 0:
        return ids
    if n < width:
        width, salt = n, U64(n)
    else:
        salt = U64(0)
    out = np.full(n - width + 1, salt, U64)
    for i in range(width):
        out += ids[i : n - width + 1 + i] * _place[i]
    return mix(out)


def by_batch(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterable[pa.RecordBatch]:
    """The same rows in batches of `rows` at most."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
