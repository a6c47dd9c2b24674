"""Where lines come from, along the versions of a file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.stages import discard, staged
from .text_diff import matches, split_lines


#: A line of the version in `place` (0: the newest) and where it came from; open: from a version before that too, maybe.
STEP = "file bigint, place bigint, line bigint, to_seq bigint, to_line bigint, open boolean"


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "place", "line", "to_seq", "to_line", "open"]
    for b in batches:
        rows: list[tuple] = []
        for file, seq, newest, new, old in zip(*(b.column(c).to_pylist() for c in ("file", "seq", "newest", "text", "old")), strict=True):
            lines = split_lines(new)
            came = dict((j, i) for i, j in matches(split_lines(old), lines))
            rows += [(file, newest - seq, j, seq - (j in came), came.get(j, j), j in came) for j in range(len(lines))]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n == "open" else pa.int64()) for n, c in zip(names, cols, strict=True)], names)


def line_origins(versions: DataFrame, most_rounds: int = 40) -> DataFrame:
    """versions: (file, seq, text), seq 1, 2, ... Each line (from 0) of the newest version with the version and line
    that it came from. Neighbouring versions are compared pair by pair. The steps from a version to the one before are then
    put together two by two: a round leaves every second version's lines, so all rounds take about twice the rows of the
    first. What lines of the newest versions came from is put aside as soon as it is known."""
    by = Window.partitionBy("file")
    pairs = versions.select("file", "seq", "text", F.lag("text").over(by.orderBy("seq")).alias("old"), F.max("seq").over(by).alias("newest"))
    # A file's pairs go to several tasks, whatever the number of its versions.
    pairs = pairs.repartition(int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "seq")
    rows, old, done = staged(pairs.mapInArrow(_steps, STEP), "line-steps"), None, None
    for _ in range(most_rounds):
        if old is not None:
            discard(old)
        settled = staged(rows.where("place = 0 AND NOT open").select("file", "line", "to_seq", "to_line"), "line-origins")
        done = settled if done is None else done.unionByName(settled)
        going = rows.where("place > 0 OR open")
        if going.isEmpty():
            return done.select("file", "line", F.col("to_seq").alias("origin_seq"), F.col("to_line").alias("origin_line"))
        later, earlier = going.where("place % 2 = 0"), going.where("place % 2 = 1")
        half = (F.col("place") / 2).cast("bigint").alias("place")
        through = earlier.select("file", half, F.col("line").alias("to_line"), F.col("to_seq").alias("at_seq"), F.col("to_line").alias("at_line"), F.col("open").alias("on"))
        ended = later.where("NOT open").select("file", half, "line", "to_seq", "to_line", "open")
        went = later.where("open").select("file", half, "line", "to_line").join(through, ["file", "place", "to_line"])
        went = went.select("file", "place", "line", F.col("at_seq").alias("to_seq"), F.col("at_line").alias("to_line"), F.col("on").alias("open"))
        old, rows = rows, staged(ended.unionByName(went), "line-steps")
    raise RuntimeError("a file has too many versions")


def blame_hunks(origins: DataFrame) -> DataFrame:
    """Runs of lines of one origin that are next to each other there too: final_start, count, origin_seq, origin_start."""
    group = Window.partitionBy("file", "origin_seq", F.col("line") - F.col("origin_line")).orderBy("line")
    runs = origins.withColumn("run", F.col("line") - F.row_number().over(group))
    return runs.groupBy("file", "origin_seq", (F.col("line") - F.col("origin_line")).alias("shift"), "run").agg(F.min("line").alias("final_start"), F.count("*").alias("count"), F.min("origin_line").alias("origin_start")).drop("shift", "run")
