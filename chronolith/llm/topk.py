"""Exact top-k search by inner product, a block at a time.

Vectors are quantised to integers (floor of 64 times each component). Candidates lie in blocks of
`block` rows, in doc-id ranges of an order that puts alike vectors together; a block's forward index is its
integer matrix, and its bound for a query is the sum over the terms (components) of the larger of the query's
weight times the block's greatest and least component there. Within a task each query takes its blocks in
descending order of bound and stops at the first whose bound is below its k-th best score so far; ties with the
k-th are still scored. Tasks are pairs of a query group and a block group, both of bounded size; their lists of
k are merged by query.

Rules for odd input: a vector that is null or holds a null or non-finite component takes no part, nor does a
null vec_id. Every finite component counts: where 64-bit sums could overflow, Python's integers are used, and only a
component or score that doesn't fit 64 bits is an error. Vectors of different lengths are taken as if padded with
zeros. Rows that share a vec_id: as a
candidate each row counts; as a query the least vector by order of components is taken (with `every_row` each row
asks, and the k best of all their pairs are the id's), and all rows with its id are left out. Ties go to the smaller vec_id. An empty table, or one without queries, gives no rows.
Column names other than vec_id and embedding are free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: Above this, double precision sums might not be exact.
EXACT = 2.0**53
PACKED = "part bigint, n bigint, width bigint, ids binary, cells binary"


def quantised(embedding: Column) -> Column:
    def one(x: Column) -> Column:
        y = F.floor(x.cast("double") * 64)
        return F.when(F.abs(x.cast("double")) < 2.0**57, y.cast("bigint")).otherwise(F.raise_error(F.lit("a component doesn't fit 64 bits")).cast("bigint"))

    return F.transform(embedding, one)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, cells array<bigint>) of the vectors that take part."""
    bad = F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x.cast("double")) == float("inf")), F.lit(True)))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad).select("vec_id", quantised(F.col("embedding")).alias("cells"))


def alike(cells: Column) -> Column:
    """A key that puts vectors with the same strongest components next to each other: the signs of 16 fixed
    sums of components, the first of them leading."""
    rng = np.random.default_rng(5)
    bits = []
    for k in range(16):
        signs = F.array(*[F.lit(int(s)) for s in rng.choice((-1, 1), 64)])
        total = F.aggregate(F.zip_with(cells, signs, lambda x, s: F.coalesce(x, F.lit(0)).cast("double") * F.coalesce(s, F.lit(1))), F.lit(0.0), lambda a, x: a + x)
        bits.append(F.when(total > 0, F.lit(1 << (15 - k))).otherwise(0))
    return sum(bits[1:], bits[0])


def _packed(rows: int):
    """Packs the rows of a task, as they come, into records of at most `rows` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                part = b.slice(i, rows)
                lists = part.column("cells").to_pylist()
                width = max(map(len, lists))
                m = np.zeros((len(lists), width), "<i8")
                for r, x in enumerate(lists):
                    m[r, : len(x)] = x
                ids = part.column("vec_id").cast(pa.int64()).to_numpy().astype("<i8")
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([int(ids[0])], pa.int64()), "n": pa.array([len(ids)], pa.int64()), "width": pa.array([width], pa.int64()), "ids": [ids.tobytes()], "cells": [m.tobytes()]}
                )

    return run


def unpacked(rows: pd.DataFrame, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for n, w, ids, cells in zip(rows["n"], rows["width"], rows["ids"], rows["cells"], strict=True):
        m = np.zeros((n, width), np.int64)
        m[:, :w] = np.frombuffer(cells, "<i8").reshape(n, w)
        out.append((np.frombuffer(ids, "<i8"), m))
    return out


def best_of_blocks(q_ids: np.ndarray, q: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores) of shape (queries, k), -1 where there are fewer, ordered by descending score then id; and the
    number of (query, block) pairs that were scored."""
    top = max([1, *(int(np.abs(m).max(initial=0)) for _, m in parts)]) * max(1, int(np.abs(q).max(initial=0))) * q.shape[1]
    kind = np.float64 if top < EXACT else np.int64 if top < 2**63 else object
    work = q.astype(kind)
    plus, minus = np.maximum(work, 0), np.minimum(work, 0)
    high = np.array([m.max(axis=0) for _, m in parts]).astype(kind)
    low = np.array([m.min(axis=0) for _, m in parts]).astype(kind)
    bounds = plus @ high.T + minus @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    cells = [m.astype(kind).T for _, m in parts]
    none = -(2**63)
    ids = np.full((len(q), k), 2**63 - 1, np.int64)
    scores = np.full((len(q), k), none, np.int64)
    live, scored = np.arange(len(q)), 0
    for step in range(len(parts)):
        at = order[live, step]
        live_now = (scores[live, k - 1] == none) | (bounds[live, at] >= scores[live, k - 1])
        live, at = live[live_now], at[live_now]
        if not len(live):
            break
        for p in np.unique(at):
            rows = live[at == p]
            scored += len(rows)
            new = (work[rows] @ cells[p]).astype(np.int64)
            name = np.broadcast_to(parts[p][0], new.shape)
            new = np.where(name == q_ids[rows, None], none, new)
            if new.shape[1] > 4 * k:  # only scores that reach the k-th here matter, ties included
                cut = np.partition(new, new.shape[1] - k, axis=1)[:, -k]
                keep = (new >= np.maximum(cut, scores[rows, k - 1])[:, None]) & (new > none)
                most = int(keep.sum(axis=1).max(initial=0))
                if most == 0:
                    continue
                pick = np.argsort(~keep, axis=1, kind="stable")[:, :most]
                new = np.where(np.take_along_axis(keep, pick, 1), np.take_along_axis(new, pick, 1), none)
                name = np.take_along_axis(name, pick, 1)
            all_s, all_i = np.concatenate((scores[rows], new), 1), np.concatenate((ids[rows], name), 1)
            by = np.lexsort((all_i, -np.maximum(all_s, none + 1)), axis=1)[:, :k]
            scores[rows], ids[rows] = np.take_along_axis(all_s, by, 1), np.take_along_axis(all_i, by, 1)
    return ids, scores, scored


def _task(k: int):
    def run(key, queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        if not len(queries) or not len(blocks):
            return empty
        width = max(1, int(max(queries["width"].max(), blocks["width"].max())))
        out, parts = [empty], unpacked(blocks, width)
        for q_ids, q in unpacked(queries, width):
            ids, scores, _ = best_of_blocks(q_ids, q, parts, k)
            good = scores > -(2**63)
            out.append(pd.DataFrame({"query_id": np.repeat(q_ids, k)[good.ravel()], "vec_id": ids[good], "score": scores[good]}))
        return pd.concat(out)

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 20, block: int = 128, group: int = 128, at_once: int = 1024, every_row: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of vectors for each id of queries, its own id left out."""
    some = usable(queries)
    if not every_row:
        some = some.groupBy("vec_id").agg(F.min("cells").alias("cells"))
    asked = staged(some.mapInArrow(_packed(at_once), PACKED), "query-groups")
    ordered = usable(vectors).withColumn("near", alike(F.col("cells"))).repartitionByRange(F.col("near"), F.col("vec_id")).sortWithinPartitions("near", "vec_id")
    blocks = staged(ordered.select("vec_id", "cells").mapInArrow(_packed(block), PACKED), "blocks")
    # Groups of blocks and of queries are dealt by number: n_groups grows with the rows, and each is of bounded size.
    n_blocks, n_asked = blocks.count(), asked.count()
    n_groups = max(1, -(-n_blocks // group))
    # Both sides' keys are of one type: a cogroup deals an int and a bigint of one value to different tasks.
    blocks = blocks.withColumn("g", F.pmod(F.xxhash64("part", "ids"), F.lit(n_groups)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(max(n_asked - 1, 0)))))
    asked = asked.withColumn("q", F.pmod(F.xxhash64("part"), F.lit(max(n_asked, 1))).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    lists = asked.groupBy("q", "g").cogroup(blocks.groupBy("q", "g")).applyInPandas(_task(k), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
