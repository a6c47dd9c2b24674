"""Mixing sources to target weights.

Documents are aggregated by membership pattern (the set of sources that they belong to). A small min-cost
flow routes words from patterns to the quotas of the sources: the first copy of a pattern's words costs 0,
the second 1, the third 2 a word, so repetition is spread before it is deepened. Each pattern's flow is then
met by whole documents in a seeded order: all of them floor(flow / size) times, and once more those whose
midpoint, on the line of the seeded order, lies before the remainder. That order is summed by hash buckets,
so that no source, however large, passes through one task.

Rules for odd input: a null text has size 0. A null source is a source of its own, after all others. Rows
that share doc_id and source are one unit: they are taken equally often. Sources of size 0 have target 0.
An empty table gives an empty mix. Column names other than those used are free.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Membership patterns and sources are aggregates; more of them than this is an error, not a cut.
MOST_PATTERNS = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: Sequence[float], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Shares the sum of sizes by weight; a target stops at `most` times its size and what is over goes to
    the others by weight, until none is above."""
    left, out = float(sum(sizes)), [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def min_cost_flow(sizes: list[int], members: list[list[int]], quotas: list[int], copies: int = 3) -> list[dict[int, int]]:
    """For each pattern {source: words}. Successive shortest paths over patterns and sources. The arcs of a
    pattern cost 0, 1, ... a word for each further copy of it."""
    n, m = len(sizes), len(quotas)
    flow: list[dict[int, int]] = [{} for _ in range(n)]
    used, got = [0] * n, [0] * m
    holders: list[set[int]] = [set() for _ in range(m)]

    def cost(p: int) -> int | None:
        return used[p] // sizes[p] if sizes[p] and used[p] < copies * sizes[p] else None

    # A path is: a pattern with spare words, source, [pattern that gives up words there, source]*, open quota.
    # Its cost is that of its first pattern only, so the cheapest patterns are tried first, breadth first.
    for c in range(copies):
        for p in range(n):
            while cost(p) == c:
                before: dict[int, tuple[int, int | None]] = {s: (p, None) for s in members[p]}
                queue, end = deque(members[p]), None
                while queue:
                    s = queue.popleft()
                    if got[s] < quotas[s]:
                        end = s
                        break
                    for q in holders[s]:
                        for t in members[q]:
                            if t not in before:
                                before[t] = (q, s)
                                queue.append(t)
                if end is None:
                    break
                amount, s = min(quotas[end] - got[end], (c + 1) * sizes[p] - used[p]), end
                while before[s][1] is not None:
                    q, prev = before[s]
                    amount, s = min(amount, flow[q][prev]), prev
                s = end
                while True:
                    q, prev = before[s]
                    flow[q][s] = flow[q].get(s, 0) + amount
                    holders[s].add(q)
                    if prev is None:
                        break
                    flow[q][prev] -= amount
                    if not flow[q][prev]:
                        del flow[q][prev]
                        holders[prev].discard(q)
                    s = prev
                got[end] += amount
                used[p] += amount
    return flow


def seeded_copies(units: DataFrame, quotas: DataFrame, seed: str, copies: int) -> DataFrame:
    """units: (pattern, doc_id, size); quotas: (pattern, base, rest). Adds copies: base, and one more for the
    units whose midpoint in the seeded order lies at or before rest."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    units = units.withColumn("order", digest).withColumn("bucket", F.substring("order", 1, 3))
    up_to = Window.partitionBy("pattern").orderBy("bucket")
    buckets = (
        units.groupBy("pattern", "bucket")
        .agg(F.sum("size").alias("sum"))
        .withColumn("after", F.sum("sum").over(up_to))
        .join(quotas, "pattern")
        .select("pattern", "bucket", "base", "rest", (F.col("after") - F.col("sum")).alias("before"), "after")
    )
    units = units.join(staged(buckets, "mix-buckets"), ["pattern", "bucket"])
    whole = units.where((F.col("after") <= F.col("rest")) | (F.col("before") >= F.col("rest"))).withColumn(
        "more", (F.col("after") <= F.col("rest")).cast("int")
    )
    # The one bucket of a pattern that the remainder cuts is split again, by three further digits.
    cut = units.where((F.col("after") > F.col("rest")) & (F.col("before") < F.col("rest"))).drop("after").withColumn("sub", F.substring("order", 4, 3))
    subs = (
        cut.groupBy("pattern", "bucket", "sub")
        .agg(F.sum("size").alias("sum"))
        .withColumn("upto", F.sum("sum").over(Window.partitionBy("pattern", "bucket").orderBy("sub")))
        .select("pattern", "bucket", "sub", (F.col("upto") - F.col("sum")).alias("sub_before"))
    )
    line = Window.partitionBy("pattern", "bucket", "sub").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.join(subs, ["pattern", "bucket", "sub"]).withColumn("mid2", 2 * (F.col("before") + F.col("sub_before") + F.sum("size").over(line)) - F.col("size"))
    cut = cut.withColumn("more", (F.col("mid2") <= 2 * F.col("rest")).cast("int"))
    cols = ["pattern", "doc_id", "size", (F.col("base") + F.col("more")).cast("bigint").alias("copies")]
    return whole.select(*cols).unionByName(cut.select(*cols))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: str = "mix-1") -> DataFrame:
    """docs: doc_id, text, and source (a string, or an array of strings for documents of several sources).
    weights repeat over the sources in code point order. Returns (doc_id, source, size, copies, source_size,
    target, quota) for each row of docs; source_size and target are null for documents of several sources."""
    many = dict(docs.dtypes)["source"].startswith("array")
    pattern = F.sort_array(F.array_distinct("source")) if many else F.array("source")
    rows = staged(docs.select("doc_id", "source", pattern.alias("pattern"), n_words(F.col("text")).alias("size")), "mix-sizes")
    found = rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    found.sort(key=lambda r: [(x is None, (x or "").encode()) for x in r["pattern"] or []])
    names = sorted({s for r in found for s in r["pattern"] or []}, key=lambda x: (x is None, (x or "").encode()))
    at = {s: i for i, s in enumerate(names)}
    members = [[at[s] for s in r["pattern"] or []] for r in found]
    total = [0] * len(names)
    for r, m in zip(found, members, strict=True):
        for i in m:
            total[i] += r["size"]
    goal = targets(total, [weights[i % len(weights)] for i in range(len(names))], most)
    flow = min_cost_flow([r["size"] for r in found], members, [round(x) for x in goal], most)
    plan = []
    for r, m, f in zip(found, members, flow, strict=True):
        taken, alone = sum(f.values()), m[0] if len(m) == 1 else None
        base, rest = divmod(taken, r["size"]) if r["size"] else (0, 0)
        if base == most:
            base, rest = most - 1, r["size"]
        plan.append((r["pattern"], base, rest, None if alone is None else total[alone], None if alone is None else goal[alone], taken))
    spark = docs.sparkSession
    plan = spark.createDataFrame(plan, "pattern array<string>, base bigint, rest bigint, source_size bigint, target double, quota bigint")
    # Arrays with a null don't join by =, so patterns go by their JSON text.
    key = F.to_json(F.struct("pattern"), {"ignoreNullFields": "false"})
    rows, plan = rows.withColumn("pattern", key), plan.withColumn("pattern", key)
    units = rows.groupBy("pattern", "doc_id").agg(F.sum("size").alias("size"))
    taken = seeded_copies(units, plan.select("pattern", "base", "rest"), seed, most)
    taken = taken.select(F.col("pattern").alias("of_pattern"), F.col("doc_id").alias("of_doc"), "copies")
    return (
        rows.join(taken, (F.col("pattern") == F.col("of_pattern")) & F.col("doc_id").eqNullSafe(F.col("of_doc")))
        .join(F.broadcast(plan.select("pattern", "source_size", "target", "quota")), "pattern")  # MOST_PATTERNS rows at most
        .select("doc_id", "source", "size", "copies", "source_size", "target", "quota")
    )


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it."""
    times = mixed.where("copies > 0").select(F.col("doc_id").alias("__doc"), F.col("source").alias("__source"), F.col("copies").alias("__copies")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("__doc")) & docs["source"].eqNullSafe(F.col("__source"))
    return docs.join(times, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[docs[c] for c in docs.columns])
