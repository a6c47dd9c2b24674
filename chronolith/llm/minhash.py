"""MinHash near-dedup by a signature-coordinate inverted join.

A document is the set of its distinct word shingles. Documents with the same set are one class and go on as
their smallest doc_id. Each class posts itself under (coordinate, value) pairs of its signature of `coords`
min-hashes. Two sets of Jaccard similarity s agree in a Binomial(coords, s) number of coordinates; pairs with
`matches` agreements at least are candidates (64 and 32: at s = 0.8 one pair in 5 x 10^7 has fewer), and a link is
confirmed on the full sets. Prefix and skip merging keep the lists short: each class orders its coordinates
from rare to frequent values and posts only the first coords - matches + 1, which no pair with `matches`
agreements can both avoid; the frequent rest is skipped, and counted only for pairs that meet in a prefix.

Lists don't give all their pairs. First each list ties its members to two hubs, the links found are merged
into components, and lists that lie in one component are done. Of the others, short lists give their pairs of
different components. Long lists that share members form clusters; in each, the documents outside the largest
component (the strays) are compared with all by blocks: a task has one block of strays and one of the cluster,
intersects their full sets, and returns only links that join components. So no component is missed, and n near
copies cost n pairs and blocks of their strays.

Rules for odd input: a null or blank text has an empty set and is linked with nothing. A null doc_id takes no
part: its component_id is null and it is kept. Rows that share a doc_id are one document of several texts: they
share a component and stay or go together. An empty table gives an empty table. Column names other than doc_id
and text are free. `kept` is doc_id = component_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, by_batch, many_word_ids, mix, odd_constants, shingles, staged
from .graph import components

#: Lists of more members are compared by blocks instead of by pairs.
LONG_LIST = 32


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    for i in range(0, len(texts), 128):
        ids, at = many_word_ids(texts.slice(i, 128))
        all_ = shingles(ids, width)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            items = np.sort(all_[a : b - width + 1] if b - a >= width else shingles(ids[a:b], width))
            yield items[np.concatenate(([True], items[1:] != items[:-1]))] if len(items) else items


def signature(items: np.ndarray, coords: int) -> np.ndarray:
    """For each coordinate a token that stands for (coordinate, smallest hash of the set)."""
    scale = odd_constants(coords, 23)[:, None]
    low = np.full(coords, ~U64(0), U64)
    for i in range(0, len(items), 2048):
        np.minimum(low, (scale * items[None, i : i + 2048]).min(axis=1), out=low)
    return mix(low ^ (scale[:, 0] << U64(1)))


def _sketches(width: int, coords: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_batch(batches):
            rows = []
            for items in shingle_sets(b.column(1), width):
                if len(items):
                    whole = xxhash.xxh3_128_digest(items.tobytes())
                    rows.append((len(items), *np.frombuffer(whole, np.int64).tolist(), signature(items, coords).view(np.int64)))
                else:
                    rows.append((0, None, None, None))
            n, f1, f2, sig = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "f1", "f2", "sig"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_batch(batches, 512):
            data = [items.tobytes() for items in shingle_sets(b.column(1), width)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["doc_id", "items"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_batch(batches, 512):
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = np.concatenate((p, q))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, sketches: DataFrame, matches: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity: first by sizes and signatures, then by sets."""
    x = sketches.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
    y = sketches.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
    near = pairs.join(x, "a").join(y, "b").where(
        (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.size(F.array_intersect("sa", "sb")) >= matches)
    )
    near = staged(near.select("a", "b").distinct(), "near-pairs")
    both = near.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b"
    )
    return staged(both.select("a", "b", "x", "y").mapInArrow(_linked(percent), "a bigint, b bigint").distinct(), "links")


def postings(sketches: DataFrame, coords: int, matches: int) -> DataFrame:
    """(token, doc_id, n_shingles): each document under the rarest coords - matches + 1 of its tokens. Tokens
    that one document has alone count in that number but are left out, as they meet nobody."""
    tokens = sketches.select("doc_id", "n_shingles", F.explode("sig").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("doc_id", "n_shingles")
    return (
        tokens.join(shared, "token")
        .withColumn("rank", F.row_number().over(own.orderBy("df", "token")))
        .withColumn("n", F.count("*").over(own))
        .where(F.col("rank") + (coords - F.col("n")) <= coords - matches + 1)
        .select("token", "doc_id", "n_shingles")
    )


def hub_pairs(posts: DataFrame) -> DataFrame:
    """Pairs of each member of a list with the list's two hubs, which are chosen by hash, so that lists of the
    same group choose the same."""
    hubs = (
        posts.groupBy("token")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), *[F.min_by("doc_id", F.xxhash64(F.lit(i), "doc_id")).alias(f"hub{i}") for i in (1, 2)])
        .where("least <> most")
    )
    each = posts.join(hubs, "token").select("doc_id", F.explode(F.array_distinct(F.array("hub1", "hub2"))).alias("hub"))
    return each.where("doc_id <> hub").select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()


def open_lists(posts: DataFrame, comps: DataFrame) -> DataFrame:
    """posts with component and n (members of the list), of the lists whose members are in different components."""
    posts = posts.join(comps.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    lists = posts.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("n"))
    return staged(posts.join(lists.where("c1 <> c2").select("token", "n"), "token"), "open-posts")


def open_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components from the same list; the lists are short."""
    x = posts.select("token", *[F.col(c).alias(f"{c}_a") for c in ("doc_id", "n_shingles", "component")])
    y = posts.select("token", *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "n_shingles", "component")])
    alike = 100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b")
    return (
        x.join(y, "token")
        .where((F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("component_a") != F.col("component_b")) & alike)
        .select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))
        .distinct()
    )


def _blocks_linked(percent: int):
    def run(key, strays: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        """One link for each stray and component of the others that it belongs to."""
        out = []
        if len(strays) and len(others):
            sets = [np.frombuffer(x, U64) for x in strays["items"]]
            sizes = np.array([len(x) for x in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            ids, comps = strays["doc_id"].to_numpy(), strays["component"].to_numpy()
            seen: set = set()
            for doc, comp, items in zip(others["doc_id"], others["component"], others["items"], strict=True):
                y = np.frombuffer(items, U64)
                lo, hi = np.searchsorted(flat, y, "left"), np.searchsorted(flat, y, "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(sets))
                for i in np.flatnonzero(100 * common >= percent * (sizes + len(y) - common)):
                    if comps[i] != comp and (i, comp) not in seen:
                        seen.add((i, comp))
                        out.append((min(ids[i], doc), max(ids[i], doc)))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def cluster_links(posts: DataFrame, sets: DataFrame, percent: int, strays_at_once: int = 128, others_at_once: int = 256) -> DataFrame:
    """Links between components within clusters of long lists."""
    hub = posts.groupBy("token").agg(F.min("doc_id").alias("a"))
    clusters = components(posts.join(hub, "token").select("a", F.col("doc_id").alias("b"))).withColumnRenamed("component", "cluster")
    members = posts.select("doc_id", "component").distinct().join(clusters.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("cluster", F.coalesce("cluster", "doc_id"))
    members = staged(members, "cluster-members")
    largest = (
        members.groupBy("cluster", "component")
        .agg(F.count("*").alias("n"))
        .groupBy("cluster")
        .agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"))
        .select("cluster", F.col("top.component").alias("main"), ((F.col("all") - F.col("top.n") - 1) / strays_at_once + 1).cast("int").alias("n_i"), ((F.col("all") - 1) / others_at_once + 1).cast("int").alias("n_j"))
        .where(F.col("n_i") > 0)
    )
    rows = staged(members.join(largest, "cluster").join(sets, "doc_id"), "cluster-sets")

    def dealt(block: str, n: str, over: str, n_over: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int").alias(block)
        return rows.where("component <> main" if block == "i" else "true").select("cluster", "doc_id", "component", "items", mine, F.explode(F.sequence(F.lit(0), F.col(n_over) - 1)).alias(over))

    keys = ["cluster", "i", "j"]
    strays, others = dealt("i", "n_i", "j", "n_j").groupBy(*keys), dealt("j", "n_j", "i", "n_i").groupBy(*keys)
    return staged(strays.cogroup(others).applyInPandas(_blocks_linked(percent), "a bigint, b bigint").distinct(), "cluster-links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, coords: int = 64, matches: int = 32) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept. Documents are linked when 100 times the
    common shingles reach `percent` times the shingles of both."""
    docs = docs.select("doc_id", "text")
    schema = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, sig array<bigint>"
    all_ = staged(docs.mapInArrow(_sketches(width, coords), schema), "sketches")
    rows = all_.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = rows.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    member = staged(
        rows.select("doc_id", "f1", "f2").join(classes, ["f1", "f2"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")), "classes"
    )
    copies = member.where("rep <> doc_id")
    # A document of several texts ties their classes together.
    tied = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.collect_set("rep").alias("reps")).where("a <> b")
    tied = tied.select("a", F.explode("reps").alias("b")).where("a <> b")
    # Of equal sets one goes on: rows of a class other than its smallest document are left out.
    alone = rows.join(classes, ["f1", "f2"], "left").where("rep IS NULL OR rep = doc_id").dropDuplicates(["doc_id", "f1", "f2"])
    sketches = alone.select("doc_id", "n_shingles", "sig")
    posts = staged(postings(sketches, coords, matches), "postings")
    sketches = staged(sketches.join(posts.select("doc_id").distinct(), "doc_id", "left_semi"), "posted")
    # The texts are shuffled once: the full sets of all documents that may have a partner.
    sets = docs.join(posts.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id bigint, items binary")
    sets = staged(sets, "posted-sets")
    args = (sets, sketches, matches, percent)
    first = staged(hub_pairs(posts), "hub-pairs")
    links = confirmed(first, *args)
    posts = open_lists(posts, components(links))
    more = open_pairs(posts.where(F.col("n") <= LONG_LIST), percent).join(first, ["a", "b"], "left_anti")
    links = links.unionByName(confirmed(more, *args)).unionByName(tied)
    links = links.unionByName(cluster_links(posts.where(F.col("n") > LONG_LIST), sets, percent))
    comp = components(links)
    return (
        all_.select("doc_id", "n_shingles", "f1", "f2")
        .join(classes, ["f1", "f2"], "left")
        .withColumn("rep", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
        .join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
