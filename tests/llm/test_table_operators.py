"""Mixing, sharding, archive, top-k and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronolith.llm import decontaminate, language, minhash, mixing, queries, sharding, token_files, topk, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, h bigint, bytes int, prefix string, pattern string, copies int"


def table(spark, rows):
    return spark.createDataFrame([(d, t, None, s, 1, 2, "a", "b", 3) for d, t, s in rows], SCHEMA)


# Mixing


def test_targets():
    for sizes, weights in (([100, 100, 100], [5, 2, 1]), ([1, 1000, 50], [5, 2, 1]), ([0, 10, 10], [5, 2, 1]), ([7], [5]), ([1, 2, 300, 4], [5, 2, 1, 5])):
        t = mixing.targets(sizes, weights)
        assert sum(t) == pytest.approx(sum(sizes))
        assert all(x <= 3 * s + 1e-9 for x, s in zip(t, sizes))
        free = [x / w for x, s, w in zip(t, sizes, weights) if 0 < x < 3 * s - 1e-9]
        assert max(free, default=0) == pytest.approx(min(free, default=0))
    assert mixing.targets([], []) == []


def best_cost(sizes, members, quotas, copies=3):
    """Least cost over a word's routes, one augmenting path of one word at a time (Bellman-Ford); a routed word
    earns 1000."""
    n, m = len(sizes), len(quotas)
    arcs = []  # [from, to, capacity, cost]; 0 is the start, then patterns, sources, the end

    def arc(a, b, cap, cost):
        arcs.append([a, b, cap, cost])
        arcs.append([b, a, 0, -cost])

    for p in range(n):
        for c in range(copies):
            arc(0, 1 + p, sizes[p], c)
        for s in members[p]:
            arc(1 + p, 1 + n + s, 10**9, 0)
    for s in range(m):
        arc(1 + n + s, 1 + n + m, quotas[s], 0)
    total = 0
    while True:
        dist, via = {0: 0}, {}
        for _ in range(n + m + 2):
            for i, (a, b, cap, cost) in enumerate(arcs):
                if cap and a in dist and dist[a] + cost < dist.get(b, 10**9):
                    dist[b], via[b] = dist[a] + cost, i
        if 1 + n + m not in dist:
            return total
        at = 1 + n + m
        while at:
            i = via[at]
            arcs[i][2] -= 1
            arcs[i ^ 1][2] += 1
            at = arcs[i][0]
        total += dist[1 + n + m] - 1000


def test_min_cost_flow():
    rng = random.Random(1)
    for _ in range(40):
        n, m = rng.randint(1, 6), rng.randint(1, 4)
        sizes = [rng.randint(0, 20) for _ in range(n)]
        members = [sorted(rng.sample(range(m), rng.randint(1, m))) for _ in range(n)]
        quotas = [rng.randint(0, 60) for _ in range(m)]
        flow = mixing.min_cost_flow(sizes, members, quotas)
        total = 0
        for p, f in enumerate(flow):
            used = sum(f.values())
            assert used <= 3 * sizes[p] and set(f) <= set(members[p]) and all(v > 0 for v in f.values())
            total += sum(c * max(0, min(sizes[p], used - c * sizes[p])) for c in range(3)) - 1000 * used
        assert all(sum(f.get(s, 0) for f in flow) <= quotas[s] for s in range(m))
        assert total == pytest.approx(best_cost(sizes, members, quotas))


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "c", "d", None, "Z"])) for i in range(400)]
    rows += [(500, None, "a"), (501, "", "b"), (502, "x " * 3000, "d"), (None, "one two", "a"), (7, "dup dup", "a"), (7, "dup dup", "a")]
    got = mixing.mix(table(spark, rows)).collect()
    again = mixing.mix(table(spark, rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((d, s, len((t or "").split())) for d, t, s in rows)
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == x) for x in names]
    goal = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for name, size, want in zip(names, sizes, goal):
        mine = [r for r in got if r["source"] == name]
        assert {(r["source_size"], round(r["target"], 6)) for r in mine} == {(size, round(want, 6))}
        assert all(0 <= r["copies"] <= 3 for r in mine)
        assert abs(sum(r["copies"] * r["size"] for r in mine) - want) <= max(r["size"] for r in mine) / 2 + 1
        assert max(r["copies"] for r in mine) - min(r["copies"] for r in mine) <= 1
    assert mixing.mix(table(spark, [])).count() == 0
    taken = Counter({(r["doc_id"], r["source"]): r["copies"] for r in got})
    out = mixing.repeated(table(spark, rows), mixing.mix(table(spark, rows)))
    assert out.columns == table(spark, []).columns
    assert Counter((r["doc_id"], r["source"]) for r in out.collect()) == Counter({k: n * sum((d, s) == k for d, _, s in rows) for k, n in taken.items() if n})


def test_mix_of_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, "w " * 10, s) for i, s in enumerate([["a"]] * 10 + [["b", "a"]] * 10 + [["b"]] * 2)], "doc_id bigint, text string, source array<string>")
    got = mixing.mix(docs, weights=(1, 1))
    taken = got.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.max("quota").alias("quota")).collect()
    assert all(abs(r["n"] - r["quota"]) <= 5 for r in taken) and abs(sum(r["n"] for r in taken) - 320) <= 15


# Shards


def brute_shards(sizes, limit):
    out = {}

    def split(rows, depth, prefix):
        if sum(b for _, _, b in rows) <= limit or len({h for _, h, _ in rows}) == 1 or depth == sharding.BITS:
            for i, _, _ in rows:
                out[i] = (depth, prefix)
            return
        for bit in (0, 1):
            part = [r for r in rows if r[1] >> (sharding.BITS - depth - 1) & 1 == bit]
            if part:
                split(part, depth + 1, prefix * 2 + bit)

    if sizes:
        split(sizes, 0, 0)
    return out


@pytest.mark.parametrize("limit", [50, 700, 10**6])
def test_shards(spark, limit):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 90), None) for i in range(300)] + [(300, None, None), (301, "é" * 400, None), (None, "abc", None), (5, "again", None), (5, "x" * 60, None)]
    got = sharding.shard(table(spark, rows), limit).collect()
    hashes = [int(hashlib.md5(("null" if d is None else str(d)).encode()).hexdigest()[:15], 16) for d, _, _ in rows]
    want = brute_shards([(i, h, len((t or "").encode())) for i, (h, (_, t, _)) in enumerate(zip(hashes, rows))], limit)
    assert Counter((r["doc_id"], r["bytes"], r["depth"], r["prefix"]) for r in got) == Counter((d, len((t or "").encode()), *want[i]) for i, (d, t, _) in enumerate(rows))
    sums = defaultdict(int)
    for r in got:
        sums[r["depth"], r["prefix"]] += r["bytes"]
    assert all(r["shard_bytes"] == sums[r["depth"], r["prefix"]] and r["oversize"] == (r["shard_bytes"] > limit) for r in got)
    assert all(len(r["shard"]) == r["depth"] and int(r["shard"] or "0", 2) == r["prefix"] for r in got)
    path = sharding.write_shards(table(spark, rows), limit)
    assert spark.read.parquet(path).count() == len(rows)


def test_no_shards(spark):
    assert sharding.shard(table(spark, []), 10).count() == 0


# Archive


def test_archive(spark):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://a/1", big), (2, "http://a/2", "small"), (3, "http://a/3", "small"), (4, None, None), (5, "http://a/5", ""), (6, "http://a/\n6", big), (9, "u", big + "é"), (9, "u", big), (None, "n", big), (10, "v", "y" * 999), (11, "v", "y" * 999), (12, "v", "z" * 1000), (13, "v", "z" * 1000)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, digest string, header string")
    path = warc.write_archive(pages)
    got = warc.read_archive(spark, path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({(h or "") for _, _, h in rows})
    want = Counter()
    for p, u, h in rows:
        body = (h or "").encode()
        top = max((q for q, _, x in rows if (x or "") == (h or "") and q is not None), default=None)
        revisit = len(body) >= 1000 and p != top
        want[p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top if revisit else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_sha1"], r["record_type"], r["refers_to"]) for r in got.collect()) == want
    for r in warc.records(got).join(got.select("page_id", "payload", "record_type"), "page_id").where("page_id IS NOT NULL AND page_id <> 9").collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest == (b"" if r["record_type"] == "revisit" else bytes(r["payload"])) + b"\r\n\r\n" and length == len(rest) - 4
    assert warc.read_archive(spark, warc.write_archive(pages.limit(0))).count() == 0


def test_archive_notices_damage(spark, tmp_path):
    path = warc.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id bigint, url string, html string"))
    other = f"file://{tmp_path}/damaged"
    spark.read.parquet(f"{path}/headers").write.parquet(f"{other}/headers")
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.encode(F.lit("abd"), "UTF-8")).write.parquet(f"{other}/payloads")
    with pytest.raises(Exception, match="payload differs"):
        warc.read_archive(spark, other).collect()


# Top-k


def test_top_k(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 16))
    vectors = [(i, (base[i % 6] + rng.normal(size=16) * 0.1).astype("float32").tolist()) for i in range(300)]
    vectors += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 16), (303, [float("inf")] * 16), (304, []), (305, [2.0]), (306, vectors[0][1]), (307, vectors[0][1]), (None, vectors[0][1]), (20, vectors[3][1])]
    df = spark.createDataFrame([(i, v, 1, [1]) for i, v in vectors], "vec_id bigint, embedding array<float>, score int, cells array<int>")
    got = topk.top_k(df.where("vec_id % 20 = 0"), df, k=7, block=16, group=3, at_once=5).collect()
    good = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries_ = {}
    for i, v in good:
        if i % 20 == 0:
            queries_[i] = min(queries_.get(i, v), v)
    want = set()
    for q, v in queries_.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:7])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.top_k(df.limit(0), df).count() == 0 == topk.top_k(df, df.limit(0)).count()


def test_blocks_are_skipped():
    rng = np.random.default_rng(5)
    parts = [(np.arange(k * 50, k * 50 + 50), rng.integers(0, 5, (50, 8)) + 100 * np.eye(8, dtype=int)[k % 8]) for k in range(40)]
    q = 100 * np.eye(8, dtype=np.int64)
    ids, scores, scored = topk.best_of_blocks(np.arange(8) - 8, q, parts, 20)
    assert scored < 8 * 40 / 3
    for i in range(8):
        all_ = sorted((-int(q[i] @ m[j]), int(n[j])) for n, m in parts for j in range(50))[:20]
        assert [(-s, d) for s, d in all_] == list(zip(scores[i].tolist(), ids[i].tolist()))


# Pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(6)
    vocab = {x: ["".join(random.Random(f"{x}{i}").choice(s) for _ in range(6)) for i in range(300)] for x, s in (("aa", "abcdefg"), ("bb", "mnopqrs"))}

    def text(lang, n):
        return " ".join(rng.choices(vocab[lang], k=n))

    bench = [(i, text("aa", 20)) for i in range(5)]
    rows = [(i, text(lang, rng.randint(30, 90)), lang, f"s{i % 4}", 0) for i in range(120) for lang in [rng.choice(list(vocab))]]
    rows += [(200 + i, rows[i][1], rows[i][2], "s1", 0) for i in range(15)]
    rows += [(220 + i, rows[20 + i][1] + " tail", rows[20 + i][2], "s2", 0) for i in range(10)]
    rows += [(240 + i, text("aa", 30) + " " + bench[i][1] + " " + text("aa", 30), "aa", "s0", 0) for i in range(5)]
    rows += [(250, None, None, "s0", 0), (251, "", "aa", "s0", 0), (252, "123 456", "aa", None, 0), (253, text("bb", 40), "bb", None, 0)]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"file://{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"file://{at}/benchmark.parquet")
    return f"file://{at}", rows, bench


def test_pipeline(spark, corpus):
    at, rows, bench = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        if name == "language_id":
            kept = [r for r in kept if r[1] and re.search("[a-z]", r[1])]
        elif name == "near_dedup":
            sets = {r[0]: {tuple(r[1].split()[i : i + 5]) for i in range(max(1, len(r[1].split()) - 4))} for r in kept}
            kept = [r for r in kept if not any(o < r[0] and 5 * len(sets[o] & s) >= 4 * len(sets[o] | s) for s in [sets[r[0]]] for o in sets)]
        elif name == "decontamination":
            kept = [r for r in kept if not any(b in r[1] for _, b in bench)]
        else:
            taken = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(kept, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
            kept = [r for r in kept for _ in range(taken[r[0]])]
        assert ids == Counter(r[0] for r in kept), name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    encode = token_files.Encoder(open(token_files.public_vocabulary(), encoding="utf-8").read())
    want, start = [], 0
    for r in sorted(kept, key=lambda r: r[0]):
        ids = np.append(encode.plain(r[1]), 0).astype("<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, at).collect()), key=lambda r: r[1]) == want


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "token_output"]
    assert decontaminate and language and minhash


def test_topk_of_large_components(spark):
    rows = [(1, [2e15, 0.0, 0.0, 0.0]), (2, [1.0, 1.0, 1.0, 1.0]), (3, [0.0, 2.0, None, 0.0]), (4, [float("inf"), 0.0, 0.0, 0.0]), (5, [-1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(vectors.where("vec_id = 2"), vectors, k=5).orderBy("rank").collect()]
    assert got == [(2, 1, 1, 64 * 64 * 2 * 10**15), (2, 2, 5, 0)]


def test_topk_query_of_repeated_ids(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(8)
    rows = [(i % 70, v.astype("float32").tolist()) for i, v in enumerate(rng.normal(size=(150, 6)))] + [(20, [1.0] * 6)] * 2
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = queries.op3_topk(spark, f"file://{tmp_path}").select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(queries.SQL["op3_topk"]).fetchall())


def test_topk_deals_both_sides_alike(spark):
    """Without one partition for all, queries and blocks of a key have to meet."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(240, 4)))]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(keep, ("61", "false"), strict=True):
            spark.conf.set(k, v)
        got = topk.top_k(vectors.where("vec_id % 20 = 0"), vectors, k=3, block=8, group=4, at_once=3).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    cells = [np.floor(64 * np.array(v)).astype(int) for _, v in rows]
    want = set()
    for q in range(0, 240, 20):
        best = sorted((-int(cells[q] @ c), i) for i, c in enumerate(cells) if i != q)[:3]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_staged_tables_leave_no_shuffle_files(spark):
    import time
    from pathlib import Path

    from chronolith.llm.common import staged

    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f.name for d in local for f in Path(d).rglob("shuffle_*.data")}
    before = files()
    held = staged(spark.range(1000).repartition(4, "id"), "t")
    for _ in range(100):  # executors are told, not waited for
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert held.count() == 1000
