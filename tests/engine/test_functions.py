"""Scalar functions, patterns, sources, blame and streams on small cases."""

from __future__ import annotations

import hashlib
import os
import random
import struct
import subprocess
import zlib

import pytest
from pyspark.sql import functions as F

from chronolith.functions import globs, text
from chronolith.operators import blame, checks, grouping, history, objects, refs, trees
from chronolith.operators.text_diff import matches, split_lines
from chronolith.plans import stages
from chronolith.sources import files
from chronolith.streaming import logs


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize("pattern, yes, no", [
    ("*.c", ["a.c", ".c"], ["a/b.c", "a.cc"]), ("**/x", ["x", "a/x", "a/b/x"], ["ax"]), ("a/**", ["a/b", "a/b/c"], ["b/a"]), ("a/**/b", ["a/b", "a/x/y/b"], ["a/xb"]),
    ("[a-c]?", ["bx"], ["dx", "b/"]), ("[!a]", ["b"], ["a"]), ("\\*", ["*"], ["a"]), ("[[:digit:]]x", ["1x"], ["ax"]), ("[a", [], ["a", "[a"]),
])
def test_globs(spark, pattern, yes, no):
    got = column(spark, yes + no, lambda v: globs.glob_match(v, pattern))
    assert got == [True] * len(yes) + [False] * len(no)


def test_pathspecs_rules_and_refspecs(spark):
    paths = ["a.c", "dir/a.c", "dir/b.h", "DIR/x", "other"]
    assert column(spark, paths, lambda v: globs.pathspec(v, ["*.c"])) == [True, True, False, False, False]
    assert column(spark, paths, lambda v: globs.pathspec(v, [":(glob)*.c"])) == [True, False, False, False, False]
    assert column(spark, paths, lambda v: globs.pathspec(v, ["dir", ":!*.h"])) == [False, True, False, False, False]
    assert column(spark, paths, lambda v: globs.pathspec(v, [":(icase)dir/"])) == [False, True, True, True, False]
    assert column(spark, paths, lambda v: globs.last_rule(v, ["*.c", "!a.c", "dir/", "# x"])) == [False, True, True, False, False]
    assert column(spark, ["refs/a/x", "refs/a", "refs/ab", "refs/a/y"], lambda v: globs.hidden(v, ["refs/a", "!refs/a/y"])) == [True, True, False, False]
    assert column(spark, ["refs/heads/m/x", "refs/tags/a"], lambda v: globs.refspec_target(v, "+refs/heads/*:refs/remotes/o/*")) == ["refs/remotes/o/m/x", None]


def test_scalars(spark):
    assert column(spark, ["a", ""], lambda v: text.object_id("blob", F.encode(v, "UTF-8"))) == [hashlib.sha1(b"blob 1\0a").hexdigest(), hashlib.sha1(b"blob 0\0").hexdigest()]
    message = "\n\none\n two \nthree\n\n\nbody\n\nKey: v\n more\nOther: w\n"
    assert column(spark, [message], text.subject) == ["one  two three"]
    assert column(spark, [message], text.body) == ["body\n\nKey: v\n more\nOther: w\n"]
    assert [[tuple(t) for t in x] for x in column(spark, [message, "no trailers", "a: b"], text.trailers)] == [[("Key", "v more"), ("Other", "w")], [], []]
    assert column(spark, ["Fix: a/b..c!", "--x--"], text.sanitized_subject) == ["Fix-a-b.c", "x"]
    assert column(spark, ["Yes", "off", "", "2k", "0", "x", None], text.parse_bool) == [True, False, False, True, False, None, None]
    assert column(spark, ["1k", "0x10", "010", "-3g", "9223372036854775808", "8g8", "9"], text.parse_int) == [1024, 16, 8, -3 << 30, None, None, 9]
    assert column(spark, ["+0130", "-0330", "x"], text.offset_minutes) == [90, -210, None]
    assert column(spark, [90, -210, 0], text.offset_text, "int") == ["+0130", "-0330", "+0000"]
    assert column(spark, [5, 100, 7200, 86400 * 3, 86400 * 20, 86400 * 100, 86400 * 400, 86400 * 3650], text.relative_date, "bigint") == ["5 seconds ago", "2 minutes ago", "2 hours ago", "3 days ago", "3 weeks ago", "3 months ago", "1 year, 1 month ago", "10 years ago"]
    assert column(spark, ["it's !"], text.shell_quote) == ["'it'\\''s '\\!''"]
    assert column(spark, ["a%20b+c", "%zz"], text.percent_decoded) == ["a b+c", "%zz"]
    assert column(spark, ["refs/heads/a", "refs/heads/.a", "refs/a..b", "refs/a.lock", "a", "refs/a b", "refs/a/"], text.valid_ref_name) == [True] + [False] * 6
    assert column(spark, ["a/b", ".git/x", "a/.GIT", "a/git~1", "..", "con", "a:b", "x.git"], text.safe_path) == [True] + [False] * 6 + [True]
    pointer = f"version https://x/spec/v1\noid sha256:{'a' * 64}\nsize 12\n"
    assert column(spark, [pointer, "x"], lambda v: text.large_pointer(v)["size"]) == [12, None]
    assert column(spark, ["$Id$ $Id: x $"], lambda v: text.ident_expanded(v, F.lit("f00"))) == ["$Id: f00 $ $Id: f00 $"]
    assert column(spark, ["# c\n\na  \n\n\n\nb\n\n"], text.cleaned_message) == ["a\n\nb\n"]
    assert [tuple(r) for r in column(spark, ["https://u@h:81/p?q", "u@h:p/q", "/local"], lambda v: F.struct(*[text.url_parts(v)[k].alias(k) for k in ("scheme", "user", "host", "port", "path")]))] == [("https", "u", "h", 81, "/p?q"), ("ssh", "u", "h", None, "p/q"), (None, None, None, None, None)]
    assert [tuple(r) for r in column(spark, ["A B <a@b> 12 +0100"], lambda v: F.struct(*[c.alias(k) for k, c in text.identity(v).items()]))] == [("A B", "a@b", 12, 60)]
    assert column(spark, [b"GIF89a", b"<html>", b"hi", b"\x00\x01"], text.media_type, "binary") == ["image/gif", "text/html; charset=utf-8", "text/plain; charset=utf-8", "application/octet-stream"]


def test_version_sort(spark):
    df = spark.createDataFrame([(f"v{x}", "o") for x in ("1.10", "1.9", "1.2.3", "0.100")], "name string, oid string")
    assert [r["name"] for r in refs.sort_refs(df, ["version:name"]).collect()] == ["v0.100", "v1.2.3", "v1.9", "v1.10"]


def test_transaction_and_symbolic(spark):
    table = spark.createDataFrame([("refs/heads/a", "1"), ("refs/heads/b", "2")], "name string, oid string")
    edits = spark.createDataFrame([("refs/heads/a", "3", "1"), ("refs/heads/c", "4", None), ("refs/heads/b", None, "2")], "name string, new_oid string, expected_oid string")
    after, bad = refs.apply_transaction(table, edits)
    assert sorted(map(tuple, after.collect())) == [("refs/heads/a", "3"), ("refs/heads/c", "4")] and bad.count() == 0
    after, bad = refs.apply_transaction(table, edits.unionByName(spark.createDataFrame([("refs/heads/d", "5", "9")], edits.schema)))
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, table.collect())) and bad.count() == 1
    sym = spark.createDataFrame([("HEAD", None, "x"), ("x", None, "y"), ("y", "1", None), ("z", None, "gone")], "name string, oid string, symbolic string")
    assert dict(map(tuple, refs.resolve_symbolic(sym).collect())) == {"HEAD": "1", "x": "1", "y": "1", "z": None}


def test_closure_of_random_graphs(spark):
    rng = random.Random(1)
    parents = {i: rng.sample(range(i), min(i, rng.randint(0, 2))) for i in range(60)}
    rows = [(str(i), *(map(str, p + [None] * (2 - len(p))))) for i, p in parents.items()]
    commits = spark.createDataFrame([(o, *(None if x == "None" else x for x in p)) for o, *p in rows], "oid string, parent1 string, parent2 string")
    far = {i: {i: 0} for i in parents}
    for i, ps in parents.items():
        for p in ps:
            for a, d in far[p].items():
                far[i][a] = max(far[i].get(a, 0), d + 1)
    got = {(int(r["node"]), int(r["ancestor"])): r["far"] for r in history.closure(commits).collect()}
    assert got == {(i, a): d for i, m in far.items() for a, d in m.items()}
    seen = history.reachable(history.edges(commits), commits.where("oid IN ('59', '40')"))
    assert {int(r["oid"]) for r in seen.collect()} == set(far[59]) | set(far[40])


def test_line_origins(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for file in range(3):
        lines, origin = [], []
        for seq in range(1, 7):
            new, came = [], []
            for line, o in zip(lines, origin):
                if rng.random() < 0.8:
                    new.append(line)
                    came.append(o)
                if rng.random() < 0.3:
                    new.append(f"{rng.random()}\n")
                    came.append(None)
            new.append(f"{rng.random()}\n")
            came.append(None)
            assert matches(split_lines("".join(lines)), new) is not None
            lines, origin = new, [o if o else (seq, i) for i, o in enumerate(came)]
            rows.append((file, seq, "".join(lines)))
        want.update({(file, i): o for i, o in enumerate(origin)})
    got = blame.line_origins(spark.createDataFrame(rows, "file bigint, seq bigint, text string"))
    assert {(r["file"], r["line"]): (r["origin_seq"], r["origin_line"]) for r in got.collect()} == want
    assert blame.blame_hunks(got).agg(F.sum("count")).first()[0] == len(want)


def test_similarity(spark):
    a = "\n".join(f"line {i}" for i in range(100)) + "\n"
    b = a.replace("line 7\n", "other\n")
    blobs = spark.createDataFrame([(1, a), (2, b), (3, "x" * 500), (4, "")], "id bigint, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "old_id bigint, new_id bigint")
    got = {(r["old_id"], r["new_id"]): r["score"] for r in trees.similarity(pairs, blobs).collect()}
    assert got == {(1, 2): (len(a) - 7) * 60000 // len(a)}


def test_three_way_and_notes(spark):
    t = lambda rows: spark.createDataFrame(rows, "path string, oid string")
    got = {r["path"]: (r["oid"], r["conflict"]) for r in trees.three_way(t([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")]), t([("a", "2"), ("b", "1"), ("c", "2"), ("e", "1")]), t([("a", "1"), ("c", "3"), ("d", "2"), ("e", "2")])).collect()}
    assert got == {"a": ("2", None), "b": (None, None), "c": (None, "both_modified"), "d": (None, "modify_delete"), "e": (None, "both_added")}


def test_object_filters_and_rules(spark):
    o = spark.createDataFrame([("a", "blob", 10, 1), ("b", "blob", 5000, 2), ("c", "tree", 1, 0), ("d", "commit", 1, 0)], "oid string, kind string, size bigint, depth int")
    names = lambda df: sorted(r["oid"] for r in df.collect())
    assert names(objects.filtered(o, "blob:none")) == ["c", "d"]
    assert names(objects.filtered(o, "blob:limit=1k")) == ["a", "c", "d"]
    assert names(objects.filtered(o, "combine:tree:2+blob:limit=1k")) == ["a", "c", "d"]
    entries = spark.createDataFrame([("t", 0, "b", "100644", "1" * 40), ("t", 1, "a", "100644", "0" * 40), ("t", 2, ".git", "100644", "2" * 40), ("u", 0, "a", "100644", "1" * 40), ("u", 1, "a.c", "100644", "1" * 40)], "oid string, pos int, name string, mode string, entry_oid string")
    assert sorted((r["oid"], r["id"]) for r in checks.problems(entries, checks.tree_rules()).collect()) == [("t", "hasDotgit"), ("t", "nullSha1")]
    assert [(r["oid"], r["id"]) for r in checks.tree_order_problems(entries).collect()] == [("t", "treeNotSorted")]


def test_files(spark, tmp_path):
    (tmp_path / "packed").write_text("# pack-refs with: peeled\n" + "a" * 40 + " refs/heads/x\n" + "b" * 40 + " refs/tags/t\n^" + "c" * 40 + "\n")
    got = files.packed_refs(spark, f"file://{tmp_path}/packed")
    assert sorted(map(tuple, got.collect())) == [("refs/heads/x", "a" * 40, None), ("refs/tags/t", "b" * 40, "c" * 40)]
    files.write_packed_refs(got, f"file://{tmp_path}/again")
    assert sorted(map(tuple, files.packed_refs(spark, f"file://{tmp_path}/again").collect())) == sorted(map(tuple, got.collect()))
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "HEAD").write_text(f"{'0' * 40} {'a' * 40} N M <n@m> 100 +0130\tfirst\nbad line\n")
    log = files.reflogs(spark, f"file://{tmp_path}/logs", "logs").orderBy("seq").collect()
    assert [(r["ref"], r["seq"], r["malformed"], r["when_secs"], r["offset_minutes"], r["message"]) for r in log] == [("HEAD", 1, False, 100, 90, "first"), ("HEAD", 2, True, None, None, "")]
    for name, body in (("low", '[core]\n\tbare = false ; no\n[remote "o"]\n\turl = "x#y"\n'), ("high", "[Core]\n\tBare\n")):
        (tmp_path / name).write_text(body)
    conf = files.effective(files.config(spark, [f"file://{tmp_path}/low", f"file://{tmp_path}/high"]))
    assert sorted((r["section"], r["subsection"], r["key"], r["value"]) for r in conf.collect()) == [("core", None, "bare", "true"), ("remote", "o", "url", "x#y")]
    (tmp_path / "mbox").write_text("From abc Mon Sep 17 00:00:00 2001\nFrom: A <a@b>\nDate: now\nSubject: [PATCH 1/2] do\n it\n\nWhy.\n---\n x | 1 +\n\ndiff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -0,0 +1 @@\n+y\n-- \n2.1\n")
    m = files.mailbox(spark, f"file://{tmp_path}/mbox").collect()
    assert [(r["author"], r["subject"], r["body"].strip()) for r in m] == [("A <a@b>", "do it", "Why.")] and m[0]["patch"].startswith("diff --git")


def pack_of(entries):
    out = b"PACK" + struct.pack(">II", 2, len(entries))
    for kind, body, ref in entries:
        n = len(body)
        byte = kind << 4 | n & 15
        n >>= 4
        while n:
            out += bytes([byte | 128])
            byte, n = n & 127, n >> 7
        out += bytes([byte]) + (bytes.fromhex(ref) if ref else b"") + zlib.compress(body)
    return out + hashlib.sha1(out).digest()


def test_objects_and_packs(spark, tmp_path):
    base = b"hello world, hello world\n" * 20
    name = hashlib.sha1(b"blob %d\0" % len(base) + base).hexdigest()
    new = base[:100] + b"!" + base[100:200]
    delta = bytes([len(base) & 127 | 128, len(base) >> 7, len(new) & 127 | 128, len(new) >> 7]) + bytes([0x90, 100]) + b"\x01!" + bytes([0x91, 100, 100])
    (tmp_path / "x.pack").write_bytes(pack_of([(7, delta, name), (3, base, None)]))
    got = {bytes(r["content"]): (r["oid"], r["kind"]) for r in files.packs(spark, f"file://{tmp_path}/x.pack").collect()}
    assert got == {base: (name, "blob"), new: (hashlib.sha1(b"blob %d\0" % len(new) + new).hexdigest(), "blob")}
    tree = b"100644 a.txt\0" + bytes.fromhex(name) + b"40000 dir\0" + bytes(20)
    commit = b"tree %s\nparent %s\nauthor A <a@b> 5 +0100\ncommitter C <c@d> 6 -0030\n\nsubject\n\nbody\n" % (b"1" * 40, b"2" * 40)
    (tmp_path / "loose").mkdir()
    for i, (kind, body) in enumerate((("tree", tree), ("commit", commit))):
        (tmp_path / "loose" / str(i)).write_bytes(zlib.compress(f"{kind} {len(body)}".encode() + b"\0" + body))
    o = files.loose_objects(spark, f"file://{tmp_path}/loose")
    assert [(r["pos"], r["mode"], r["name"]) for r in files.tree_entries(o).orderBy("pos").collect()] == [(0, "100644", "a.txt"), (1, "040000", "dir")]
    c = files.commits(o).first()
    assert (c["tree"], c["parents"], c["author"]["name"], c["committer"]["offset_minutes"], c["message"]) == ("1" * 40, ["2" * 40], "A", -30, "subject\n\nbody\n")
    assert objects.verify(o).count() == 0


def test_put_stream(spark, tmp_path):
    source = tmp_path / "in"
    schema = "oid string, n int"
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], schema).coalesce(1).write.parquet(f"file://{source}/1")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{source}/*")
    spark.createDataFrame([("b", 2), ("c", 3)], schema).coalesce(1).write.parquet(f"file://{source}/2")
    logs.put_stream(stream(), f"file://{tmp_path}/store")
    assert sorted(r["oid"] for r in spark.read.parquet(f"file://{tmp_path}/store").collect()) == ["a", "b", "c"]
    spark.createDataFrame([("c", 3), ("d", 4)], schema).coalesce(1).write.parquet(f"file://{source}/3")
    for _ in range(2):  # a later call, and one more over the same entries
        logs.put_stream(stream(), f"file://{tmp_path}/store")
        assert sorted(r["oid"] for r in spark.read.parquet(f"file://{tmp_path}/store").collect()) == ["a", "b", "c", "d"]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="share"):
        stages.shared_dir(Session())


def test_mailmap_and_geometry(spark):
    people = spark.createDataFrame([("A", "a@x"), ("B", "B@X"), ("C", "b@x")], "name string, email string")
    mm = spark.createDataFrame([("New A", "n@x", None, "A@x"), ("New C", "c@x", "c", "b@x")], "name string, email string, old_name string, old_email string")
    assert sorted((r["name"], r["canonical_name"]) for r in grouping.canonical(people, mm).collect()) == [("A", "New A"), ("B", "B"), ("C", "New C")]
    packs = spark.createDataFrame([("r", f"p{i}", n) for i, n in enumerate((1, 1, 5, 100))], "repo string, pack string, objects bigint")
    assert sorted((r["pack"], r["roll_up"]) for r in grouping.geometry(packs).collect()) == [("p0", True), ("p1", True), ("p2", False), ("p3", False)]


def test_nothing_else_imports_the_corpus_operators():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import sys; sys.modules['chronolith.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(k.startswith('op1') for k in e.queries())"
    subprocess.run(["python", "-c", code], cwd=root, check=True, timeout=120)


def test_line_origins_take_twice_the_rows_of_the_steps(spark, monkeypatch):
    """Each round keeps every second version's lines; the rows of all tables together don't grow with the rounds."""
    made = []
    keep = blame.staged
    monkeypatch.setattr(blame, "staged", lambda df, tag: made.append(keep(df, tag)) or made[-1])
    monkeypatch.setattr(blame, "discard", lambda df: None, raising=False)
    rng = random.Random(5)
    rows, text = [], [str(rng.random()) for _ in range(6)]
    for seq in range(1, 65):
        rows.append((1, seq, "\n".join(text) + "\n"))
        text[rng.randrange(1, 6)] = str(rng.random())
    got = blame.line_origins(spark.createDataFrame(rows, "file bigint, seq bigint, text string")).collect()
    final = rows[-1][2].splitlines()
    want = {(1, i, min(s for _, s, t in rows if x in t.splitlines()), i) for i, x in enumerate(final)}
    assert {tuple(r) for r in got} == want and len(got) == 6
    assert sum(t.count() for t in made) < 3 * 64 * 6
