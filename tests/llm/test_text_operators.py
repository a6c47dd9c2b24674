"""Line dedup, near-dedup, passages, decontamination, language and token files against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolith.llm import common, decontaminate, language, line_dedup, minhash, substrings, token_files
from chronolith.llm.common import shingles, word_ids
from chronolith.llm.graph import components

SCHEMA = "doc_id bigint, text string, lang string, source string, h1 string, token int, line string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, None, None, "x", 1, "y") for d, t in rows], SCHEMA)


def odd_rows(rng):
    long_ = words(rng, 4000)
    return [(1, None), (2, ""), (3, " \t "), (4, "word"), (5, long_), (6, long_ + " more"), (7, "one two three"), (8, "one two three"), (9, "One  two\nthree"), (None, "one two three"), (10, "é ü ß " * 30), (11, "x"), (11, "x"), (11, words(rng, 80))]


# Lines


def clean_lines(rows, min_chars=40, min_docs=5):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    docs_of = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                docs_of[key(line)].add(-1 if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(docs_of[key(x)]) < min_docs or max(docs_of[key(x)]) == (-1 if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches, fan_out", [(1, 2), (4, 2), (7, 3)])
def test_lines(spark, batches, fan_out):
    rng = random.Random(3)
    common = [words(rng, 12) for _ in range(6)] + ["É" + "a" * 39, "b" * 39, "B" * 40]
    rows = [(i, "\n".join(rng.choice([c, f"  {c.upper()}\t", words(rng, 10), ""]) for c in rng.choices(common, k=8))) for i in range(60)]
    rows += odd_rows(rng) + [(70, "b" * 40), (70, ("b" * 40 + "\n") * 3), (None, "b" * 40)]
    got = line_dedup.dedup_lines(table(spark, rows), batches=batches, fan_out=fan_out).collect()
    assert sorted(((r["doc_id"], len(r["lines"]), len(r["lines"]) - len(r["kept_lines"]), "\n".join(r["kept_lines"])) for r in got), key=str) == clean_lines(rows)


def test_runs_are_compacted(spark):
    runs = line_dedup.Runs(spark, 2, 5)
    for i in range(5):
        runs.add(spark.createDataFrame([(i % 3, 0, 1, i)], "h1 bigint, h2 bigint, n_docs bigint, last_doc bigint"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert sorted(map(tuple, runs.merged(runs.names()).collect())) == [(0, 0, 2, 3), (1, 0, 2, 4), (2, 0, 1, 2)]
    runs.drop(runs.names())


def test_no_lines(spark):
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


# Near copies


def near_truth(rows, width, percent=80):
    def shingle_set(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets = [(d, shingle_set(t)) for d, t in rows]
    comp = {d: d for d, _ in sets if d is not None}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, u in sets[:i]:
            if a is not None and b is not None and s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else root(d) if s else d) for d, s in sets), key=str)


@pytest.mark.parametrize("width, long_list", [(4, 32), (5, 4), (5, 1)])
def test_near_copies(spark, width, long_list, monkeypatch):
    monkeypatch.setattr(minhash, "LONG_LIST", long_list)
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = words(rng, rng.randint(20, 120)).split()
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                w[rng.randrange(len(w))] = words(rng, 1)
            rows.append((len(rows) + 20, " ".join(w)))
    base = words(rng, 60).split()
    for i in range(70):  # about half of these pairs are linked
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((300 + i, " ".join(w)))
    passage = words(rng, 50)
    rows += [(200 + i, f"{words(rng, 30)} {passage} {words(rng, 30)}") for i in range(20)] + odd_rows(rng)
    got = minhash.near_duplicates(table(spark, rows), width=width)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == near_truth(rows, width)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got.collect())


def test_no_near_copies(spark):
    assert minhash.near_duplicates(table(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 90)] + [(rng.randrange(100, 140), rng.randrange(100, 140)) for _ in range(25)] + [(500, i) for i in range(501, 560)]
    comp = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: c for x, c in comp.items() if x != c}


# Passages


def test_compact_windows():
    """The wide nodes of the Cartesian tree over the hashes of each text, as far as t places reach, several texts side by side."""
    rng = np.random.default_rng(1)
    t = 4
    for _ in range(50):
        sizes = rng.integers(0, 30, 5)
        h = rng.permutation(sizes.sum()).astype(np.uint64) << np.uint64(20)
        want, at = [], 0
        for n in sizes.tolist():
            one = h[at : at + n].tolist()
            for c in range(n):
                a = b = c
                while a > max(0, c - t + 1) and one[a - 1] > one[c]:
                    a -= 1
                while b < min(n, c + t) - 1 and one[b + 1] > one[c]:
                    b += 1
                if b - a + 1 >= t:
                    want.append((at + c, at + a, at + b))
            at += n
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        starts = np.concatenate([np.arange(x, x + n - t + 1) for x, n in zip(begins, sizes, strict=True) if n >= t] or [np.empty(0, np.int64)])
        if len(starts):
            assert sorted(zip(*(x.tolist() for x in substrings.compact_windows(h, starts, t)), strict=True)) == want


def test_passages(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randint(0, 200))) for i in range(100, 160)]
    passage, other = words(rng, 55), words(rng, 300)
    for i in range(100, 130, 3):
        w = rows[i - 100][1].split()
        k = rng.randint(0, len(w))
        rows[i - 100] = (i, " ".join([*w[:k], passage, *w[k:]]))
    rows[40] = (140, rows[40][1] + " " + " ".join(other.split()[:150]))
    rows[41] = (141, " ".join(other.split()[90:260]) + "\n" + rows[41][1])
    line = words(rng, 20)
    rows += [(300 + i, f"{words(rng, 40)} {line} {words(rng, 40)}") for i in range(10)]  # too short to count
    rows += [(400, words(rng, 60)), *[(401 + i, "a b c d e f g h i j " * 6) for i in range(2)]] + odd_rows(rng)
    where, covered = defaultdict(set), defaultdict(set)
    for d, t in rows:
        w = (t or "").lower().split()
        for j in range(len(w) - 49):
            where[tuple(w[j : j + 50])].add(d)
    for d, t in rows:
        w = (t or "").lower().split()
        for j in range(len(w) - 49):
            if d is not None and len(where[tuple(w[j : j + 50])] - {None}) > 1:
                covered[d].update(range(j, j + 50))
    got = defaultdict(set)
    for r in substrings.repeated_passages(table(spark, rows)).collect():
        got[r["doc_id"]].update(range(r["start"], r["start"] + r["n_words"]))
        assert r["n_words"] >= 50 and r["other_id"] != r["doc_id"]
    assert set(got) == set(covered)
    assert all(covered[d] <= got[d] for d in covered)


def test_edited_passage():
    rng = random.Random(2)
    a = words(rng, 120).split()
    b = words(rng, 30).split() + a[20:50] + ["new"] + a[51:100] + words(rng, 30).split()
    x, y = (shingles(word_ids(" ".join(w)), 5) for w in (a, b))
    assert substrings.passages(x, y, [-10], 46, 80) == [(20, 96, 30, 106)]


def test_passages_that_hold_a_frequent_line(spark):
    """Two documents each share a passage round a line of very many documents, which are the hubs of its windows."""
    rng = random.Random(11)
    line = words(rng, 36)
    rows = [(i, f"{words(rng, 60)} {line} {words(rng, 60)}") for i in range(200)]
    for i in range(1000, 1060, 2):
        passage = f"{words(rng, 12)} {line} {words(rng, 12)}"
        rows += [(i + k, f"{words(rng, 60)} {passage} {words(rng, 60)}") for k in range(2)]
    got = defaultdict(set)
    for r in substrings.repeated_passages(table(spark, rows)).collect():
        got[r["doc_id"]].update(range(r["start"], r["start"] + r["n_words"]))
    assert set(got) == set(range(1000, 1060)) and all(set(range(60, 120)) <= x for x in got.values())


def stock_texts(rng, edit):
    """Texts of 60 stock phrases, and 30 pairs of documents with a passage of 72 words of them; edit changes the second."""
    phrases = [words(rng, 12) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(9))) for i in range(660)]
    for i in range(1000, 1060, 2):
        passage = " ".join(rng.choice(phrases) for _ in range(6)).split()
        rows += [(i + k, " ".join([*(rng.choice(phrases) for _ in range(2)), *(edit(passage) if k else passage), *(rng.choice(phrases) for _ in range(2))])) for k in range(2)]
    return rows


def test_exact_passages_of_stock_phrases(spark):
    rows = stock_texts(random.Random(15), lambda w: w)
    where, covered, got = defaultdict(set), defaultdict(set), defaultdict(set)
    for _ in range(2):
        for d, t in rows:
            w = t.split()
            for j in range(len(w) - 49):
                key = tuple(w[j : j + 50])
                if len(where[key]) > 1:
                    covered[d].update(range(j, j + 50))
                where[key].add(d)
    for r in substrings.repeated_passages(table(spark, rows)).collect():
        got[r["doc_id"]].update(range(r["start"], r["start"] + r["n_words"]))
    assert len(covered) >= 60 and all(covered[d] <= got[d] for d in covered)


def test_recall_of_near_passages_of_stock_phrases(spark):
    """One word in the passage is another: 0.86 of the shingles are common."""
    rng = random.Random(16)

    def edit(w):
        k = rng.randrange(5, len(w) - 5)
        return [*w[:k], words(rng, 1), *w[k + 1 :]]

    rows = dict(stock_texts(rng, edit))
    pairs = defaultdict(set)
    for r in substrings.repeated_passages(table(spark, list(rows.items()))).collect():
        if r["start"] < 48 and r["start"] + r["n_words"] > 72:
            pairs[r["doc_id"]].add(r["other_id"])
    found = sum(bool(pairs[i]) + bool(pairs[i + 1]) for i in range(1000, 1060, 2))
    assert found >= 54, found


def test_passages_with_words_put_in_or_left_out():
    """Whatever whole texts reach the similarity is found, both ways round."""
    rng, tried = random.Random(5), 0
    for n in (50, 56, 64, 80, 120):
        for k in range(1, 21):
            for at in (n // 4, n // 2, n - 12):
                a = words(rng, n).split()
                more, less = a[:at] + words(rng, k).split() + a[at:], a[:at] + a[at + k :]
                for b in (more, less):
                    x, y = (shingles(word_ids(" ".join(w)), 5) for w in (a, b))
                    sx, sy = set(x.tolist()), set(y.tolist())
                    if min(len(x), len(y)) >= 46 and 100 * len(sx & sy) >= 80 * len(sx | sy):
                        tried += 1
                        for p, q in ((x, y), (y, x)):
                            got = substrings.passages(p, q, [0], 46, 80)
                            assert got and all(min(v - u, z - s) >= 46 for u, v, s, z in got), (n, k, at, len(b))
                            for u, v, s, z in got:
                                i, j = set(p[u:v].tolist()), set(q[s:z].tolist())
                                assert 100 * len(i & j) >= 80 * len(i | j)
    assert tried > 100


def test_no_passages(spark):
    assert substrings.repeated_passages(table(spark, [])).count() == 0


# Benchmark passages


def least_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, ch in enumerate(pattern, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (ch != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_is_lossless():
    rng = random.Random(11)
    items = [(i, decontaminate.normal(words(rng, rng.randint(8, 40)))) for i in range(15)]
    index = decontaminate.Index(items)
    texts = []
    for _ in range(120):
        _, item = rng.choice(items)
        p = list(rng.choice(decontaminate.pieces_of(item, 120)))
        for _ in range(rng.randint(0, int(len(p) * 0.13))):
            k = rng.randrange(len(p))
            p[k : k + rng.randint(0, 1)] = rng.choice(["", "k", "kl"])
        texts.append(f"{words(rng, 12)} {''.join(p)} {words(rng, 12)}")
    found = index.search(texts)
    for row, text in enumerate(texts):
        norm = decontaminate.normal(text)
        want = {index.items[p] for p in range(len(index.texts)) if least_edits(index.texts[p], norm) <= index.edits[p]}
        assert {i for r, i in found if r == row} == want


def test_decontamination_odd_rows(spark):
    rng = random.Random(12)
    item = words(rng, 40)
    bench = spark.createDataFrame([(1, item, "a"), (2, None, "b"), (3, "", "c"), (None, item, "d"), (4, "short", "e"), (1, words(rng, 40), "f")], "item_id bigint, text string, doc_id string")
    docs = table(spark, [*odd_rows(rng), (50, "x " + item.upper().replace(" ", "\n ")), (None, item), (51, item[:150]), (52, words(rng, 50) + item + words(rng, 9))])
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=str) == [(50, 1), (51, 1), (52, 1), (None, 1)]
    in_blocks = decontaminate.contaminated(docs, bench, block_chars=100).collect()
    assert {r["doc_id"] for r in in_blocks} == {50, 51, 52, None}
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 == decontaminate.contaminated(docs.limit(0), bench).count()


def test_decontamination_of_long_texts(monkeypatch):
    rng = random.Random(13)
    monkeypatch.setattr(decontaminate, "SEGMENT", 500)
    item = decontaminate.normal(words(rng, 40))
    index = decontaminate.Index([(9, item)])
    for k in range(0, 400, 17):
        assert (0, 9) in index.search([words(rng, k) + " " + item + " " + words(rng, 300)])


def test_short_items_are_found_between_word_borders(spark):
    bench = spark.createDataFrame([(1, "Ab  c?"), (2, "short item of thirty-one chars."), (3, "x"), (4, "")], "item_id bigint, text string")
    docs = table(spark, [(1, "so ab c? yes"), (2, "so ab c?yes"), (3, "SHORT item\nof thirty-one chars."), (4, "a short item of thirty-one chars, no"), (5, "y x"), (6, "yx xy"), (7, None)])
    assert sorted((r["doc_id"], r["item_id"], r["edits"], r["start"]) for r in decontaminate.contaminated(docs, bench).collect()) == [(1, 1, 0, 3), (3, 2, 0, 0), (5, 3, 0, 2)]


def test_decontamination_in_halves(spark):
    rng = random.Random(14)
    items = [(i, decontaminate.normal(words(rng, 40))) for i in range(4)] + [(9, "z" * 400)]
    index = decontaminate.Index(items)
    texts = [f"{words(rng, 900)} {items[i][1]} {words(rng, 900)}" for i in range(4)] + ["z" * 3000, words(rng, 50)]
    want = index.found(texts)
    assert {k for k, _ in want} == {0, 1, 2, 3, 4}
    for most in (20000, 300, 10):
        got = index.found(texts, most)
        assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in want.items()}


# Language


def test_language(spark):
    rng = random.Random(4)
    vocab = {x: [words(random.Random(f"{x}{i}"), 1) + e for i in range(80) for e in ends] for x, ends in (("aa", ["um", "us"]), ("bb", ["ing", "ed"]), ("cc", ["ção", "é"]))}
    rows = []
    for i in range(300):
        lang = rng.choice(list(vocab))
        rows.append((i, " ".join(rng.choices(vocab[lang], k=rng.randint(5, 40))).capitalize() + ".", lang, None, "x", 1, "y"))
    rows += [(900, None, "aa", None, "x", 1, "y"), (901, "12 34 !", "bb", None, "x", 1, "y"), (902, "", None, None, "x", 1, "y"), (None, "Xyzum xyzus", "bb", None, "x", 1, "y"), (903, "qqqing zzzed", None, None, "x", 1, "y"), (904, "qqqing " * 20000, "bb", None, "x", 1, "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = language.identify(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = {r["doc_id"]: r for r in got.collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (d is None or zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    held = [(r[2], got[r[0]]["lang_pred"]) for r in rows[:300] if got[r[0]]["held_out"]]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert [got[d]["lang_pred"] for d in (900, 901, 902, None, 903, 904)] == ["und", "und", "und", "aa", "bb", "bb"]
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


def brute_force_language(counts, grams, languages, text):
    """The definition, word by word, with dictionaries."""

    def logs(table, item):
        share = [(table[item].get(x, 0) + 0.05) / sum(n.get(x, 0) + 0.05 for n in table.values()) for x in languages]
        return [np.log(v / sum(share)) for v in share]

    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not any(c.isalpha() for w in words for c in w):
        return "und"
    total = np.zeros(len(languages))
    for w in words:
        if w in counts:
            total += logs(counts, w)
            continue
        for n in (4, 3, 2, 1):
            known = [g for i in range(len(w) + 3 - n) if (g := f" {w} "[i : i + n]) in grams]
            if known:
                total += np.mean([logs(grams, g) for g in known], axis=0)
                break
        else:
            total -= np.log(len(languages))
    return languages[int(np.argmax(total))]


def test_language_by_brute_force(spark):
    rng = random.Random(21)
    langs = {"x": ["um", "us", "bat"], "y": ["ing", "bad", "ed"], "z": ["ção", "é", "bar"]}
    rows = [(i, " ".join(words(random.Random(rng.randint(0, 60)), 1) + rng.choice(ends) for _ in range(rng.randint(1, 6))), lang) for i in range(240) for lang, ends in [rng.choice(list(langs.items()))]]
    rows += [(300, "½ ² Ⅷ", "x"), (301, "½", None), (302, None, "x"), (303, "", "y"), (304, "½ bat", None), (305, "zzz " * 3000, None), (306, "12 34", None)]
    rows += [rows[0], rows[1]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    counts, grams = defaultdict(Counter), defaultdict(Counter)
    for d, t, lang in rows:
        if t and lang and zlib.crc32(str(d).encode()) % 3 != 1 and any(c.isalpha() for c in t):
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                counts[w][lang] += 1
                for n in (1, 2, 3, 4):
                    for i in range(len(w) + 3 - n):
                        grams[f" {w} "[i : i + n]][lang] += 1
    got = sorted((r["doc_id"], r["lang_pred"]) for r in language.identify(docs).collect())
    assert got == sorted((d, brute_force_language(counts, grams, sorted(langs), t)) for d, t, _ in rows)


def test_language_backs_off_to_shorter_grams():
    counts = [("the", {"a": 9}), ("der", {"b": 9})]
    grams = Counter()
    for w, n in counts:
        for k in range(1, 5):
            for g in language.grams_of(w, k):
                grams[g, next(iter(n))] += 9
    by_gram = defaultdict(dict)
    for (g, lang), n in grams.items():
        by_gram[g][lang] = n
    model = language.Model(["a", "b"], counts, list(by_gram.items()))
    scorer = language.Scorer(model)
    assert [scorer(t)[0] for t in ("the", "thex", "oder", "h", "")] == ["a", "a", "b", "a", "und"]


# Token files


@pytest.mark.parametrize("special_as_text", [False, True])
def test_encoder_is_exact(special_as_text):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    fresh = Tokenizer.from_file(token_files.public_vocabulary())
    fresh.encode_special_tokens = special_as_text
    encode = token_files.Encoder(open(token_files.public_vocabulary(), encoding="utf-8").read(), special_as_text)
    marks = [" ", "  ", "\n", " \n", "\n\n", "\t", ", ", ". ", ".\n", "'s ", "don't", "é", "ñ,", "3,5", "\x1c", " ", "!", "a", "Bc", "<|endoftext|>", "日本", "🙂"]
    texts = ["".join(rng.choice(marks) + rng.choice(["", "word", "x"]) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    encode.units.most = 50  # so that units are forgotten
    for some in (texts[:5], texts[:500], texts, [], [None]):
        ids, lengths = encode.batch(pa.array(some, pa.string()), 7)
        at = np.concatenate(([0], np.cumsum(lengths))).tolist()
        assert at[-1] == len(ids)
        for text, i, j in zip(some, at[:-1], at[1:], strict=True):
            assert ids[i:j].tolist() == [*fresh.encode(text or "", add_special_tokens=False).ids, 7], repr(text)


def test_special_tokens_by_the_contract(spark):
    from tokenizers import Tokenizer

    text = "a <|endoftext|> b"
    ids = Tokenizer.from_file(token_files.public_vocabulary()).encode(text, add_special_tokens=False).ids
    assert 50256 in ids
    path = token_files.write_tokens(table(spark, [(1, text)]))
    (row,) = spark.read.parquet(f"{path}/manifest").collect()
    assert [x.tolist() for _, _, x in token_files.documents_of(path, row["name"], row["width"])] == [[*ids, 0]]


def test_token_files(spark):
    from tokenizers import Tokenizer

    rows = odd_rows(random.Random(8))
    tokenizer = Tokenizer.from_file(token_files.public_vocabulary())
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    path = token_files.write_tokens(table(spark, rows))
    got = token_files.read_tokens(spark, path)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    flat = [len(ids) for r in spark.read.parquet(f"{path}/manifest").orderBy("part").collect() for _, _, ids in token_files.documents_of(path, r["name"], r["width"], 2)]
    assert sum(flat) == start
    assert token_files.read_tokens(spark, token_files.write_tokens(table(spark, []))).count() == 0


def test_texts_are_dealt_once_for_all_rounds(spark):
    """The rounds' joins of pairs with texts shuffled all texts, again in each round, on either side."""
    texts = common.staged_by(spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc bigint, text string"), "texts", "doc")
    pairs = spark.createDataFrame([(i, i + 1, [0]) for i in range(0, 40, 2)], "hub bigint, doc bigint, diagonals array<bigint>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plans, put = [], substrings.staged
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        substrings.staged = lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or put(df, tag)
        assert substrings.verified(pairs, texts, 46, 80).count() == 0
    finally:
        substrings.staged = put
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    deals = [line.split("hashpartitioning(")[1] for line in plans[0].splitlines() if "Exchange hashpartitioning" in line]
    scans = [line for line in plans[0].splitlines() if "Bucketed: true" in line]
    assert len(scans) == 2 and len(deals) <= 5  # pairs by doc, both sides by hub and part, and the distinct hubs
