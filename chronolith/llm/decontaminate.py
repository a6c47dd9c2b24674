"""Benchmark decontamination by the q-gram lemma.

Texts are lower-cased and their white space is made single spaces. A benchmark item is cut into pieces of
`piece` characters (every half piece, the last at the end), or is one piece. A document is contaminated by an
item when one of the pieces occurs in it with at most a tenth of its characters edited. Items of fewer than
`shortest` characters have to occur unedited, between word borders.

If a region has the piece with e edits, at least m + 1 - q (e + 1) of the piece's m + 1 - q character q-grams
stand in it unchanged, on diagonals (place in the document less place in the piece) that differ by e at most.
So the shared q-grams are counted in bands of 2 (e + 1) diagonals that overlap by half. Bands that reach the bound
stay if their gaps allow it: an edit changes q neighbouring q-grams at most, so u missing ones in a row cost u / q
edits, rounded up. What is left is verified by alignment within the band, all bands of a batch together. Nothing
that the definition names is lost.

The pieces are dealt by hash to blocks of about `block_chars` characters in the shared folder; tasks read them
there, so the benchmark goes neither through the driver nor into a broadcast. There is one pass over the documents:
a task holds about HELD bytes of them and one block's index at a time.

Rules for odd input: null or empty texts have no regions. Rows that share an item_id are one item; a null item_id
takes no part. Each row of docs is tested by itself, a null doc_id too. Empty tables give no rows. Very long texts
are tested in overlapping segments. Column names other than those used are free.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, file_system, new_path, staged

SEPARATOR = "\x00"
SEGMENT = 1 << 17
FAR = 1 << 20
#: A segment with more pairs of equal q-grams is searched in halves.
MOST_PAIRS = 1 << 22
HELD = 32 << 20
U32 = np.uint32


def normal(text: str | None) -> str:
    return " ".join(text.lower().replace(SEPARATOR, " ").split()) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def rolling(c: np.ndarray, q: int) -> np.ndarray:
    """A 32-bit code of the q characters at each place, put together from those of powers of two. Different q-grams
    of one code only add candidates."""
    base, have, out, n = 0x9E3779B1, 1, None, 0
    part = c * U32(0x85EBCA77)
    part ^= part >> U32(15)
    while True:
        if q & have:
            if out is None:
                out, n = part, have
            else:
                size = len(c) - n - have + 1
                out, n = out[:size] * U32(pow(base, have, 1 << 32)) + part[n : n + size], n + have
        if have * 2 > q:
            return out
        size = len(c) - 2 * have + 1
        part = part[:size] * U32(pow(base, have, 1 << 32)) + part[have : have + size]
        have *= 2


def pieces_of(text: str, piece: int) -> list[str]:
    if len(text) <= piece:
        return [text]
    at = list(range(0, len(text) - piece, piece // 2)) + [len(text) - piece]
    return [text[i : i + piece] for i in at]


def joined(out: dict, key: tuple[int, int], hit: tuple[int, int, int]) -> None:
    """Adds (matched pieces, least edits, first start) to those of the key."""
    n, e, s = out.get(key, (0, *hit[1:]))
    out[key] = (n + hit[0], min(e, hit[1]), min(s, hit[2]))


class Index:
    """The q-grams of some pieces of benchmark items, and the short items."""

    def __init__(self, items: list[tuple[int, str]], q: int = 8, piece: int = 120, tenth: float = 0.1, shortest: int = 32):
        self.q = q
        shortest = max(shortest, q)
        pieces = [(item, p) for item, text in items if len(text) >= shortest for p in dict.fromkeys(pieces_of(text, piece))]
        self.items, self.texts = [i for i, _ in pieces], [p for _, p in pieces]
        short: dict[str, set[int]] = {}
        for item, text in items:
            if 0 < len(text) < shortest:
                short.setdefault(f" {text} ", set()).add(item)
        self.short = ahocorasick.Automaton() if short else None
        for text, owners in short.items():
            self.short.add_word(text, (len(text), sorted(owners)))
        if self.short:
            self.short.make_automaton()
        m = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.minimum((m * tenth).astype(np.int64), (m - q) // q)  # keeps the bound at 1 or more
        self.least = m + 1 - q * (self.edits + 1)
        self.overlap = max(int((m + 4 * self.edits + q).max(initial=0)), shortest + 2)
        self.sizes = m + 1 - q
        grams = [rolling(codes(t), q) for t in self.texts]
        all_ = np.concatenate(grams) if grams else np.empty(0, U32)
        piece_of = np.repeat(np.arange(len(grams)), self.sizes)
        place = np.concatenate([np.arange(n) for n in self.sizes]) if grams else np.empty(0, np.int64)
        order = np.argsort(all_, kind="stable")
        self.piece, self.place = piece_of[order], place[order]
        self.codes, self.first, self.count = np.unique(all_[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.slot(self.codes)] = True

    @staticmethod
    def slot(x: np.ndarray) -> np.ndarray:
        return (x * U32(0x94D049BB)) >> U32(10)

    def bands(self, texts: list[str], most_pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(text, piece, first diagonal) of each band that reaches both bounds; None if there are too many pairs."""
        none = np.empty(0, np.int64)
        c = codes(SEPARATOR.join(texts))
        if len(c) < self.q or not len(self.codes):
            return none, none, none
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        g = rolling(c, self.q)
        at = np.flatnonzero(self.seen.take(self.slot(g)))
        where = np.minimum(np.searchsorted(self.codes, g[at]), len(self.codes) - 1)
        real = self.codes[where] == g[at]
        at, where = at[real], where[real]
        n = self.count[where]
        if n.sum() > most_pairs:
            return None
        post = np.repeat(self.first[where] - np.cumsum(n) + n, n) + np.arange(n.sum())
        piece, place, at = self.piece[post], self.place[post], np.repeat(at, n)
        text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(at, np.append(starts, len(c)))))
        # Most texts have too few of a piece's q-grams in all; cells that several share only count too much.
        cell = (text * len(self.texts) + piece) & 0x1FFFF
        real = np.bincount(cell)[cell] >= self.least[piece]
        at, text, piece, place = at[real], text[real], piece[real], place[real]
        wide = self.edits[piece] + 1
        band = (at - starts[text] - place + FAR * wide) // wide
        key = (text * len(self.texts) + piece) << 32
        key, place = np.concatenate((key + band, key + band - 1)), np.concatenate((place, place))
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else none
        counts = np.diff(first, append=len(key))
        keys = key[first]
        good = counts >= self.least[(keys >> 32) % len(self.texts)]
        keys = keys[good]
        if not len(keys):
            return none, none, none
        # Different places of the piece only, and the edits that the gaps between them cost.
        held = np.unique(np.repeat(np.arange(len(keys)), counts[good]) << 32 | place[np.repeat(good, counts)])
        owner, place = held >> 32, held & 0xFFFFFFFF
        piece = (keys >> 32) % len(self.texts)
        begins = np.concatenate(([True], owner[1:] != owner[:-1]))
        gap = place - np.where(begins, -1, np.roll(place, 1)) - 1
        cost = np.add.reduceat(-(-gap // self.q), np.flatnonzero(begins))
        last = place[np.append(np.flatnonzero(begins)[1:], len(place)) - 1]
        cost += -(-(self.sizes[piece] - 1 - last) // self.q)
        good = cost <= self.edits[piece]
        keys, piece = keys[good], piece[good]
        return (keys >> 32) // len(self.texts), piece, ((keys & 0xFFFFFFFF) - FAR) * (self.edits[piece] + 1)

    def aligned(self, texts: list[str], text: np.ndarray, piece: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edits, start) of the best occurrence of each piece that starts in its band; edits are many where it has
        none within the piece's edits."""
        many = 1 << 14
        edits, start = np.full(len(text), many, np.int64), np.zeros(len(text), np.int64)
        e, m = self.edits[piece], self.sizes[piece] + self.q - 1
        lo, wide = first - e, int((4 * e + 2).max(initial=1))  # diagonals of the band, and what edits may reach
        chars, pattern = np.zeros((len(text), wide + int(m.max(initial=0))), U32), np.zeros((len(text), int(m.max(initial=0))), U32)
        size = np.array([len(texts[t]) for t in text], np.int64)
        for i, (t, p) in enumerate(zip(text.tolist(), piece.tolist(), strict=True)):
            exact = texts[t].find(self.texts[p], max(0, int(first[i])), max(0, int(first[i] + 2 * (e[i] + 1))) + int(m[i]))
            if exact >= 0:
                edits[i], start[i] = 0, exact
                continue
            pattern[i, : m[i]] = codes(self.texts[p])
            span = codes(texts[t][max(0, int(lo[i])) : max(0, int(lo[i]) + wide + int(m[i]))])
            chars[i, max(0, -int(lo[i])) :][: len(span)] = span
        live, near_end = np.flatnonzero(edits > 0), bool((lo + wide + m > size).any())
        steps = np.arange(wide, dtype=np.int16)
        at = lo[live, None] + steps
        row = np.where((at < 0) | (at > size[live, None]), many, 0).astype(np.int16)
        for i in range(pattern.shape[1]):
            if not len(live):
                break
            new = row + (chars[live, i : i + wide] != pattern[live, i, None])
            np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
            row = np.minimum.accumulate(new - steps, axis=1) + steps  # inserted characters
            if near_end:
                row[lo[live, None] + steps + (i + 1) > size[live, None]] = many
            np.minimum(row, np.int16(many), out=row)
            best, ends = row.min(axis=1), m[live] == i + 1
            done = ends & (best <= e[live])
            edits[live[done]], start[live[done]] = best[done], np.maximum(0, lo[live[done]] + row[done].argmin(axis=1))
            stay = ~ends & (best <= e[live])
            if not stay.all():
                live, row = live[stay], row[stay]
        return edits, start

    def found(self, texts: list[str], most_pairs: int = MOST_PAIRS) -> dict[tuple[int, int], tuple[int, int, int]]:
        """{(text, item): (matched pieces, least edits, first start)}."""
        bands = self.bands(texts, most_pairs)
        if bands is None:
            return self.halved(texts, most_pairs)
        out: dict = {}
        for t, text in enumerate(texts if self.short else []):
            for end, (size, owners) in self.short.iter(f" {text} "):
                for item in owners:
                    out.setdefault((t, item), (1, 0, end + 1 - size))
        done: set = set()
        for i in range(0, len(bands[0]), 512):
            text, piece, first = (x[i : i + 512] for x in bands)
            for t, p, edits, start in zip(text.tolist(), piece.tolist(), *(x.tolist() for x in self.aligned(texts, text, piece, first)), strict=True):
                if edits <= self.edits[p] and (t, p) not in done:
                    done.add((t, p))
                    joined(out, (t, self.items[p]), (1, edits, start))
        return out

    def halved(self, texts: list[str], most_pairs: int) -> dict[tuple[int, int], tuple[int, int, int]]:
        """found() for parts with fewer pairs: half of the texts, or overlapping halves of a text."""
        middle = len(texts) // 2
        parts = [(texts[:middle], 0, 0), (texts[middle:], middle, 0)]
        if len(texts) == 1:
            middle = len(texts[0]) // 2
            if middle < 2 * self.overlap:
                return self.found(texts, 1 << 62)
            parts = [([texts[0][: middle + self.overlap]], 0, 0), ([texts[0][middle:]], 0, middle)]
        out: dict = {}
        for some, row, base in parts:
            for (k, item), (n, e, s) in self.found(some, most_pairs).items():
                joined(out, (k + row, item), (n, e, s + base))
        return out

    def search(self, texts: list[str | None]) -> dict[tuple[int, int], tuple[int, int, int]]:
        return self.search_normal([normal(t) for t in texts])

    def search_normal(self, texts: list[str]) -> dict[tuple[int, int], tuple[int, int, int]]:
        """found() for normal texts of any number and length, about SEGMENT characters at a time."""
        out: dict = {}
        group: list[tuple[int, int, str]] = []
        size = 0

        def flush() -> None:
            for (k, item), (n, e, s) in self.found([g[2] for g in group]).items():
                row, base, _ = group[k]
                joined(out, (row, item), (n, e, s + base))
            group.clear()

        for row, text in enumerate(texts):
            for i in range(0, max(1, len(text) - self.overlap), SEGMENT):
                part = text[i : i + SEGMENT + self.overlap] if len(text) > SEGMENT else text
                group.append((row, i, part))
                size += len(part)
                if size >= SEGMENT:
                    flush()
                    size = 0
        flush()
        return out


def _pieces(piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_batch(batches, 1024):
            rows = [(item, p) for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for p in pieces_of(normal(text), piece) if p]
            items, texts = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(texts, pa.string())], ["item_id", "piece"])

    return run


class Blocks:
    """The benchmark in the shared folder. Tasks hold the index of one block, and keep it where it is the only one."""

    def __init__(self, benchmark: DataFrame, block_chars: int, q: int = 8, piece: int = 120, tenth: float = 0.1, shortest: int = 32):
        self.how = {"q": q, "piece": piece, "tenth": tenth, "shortest": shortest}
        rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint"), "text")
        rows = staged(rows.mapInArrow(_pieces(piece), "item_id bigint, piece string").distinct(), "benchmark-pieces")
        chars = rows.agg(F.sum(F.length("piece"))).first()[0] or 0
        self.n, self.path = max(1, -(-chars // block_chars)), new_path(benchmark.sparkSession, "benchmark-blocks")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("piece"), F.lit(self.n)))
        rows.repartition("block").write.partitionBy("block").parquet(self.path)

    def index(self, block: int) -> Index:
        key = (self.path, block)
        if key not in _indexes:
            _indexes.clear()
            store, at = file_system(f"{self.path}/block={block}")
            there = store.get_file_info(at).type != fs.FileType.NotFound
            rows = pq.read_table(at, filesystem=store, columns=["item_id", "piece"], partitioning=None).to_pydict() if there else {"item_id": [], "piece": []}
            _indexes[key] = Index(list(zip(rows["item_id"], rows["piece"], strict=True)), **self.how)
        return _indexes[key]

    def found(self, batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, dict]]:
        """Each batch with {(row, item): (matched pieces, least edits, first start)}; column `at` has the texts."""
        held: list[tuple[pa.RecordBatch, list[str], dict]] = []
        size = 0

        def searched() -> Iterator[tuple[pa.RecordBatch, dict]]:
            for block in range(self.n):
                index = self.index(block)
                for _, texts, out in held:
                    for key, hit in index.search_normal(texts).items():
                        joined(out, key, hit)
            for b, _, out in held:
                yield b, out
            held.clear()

        for b in by_batch(batches, 512):
            texts = [normal(t) for t in b.column(at).to_pylist()]
            held.append((b, texts, {}))
            size += b.nbytes + sum(map(len, texts))
            if self.n == 1 or size >= HELD:
                yield from searched()
                size = 0
        yield from searched()


_indexes: dict[tuple[str, int], Index] = {}


def _regions(blocks: Blocks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in blocks.found(batches, 1):
            rows = [k for k, _ in found]
            values = list(found.values())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in ([i for _, i in found], *([v[j] for v in values] for j in range(3)))]],
                ["doc_id", "item_id", "regions", "edits", "start"],
            )

    return run


def _clean(blocks: Blocks, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in blocks.found(batches, at):
            bad = {row for row, _ in found}
            yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = 1 << 21, **how) -> DataFrame:
    """doc_id, item_id, regions (pieces found), edits (fewest in a piece), start (in the normalised text)."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id bigint, regions bigint, edits bigint, start bigint"
    return docs.select("doc_id", "text").mapInArrow(_regions(Blocks(benchmark, block_chars, **how)), schema)


def clean(docs: DataFrame, benchmark: DataFrame, block_chars: int = 1 << 21, **how) -> DataFrame:
    """The rows of docs, all columns, that no item contaminates; nothing is shuffled."""
    return docs.mapInArrow(_clean(Blocks(benchmark, block_chars, **how), docs.columns.index("text")), docs.schema)
