"""Language ID by word-first backoff.

A known word scores each language by the log of its relative frequency there. An unseen word falls back to
its character n-grams (with word borders), the longest n first: the first n of which any n-gram is known
scores it by the mean over those. A text's language is the one with the largest sum over its words.

The model is learned from labelled rows: all of a language, or a sample of about `per_language` rows by hash
of the id where it has more. All words and n-grams of the sample are known; its size bounds the model, which goes to
every task, whatever the corpus.

Rules for odd input: a null text, or one without a letter (str.isalpha), is `und` with score 0, as is everything when nothing
could be learned. A null doc_id is never learned from and counts as held out. Rows that share a doc_id are
predicted each by its own text. Equal sums go to the language first in code point order. An empty table gives
an empty table. Column names other than doc_id, text and lang are free.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, staged

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 4
UNDETERMINED = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of word characters but digits and underscores. Signs such as a half or a Roman numeral may stand in a word,
    but a text of nothing else has no letter and no words."""
    words = LETTERS.findall(text.lower()) if text else []
    return words if any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w) else []


def grams_of(word: str, n: int) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def _counted(items_of, at_once: int = 300_000):
    """(item, lang, n) summed within a task; a counter is handed on when it is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(counts)
            batch = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())],
                ["item", "lang", "n"],
            )
            counts.clear()
            return batch

        for b in by_batch(batches, 256):
            for x, lang, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for item in items_of(x):
                    counts[item, lang] += n
                if len(counts) > at_once:
                    yield out()
        if counts:
            yield out()

    return run


def _table(counts: DataFrame, labels: DataFrame) -> pa.Table:
    """item, at (numbers of languages) and n (how often it stands there) of all items, as Arrow."""
    each = counts.groupBy("item", "lang").agg(F.sum("n").alias("n")).join(labels, "lang")
    pairs = F.sort_array(F.collect_list(F.struct("at", "n")))
    return each.groupBy("item").agg(pairs.alias("pairs")).select("item", F.col("pairs.at").alias("at"), F.col("pairs.n").alias("n")).toArrow()


def _as_table(items: list) -> pa.Table:
    return pa.table({"item": pa.array([k for k, _ in items], pa.string()), "at": pa.array([list(n) for _, n in items], pa.list_(pa.int32())), "n": pa.array([list(n.values()) for _, n in items], pa.list_(pa.int64()))})


class Model:
    """languages, and for each known word and n-gram the log of each language's share in it."""

    def __init__(self, languages: list[str], words: pa.Table | list, grams: pa.Table | list):
        """words and grams: item, at and n, or [(item, {language: n})]."""
        self.languages = languages
        number = {x: i for i, x in enumerate(languages)}

        def table(items: pa.Table | list) -> tuple[dict[str, int], np.ndarray]:
            if isinstance(items, list):
                items = _as_table([(k, {number[x]: c for x, c in n.items()}) for k, n in items])
            items = items.sort_by("item").combine_chunks()
            counts = np.full((len(items), len(languages)), 0.05)
            lists = items.column("at").combine_chunks()
            rows = np.repeat(np.arange(len(items)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            counts[rows, pc.list_flatten(lists).to_numpy(zero_copy_only=False)] += pc.list_flatten(items.column("n").combine_chunks()).to_numpy(zero_copy_only=False)
            names = items.column("item").to_pylist()
            share = counts / np.maximum(counts.sum(axis=0, keepdims=True), 1e-9) if len(items) else counts
            return {k: i for i, k in enumerate(names)}, np.log(share / np.maximum(share.sum(axis=1, keepdims=True), 1e-300)).astype(np.float32)

        self.words, self.word_logs = table(words)
        self.grams, self.gram_logs = table(grams)

    def unseen(self, word: str) -> np.ndarray:
        for n in range(LONGEST, 0, -1):
            known = [i for i in map(self.grams.get, grams_of(word, n)) if i is not None]
            if known:
                return self.gram_logs[known].mean(axis=0)
        return np.full(len(self.languages), -math.log(len(self.languages)), np.float32)


class Scorer(dict):
    """word -> row of `logs`. Unseen words are given rows as they come; those are forgotten at `most`."""

    most = 200_000

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model, self.known = model, len(model.words)
        self.logs = np.zeros((self.known + self.most, len(model.languages)), np.float32)
        self.logs[: self.known] = model.word_logs
        self.next = self.known

    def __missing__(self, word: str) -> int:
        i = self.next
        if i == len(self.logs):  # words of the text at hand may still be in use
            self.logs = np.concatenate((self.logs, np.zeros((self.most, self.logs.shape[1]), np.float32)))
        self.logs[i] = self.model.unseen(word)
        self[word], self.next = i, i + 1
        return i

    def trim(self) -> None:
        if self.next > self.known + self.most * 3 // 4:
            self.clear()
            self.update(self.model.words)
            self.logs, self.next = self.logs[: self.known + self.most], self.known

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.languages:
            return UNDETERMINED, 0.0
        rows = list(map(self.__getitem__, words))
        total = self.logs[rows].sum(axis=0, dtype=np.float64)
        self.trim()
        # Neighbouring words aren't independent: the sum counts as that of 20 words at most.
        share = np.exp((total - total.max()) * min(1.0, 20 / len(words)))
        best = int(total.argmax())
        return self.model.languages[best], float(share[best] / share.sum())


def learn(labelled: DataFrame, per_language: int = 600) -> Model:
    """labelled: doc_id, text, lang. See the module's docstring for the bounds."""
    labelled = labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    spark = labelled.sparkSession
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not counts:
        return Model([], [], [])
    wide = 1 << 30
    rows = [(x, i, min(wide, wide * per_language // counts[x])) for i, x in enumerate(languages)]
    labels = spark.createDataFrame(rows, "lang string, at int, bound bigint")
    # The texts needn't be shuffled for a list of labels, whose size is known here.
    sample = labelled.join(F.broadcast(labels) if len(languages) <= 10_000 else labels, "lang").where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(wide)) < F.col("bound"))
    schema = "item string, lang string, n bigint"
    of_words = staged(sample.select("text", "lang", F.lit(1).cast("bigint").alias("n")).mapInArrow(_counted(words_of), schema).groupBy("item", "lang").agg(F.sum("n").alias("n")), "language-words")

    def grams(word: str) -> list[str]:
        return [g for n in range(1, LONGEST + 1) for g in grams_of(word, n)]

    of_grams = of_words.mapInArrow(_counted(grams), schema)
    labels = labels.select("lang", "at")
    return Model(languages, _table(of_words, labels), _table(of_grams, labels))


_scorers: list[Scorer] = []


def scorer_of(model: Model) -> Scorer:
    """One scorer a worker, kept while tasks use the same model."""
    if not _scorers or _scorers[0].model is not model:
        _scorers[:] = [Scorer(model)]
    return _scorers[0]


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared.value)
        for b in by_batch(batches, 1024):
            found = [scorer(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def _kept(shared, at: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared.value)
        for b in by_batch(batches, 1024):
            found = [scorer(t) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in found], pa.bool_()))

    return run


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, all columns, whose language is determined with a score of `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_kept(shared, docs.columns.index("text"), least), docs.schema)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_predicted(shared), f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text, lang). Held-out rows, those with
    crc32(doc_id as text) mod 3 = 1, aren't learned from."""
    model = learn(docs.where(~is_held_out(F.col("doc_id"))), **bounds)
    return predict(docs, model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
