"""Token-ID / binary output.

A dataset is a folder of parts in ascending doc_id order. Part files hold flat little-endian unsigned ids
(`.tokens`: 16 bits where the vocabulary allows, else 32), n + 1 64-bit offsets in ids (`.offsets`) and the n
doc_ids (`.docs`). The manifest names the files of each part, with its base: the ids of all parts before it,
a prefix sum over the parts. Readers map the files into memory where they are local.

Each row ends with the id 0 (`end_id`). A special token's string in a text is that token, as the library has it, or
ordinary text where `special_as_text` is set. The vocabulary lies beside the parts, and tasks read it there.

Rules for odd input: a null or empty text is the end id alone. A null doc_id sorts first. Rows that share a
doc_id are separate documents, ordered by text. An empty table gives an empty dataset. A text of any length is
encoded whole. Column names other than doc_id and text are free.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_batch, file_system, new_path, shuffle_width, staged

#: Stands for a null doc_id in a `.docs` file.
NO_DOC = -(2**63)


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Units(dict):
    """Text unit -> its place in `lengths` and `starts`, which tell where its ids lie in `ids`. New units get a place
    at once and their ids, all together, from learn(). Place 0 stands for a unit that is no unit by itself."""

    def __init__(self, encode_many, kind: np.dtype, most: int = 400_000):
        super().__init__()
        self.encode_many, self.most = encode_many, most
        self.new: list[str] = []
        self.ids, self.used = np.zeros(1 << 20, kind), 0
        self.starts, self.lengths, self.hits = (np.zeros(1, np.int64) for _ in range(3))

    def __missing__(self, unit: str) -> int:
        if not unit or unit[-1].isspace() or unit[unit[0] == "\n"].isspace():
            self[unit] = 0
            return 0
        at = self[unit] = len(self.starts) + len(self.new)
        self.new.append(unit)
        return at

    def places(self, units: pa.Array) -> np.ndarray:
        """The place of each unit; equal units of a batch are looked up once."""
        coded = units.dictionary_encode()
        which = coded.indices.to_numpy()
        different = coded.dictionary.to_pylist()
        at = np.fromiter(map(self.__getitem__, different), np.int64, len(different))
        if self.new:
            self.learn()
        np.add.at(self.hits, at, np.bincount(which, minlength=len(different)))
        return at[which]

    def learn(self) -> None:
        ids, lengths = self.encode_many(self.new)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts = np.concatenate((self.starts, self.used + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.hits = np.concatenate((self.hits, np.zeros(len(lengths), np.int64)))
        self.used += len(ids)
        self.new = []

    def joined(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units at some places, one after the other, and where those of each end."""
        n = self.lengths[at]
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.starts[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], ends

    def trim(self) -> None:
        """Beyond `most` units, those met most often stay, half of `most` at the most."""
        if len(self) <= self.most:
            return
        names = [""] * len(self.starts)
        for unit, at in self.items():
            names[at] = unit
        keep = np.flatnonzero(self.hits[1:] > 1) + 1
        keep = keep[np.argsort(-self.hits[keep], kind="stable")[: self.most // 2]]
        ids, _ = self.joined(keep)
        self.lengths = np.concatenate(([0], self.lengths[keep]))
        self.starts = np.concatenate(([0], np.cumsum(self.lengths[1:]) - self.lengths[1:]))
        self.hits = np.zeros(len(self.lengths), np.int64)
        self.ids[: len(ids)], self.used = ids, len(ids)
        self.clear()
        self.update(zip([names[i] for i in keep], range(1, len(keep) + 1), strict=True))


class Encoder:
    """Whole texts to ids. For byte-level BPE with the usual pattern, no piece reaches over a lone space or line end
    between two other characters. So texts are cut there, and the ids of frequent units are remembered: a unit that
    begins with a line end is encoded as it is, any other one behind a space. Other tokenizers, and texts that hold the
    string of an added token, get whole texts."""

    def __init__(self, vocabulary: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = special_as_text
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.type = np.dtype("<u2" if max(names.values(), default=0) < 1 << 16 else "<u4")
        told = json.loads(vocabulary)
        pre = told.get("pre_tokenizer") or {}
        self.in_units = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and told.get("normalizer") is None
        self.added = [x["content"] for x in told.get("added_tokens") or [] if not (special_as_text and x.get("special"))]
        #: ids that begin with a space, and the id of a line end, by the byte-level alphabet.
        self.spaced = np.zeros(max(names.values(), default=0) + 1, bool)
        self.spaced[[i for token, i in names.items() if token.startswith("\u0120")]] = True
        self.line = names.get("\u010a", -1)
        self.units = Units(self.many, self.type)

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type)

    def many(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units, one after the other, and how many each has. Units are encoded many at a time, and cut where
        an id begins with a space or is a line end, as only the first id of a unit is."""
        ids: list[np.ndarray] = []
        lengths = np.zeros(len(units), np.int64)
        after_line = np.array([u[0] == "\n" for u in units], bool)
        order = np.argsort(after_line, kind="stable")
        n_spaced = len(units) - int(after_line.sum())
        runs = [order[i : min(i + 2000, n_spaced)] for i in range(0, n_spaced, 2000)] + [order[i : i + 2000] for i in range(n_spaced, len(order), 2000)]
        texts = [" " + " ".join([units[i] for i in r]) if units[r[0]][0] != "\n" else "".join([units[i] for i in r]) for r in runs]
        for r, encoded in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            some = np.array(encoded.ids, self.type)
            starts = np.flatnonzero(self.spaced[some] if units[r[0]][0] != "\n" else some == self.line)
            if len(starts) == len(r) and starts[0] == 0:
                lengths[r] = np.diff(starts, append=len(some))
            else:  # other white space inside
                parts = [self.plain(u if u[0] == "\n" else " " + u) for u in (units[i] for i in r)]
                some, lengths[r] = np.concatenate(parts), list(map(len, parts))
            ids.append(some)
        flat = np.concatenate(ids) if ids else np.empty(0, self.type)
        n = lengths[order]
        starts = np.empty(len(units), np.int64)
        starts[order] = np.cumsum(n) - n
        return flat[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(len(flat))], lengths

    def by_units(self, text: str) -> np.ndarray:
        """Cuts a text with unusual spacing at lone spaces between other characters. Units with white space inside are
        encoded as they come, the others looked up."""
        first, *later = re.split(r"(?<=\S) (?=\S)", text)
        odd = [i for i, u in enumerate(later) if re.search(r"\s", u)]
        fresh = dict(zip(odd, (np.array(x.ids, self.type) for x in self.tokenizer.encode_batch_fast([" " + later[i] for i in odd], add_special_tokens=False)), strict=True))
        at = self.units.places(pa.array([u if i not in fresh else "" for i, u in enumerate(later)], pa.string()))
        ids, ends = self.units.joined(at)
        out, last = [self.plain(first)], 0
        for i in odd:
            out += [ids[last : ends[i]], fresh[i]]
            last = ends[i]
        return np.concatenate([*out, ids[last:]])

    def batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, each with end_id behind it, one after the other, and how many each has."""
        large = partial(pa.scalar, type=pa.large_string())
        texts = texts.cast(pa.large_string()).fill_null("")
        end = np.array([end_id], self.type)
        whole = np.full(len(texts), not self.in_units)
        for x in self.added:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        # A line end before each text makes its first unit one like the others; its id becomes the end id of the text before.
        some = pc.if_else(pa.array(whole), large(""), texts) if whole.any() else texts
        lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(large(""), some, large("\n")), "\n", " \n"), " ")
        at = self.units.places(lists.flatten())
        offsets = lists.offsets.to_numpy()
        at, n_units = np.delete(at, offsets[:-1] - offsets[0]), np.diff(offsets) - 1  # nothing stands before the first line end
        last = np.cumsum(n_units)
        first = last - n_units
        odd = np.flatnonzero(np.add.reduceat(at == 0, first)) if len(texts) else []
        ids, ends = self.units.joined(at)
        ends = np.concatenate(([0], ends))
        lengths = ends[last] - ends[first]
        ids[ends[first[np.add.reduceat(at == 0, first) == 0]] if len(texts) else []] = end_id
        if len(odd):
            out, upto = [], 0
            for i in odd:
                t = texts[i].as_py()
                own = end[:0] if not t else self.plain(t) if whole[i] else self.by_units(t)
                out += [ids[upto : ends[first[i]]], end, own]
                upto = ends[last[i]]
                lengths[i] = len(own) + 1
            ids = np.concatenate([*out, ids[upto:]])
        self.units.trim()
        return np.concatenate((ids[1:], end)) if len(texts) else ids, lengths

    def __call__(self, text: str | None) -> np.ndarray:
        return self.batch(pa.array([text], pa.string()), 0)[0][:-1]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(vocabulary_path: str, special_as_text: bool) -> Encoder:
    """The worker's encoder for a vocabulary file in the shared folder; the one of an earlier dataset is let go."""
    key = (vocabulary_path, special_as_text)
    if key not in _encoders:
        _encoders.clear()
        store, at = file_system(vocabulary_path)
        with store.open_input_stream(at) as f:
            _encoders[key] = Encoder(f.read().decode("utf-8"), special_as_text)
    return _encoders[key]


def _writer(path: str, end_id: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(f"{path}/vocabulary.json", special_as_text)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"  # a task that runs again writes other files
        store, at = file_system(path)
        docs, offsets, out = [], [np.zeros(1, "<i8")], None
        total = 0
        for b in by_batch(batches, 1024):
            if b.num_rows == 0:
                continue
            if out is None:
                out = store.open_output_stream(f"{at}/{name}.tokens")
            ids, lengths = encode.batch(b.column("text"), end_id)
            out.write(ids.tobytes())
            offsets.append(total + np.cumsum(lengths))
            total = int(offsets[-1][-1])
            docs.append(b.column("doc_id").cast(pa.int64()).fill_null(NO_DOC).to_numpy())
        if out is None:
            return
        out.close()
        for kind, data in (("offsets", offsets), ("docs", docs)):
            with store.open_output_stream(f"{at}/{name}.{kind}") as f:
                f.write(np.concatenate(data).astype("<i8").tobytes())
        n = sum(map(len, docs))
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "n_docs": [n], "n_tokens": [total], "width": [encode.type.itemsize]})

    return run


def write_tokens(docs: DataFrame, vocabulary_path: str | None = None, end_id: int = 0, path: str | None = None, special_as_text: bool = False) -> str:
    """Encodes docs (doc_id, text) and writes the dataset; returns its path, which Spark can read the manifest of.
    special_as_text: strings of special tokens are ordinary text instead of their ids."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    store, at = file_system(path)
    store.create_dir(at, recursive=True)
    with open(vocabulary_path or public_vocabulary(), "rb") as f, store.open_output_stream(f"{at}/vocabulary.json") as out:
        out.write(f.read())
    order = [F.col("doc_id").asc_nulls_first()]
    rows = docs.select("doc_id", "text").repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order, "text")
    schema = "part bigint, name string, n_docs bigint, n_tokens bigint, width bigint"
    parts = staged(rows.mapInArrow(_writer(path, end_id, special_as_text), schema), "token-parts")
    # One row for each part: a window over them is a few thousand rows, whatever the corpus.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{path}/manifest")
    return path


def open_mapped(store: fs.FileSystem, file: str):
    return pa.memory_map(file) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(file)


def documents_of(path: str, name: str, width: int, at_once: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, offsets, ids) of runs of documents of one part; offsets has one more entry and starts anywhere."""
    store, at = file_system(path)
    kind = np.dtype("<u2" if width == 2 else "<u4")
    with open_mapped(store, f"{at}/{name}.tokens") as ids, open_mapped(store, f"{at}/{name}.offsets") as offsets, open_mapped(store, f"{at}/{name}.docs") as docs:
        n = docs.size() // 8
        for i in range(0, n, at_once):
            k = min(at_once, n - i)
            off = np.frombuffer(offsets.read_at(8 * (k + 1), 8 * i), "<i8")
            doc = np.frombuffer(docs.read_at(8 * k, 8 * i), "<i8")
            yield doc, off, np.frombuffer(ids.read_at(width * int(off[-1] - off[0]), width * int(off[0])), kind)


def _reader(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                for doc, off, ids in documents_of(path, row["name"], row["width"]):
                    at = off - off[0]
                    crc = [zlib.crc32(ids[at[i] : at[i + 1]].astype("<u4").tobytes()) for i in range(len(doc))]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc, pa.int64(), mask=doc == NO_DOC),
                            pa.array(row["base"] + off[:-1], pa.int64()),
                            pa.array(np.diff(off), pa.int64()),
                            pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32 (unsigned CRC-32
    of its ids as little-endian unsigned 32-bit integers)."""
    parts = spark.read.parquet(f"{path}/manifest").select("part", "name", "width", "base")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return parts.repartitionByRange(shuffle_width(spark), "part").mapInArrow(_reader(path), schema)
