"""Operator 9, token ids in ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids.

Documents are dealt by ranges of their ids and sorted, encoded, and written in that order, so each file and stripe covers
a range of ids. A read for some ids prunes stripes and row groups by their ranges and Bloom filters; a full read goes
stripe by stripe in parallel.

Encoding looks up white-space-separated words, in lower case as the tokenizer makes them, and gathers their ids with numpy:
the tokenizer's pieces never hold white space, and its normaliser does not look past it, so a text's ids are those of its
words joined. That holds for a file with the parts named in WORDWISE, which is checked; any other file, and any text that
holds an added token's string, such as <|endoftext|>, is encoded whole by the plain library call.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .byte_bpe import byte_characters
from .common import cut, new_path, slices

TOKENIZER = "word_bpe_49k.json"
END = 1
#: Words whose ids a Python worker keeps; later ones are forgotten after their batch.
CACHE = 500_000
#: The parts of a tokenizer file that make ids depend on words alone.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}
#: A word that parts other words in one call; its single id marks the cuts.
MARK = "\x01"
#: A comma or full stop between a letter and white space is a piece of its own.
POINT = re.compile(rb"[,.](?=[\x20\x0a])(?:(?<=[a-z][,.])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][,.]))")
#: A word of lower-case Latin letters: one piece, already normalised.
PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: Bytes of text encoded at once.
PART = 4 << 20


def wordwise(path: str) -> bool:
    """Whether a tokenizer file has the parts of WORDWISE."""
    with open(path) as file:
        found = json.load(file)
    return all(found.get(k) == v for k, v in WORDWISE.items() if k != "model") and all(found["model"].get(k) == v for k, v in WORDWISE["model"].items())


class WordEncoder:
    """Ids of texts, as a flat array and the number of each text's; with a bounded cache of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.plain = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.plain.get_added_tokens_decoder().values()]
        self.by_word = wordwise(path)
        if not self.by_word:
            return
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # words are lower case by then and may spell an added token
        self.bare = Tokenizer(self.tokenizer.model)  # for words that the normaliser and the splitter leave whole
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.spelled = dict(enumerate(byte_characters()))
        (self.mark,) = self._ids(self.tokenizer, MARK)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        #: A word's number; its ids are flat[starts[k] : starts[k + 1]]. What precedes leading white space is an empty word.
        self.known = {"": 0}
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(2, np.int32)

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, many in a call."""
        plain, others, odd = [], [], []
        for w in words:
            (plain if PLAIN.fullmatch(w) else odd if MARK in w else others).append(w)
        ids, counts = [], []
        for start in range(0, len(plain), 2000):
            part = plain[start : start + 2000]
            found = self._ids(self.bare, " ".join([w.encode().decode("latin-1").translate(self.spelled) for w in part]))
            ids.append(found)
            counts.append(np.diff(np.flatnonzero(self.ends[found]), prepend=-1))
        for start in range(0, len(others), 2000):
            found = self._ids(self.tokenizer, f"\n{MARK}\n".join(others[start : start + 2000]))
            cut = found == self.mark
            ids.append(found[~cut])
            counts.append(np.diff(np.flatnonzero(np.append(cut, True)), prepend=-1) - 1)
        for w in odd:
            ids.append(self._ids(self.tokenizer, w))
            counts.append(np.array([len(ids[-1])]))
        learnt = [*plain, *others, *odd]
        self.known.update(zip(learnt, range(len(self.known), len(self.known) + len(learnt))))
        self.flat = np.concatenate([self.flat, *ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate([[], *counts]), dtype=np.int32)]).astype(np.int32)
        if len(self.starts) != len(self.known) + 1 or self.starts[-1] != len(self.flat):
            raise AssertionError("words and ids don't match")

    def _ids(self, tokenizer: Tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        whole = {i: self._ids(self.plain, t.decode()) for i, t in enumerate(texts) if t and (not self.by_word or any(a in t for a in self.added))}
        if not self.by_word:
            none = np.zeros(0, np.int32)
            parts = [whole.get(i, none) for i in range(len(texts))]
            return np.concatenate([none, *parts]), np.array([len(x) for x in parts], np.int64)
        words = pc.ascii_split_whitespace(pa.array([b"" if i in whole else POINT.sub(rb" \g<0>", (t or b"").lower()) for i, t in enumerate(texts)], pa.string()))
        coded = words.values.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if new := [w for w in names if w not in self.known]:
            self._learn(new)
        number = np.fromiter(map(self.known.__getitem__, names), np.int32, len(names))[coded.indices.to_numpy()]
        starts = self.starts[number]
        size = self.starts[number + 1] - starts
        ends = np.cumsum(size, dtype=np.int32)
        at = np.repeat(starts - ends + size, size)
        at += np.arange(len(at), dtype=np.int32)
        ids = self.flat[at]
        upto = np.concatenate([[0], ends])[words.offsets.to_numpy()]
        counts = np.diff(upto)
        if len(self.known) > CACHE:
            for w in new:
                del self.known[w]
            self.starts = self.starts[: len(self.known) + 1]
            self.flat = self.flat[: self.starts[-1]]
        if whole:
            parts = np.split(ids, upto[1:-1])
            for i, x in whole.items():
                parts[i] = x
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, counts


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None, partitions: int | None = None) -> None:
    """Write (row, id_col, ids) of every row of docs in ascending id order as ORC files under path.

    ids ends with END. Null text is the empty text: its ids are END alone. Null ids come first. Rows that repeat an id, or
    have none, are ordered by a hash of the text and the text, so that ranges can part them too. `row` ascends in the order
    of the whole table. Whole texts are encoded, however long. Other columns are not read. An empty table gives files with no rows.
    """
    file = tokenizer_file or public_tokenizers.path(TOKENIZER)
    docs = docs.select(id_col, text_col)
    order = [F.col(id_col), F.xxhash64(text_col)]
    dealt = docs.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order, text_col)
    dealt = dealt.select(F.monotonically_increasing_id().alias("row"), id_col, text_col)
    schema = dealt.select("row", id_col, F.array().cast("array<int>").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file)
        for batch in batches:
            for start, texts in slices(batch.column(2), PART):
                found, counts = own.encode(texts)
                ends = np.cumsum(counts)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]), pa.int32()), pa.array(np.insert(found, ends, END)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), batch.column(1).slice(start, len(texts)), ids], names=schema.names)

    options = {"orc.bloom.filter.columns": id_col, "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "none"}  # ids are run-length encoded already
    dealt.mapInArrow(run, schema).write.options(**options).orc(path)


def read(spark: SparkSession, path: str, ids: list[int] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(row, id_col, ids) of the files; given ids, only their rows, pruned by ranges and Bloom filters."""
    rows = spark.read.orc(path)
    return rows if ids is None else rows.where(F.col(id_col).isin(ids))


def positions(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of rows of read(): where each document's ids lie in all ids, and their checksum."""
    schema = rows.select("row", id_col, *[F.lit(0).cast("long").alias(c) for c in ("n_tokens", "ids_crc32")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = ids.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], names=schema.names)

    found = cut(rows.select("row", id_col, "ids").mapInArrow(run, schema), "token-counts").withColumn("part", F.shiftright("row", 33))
    parts = found.groupBy("part").agg(F.sum("n_tokens").alias("held"))  # a row for each part that was written
    before = F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts, "part")
    return found.select(id_col, (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """positions() of docs, written to the shared folder and read back."""
    path = new_path(docs.sparkSession, "token-orc")
    write(docs, path, id_col, text_col)
    return positions(read(docs.sparkSession, path), id_col)
