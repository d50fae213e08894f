"""Operator 4, byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The tokenizer is put together from a rank file: tokens by rank, and for each token of several bytes the pair that byte
pair encoding merges last. Token ids are packed as little-endian unsigned 32-bit integers, so a document's ids are one
binary value. Offsets follow from the tokens' byte lengths and the byte-to-character map of the text: a token that holds
part of a character gets the whole character's offsets. With the published pattern a text is split by Python's `re`, whose
classes are listed by the library's own, and only words not met before are encoded. Decoding spells each id in the vocabulary's characters and reverses
the byte table; as tokens may split characters, it gives bytes, and text only from the joined bytes.
"""

from __future__ import annotations

import base64
import os
import re
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

from .common import BATCH_BYTES, rest, slices

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of text in a call of the encoder, whose results take many times that.
PART = 1 << 18
#: Words whose ids a task keeps, and their longest; others are forgotten after their part.
CACHE, LONGEST = 500_000, 64
#: Before a space between two ASCII letters a word ends, whatever is before or after; long texts are cut there.
CUT = re.compile("[A-Za-z](?= [A-Za-z])")
BEYOND = re.compile("[\U00010000-\U0010ffff]")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in kept else next(others)) for b in range(256)]


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def last_pair(token: bytes, rank: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that merge last into a token: its bytes merged by the ranks below its own."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        known = [(rank.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        best, i = min(known)
        if best >= rank[token]:
            raise ValueError(f"token {token!r} can't be reached by merges")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


@cache
def tokenizer(path: str, pattern: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    rank, character = ranks(path), byte_characters()
    spelled = {t: "".join(character[b] for b in t) for t in rank}
    merges = [tuple(spelled[x] for x in last_pair(t, rank)) for t in sorted(rank, key=rank.get) if len(t) > 1]
    found = Tokenizer(models.BPE(vocab={spelled[t]: r for t, r in rank.items()}, merges=merges))
    found.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return found


@cache
def token_bytes(path: str, pattern: str) -> list[bytes | None]:
    """The bytes of each id: its spelling in the vocabulary, with the byte table reversed; None for an id that has no token."""
    byte_of = {ord(c): b for b, c in enumerate(byte_characters())}
    spelled = tokenizer(path, pattern).get_vocab()
    found: list[bytes | None] = [None] * (max(spelled.values()) + 1)
    for token, i in spelled.items():
        found[i] = token.translate(byte_of).encode("latin-1")
    return found


@cache
def listed(name: str) -> list[tuple[int, int]]:
    """Runs (first, last) of all code points that the library's regular expressions take for `name`, such as \\p{L}."""
    every = [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]
    left = normalizers.Replace(Regex(name), "").normalize_str("".join(map(chr, every)))
    taken = np.ones(sys.maxunicode + 3, np.int8)  # of each code point, with none before the first and after the last
    taken[[0, -1]] = 0
    taken[np.frombuffer(left.encode("utf-32-le"), "<u4") + 1] = taken[0xD801:0xE001] = 0
    steps = np.diff(taken)
    return list(zip(np.flatnonzero(steps > 0).tolist(), (np.flatnonzero(steps < 0) - 1).tolist()))


def ranges(runs: list[tuple[int, int]], most: int) -> str:
    """What a character class holds for runs, up to code point `most`."""
    return "".join(f"\\U{a:08x}-\\U{min(b, most):08x}" for a, b in runs if a <= most)


@cache
def splitter(most: int) -> re.Pattern:
    """public_tokenizers.PATTERN for texts up to code point `most`: the fewer ranges a class has, the faster it is left. Its endings come second, as no word of letters begins like them."""
    letter, number, white = (ranges(listed(x), most) for x in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(rf" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{white}{letter}{number}]+|[{white}]+(?![^{white}])|[{white}]+")


class WordEncoder:
    """Packed ids of texts by public_tokenizers.PATTERN: those of its matches one after the other, with a bounded cache of words."""

    def __init__(self, path: str):
        whole = tokenizer(path, public_tokenizers.PATTERN)
        self.bare = Tokenizer(whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.spelled = "".join(byte_characters()[:255]) + " "  # no byte of UTF-8 is 255
        self.sizes = np.array([len(x or b"") for x in token_bytes(path, public_tokenizers.PATTERN)], np.int64)
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, all in a call, in which they are spelled as in the vocabulary; the words' bytes part its tokens."""
        raw = [w.encode() for w in words]
        text = b"\xff".join(raw).decode("latin-1").translate(self.spelled)
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(self.sizes[ids])
        upto = np.cumsum(list(map(len, raw)))
        cuts = np.searchsorted(ends, upto)
        if not np.array_equal(ends[cuts], upto):
            raise AssertionError("words and ids don't match")
        packed, stops = ids.tobytes(), (4 * (cuts + 1)).tolist()
        self.known.update(zip(words, [packed[a:b] for a, b in zip([0, *stops], stops)]))

    def _encode(self, texts: list[str]) -> list[bytes]:
        words = [splitter(0x7F if t.isascii() else sys.maxunicode if BEYOND.search(t) else 0xFFFF).findall(t) for t in texts]
        new = list(set().union(*words).difference(self.known))
        if new:
            self._learn(new)
        found = [b"".join(map(self.known.__getitem__, w)) for w in words]
        full = len(self.known) > CACHE
        for w in new:
            if full or len(w) > LONGEST:
                del self.known[w]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(texts) > 1 or not texts or len(texts[0]) <= PART:
            return self._encode(texts)
        parts, start = [], 0
        while start < len(texts[0]):
            cut = CUT.search(texts[0], start + PART)
            stop = cut.end() if cut else len(texts[0])
            parts += self._encode([texts[0][start:stop]])
            start = stop
        return [b"".join(parts)]


def token_offsets(text: bytes, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point offsets (starts, ends) of the characters that each token's bytes touch."""
    if not len(ids):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    size = lengths[ids]
    ends = np.cumsum(size)
    if text.isascii():
        return (ends - size).astype(np.int32), ends.astype(np.int32)
    character = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, dtype=np.int32) - 1  # of each byte
    return character[ends - size], character[ends - 1] + 1


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None, pattern: str = public_tokenizers.PATTERN, offsets: bool = False) -> DataFrame:
    """(id_col, ids binary, n_tokens, n_split[, offsets array of [start, end)]) of every row.

    ids are little-endian unsigned 32-bit integers. n_split counts tokens that hold a part of a character: by the offsets,
    those that begin in the character in which the token before ends. Null text is the empty text and has no tokens. No
    special tokens are known: their strings are ordinary text. Repeated rows get a row each; other columns are not read; an
    empty table gives an empty result. Whole texts are encoded, some PART bytes or one text at a time; by public_tokenizers.PATTERN
    word by word, by any other pattern in calls of the library.
    """
    path = rank_file or public_tokenizers.path(RANKS)
    docs = docs.select(id_col, text_col)
    schema = _encoded_schema(docs, id_col, offsets)
    return docs.mapInArrow(lambda batches: _encoded(batches, path, pattern, offsets, schema.names), schema)


def _encoded_schema(docs: DataFrame, id_col: str, offsets: bool) -> StructType:
    extra = [F.array().cast("array<array<int>>").alias("offsets")] if offsets else []
    return docs.select(id_col, F.lit(b"").alias("ids"), *[F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_split")], *extra).schema


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, offsets: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """encode() of a task's rows (id, text). Words are known as long as the task runs: a worker that waits holds none."""
    t = tokenizer(path, pattern)
    by_word = WordEncoder(path) if pattern == public_tokenizers.PATTERN else None
    lengths = np.array([len(x or b"") for x in token_bytes(path, pattern)], np.int32)
    for batch in batches:
        for start, texts in slices(batch.column(1), PART):
            plain = [(x or b"").decode() for x in texts]
            if by_word:
                found = [np.frombuffer(x, "<u4") for x in by_word.encode(plain)]
            else:
                found = [np.array(e.ids, "<u4") for e in t.encode_batch_fast(plain, add_special_tokens=False)]
            # In ASCII each byte is a character, and no token splits one.
            places = [None if not offsets and (x or b"").isascii() else token_offsets(x or b"", i, lengths) for x, i in zip(texts, found)]
            split = [int(np.count_nonzero(p[0][1:] < p[1][:-1])) if p else 0 for p in places]
            columns = [batch.column(0).slice(start, len(texts)), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([len(x) for x in found], pa.int64()), pa.array(split, pa.int64())]
            if offsets:
                columns.append(pa.array([np.stack(x, axis=1).tolist() for x in places], pa.list_(pa.list_(pa.int32()))))
            yield pa.RecordBatch.from_arrays(columns, names=names)
    by_word = None
    rest()


def decode(encoded: DataFrame, ids_col: str = "ids", out_col: str = "decoded", rank_file: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """`encoded` with a binary column out_col, in place of one of that name: the bytes of its packed ids.

    Null ids decode to no bytes; an unknown id is an error. Bytes are text only as a whole: a token may end within a character.
    """
    path = rank_file or public_tokenizers.path(RANKS)
    encoded = encoded.drop(out_col)
    at = encoded.columns.index(ids_col)
    schema = encoded.withColumn(out_col, F.lit(b"")).schema
    return encoded.mapInArrow(lambda batches: _decoded(batches, at, path, pattern, schema.names), schema)


def _decoded(batches: Iterator[pa.RecordBatch], at: int, path: str, pattern: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """decode() of a task's rows, whose packed ids are in column `at`."""
    known = token_bytes(path, pattern)
    for batch in batches:
        for start, packed in slices(batch.column(at), BATCH_BYTES):
            texts = [b"".join(map(known.__getitem__, np.frombuffer(p or b"", "<u4").tolist())) for p in packed]
            part = batch.slice(start, len(packed))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=names)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """decode(encode(docs)) in one pass: a task then has one Python worker, not two that each come to hold tokenizer and words."""
    path = rank_file or public_tokenizers.path(RANKS)
    docs = docs.select(id_col, text_col)
    schema = _encoded_schema(docs, id_col, False).add("decoded", "binary", False)
    names = schema.names
    return docs.mapInArrow(lambda batches: _decoded(_encoded(batches, path, pattern, False, names[:-1]), 1, path, pattern, names), schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_split, ids_sha256, decoded_sha256) after encoding and decoding every row."""
    found = round_trip(docs, id_col, text_col)
    return found.select(id_col, "n_tokens", "n_split", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
