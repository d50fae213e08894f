"""Operator 7, benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all items.

Words are runs of lower-cased ASCII letters, digits and all characters past ASCII. Texts are normalised byte by byte
(translate), so offsets of the normalised words map to the original by their number. Texts are scanned once; a match gives a
window's last byte, hence the words it covers and their places in the original text.

The automaton is a broadcast of the items' windows, and its size is checked: it holds PART bytes of them, hence at most so
many nodes. More windows are dealt by hash into parts; the texts are scanned once for each part, one after the other, so a
worker and the driver hold one part at a time, and hits are merged by row. Parts cost scans, never results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, drop_rows, filter_texts, number_rows, slices

#: Bytes of windows in an automaton, about: some 70,000 windows, for which a Python worker takes a few hundred MB.
PART = 4 << 20
#: Bytes of no word become spaces, A-Z become a-z, all else stays.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def item_windows(text: bytes | None, window: int) -> set[bytes]:
    """Windows of an item: `window` consecutive words; a shorter item is one window; an item with no words has none."""
    w = words_of(text)
    return {b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()


def patterns(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(pattern, ids) for each distinct window, ids being the sorted ids of the items that have it; null ids are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, texts in slices(batch.column(1)):
                rows = [(p, i) for i, t in zip(ids[start:], texts) for p in item_windows(t, window)]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.binary()), pa.array([i for _, i in rows], pa.string())], names=["pattern", "id"])

    found = items.select(F.col(item_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "pattern binary, id string")
    return found.groupBy("pattern").agg(F.sort_array(F.collect_set("id")).alias("ids"))


class Matcher:
    """An automaton over the bytes of (pattern, item ids) rows."""

    def __init__(self, rows: list[tuple[bytes, list[str]]]):
        self.automaton = ahocorasick.Automaton()
        for p, ids in rows:
            self.automaton.add_word(f" {p.decode('latin-1')} ", (len(p) + 1, ids))
        if rows:
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """(first byte, last byte, item ids) of each occurrence in the words between single spaces, which count with it."""
        if words and len(self.automaton):
            for end, (length, ids) in self.automaton.iter(f" {b' '.join(words).decode('latin-1')} "):
                yield end - length, end, ids


def scan(text: bytes | None, matcher: Matcher) -> tuple[list[bytes], list[tuple[int, int]], set[str]]:
    """(words, covered runs of words as [first, last + 1), ids of the items with a window there)."""
    w = words_of(text)
    found = list(matcher.hits(w))
    if not found:
        return w, [], set()
    starts = np.cumsum([1] + [len(x) + 1 for x in w])  # of each word between the spaces, and past the end
    firsts, lasts = np.searchsorted(starts, [a + 1 for a, _, _ in found]), np.searchsorted(starts, [b for _, b, _ in found])
    return w, merged(list(zip(firsts.tolist(), lasts.tolist()))), {i for _, _, ids in found for i in ids}


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs in order, those that overlap joined."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _original(text: bytes, runs: list[tuple[int, int]]) -> list[list[int]]:
    """Code point offsets [start, end) in the original text of runs of words."""
    flat = np.frombuffer(text.translate(TABLE), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flat, [False]]).astype(np.int8)))
    raw = np.frombuffer(text, np.uint8)
    point = np.cumsum((raw & 0xC0) != 0x80)
    before = lambda b: int(point[b - 1]) if b else 0
    return [[before(edge[2 * a]), before(edge[2 * b - 1])] for a, b in runs]


#: The last part's automaton, kept by a Python worker for its next tasks.
_held: dict[str, Matcher] = {}


def _matcher(key: str, shared: Broadcast) -> Matcher:
    if key not in _held:
        _held.clear()
        _held[key] = Matcher(shared.value)
    return _held[key]


def _parts(items: DataFrame, item_col: str, text_col: str, window: int, part: int) -> Iterator[tuple[Callable[[], Matcher], int]]:
    """For each part of the items' windows, what gives its automaton in a task, and the number of parts; a part is collected when its turn comes."""
    found = cut(patterns(items, item_col, text_col, window), "item-windows")
    size = found.agg(F.sum(F.length("pattern") + 2)).first()[0] or 0
    parts = 1 if size <= part else -(-4 * size // (3 * part))  # dealt by hash, parts are uneven
    dealt = found.withColumn("part", F.pmod(F.xxhash64("pattern"), F.lit(parts)))
    try:
        for k in range(parts):
            rows = [(bytes(r.pattern), list(r.ids)) for r in dealt.where(F.col("part") == k).sort("pattern").collect()]  # about `part` bytes of windows
            shared, key = items.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex
            yield (lambda shared=shared, key=key: _matcher(key, shared)), parts
            shared.unpersist()  # its scans are written
    finally:
        discard(found)


def _hits(docs: DataFrame, id_col: str, text_col: str, matcher: Callable[[], Matcher]) -> DataFrame:
    """(id_col, n_words, runs of words, items, spans) of every row by one part."""
    docs = docs.select(id_col, text_col)
    pairs = F.array().cast("array<array<int>>")
    schema = docs.select(id_col, F.lit(0).cast("long").alias("n_words"), pairs.alias("runs"), F.array().cast("array<string>").alias("items"), pairs.alias("spans")).schema
    types = (pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for _, texts in slices(batch.column(1)):
                for t in texts:
                    w, runs, ids = scan(t, own)
                    for column, x in zip(out, (len(w), runs, sorted(ids), _original(t, runs) if runs else [])):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, types)], names=schema.names)

    return docs.mapInArrow(run, schema)


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, part: int = PART
) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_hit, n_items, items (sorted ids), items_sha256, contaminated, spans.

    A word inside any occurrence of an item's window is hit. spans holds [start, end) code point offsets in the original
    text. Null text, empty text and text with no words have no hits; so has every document if there are no items. Equal
    windows of several items count for each; items with a null id mark words but are not named. Repeated rows get a row each,
    whole texts are scanned, and other columns are not read. An empty table gives an empty result.
    """
    found, numbered, row = [], None, ""
    for matcher, parts in _parts(items, item_col, item_text_col, window, part):
        if parts == 1:
            return _summary(_hits(docs, id_col, text_col, matcher), id_col)
        if numbered is None:
            numbered, row = number_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
        hits = _hits(numbered, row, "text", matcher)
        found.append(cut(hits if not found else hits.where(F.size("runs") > 0), "part-hits"))
    hits = found[0]
    for x in found[1:]:
        hits = hits.unionByName(x)
    flat = lambda c: F.flatten(F.collect_list(c))  # noqa: E731  a list of lists for each part that hit the row
    hits = hits.groupBy(row).agg(F.max("n_words").alias("n_words"), flat("runs").alias("runs"), F.array_sort(F.array_distinct(flat("items"))).alias("items"), flat("spans").alias("spans"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, spans = (pa.array([merged(x) for x in batch.column(k).to_pylist()], pa.list_(pa.list_(pa.int32()))) for k in (2, 4))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), runs, batch.column(3), spans], names=batch.schema.names)

    hits = hits.mapInArrow(join, hits.schema)
    return _summary(numbered.select("id", row).join(hits, row).select(F.col("id").alias(id_col), "n_words", "runs", "items", "spans"), id_col)


def _summary(hits: DataFrame, id_col: str) -> DataFrame:
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return hits.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"), "spans"
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, part: int = PART) -> DataFrame:
    """docs without the rows in which an item's window occurs; the columns as they were, whatever their names.

    Rows with null text stay, as do all rows if there are no items. Each row is decided by its own text; ids aren't read.
    """
    gone, numbered, row = [], None, ""
    for matcher, parts in _parts(items, item_col, item_text_col, window, part):
        if parts == 1:

            def test(matcher: Callable[[], Matcher] = matcher) -> Callable[[list[bytes | None]], list[bool]]:
                own = matcher()
                return lambda texts: [next(own.hits(words_of(t)), None) is None for t in texts]

            return filter_texts(docs, text_col, test)
        if numbered is None:
            numbered, row = number_rows(docs)
        hits = _hits(numbered.select(row, F.col(text_col).alias("text")), row, "text", matcher)
        gone.append(cut(hits.where(F.size("runs") > 0).select(row), "part-hits"))
    dropped = gone[0]
    for x in gone[1:]:
        dropped = dropped.unionByName(x)
    return drop_rows(numbered, row, dropped)
