"""Operator 2, line dedup by winnowing over line hashes.

Lines that hold words get 128-bit digests (white space collapsed). From each line on, the shortest stretch of lines with
at least `min_words` words is a window, and likewise back from each line; the least digest in a window is selected, and
selected lines are the document's fingerprints. A repeated run of min_words words or more holds a whole window at each end,
and a window's content alone decides what is selected in it, so both copies of the run select the same fingerprint: none
is missed. With min_words at 1, as registered, each later copy of a line goes, alone or in a run. Runs of RUN_WORDS words or
more are found first, by winnowing; a window of one line is left to the lines that no later run covers. A line's first copy
lies in no later run, so each later copy still meets it there.

1. One pass over the texts writes each document's line digests and fingerprints.
2. Fingerprints join the positions at which they stand; those at one position only are done with.
3. From each joined position the match is extended both ways, to all windows in which the fingerprint is the one selected.
   A window's lines are compared by their digests; a window that occurs earlier (by id, then line) is a repeat. A maximal
   repeated run is the union of its windows, so later runs go whole and no pairs of positions are listed.
4. With min_words at 1, steps 2 and 3 are done again for the lines that are left, each a fingerprint.
5. Repeats are joined to the texts, from which their lines are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, join_hot, slices

MIN_WORDS = 1
#: Words of a window in the search for runs that goes before single lines.
RUN_WORDS = 50
#: Bytes of a digest: among 10^15 different lines, two share one with a chance of 10^-9 or so.
SIZE = 16


def lines_of(text: bytes | None) -> tuple[list[int], list[int], bytes]:
    """(line numbers, words, digests of SIZE bytes each) of the lines that hold words."""
    number, words, digests = [], [], []
    for i, line in enumerate((text or b"").split(b"\n")):
        if w := line.split():
            number.append(i)
            words.append(len(w))
            digests.append(blake2b(b" ".join(w), digest_size=SIZE).digest())
    return number, words, b"".join(digests)


def windows_of(words: np.ndarray, min_words: int) -> np.ndarray:
    """(n, 2) first and last line of the shortest stretches of min_words words, forward from and back from each line."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    ahead = np.searchsorted(total, total[:-1] + min_words)
    forward = np.stack([np.arange(n), ahead - 1], axis=1)[ahead <= n]
    back = np.searchsorted(total, total[1:] - min_words, "right") - 1
    backward = np.stack([back, np.arange(n)], axis=1)[back >= 0]
    return np.unique(np.concatenate([forward, backward]), axis=0)


def selected(words: list[int], digests: bytes, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, the line that each selects): the least first half of a digest, the first such line on ties."""
    if max(words, default=0) >= min_words and min(words) >= min_words:
        at = np.arange(len(words))
        return np.stack([at, at], axis=1), at
    spans = windows_of(np.array(words, np.int64), min_words)
    order = np.frombuffer(digests, ">u8")[:: SIZE // 8].tolist()
    return spans, np.array([min(range(a, b + 1), key=order.__getitem__) for a, b in spans.tolist()], np.int64)


def _key(id_col: str, text_col: str) -> list[Column]:
    """(id, h, g): tells texts of one id, or of no id, apart by 128 bits; repeated rows share it."""
    return [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.xxhash64(F.lit(1), text_col).alias("g")]


KEY = ["id", "h", "g"]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, min_words: int, least: int) -> DataFrame:
    """(id, h, g, number, words, digests, at, mark): for each document of `least` words its lines, and the selected ones with their fingerprints."""
    docs = docs.select(*_key(id_col, text_col), F.col(text_col).alias("text"))
    ints, none = F.array().cast("array<int>"), F.lit(b"")
    schema = docs.select(*KEY, ints.alias("number"), ints.alias("words"), none.alias("digests"), ints.alias("at"), F.array().cast("array<bigint>").alias("mark")).schema
    types = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(3)):
                at, rows = [], []
                for i, text in enumerate(texts):
                    number, words, digests = lines_of(text)
                    if sum(words) < least:
                        continue
                    chosen = np.unique(selected(words, digests, min_words)[1])
                    at.append(start + i)
                    rows.append((number, words, digests, chosen, np.frombuffer(digests, ">i8")[:: SIZE // 8][chosen].tolist()))
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in range(3)], *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names=schema.names)

    return docs.mapInArrow(run, schema)


def extended(matched: DataFrame, min_words: int) -> DataFrame:
    """(id, h, g, first, last, same): the windows in which a joined position (`joined`) is the selected line; same is their content."""
    schema = matched.select(*KEY, F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(b"").alias("same")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, firsts, lasts, same = [], [], [], []
            number, words, digests, joined = (batch.column(k) for k in range(3, 7))
            for i in range(batch.num_rows):
                lines, raw = number[i].as_py(), digests[i].as_py()
                spans, chosen = selected(words[i].as_py(), raw, min_words)
                for a, b in spans[np.isin(chosen, joined[i].as_py())].tolist():
                    at.append(i)
                    firsts.append(lines[a])
                    lasts.append(lines[b])
                    held = raw[SIZE * a : SIZE * (b + 1)]
                    same.append(held if a == b else blake2b(held, digest_size=SIZE).digest())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in range(3)], pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32()), pa.array(same, pa.binary())], names=schema.names)

    return matched.select(*KEY, "number", "words", "digests", "joined").mapInArrow(run, schema)


def _beside(lines: DataFrame, more: DataFrame, column: str, how: str = "left") -> DataFrame:
    """Rows of line digests with a column of the rows of the same document."""
    kept = lines.select(*[F.col(k).alias(f"l_{k}") for k in KEY], "number", "words", "digests")
    both = kept.join(more.hint("merge"), F.col("l_id").eqNullSafe(F.col("id")) & (F.col("l_h") == F.col("h")) & (F.col("l_g") == F.col("g")), how)
    return both.select(*[F.col(f"l_{k}").alias(k) for k in KEY], "number", "words", "digests", column)


def _later(lines: DataFrame, min_words: int) -> DataFrame:
    """(id, h, g, spans): of rows as of fingerprints(), the windows that occur earlier, as [first, last] line numbers."""
    found = lines.select(*KEY, F.explode(F.arrays_zip("at", "mark")).alias("x")).select(*KEY, F.col("x.at").alias("at"), F.col("x.mark").alias("mark"))
    place = F.struct(*KEY, "at")
    marks = found.groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("times"))
    marks = cut(marks.where("a != b").select("mark", "times"), "line-marks")
    joined = cut(join_hot(found, marks, ["mark"], "times", "inner").groupBy(*KEY).agg(F.collect_set("at").alias("joined")), "line-joined")
    spans = cut(extended(_beside(lines, joined, "joined", "inner"), min_words), "line-windows")
    discard(marks, joined)
    at = F.struct(*KEY, "first")
    repeats = spans.groupBy("same").agg(F.min(at).alias("origin"), F.max(at).alias("latest"), F.count("*").alias("times"))
    repeats = cut(repeats.where("origin != latest").select("same", "origin", "times"), "line-repeats")
    later = join_hot(spans, repeats, ["same"], "times", "inner").where(at != F.col("origin"))
    later = cut(later.groupBy(*KEY).agg(F.collect_set(F.array("first", "last")).alias("spans")), "line-later")
    discard(spans, repeats)
    return later


def uncovered(lines: DataFrame) -> DataFrame:
    """Rows as of fingerprints(), of the lines that no span (spans) covers, each line a fingerprint."""
    ints = F.array().cast("array<int>")
    schema = lines.select(*KEY, "number", "words", "digests", ints.alias("at"), F.array().cast("array<bigint>").alias("mark")).schema
    types = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, words, digests, spans = (batch.column(k) for k in range(3, 7))
            rows = []
            for i in range(batch.num_rows):
                at_line, raw = np.array(number[i].as_py(), np.int64), np.frombuffer(digests[i].as_py(), np.dtype((np.void, SIZE)))
                keep = np.ones(len(at_line), bool)
                for a, b in spans[i].as_py() or []:
                    keep[np.searchsorted(at_line, a) : np.searchsorted(at_line, b, "right")] = False
                held = raw[keep].tobytes()
                rows.append((at_line[keep], np.array(words[i].as_py(), np.int64)[keep], held, np.arange(keep.sum()), np.frombuffer(held, ">i8")[:: SIZE // 8].tolist()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names=schema.names)

    return lines.mapInArrow(run, schema)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of docs: id_col, text (without later repeated runs of lines), n_lines, n_removed, removed.

    A line is deleted if it lies in a run of consecutive lines (blank ones aside) of min_words words or more that occurs
    earlier, by id and then by line. removed lists [first, last] line numbers, merged. Null text gives null and no lines;
    texts of fewer words stay as they are; a very long text is one row of digests. Null ids come first. Rows that repeat an
    id and text are one document and get the same result each. Other columns are not read. An empty table gives an empty result.
    """
    lines = cut(fingerprints(docs, id_col, text_col, RUN_WORDS if min_words == 1 else min_words, min_words), "line-digests")
    if min_words == 1:
        runs = _later(lines, RUN_WORDS)
        left = cut(uncovered(_beside(lines, runs, "spans")), "line-left")
        later = cut(_later(left, 1).unionByName(runs).groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans")), "line-all")
        discard(left, runs)
    else:
        later = _later(lines, min_words)
    discard(lines)
    texts = docs.select(*[c.alias(f"t_{k}") for c, k in zip(_key(id_col, text_col), KEY)], F.col(text_col).alias("t_text"))
    same = F.col("t_id").eqNullSafe(F.col("id")) & (F.col("t_h") == F.col("h")) & (F.col("t_g") == F.col("g"))
    both = texts.join(later.hint("merge"), same, "left").select(F.col("t_id").alias(id_col), F.col("t_text").alias("text"), "spans")
    schema = both.select(id_col, "text", *[F.lit(0).cast("long").alias(c) for c in ("n_lines", "n_removed")], F.col("spans").alias("removed")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                rows = [_without(t, s or []) for t, s in zip(texts, batch.column(2).slice(start, len(texts)).to_pylist())]
                types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names=schema.names)

    return both.mapInArrow(run, schema)


def _without(text: bytes | None, spans: list[list[int]]) -> tuple[str | None, int, int, list[list[int]]]:
    if text is None:
        return None, 0, 0, []
    if not spans:
        return text.decode(), text.count(b"\n") + 1, 0, []
    lines, merged = text.split(b"\n"), []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    kept, at = [], 0
    for a, b in merged:
        kept += lines[at:a]
        at = b + 1
    kept += lines[at:]
    return b"\n".join(kept).decode(), len(lines), len(lines) - len(kept), merged
