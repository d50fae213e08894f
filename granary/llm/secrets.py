"""Operator 10, secret scans: Aho-Corasick keywords first, anchored patterns only where a keyword is, then checksums.

Texts are scanned as UTF-8 bytes; every pattern is ASCII, so matches are those of the characters, and offsets become code
points only for texts with hits. Runs of hexadecimal digits have no keyword: a byte table folds the digits to one letter,
and a run of 16 of that letter is the keyword.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

HEX_RUN = 16
#: Hexadecimal digits become x, all other bytes a dot.
FOLD = bytes(120 if b in b"0123456789abcdef" else 46 for b in range(256))
#: Alphabets of embedded checksums.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

Span = tuple[int, int]


def _long_value(m: re.Match) -> bool:
    return len(m[2]) >= 12


def _long_key(m: re.Match) -> bool:
    return len(m[0]) >= 18


def _crc_ends(m: re.Match) -> bool:
    """The last 6 characters are the CRC-32 of the 30 before, in base 62."""
    n, digits = zlib.crc32(m[1]), ""
    while n:
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return m[2].decode() == digits.rjust(6, "0")


def _base58_check(m: re.Match) -> bool:
    """The last 4 of the 82 decoded bytes begin the double SHA-256 of the others."""
    n = 0
    for c in m[0].decode():
        n = n * 58 + BASE58.index(c)
    if n >> (8 * 82):
        return False
    raw = n.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


#: kind: (keywords in lower case, pattern anchored at a keyword, test of a match). In the order in which kinds are listed.
KINDS = {
    "assign": (
        ["password", "passwd", "secret", "token", "api_key", "apikey"],
        re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I),
        _long_value,
    ),
    "access": (["akia"], re.compile(rb"AKIA[A-Z0-9]+"), _long_key),
    "hex": ([], re.compile(rb"[0-9a-f]+"), None),
    "github": (["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), _crc_ends),
    "npm": (["npm_"], re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), _crc_ends),
    "xprv": (["xprv"], re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"), _base58_check),
}
BASE = ["assign", "access", "hex"]


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, (keywords, _, _) in KINDS.items():
        for k in keywords:
            found.add_word(k, (kind, len(k)))
    found.make_automaton()
    return found


def _matches(text: bytes, starts: list[int], pattern: re.Pattern, test) -> list[Span]:
    """Leftmost matches that don't overlap, from sorted places where a match can start; then those that pass the test."""
    spans, end = [], 0
    for start in starts:
        if start >= end and (m := pattern.match(text, start)):
            end = m.end()
            if test is None or test(m):
                spans.append(m.span())
    return spans


def find(text: bytes | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, sorted by start and then by kind as listed."""
    text = text or b""
    starts: dict[str, list[int]] = {kind: [] for kind in KINDS}
    for end, (kind, length) in automaton().iter(text.lower().decode("latin-1")):
        starts[kind].append(end + 1 - length)
    folded, run = text.translate(FOLD), b"x" * HEX_RUN
    at = folded.find(run)
    while at >= 0:
        starts["hex"].append(at)
        stop = folded.find(b".", at)
        at = folded.find(run, stop) if stop >= 0 else -1
    spans = [(a, order, kind, b) for order, (kind, (_, pattern, test)) in enumerate(KINDS.items()) if starts[kind] for a, b in _matches(text, sorted(starts[kind]), pattern, test)]
    if not spans:
        return []
    marks, place, at = {}, 0, 0
    for x in sorted({p for a, _, _, b in spans for p in (a, b)}):
        place += len(text[at:x].decode())
        marks[x] = place
        at = x
    return [(kind, marks[a], marks[b]) for a, _, kind, b in sorted(spans)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans) of every row: an array of (kind, start, end), code points, end exclusive.

    Null and empty texts have no spans. Whole texts are scanned, however long; spans of one kind never overlap, and spans of
    one start are in the order of KINDS. Repeated rows get a row each; other columns are not read; an empty table gives an
    empty result.
    """
    docs = docs.select(id_col, text_col)
    kind = "array<struct<kind: string, start: int, end: int>>"
    schema = docs.select(id_col, F.array().cast(kind).alias("spans")).schema
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for _, texts in slices(batch.column(1)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, arrow)], names=schema.names)

    return docs.mapInArrow(run, schema)


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans as text, of rows of scan()."""

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(id_col, *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
