"""Operator 8, SimHash near-dedup with BK-trees.

Documents get 64-bit fingerprints; distinct fingerprints within `radius` bits are linked; connected fingerprints form one
component. Links are found in BK-trees (children keyed by their Hamming distance to the parent), of which a search follows
only edges within the radius.

One tree over all fingerprints would be broadcast whole and grow with the corpus, so trees are sharded without loss: the
bits are cut into radius + s parts, and two fingerprints within the radius agree on s parts at least. A shard holds the
fingerprints that agree on one choice of s parts; s follows the number of fingerprints, so shards stay small, and any s
finds the same links. Where many fingerprints are alike, a shard of more than TILE is not searched; its fingerprints are
sharded anew by one more part, which finds its links too. Shards that are large by MOST parts are cut into tiles; each pair of
tiles is then a tree and its queries. A shard yields one link per fingerprint (to the least of its local component), never
all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut, discard, drop_rows, join_hot, number_rows, slices
from .components import components

#: Fingerprints of a tree, and query fingerprints of a tile, at most.
TILE = 4096
#: Mean fingerprints of a shard, beyond which one more part must agree.
SHARD = 512
#: Parts that must agree, at most.
MOST = 4
#: (query, node) pairs that a search holds at once.
FRONTIER = 1 << 21


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The fingerprint of a UTF-8 text: a bit is set if it is set in over half of its shingles' hashes."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    n = max(1, len(w) - words + 1)
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[start : start + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long) of every row; null text has no words and the fingerprint zero."""
    docs = docs.select(id_col, text_col)
    schema = docs.select(id_col, F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.zeros(batch.num_rows, np.uint64)
            for start, texts in slices(batch.column(1)):
                fps[start : start + len(texts)] = [fingerprint(t or b"") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return docs.mapInArrow(run, schema)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hexadecimal digits), component_id (smallest id reachable).

    Rows with no words have the fingerprint zero and are linked like any other; a bit that is set in just half of the hashes
    is 0. Whole texts are hashed, a long one in parts. Null ids never name a component unless all its ids are null. Repeated
    rows share a component and get a row each; other columns are not read. An empty table gives an empty result. The result
    reads two tables of ids and fingerprints, simhash-marks and simhash-named; all others are deleted on the way.
    """
    marks = cut(fingerprints(docs, id_col, text_col), "simhash-marks")
    fps = cut(marks.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("times")), "simhash-fps")
    edges = links(fps.select("fp"), radius)
    reached = components(edges)
    roots = cut(reached, "simhash-roots")
    discard(*edges.tables, *reached.tables)
    rooted = cut(fps.join(roots.withColumnRenamed("node", "fp"), "fp"), "simhash-rooted")
    discard(roots)
    firsts = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members")), "simhash-firsts")
    linked = join_hot(rooted, firsts, ["root"], "members", "inner").select("fp", "component_id")
    named = cut(fps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "times"), "simhash-named")
    discard(fps, rooted, firsts)
    return join_hot(marks, named, ["fp"], "times", "inner").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, stored: bool = False) -> DataFrame:
    """docs with one row of each component, the smallest id's (null last; of equal ids the first row).

    The columns are as they were, whatever their names. Rows with no words are one component; an empty table stays empty.
    stored says that docs is a table as read from files (see number_rows).
    """
    numbered, row = number_rows(docs, stored)
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    found = near_dedup(numbered.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", radius)
    return drop_rows(numbered, row, found.where(F.col("key.row") != F.col("component_id.row")).select(F.col("key.row").alias(row)))


def to_agree(n: int, radius: int) -> int:
    """The fewest parts that must agree so that a shard has SHARD of n evenly spread fingerprints at most; MOST at most."""
    agree = 1
    while agree < MOST and n >> (64 * agree // (radius + agree)) > SHARD:
        agree += 1
    return agree


def masks(agree: int, radius: int) -> list[int]:
    """Bit masks of the choices of `agree` parts: two fingerprints within the radius agree on one mask at least."""
    parts = radius + agree
    ends = [64 * i // parts for i in range(parts + 1)]
    part = [(1 << ends[i + 1]) - (1 << ends[i]) for i in range(parts)]
    return [sum(part[i] for i in chosen) for chosen in combinations(range(parts), agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, radius: int = 4, tile: int = TILE, agree: int | None = None) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints within the radius, whatever tile and agree are. Its `tables` are those that it reads but for fps."""
    agree = agree or to_agree(fps.count(), radius)
    found, tables = [], []
    while True:
        keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks(agree, radius)])
        rows = fps.select("fp", F.posexplode(keys).alias("mask", "key"))
        large = cut(rows.groupBy("mask", "key").count().where(F.col("count") > tile).select("mask", "key", F.ceil(F.col("count") / (tile // 2)).cast("int").alias("tiles"), "count"), "simhash-large")
        tables.append(large)
        if large.isEmpty():
            found.append(_tree_links(rows.select("mask", "key", *[F.lit(0).alias(c) for c in ("i", "j", "side")], "fp"), radius))
            break
        rows = cut(rows, "simhash-rows")
        tables.append(rows)
        rows = join_hot(rows, large, ["mask", "key"], "count")
        if agree == MOST:
            found.append(_tree_links(_tiled(rows), radius))
            break
        found.append(_tree_links(rows.where("tiles IS NULL").select("mask", "key", *[F.lit(0).alias(c) for c in ("i", "j", "side")], "fp"), radius))
        fps = cut(rows.where("tiles IS NOT NULL").select("fp").distinct(), "simhash-dense")
        tables.append(fps)
        agree += 1
    edges = found[0]
    for x in found[1:]:
        edges = edges.unionByName(x)
    edges.tables = tables
    return edges


def _tiled(rows: DataFrame) -> DataFrame:
    """Rows of shards in `tiles` tiles each, once for each pair of tiles (i, j) that the fingerprint is in: side 0 in both, 1 in i, 2 in j."""
    rows = rows.withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("tiles")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    side: Column = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return rows.select("mask", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "fp")


def _tree_links(rows: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that the trees of shards (mask, key, i, j) find."""
    by = ["mask", "key", "i", "j"]
    rows = rows.repartition(*by).sortWithinPartitions(*by, "side", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, side, fp in _whole_shards(batches):
            a, b = forest_links(group, side, fp, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(shard number, side, fingerprint) of rows sorted by shard, cut between shards; a shard has 2 tiles at most."""
    held: list[np.ndarray] = []
    for batch in batches:
        new = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        rows = np.concatenate([*held, new], axis=1)
        starts = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1
        last = starts[-1] if len(starts) else 0
        if last:
            yield _numbered(rows[:, :last])
        held = [rows[:, last:]]
    if held and held[0].shape[1]:
        yield _numbered(held[0])


def _numbered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    group = np.concatenate([[0], np.cumsum((rows[:4, 1:] != rows[:4, :-1]).any(axis=0))])
    return group, rows[4], rows[5].view(np.uint64)


def forest_links(group: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """One BK-tree for each group, all grown and searched at once; links of each fingerprint to its local component's least.

    side 0: in the tree and a query; 1: in the tree; 2: a query.
    """
    value, child, root = grow(group[side < 2], fp[side < 2])
    node_of = np.flatnonzero(side < 2)
    label = np.arange(len(fp))
    asks = np.flatnonzero((side == 0) | (side == 2))
    asks = asks[root[np.minimum(group[asks], len(root) - 1)] >= 0] if len(root) else asks[:0]
    size = np.bincount(group[side < 2], minlength=group[-1] + 1) if len(group) else np.zeros(0, np.int64)
    start = 0
    cost = np.cumsum(size[group[asks]])
    while start < len(asks):
        stop = max(start + 1, int(np.searchsorted(cost, (cost[start - 1] if start else 0) + FRONTIER)))
        q = asks[start:stop]
        for a, n in _search(fp, q, root[group[q]], value, child, radius):
            label = _join(label, a, node_of[n])
        start = stop
    least = np.full(len(fp), np.iinfo(np.int64).max)
    np.minimum.at(least, label, fp.view(np.int64))
    to = least[label]
    far = to != fp.view(np.int64)
    return fp[far], to[far].view(np.uint64)


def grow(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, child table of 65 distances a node, root of each group or -1) of BK-trees; node i holds fp[i].

    All fingerprints go down together: of those at one node and distance, the first becomes the child.
    """
    child = np.full(len(fp) * 65, -1, np.int32)
    root = np.full(int(group[-1]) + 1 if len(group) else 0, -1, np.int64)
    kinds, first = np.unique(group, return_index=True)
    root[kinds] = first
    at = root[group]
    left = np.flatnonzero(at != np.arange(len(fp)))
    while len(left):
        slot = at[left] * 65 + np.bitwise_count(fp[left] ^ fp[at[left]])
        new, where = np.unique(slot, return_index=True)
        free = child[new] < 0
        child[new[free]] = left[where[free]]
        at[left] = child[slot]
        left = left[at[left] != left]
    return fp, child, root


def _search(fp: np.ndarray, q: np.ndarray, node: np.ndarray, value: np.ndarray, child: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) within the radius, level by level; only edges of length d - radius to d + radius are followed."""
    while len(q):
        d = np.bitwise_count(fp[q] ^ value[node]).astype(np.int64)
        near = d <= radius
        yield q[near], node[near]
        nexts = []
        for step in range(-radius, radius + 1):
            e = d + step
            ok = (e > 0) & (e <= 64)
            c = child[node[ok] * 65 + e[ok]]
            there = c >= 0
            nexts.append((q[ok][there], c[there].astype(np.int64)))
        q, node = (np.concatenate(x) for x in zip(*nexts))


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the edges a-b; equal labels are one component."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
