"""Hard-negative mining by blocked dense products.

Anchors are dealt into blocks of bounded size. A block is broadcast, and each task multiplies it with its own blocks of
candidates in float64, which is exact while every sum stays below 2^53. The first pass keeps the best positives of each anchor,
the second the best negatives in each positive's window of scores; both keep a bounded list a slot, in a task and after the
merge. So that the rows which tasks emit don't grow with their number, each pass first runs over the anchors alone: the last
place of a list over a part of the rows bounds the whole list from below, and later only rows that reach it are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import cut, discard, is_stored, new_path, number_rows

#: Anchors and bytes of their vectors in a block that is broadcast; rows of a product of blocks.
BLOCK, BLOCK_BYTES, ANCHORS, CANDIDATES = 16_384, 64 << 20, 1024, 4096
EXACT = 2.0**53
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass
class Block:
    """Anchors of one block and the slots of a pass: each anchor has as many as `low` has columns."""

    keys: list[str]
    labels: np.ndarray
    vectors: np.ndarray
    same: bool  # candidates of the anchor's label, or of others
    low: np.ndarray  # scores that a slot takes
    high: np.ndarray
    size: int  # length of a slot's list
    reach: np.ndarray | None = None  # scores below it can't enter a slot's list


def dense(column: pa.Array, scale: float, width: int = 0) -> np.ndarray:
    """Rows of floor(scale * x); short vectors end in zeros."""
    column = column.cast(pa.large_list(pa.float64()))
    ends = column.offsets.to_numpy()
    lengths, flat = np.diff(ends), np.floor(scale * column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]])
    width = max(width, int(lengths.max(initial=0)))
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], lengths)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows: in float64 where no sum can reach 2^53, else in whole numbers, held to 64 bits."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * width < EXACT:
        return a @ b.T
    whole = [[[int(x) for x in row] for row in m] for m in (a, b)]
    return np.array([[max(LEAST, min(MOST, sum(x * y for x, y in zip(p, q)))) for q in whole[1]] for p in whole[0]], np.int64).reshape(len(a), len(b))


def merge(slot: np.ndarray, score: np.ndarray, at: np.ndarray, named: np.ndarray, size: int) -> np.ndarray:
    """Places of each slot's first `size`: highest score, then smallest id, ids that are null last."""
    order = np.lexsort((at, ~named, ~score, slot))
    s = slot[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    place = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    return order[place < size]


class Lists:
    """The lists of a block's slots over the candidates of one task."""

    def __init__(self, block: Block) -> None:
        self.block, n = block, block.low.size
        self.own = {k: i for i, k in enumerate(block.keys)}
        self.reach = np.full(n, LEAST) if block.reach is None else block.reach.copy()
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]  # slot, score, id, whether it has one

    def add(self, ids: np.ndarray, named: np.ndarray, labels: np.ndarray, vectors: np.ndarray, keys: list[str | None]) -> None:
        b, slots, new = self.block, self.block.low.shape[1], [self.rows]
        itself = [(self.own[k], j) for j, k in enumerate(keys) if k is not None and k in self.own]
        for start in range(0, len(b.keys), ANCHORS):
            some = slice(start, start + ANCHORS)
            score = products(b.vectors[some], vectors)
            able = (b.labels[some, None] == labels) == b.same
            for i, j in itself:
                if start <= i < start + ANCHORS:
                    able[i - start, j] = False
            for s in range(slots):
                reach = self.reach[s::slots][some]
                a, c = np.nonzero(able & (score >= np.maximum(b.low[some, s], reach)[:, None]) & (score <= b.high[some, s, None]))
                if len(a):
                    new.append([(a + start) * slots + s, score[a, c].astype(np.int64), ids[c], named[c]])
        if len(new) > 1:
            rows = [np.concatenate(x) for x in zip(*new)]
            kept = merge(*rows, b.size)
            self.rows = [x[kept] for x in rows]
            self.reach = np.maximum(self.reach, last_places(*self.rows[:2], len(self.reach), b.size))


def last_places(slot: np.ndarray, score: np.ndarray, slots: int, size: int) -> np.ndarray:
    """The score of the last place of each list that is full, else the least number."""
    n = np.bincount(slot, minlength=slots)
    least = np.full(slots, MOST)
    np.minimum.at(least, slot, score)
    return np.where(n >= size, least, LEAST)


def best(points: DataFrame, block: Block, scale: float) -> DataFrame:
    """(slot, score, id, place): the lists of the block's slots over points, in order."""
    shared = points.sparkSession.sparkContext.broadcast(block)
    schema = "slot long, score long, id long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, step = Lists(shared.value), 64
        for batch in batches:
            start = 0
            while start < len(batch):  # small blocks first, so that full lists soon turn most rows away
                part = batch.slice(start, step)
                ids = part.column(1)
                lists.add(ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_valid()), part.column(2).to_numpy(zero_copy_only=False), dense(part.column(3), scale), part.column(0).to_pylist())
                start, step = start + step, min(CANDIDATES, step * 4)
        slot, score, ids, named = lists.rows
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(score), pa.array(ids, mask=~named)], names=["slot", "score", "id"])

    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    found = points.select("key", "id", "label", "vector").mapInArrow(run, schema)
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= block.size)


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", *, scale: float = 256.0, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hard negatives of each anchor's positives.

    A score is the inner product of the vectors' floor(scale * x) with the anchor's. Positives are an anchor's first
    `positives` other rows of its label; negatives are, for each of them, the first `negatives` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Higher scores come first, then smaller ids, null
    last. Anchors are the rows for which `anchor` holds. Rows with a null label or vector or a component that is null or not
    finite take no part; labels and ids must be whole numbers. Missing components count as 0, scores are held to 64 bits.
    Repeated rows are rows of their own, anchors too; rows of one anchor apart from the anchor itself may have its id. Other
    columns are not read; an empty table, or one without anchors, gives an empty result. Every pair of an anchor and a row is
    scored, in blocks of bounded size. The result reads a table in the shared folder.
    """
    spark = rows.sparkSession
    sound = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    numbered, row = number_rows(rows, is_stored(rows))
    key = F.when(anchor, F.to_json(F.struct(row))).alias("key")
    points = numbered.where(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & F.coalesce(sound, F.lit(False)))
    points = points.select(key, F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vector"))
    anchors = cut(points.where("key IS NOT NULL"), "anchors")
    size = anchors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    blocks = max(1, -(-size.n // BLOCK), -(-size.n * size.width * 8 // BLOCK_BYTES))
    path = new_path(spark, "negatives")
    columns = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], columns).write.parquet(path)
    for b in range(blocks):
        own = anchors.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).toArrow()
        if own.num_rows:
            _mine_block(points, anchors, own, scale, positives, negatives, low, high).write.mode("append").parquet(path)
    discard(anchors, *([numbered] if hasattr(numbered, "cut_path") else []))
    return spark.read.schema(columns).parquet(path)


def _mine_block(points: DataFrame, anchors: DataFrame, own: pa.Table, scale: float, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    own = own.combine_chunks()
    n, ids = own.num_rows, own["id"].to_pylist()
    parts = own["key"].to_pylist(), own["label"].to_numpy(), dense(own["vector"].combine_chunks(), scale)

    def lists(same: bool, least: np.ndarray, most: np.ndarray, length: int) -> DataFrame:
        block = Block(*parts, same, least, most, length)
        few = best(anchors, block, scale).select("slot", "score").toArrow()
        block.reach = last_places(few["slot"].to_numpy(), few["score"].to_numpy(), least.size, length)
        return best(points, block, scale)

    found = lists(True, np.full((n, 1), LEAST), np.full((n, 1), MOST), positives).toArrow().to_pylist()  # at most `positives` rows an anchor of the block
    least, most, named = np.full((n, positives), MOST), np.full((n, positives), LEAST), []
    for r in found:
        a, p, score = r["slot"], r["place"] - 1, r["score"]
        least[a, p], most[a, p] = -(-low * score // 100), high * score // 100
        named.append((a * positives + p, ids[a], r["id"], score))
    slots = points.sparkSession.createDataFrame(named, "slot long, anchor_id long, positive_id long, positive_score long")
    chosen = lists(False, least, most, negatives).select("slot", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return chosen.join(slots, "slot").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
