"""A small evaluation network over sparse features: an integer first layer by gathering, then clipped layers in 32-bit floats (FN-27)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The accumulator's range, what it is clipped to and divided by, the hidden layer's upper clip.
LOW, HIGH, CLIP, SCALE, TOP = -(1 << 15), (1 << 15) - 1, 8128, 64, 127.0


@dataclass
class Network:
    """Weights of fixed size, as each task gets them: features x units, units, 2 units x hidden, hidden, hidden, one."""

    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray
    out: np.ndarray
    out_bias: float


def accumulate(net: Network, lists: pa.Array) -> np.ndarray:
    """The first layer of each row: the bias and the rows of its active features, added in their order and held to 16 bits after each."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if len(flat) and not (0 <= flat.min() and flat.max() < len(net.first)):
        raise ValueError("a feature out of range")
    starts = np.cumsum(sizes) - sizes
    total = np.tile(net.first_bias.astype(np.int32), (len(sizes), 1))
    for k in range(int(sizes.max(initial=0))):
        rows = np.flatnonzero(sizes > k)
        total[rows] = np.clip(total[rows] + net.first[flat[starts[rows] + k]], LOW, HIGH)
    return total


def outputs(net: Network, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The network's output for accumulators of the side to move and of the other, every sum rounded to 32 bits as it is made."""
    one = np.float32
    hidden = np.tile(net.second_bias.astype(one), (len(own), 1))
    units = own.shape[1]
    a, b = (np.clip(x, 0, CLIP).astype(one) / one(SCALE) for x in (own, other))
    for unit in range(units):
        hidden += a[:, unit, None] * net.second[unit].astype(one)
        hidden += b[:, unit, None] * net.second[units + unit].astype(one)
    total = np.full(len(own), net.out_bias, one)
    for k in range(hidden.shape[1]):
        total += np.clip(hidden[:, k], one(0), one(TOP)) * one(net.out[k])
    return total / one(SCALE)


def forward_sparse(rows: DataFrame, id_col: str, own: str, other: str, net: Network) -> DataFrame:
    """(id_col, output, score): output in 32-bit floats, score without its fraction; own and other are arrays of active features.

    A row whose arrays are null has null results; a feature out of range is an error. Weights go to the tasks with the code.
    """
    kept = rows.select(id_col, F.col(own).cast("array<int>").alias("own"), F.col(other).cast("array<int>").alias("other"))
    schema = kept.select(id_col, F.lit(None).cast("float").alias("output"), F.lit(None).cast("bigint").alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = np.asarray(batch.column(1).is_valid()) & np.asarray(batch.column(2).is_valid())
            found = np.full(batch.num_rows, np.nan, np.float32)
            some = batch.filter(pa.array(there))
            if some.num_rows:
                found[there] = outputs(net, *(accumulate(net, some.column(k)) for k in (1, 2)))
            whole = np.trunc(np.where(there, found, 0)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, mask=~there), pa.array(whole, mask=~there)], names=schema.names)

    return kept.mapInArrow(run, schema)
