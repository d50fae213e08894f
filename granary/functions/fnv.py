"""FNV-1a, 64 bits: SQL has no multiplication that wraps, so a pandas UDF over Arrow batches computes it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: The public offset basis and prime.
BASIS, PRIME = 0xCBF29CE484222325, 0x100000001B3


@F.pandas_udf(LongType())
def fnv1a(texts: pd.Series) -> pd.Series:
    """The hash of the UTF-8 bytes as a signed long, null for null: all texts of a batch go forward together, byte by byte."""
    raw = [t.encode() if t is not None else b"" for t in texts]
    size = np.array([len(b) for b in raw], np.int64)
    order = np.argsort(-size, kind="stable")
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    data = np.frombuffer(b"".join(raw), np.uint8)
    h = np.full(len(raw), BASIS, np.uint64)
    live = np.searchsorted(-size[order], -np.arange(1, (size.max() if len(size) else 0) + 1), "right")
    for k, n in enumerate(live):
        rows = order[:n]
        h[rows] = (h[rows] ^ data[start[rows] + k]) * np.uint64(PRIME)
    return pd.Series(h.view(np.int64), dtype="Int64").where(texts.notna().to_numpy())
