"""Exact statistics of sparse integer rows and fits on them (AGG-28, NUM-02, NUM-04).

The statistics are one Spark aggregate, proved to be exact before they are taken. They are a table of at most K x K numbers, K
being the number of features and bounded by a parameter; only that reaches the driver, where the fit is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sums below it are exact in 64-bit doubles and integers alike, whatever their order.
EXACT = 1 << 53
#: Most features: a task and the driver hold a square of as many doubles.
MOST = 4096


def bounds(rows: DataFrame, index: str, value: str, target: str) -> DataFrame:
    """(i, squares): the sum of squares of each feature, and of the target as i = -1, in 38 digits, where nothing wraps.

    index and value are arrays of a row's features that aren't 0; a feature that a row names twice is an error of the input
    that sparse_gram() refuses. By Cauchy and Schwarz no sum of products over any part of the rows is larger than the
    largest of these sums.
    """
    wide = lambda c: F.col(c).cast("decimal(19,0)") * F.col(c).cast("decimal(19,0)")
    each = rows.select(F.inline(F.arrays_zip(F.col(index).alias("i"), F.col(value).alias("z")))).select(F.col("i").cast("int").alias("i"), wide("z").alias("x"))
    return each.unionByName(rows.select(F.lit(-1).alias("i"), wide(target).alias("x"))).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("squares"))


def sparse_gram(rows: DataFrame, index: str, value: str, target: str, features: int) -> DataFrame:
    """(i, j, s), i <= j: the exact sums of z_i z_j over the rows, and of z_i d as j = -1 (AGG-28). Sums that are 0 are left out.

    A first pass proves that every sum, of any part of the rows, stays below 2^53; else it is an error, not a wrapped
    number. Then tasks add up the pairs of features that are active in a row, and a row a pair and task is shuffled. Rows
    with a null array or target are left out; a feature out of range, or named twice in a row, is an error.
    """
    if features > MOST:
        raise ValueError(f"over {MOST} features")
    rows = rows.select(F.col(index).cast("array<int>").alias("index"), F.col(value).cast("array<bigint>").alias("value"), F.col(target).cast("bigint").alias("target")).where("index IS NOT NULL AND value IS NOT NULL AND target IS NOT NULL")
    good = (F.size("index") == F.size("value")) & (F.size(F.array_distinct("index")) == F.size("index")) & F.forall("index", lambda i: F.coalesce((i >= 0) & (i < features), F.lit(False))) & F.forall("value", lambda z: z.isNotNull())
    if not rows.where(~good).isEmpty():
        raise ValueError("a row whose features are out of range, named twice or without a value")
    worst = bounds(rows, "index", "value", "target").orderBy(F.desc("squares")).first()
    if worst and worst.squares >= EXACT:
        raise ValueError(f"the sum of squares of feature {worst.i} is {worst.squares}: sums may not be exact")
    width = features + 1  # the target is the last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width)
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            row = np.repeat(np.arange(len(sizes)), sizes)
            last = np.cumsum(sizes) - 1
            f, z = np.full(len(row), features, np.int64), np.empty(len(row))
            own = np.ones(len(row), bool)
            own[last] = False
            f[own], z[own] = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
            z[last] = batch.column(2).to_numpy()
            ahead = last[row] - np.arange(len(row))  # pairs of an entry with those after it in its row, a distance at a time
            for step in range(int(ahead.max(initial=0)) + 1):
                a = np.flatnonzero(ahead >= step)
                b = a + step
                low, high = np.minimum(f[a], f[b]), np.maximum(f[a], f[b])
                np.add.at(total, low * width + high, z[a] * z[b])
        at = np.flatnonzero(total)
        low, high = at // width, at % width
        kept = low < features  # not the target's own square
        yield pa.RecordBatch.from_arrays([pa.array(low[kept].astype(np.int32)), pa.array(np.where(high == features, -1, high)[kept].astype(np.int32)), pa.array(total[at][kept].astype(np.int64))], names=["i", "j", "s"])

    return rows.mapInArrow(run, "i int, j int, s long").groupBy("i", "j").agg(F.sum("s").alias("s")).where("s <> 0")


@dataclass
class Fit:
    weights: np.ndarray
    steps: int
    distance: float  # proved bound, in doubles, of the distance to the optimum


def onto_simplex(v: np.ndarray, a: np.ndarray, cap: float) -> np.ndarray:
    """The nearest point to v with weights >= 0 and a . weights <= cap, a > 0: max(v - t a, 0) for the least t >= 0 that fits."""
    inside = np.maximum(v, 0)
    if a @ inside <= cap:
        return inside
    order = np.argsort(-v / a, kind="stable")
    t = (np.cumsum(a[order] * v[order]) - cap) / np.cumsum(a[order] ** 2)  # t if the first k are those above 0
    k = np.flatnonzero(t < (v / a)[order])[-1]
    return np.maximum(v - t[k] * a, 0)


def constrained_ridge(gram: np.ndarray, moment: np.ndarray, ridge: float, prior: np.ndarray, groups: list[tuple[list[int], list[float], float]], near: float = 1e-6, steps: int = 200_000) -> Fit:
    """The weights w that minimise w'Gw - 2 m'w + ridge |w - prior|^2 under w >= 0 and a . w <= cap in each group (NUM-02).

    groups are (features, a, cap); each feature is in one of them. Projected gradient steps with momentum, which starts anew
    where the objective rises. The objective is strongly convex by 2 ridge. A step to z from y leaves L (y - z) - f'(y) in
    the cone of normals at z, so f'(z) plus it is a subgradient there, and its length over 2 ridge bounds the distance to
    the optimum. It ends at a bound of `near`; no such bound within `steps` is an error.
    """
    a, b = gram + ridge * np.eye(len(gram)), moment + ridge * prior
    slope = 2 * np.abs(a).sum(axis=1).max()
    if sorted(i for g, _, _ in groups for i in g) != list(range(len(gram))) or ridge <= 0:
        raise ValueError("each feature belongs to one group, and the ridge is above 0")

    def project(v: np.ndarray) -> np.ndarray:
        out = np.empty_like(v)
        for own, weights, cap in groups:
            out[own] = onto_simplex(v[own], np.array(weights, float), cap)
        return out

    def objective(w: np.ndarray) -> float:
        return float(w @ a @ w - 2 * b @ w)

    w = ahead = project(prior.astype(float))
    speed = 1.0
    for step in range(1, steps + 1):
        z = project(ahead - 2 * (a @ ahead - b) / slope)
        bound = float(np.linalg.norm(slope * (ahead - z) - 2 * a @ (ahead - z)) / (2 * ridge))
        if bound <= near:
            return Fit(z, step, bound)
        if objective(z) > objective(w) and speed > 1:
            ahead, speed = w, 1.0
            continue
        faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        w, ahead, speed = z, z + (speed - 1) / faster * (z - w), faster
    raise ValueError(f"no certificate within {steps} steps")


def fit_rows(rows: DataFrame, index: str, value: str, target: str, features: int, ridge: float, prior: list[float], groups: list[tuple[list[int], list[float], float]]) -> DataFrame:
    """(feature, weight, distance): the constrained ridge fit over the means of sparse_gram()'s sums; without rows it is the prior, projected."""
    sums = sparse_gram(rows, index, value, target, features).collect()  # at most `features` squared
    n = max(1, rows.where(F.col(index).isNotNull() & F.col(value).isNotNull() & F.col(target).isNotNull()).count())
    gram, moment = np.zeros((features, features)), np.zeros(features)
    for r in sums:
        if r.j < 0:
            moment[r.i] = r.s / n
        else:
            gram[r.i, r.j] = gram[r.j, r.i] = r.s / n
    found = constrained_ridge(gram, moment, ridge, np.array(prior, float), groups)
    return rows.sparkSession.createDataFrame([(i, float(w), found.distance) for i, w in enumerate(found.weights)], "feature int, weight double, distance double")


@dataclass
class Certified:
    weights: np.ndarray
    steps: int
    gap: Fraction  # proved, without rounding: the objective is at most so far above its least value


def onto_l1_ball(v: np.ndarray, radius: float) -> np.ndarray:
    """The nearest point to v whose absolute values sum to `radius` at most."""
    return np.sign(v) * onto_simplex(np.abs(v), np.ones(len(v)), radius)


def duality_gap(gram: np.ndarray, moment: np.ndarray, ridge: int, weights: np.ndarray, radius: Fraction) -> Fraction | None:
    """g . w + radius * max |g| with g the gradient at w, in whole numbers; None if w is outside the ball.

    For a convex objective it bounds how far w is above the least value over the ball: no point of the ball is lower than the
    tangent at w allows. Doubles are fractions with a power of two below, so nothing is rounded. gram and moment are whole.
    """
    parts = [float(w).as_integer_ratio() for w in weights]
    below = max((q for _, q in parts), default=1)
    u = np.array([p * (below // q) for p, q in parts], dtype=object)
    if Fraction(int(sum(abs(x) for x in u)), below) > radius:
        return None
    g = gram.astype(object).dot(u) + ridge * u - below * moment.astype(object)  # times `below`
    return Fraction(int(g.dot(u)), below * below) + radius * Fraction(int(max(abs(x) for x in g)), below)


def l1_ridge(gram: np.ndarray, moment: np.ndarray, ridge: int, radius: float, near: float, steps: int = 100_000) -> Certified:
    """The weights w that minimise w'(G + ridge I)w / 2 - m'w over |w|_1 <= radius, for whole G and m (NUM-04).

    Gradient steps with momentum, projected on the ball, that start anew where the objective rises. When the gap in doubles
    is small enough, it is taken again in whole numbers, for weights that are shrunk by a few units in the last place if
    rounding left them outside. A gap of at most `near` ends the search; if none is proved within `steps`, that is an error.
    """
    a, b = gram.astype(float) + ridge * np.eye(len(gram)), moment.astype(float)
    slope = float(np.abs(a).sum(axis=1).max(initial=0)) or 1.0
    bound = Fraction(radius)

    def objective(w: np.ndarray) -> float:
        return float(w @ a @ w / 2 - b @ w)

    w = ahead = np.zeros(len(b))
    speed = 1.0
    for step in range(1, steps + 1):
        z = onto_l1_ball(ahead - (a @ ahead - b) / slope, radius)
        if objective(z) > objective(w) and speed > 1:
            ahead, speed = w, 1.0
            continue
        g = a @ z - b
        if g @ z + radius * np.abs(g).max(initial=0) <= 0.9 * near:
            for shrunk in (z, z * (1 - 2.0**-40)):
                gap = duality_gap(gram, moment, ridge, shrunk, bound)
                if gap is not None and gap <= Fraction(near):
                    return Certified(shrunk, step, gap)
        faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        w, ahead, speed = z, z + (speed - 1) / faster * (z - w), faster
    raise ValueError(f"no certificate within {steps} steps")


def l1_fit_rows(rows: DataFrame, index: str, value: str, target: str, features: int, ridge: int, radius: float, near: float) -> DataFrame:
    """(feature, weight, gap): the certified fit over sparse_gram()'s exact sums; gap as text, a fraction. Without rows all weights are 0."""
    gram, moment = np.zeros((features, features), np.int64), np.zeros(features, np.int64)
    for r in sparse_gram(rows, index, value, target, features).collect():  # at most `features` squared
        if r.j < 0:
            moment[r.i] = r.s
        else:
            gram[r.i, r.j] = gram[r.j, r.i] = r.s
    found = l1_ridge(gram, moment, ridge, radius, near)
    return rows.sparkSession.createDataFrame([(i, float(w), str(found.gap)) for i, w in enumerate(found.weights)], "feature int, weight double, gap string")
