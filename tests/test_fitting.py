"""Exact sums over sparse rows, fits with certificates and digest trees against plain versions."""

import hashlib
import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import fitting
from granary.sources.datasets import inventory_digest


def test_agg28_sparse_rows(spark):
    r = random.Random(2)
    rows = []
    for _ in range(400):
        f = r.sample(range(60), r.randrange(8))
        rows.append((f, [r.randrange(-9, 10) for _ in f], r.randrange(-500, 500)))
    made = spark.createDataFrame([*rows, (None, [1], 1), ([1], None, 1), ([1], [1], None)], "i array<int>, z array<long>, y long").repartition(6)
    z, y = np.zeros((400, 60), np.int64), np.array([t for _, _, t in rows])
    for k, (f, v, _) in enumerate(rows):
        z[k, f] = v
    gram, moment = z.T @ z, z.T @ y
    want = {(i, j): int(gram[i, j]) for i in range(60) for j in range(i, 60) if gram[i, j]} | {(i, -1): int(moment[i]) for i in range(60) if moment[i]}
    assert {(x.i, x.j): x.s for x in fitting.sparse_gram(made, "i", "z", "y", 60).collect()} == want
    assert fitting.sparse_gram(made.where("false"), "i", "z", "y", 60).count() == 0


def test_agg28_proof(spark):
    """Sums that could pass 2^53 are an error, though 64 bits would hold them or wrap; so are rows that name a feature twice."""
    make = lambda *rows: spark.createDataFrame(rows, "i array<int>, z array<long>, y long")
    assert fitting.sparse_gram(make(([0], [2**26], 3), ([0], [2**25], 3)), "i", "z", "y", 1).where("j = 0").first().s == 2**52 + 2**50
    for rows in ([([0], [2**26], 0), ([0], [2**26], 0)], [([0], [2**62], 0)], [([0], [1], -(2**40))]):
        with pytest.raises(ValueError, match="exact"):
            fitting.sparse_gram(make(*rows), "i", "z", "y", 1)
    for row in (([0, 0], [1, 1], 0), ([1], [1], 0), ([-1], [1], 0), ([0], [1, 2], 0), ([None], [1], 0), ([0], [None], 0)):
        with pytest.raises(ValueError, match="out of range"):
            fitting.sparse_gram(make(row), "i", "z", "y", 1)


def plain_fit(a, b, groups):
    """The best of the feasible optima over all faces: each weight 0 or free, each cap slack or binding."""
    n, best, at = len(b), np.inf, None
    for zero in itertools.product([0, 1], repeat=n):
        for tight in itertools.product([0, 1], repeat=len(groups)):
            rows = [np.eye(n)[i] for i in range(n) if zero[i]] + [np.array([dict(zip(g, w)).get(i, 0.0) for i in range(n)]) for (g, w, _), t in zip(groups, tight) if t]
            ends = [0.0] * sum(zero) + [cap for (_, _, cap), t in zip(groups, tight) if t]
            c = np.array(rows).reshape(len(rows), n)
            system = np.block([[2 * a, c.T], [c, np.zeros((len(rows), len(rows)))]])
            w = np.linalg.lstsq(system, np.concatenate([2 * b, ends]), rcond=None)[0][:n]
            if np.allclose(c @ w, ends) and (w >= -1e-9).all() and all(np.dot(v, w[g]) <= cap + 1e-9 for g, v, cap in groups) and w @ a @ w - 2 * b @ w < best:
                best, at = w @ a @ w - 2 * b @ w, w
    return at


def test_num02_certificate():
    r = np.random.default_rng(3)
    for k in range(30):
        x = r.normal(size=(20, 5)) * [1, 3, 0.2, 5, 1]
        gram, moment, prior = x.T @ x / 20, r.normal(size=5) * 20, r.uniform(0, 3, 5)
        groups = [([0, 2, 3], [1.0, 2.0, 0.5], float(r.uniform(0.5, 20))), ([1, 4], [3.0, 1.0], float(r.uniform(0.5, 20)))]
        found = fitting.constrained_ridge(gram, moment, 0.5, prior, groups)
        want = plain_fit(gram + 0.5 * np.eye(5), moment + 0.5 * prior, groups)
        assert np.linalg.norm(found.weights - want) <= found.distance + 1e-7 and found.distance <= 1e-6
    with pytest.raises(ValueError, match="certificate"):
        fitting.constrained_ridge(gram, moment, 0.5, prior, groups, near=1e-30, steps=50)
    with pytest.raises(ValueError, match="one group"):
        fitting.constrained_ridge(gram, moment, 0.5, prior, groups[:1])


def test_num02_projection():
    """No feasible point is nearer: the gap to all others is one-sided."""
    r = np.random.default_rng(4)
    for _ in range(200):
        v, a, cap = r.normal(size=6) * 5, r.uniform(0.2, 3, 6), float(r.uniform(0.1, 10))
        p = fitting.onto_simplex(v, a, cap)
        assert (p >= 0).all() and a @ p <= cap * (1 + 1e-12)
        corners = np.vstack([np.zeros(6), np.diag(cap / a)])
        assert ((corners - p) @ (v - p) <= 1e-9).all()


def test_num02_from_rows(spark):
    empty = spark.createDataFrame([], "i array<int>, z array<long>, y long")
    assert [x.weight for x in fitting.fit_rows(empty, "i", "z", "y", 2, 1.0, [5.0, 1.0], [([0, 1], [1.0, 1.0], 2.0)]).orderBy("feature").collect()] == pytest.approx([2.0, 0.0])


def test_agg34_tree(spark):
    """100,000 files; no group gathers more than a leaf's share."""
    files = spark.range(100_000).select(F.concat(F.lit("data/"), "id").alias("name"), (F.col("id") % 77).alias("bytes"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    level = {}
    for i in range(100_000):
        level.setdefault(sha(f"data/{i}")[:4], []).append(f"data/{i} {i % 77} {sha(str(i))}")
    for digits in (2, 0):
        above = {}
        for at, lines in level.items():
            above.setdefault(at[:digits], []).append(f"{at} {sha(chr(10).join(sorted(lines)))}")
        level = above
    assert tuple(inventory_digest(files.repartition(9)).first()) == (100_000, sum(i % 77 for i in range(100_000)), sha("\n".join(sorted(level[""]))))
    assert tuple(inventory_digest(files.where("false")).first()) == (0, 0, sha(""))


def test_num04_certificate():
    """The proved gap bounds the distance of the objective to the best of all faces of the ball; gaps are exact and never negative."""
    r = np.random.default_rng(5)
    for k in range(25):
        z = r.integers(-9, 10, size=(40, 4))
        d = r.integers(-300, 300, size=40)
        gram, moment, radius = z.T @ z, z.T @ d, float(r.uniform(0.1, 40))
        found = fitting.l1_ridge(gram, moment, 1, radius, 1e-6)
        value = lambda w: w @ (gram + np.eye(4)) @ w / 2 - moment @ w  # noqa: B023, E731
        best = np.inf
        for signs in itertools.product([-1, 1], repeat=4):  # each orthant's part of the ball is a simplex
            s = np.array(signs)
            w = plain_fit((gram + np.eye(4)) * np.outer(s, s) / 2, moment * s / 2, [(list(range(4)), [1.0] * 4, radius)]) * s
            best = min(best, value(w))
        assert -1e-6 <= value(found.weights) - best <= float(found.gap) + 1e-6 and 0 <= found.gap <= Fraction(1e-6)
        assert fitting.duality_gap(gram, moment, 1, np.full(4, radius), Fraction(radius)) is None
    assert fitting.duality_gap(np.array([[2]]), np.array([3]), 1, np.array([0.5]), Fraction(2)) == Fraction(3, 2) * Fraction(-1, 2) + 2 * Fraction(3, 2)
    with pytest.raises(ValueError, match="certificate"):
        fitting.l1_ridge(gram, moment, 1, 5.0, 1e-30, steps=20)


def test_num04_from_rows(spark):
    rows = spark.createDataFrame([([0, 2], [3, -1], 30), ([1], [2], -8), ([2], [5], 1)], "i array<int>, z array<long>, y long")
    found = fitting.l1_fit_rows(rows, "i", "z", "y", 3, 1, 100.0, 1e-9).orderBy("feature").collect()
    want = np.linalg.solve(np.array([[10, 0, -3], [0, 5, 0], [-3, 0, 27]]), [90, -16, -25])
    assert np.allclose([x.weight for x in found], want, atol=1e-4) and all(0 <= Fraction(x.gap) <= Fraction(1e-9) for x in found)
    assert [x.weight for x in fitting.l1_fit_rows(rows.where("false"), "i", "z", "y", 2, 1, 1.0, 1e-9).collect()] == [0.0, 0.0]
