"""Selections that were sequential by definition against plain loops."""

import random

import pytest

from granary.operators import relations as R


def plain_permutation(n, seed):
    places, state = list(range(n)), (seed ^ R.MIX) % 2**64
    for last in reversed(range(1, n)):
        state = (state * R.MULTIPLIER + R.INCREMENT) % 2**64
        other = state % (last + 1)
        places[last], places[other] = places[other], places[last]
    return {index: at for at, index in enumerate(places)}


@pytest.mark.parametrize("n, seed", [(0, 1), (1, 1), (2, 7), (3, 2**63 + 5), (150_000, 42)])
def test_top07_equals_the_loop(spark, n, seed):
    rows = spark.range(n).selectExpr("id * 3 - 7 AS k", "'x' AS index").repartition(7)
    found = {(r.k + 7) // 3: r.at for r in R.seeded_permutation(rows, "k", seed).collect()}
    assert found == plain_permutation(n, seed)


def plain_pick(rows, buckets, k):
    used, chosen = set(), []
    for bucket in buckets:
        n = 0
        for _, _, i, a, b in sorted(r for r in rows if r[0] == bucket):
            if n < k and not used & {a, b}:
                used |= {a, b}
                chosen.append((bucket, i, a, b))
                n += 1
        assert n == k
    return sorted(chosen)


def test_top02_equals_the_loop(spark):
    """Long chains of shared entities, which take a round a link, and a hot entity; too few are an error."""
    r = random.Random(4)
    rows = [("x", i, f"x{i}", f"e{i}", f"e{i + 1}") for i in range(12)] + [("y", i, f"y{i}", f"e{r.randrange(40)}", f"f{r.randrange(400)}") for i in range(300)] + [("y", 1000 + i, f"h{i}", "hot", f"g{i}") for i in range(200)] + [("x", 50, "same", "s", "s")]
    made = spark.createDataFrame(rows, "bucket string, rank int, id string, a string, b string").repartition(5)
    for k in (1, 5):
        assert sorted(map(tuple, R.pick_exclusive(made, ["x", "y"], k).collect())) == plain_pick(rows, ["x", "y"], k)
    with pytest.raises(ValueError, match="only"):
        R.pick_exclusive(made.where("bucket = 'x'"), ["x"], 20)
