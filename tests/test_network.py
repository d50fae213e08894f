"""The sparse network against a scalar version that rounds each sum to 32 bits."""

import random
import struct

import numpy as np
import pytest

from granary.operators import network as N


def single(x):
    return struct.unpack("<f", struct.pack("<f", x))[0]


def plain(net, own, other):
    seats = []
    for features in (own, other):
        total = list(map(int, net.first_bias))
        for f in features:
            total = [max(N.LOW, min(N.HIGH, t + int(w))) for t, w in zip(total, net.first[f])]
        seats.append([max(0, min(N.CLIP, t)) / N.SCALE for t in total])
    hidden = [single(float(b)) for b in net.second_bias]
    for unit in range(len(seats[0])):
        for seat in (0, 1):
            row = net.second[seat * len(seats[0]) + unit]
            hidden = [single(h + single(seats[seat][unit] * single(float(w)))) for h, w in zip(hidden, row)]
    out = single(net.out_bias)
    for h, w in zip(hidden, net.out):
        out = single(out + single(max(0.0, min(N.TOP, h)) * single(float(w))))
    return single(out / N.SCALE)


def test_against_scalars(spark):
    """Sums that leave 16 bits are held after each feature, so their order counts; rounding is that of 32 bits; null arrays give null."""
    r = np.random.default_rng(8)
    net = N.Network(r.integers(-20_000, 20_000, (50, 6)), r.integers(-500, 500, 6), r.normal(size=(12, 5)) / 3, r.normal(size=5), r.normal(size=5) * 300, 0.3)
    s = random.Random(8)
    rows = [(i, [s.randrange(50) for _ in range(s.randrange(9))], [s.randrange(50) for _ in range(s.randrange(9))]) for i in range(300)]
    made = spark.createDataFrame([*rows, (900, None, [1]), (901, [1], None)], "id long, a array<int>, b array<int>").repartition(5)
    found = {x.id: (x.output, x.score) for x in N.forward_sparse(made, "id", "a", "b", net).collect()}
    want = {i: plain(net, a, b) for i, a, b in rows}
    assert found == {i: (w, int(w)) for i, w in want.items()} | {900: (None, None), 901: (None, None)}
    assert len({w for w in want.values()}) > 100 and N.forward_sparse(made.where("false"), "id", "a", "b", net).count() == 0
    with pytest.raises(Exception, match="out of range"):
        N.forward_sparse(spark.createDataFrame([(1, [50], [0])], made.schema), "id", "a", "b", net).collect()


def test_dense_pass_of_null_vectors(spark):
    from granary.operators import evaluation as E

    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id long, v array<double>")
    assert {x.id: x.output for x in E.forward(rows, "id", "v", [[1.0, 1.0]], [0.5], [2.0], 1.0, 3.0).collect()} == {1: 7.0, 2: None}
