"""Operators 11 to 13 against plain versions, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import common, hard_negatives, importance, queries, toxicity

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
AWKWARD = [(1, None), (2, ""), (3, " \t\n-- !"), (4, LONG), (5, LONG), (6, "Ünïcödé 😀 text"), (6, "Ünïcödé 😀 text"), (None, "no id here"), (None, "no id here"), (7, "MIXED Case 9 mixed"), (8, None), (9, "x" * 300)]
SCHEMA = "doc_id long, text string, bucket string, gram int, n_words string, key int, label string, __row int, id int, place int, able int, rank int, weight int, score string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "a", 1, "b", 2, "c", 3, 4, 5, 6, 7, 8, "d") for i, t in AWKWARD], SCHEMA)


# 11: toxicity


def plain_scores(model, texts):
    """Word by word, without cells that are remembered, pieces or sums that are merged."""
    toxic, ordinary = (toxicity.Sizes(c) for c in model.contents)
    out = []
    for t in texts:
        words = toxicity.windows((t or "").encode())
        v = sorted((model.values.get((len(w) * 128 + ordinary(w)) * 128 + toxic(w), 0.0) for w in words), reverse=True)
        n, over = max(1, len(v)), sum(max(x - 1, 0) for x in v)
        means = [sum(v[:k]) / max(1, len(v[:k])) for k in (1, 2, 4, 8)]
        x = [*means, sum(v) / n, over / n, math.log1p(over), math.log1p(sum(x > 2 for x in v)), math.log1p(sum(x > 3 for x in v)), sum(x > 2 for x in v) / n, math.log1p(len(v))]
        z = model.weight[0] + sum(w * (a - m) / d for w, a, m, d in zip(model.weight[1:], x, model.mean, model.deviation))
        out.append(1 / (1 + math.exp(-z)) if v else 0.0)
    return out


@pytest.fixture(scope="module")
def toxic_model():
    r = random.Random(3)
    ordinary = ["the", "and", "garden", "house", "with", "people", "river", "under", "stone", "water", "evening", "letter"]
    bad = ["grobnik", "slorvath", "murgling"]

    def text(toxic):
        words = [r.choice(ordinary) + r.choice(["", "s", "er", "ing"]) for _ in range(60)]
        for _ in range(4 if toxic else 0):
            words[r.randrange(60)] = r.choice(bad)
        return " ".join(words)

    sample = [(text(i % 4 == 0).encode(), i % 4 == 0) for i in range(200)]
    return toxicity.fit(sample, 0.25), [(text(i % 4 == 0), i % 4 == 0) for i in range(100)]


def test_op11_separates_and_equals_the_plain_version(spark, toxic_model):
    model, held = toxic_model
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(held)], "doc_id long, text string")
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((found[i] >= 0.3) == y for i, (_, y) in enumerate(held))
    assert np.allclose([found[i] for i in range(len(held))], plain_scores(model, [t for t, _ in held]))
    assert toxicity.Sizes(model.contents[0])(b"grobnik") + 3 < toxicity.Sizes(model.contents[1])(b"grobnik")


def test_op11_awkward(spark, odd, toxic_model):
    model, _ = toxic_model
    found = toxicity.score(odd, model).collect()
    assert len(found) == len(AWKWARD) and {r.doc_id for r in found if r.score == 0} == {1, 2, 3, 8}
    assert np.allclose(sorted(r.score for r in found), sorted(plain_scores(model, [t for _, t in AWKWARD])))
    assert toxicity.score(odd.where("false"), model).count() == 0 and {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    labels = spark.createDataFrame([(4, 1), (6, 0), (None, 1), (7, None), (9, 5)], "doc_id long, toxic int")
    assert toxicity.learn(odd, labels) is None and toxicity.learn(odd, labels.where("false")) is None


def test_op11_pieces(toxic_model, monkeypatch):
    """A text that is read in pieces has the score of the whole text; pieces join to the text and split no character."""
    model, held = toxic_model
    text = "\n".join(t for t, _ in held).encode()
    whole = toxicity.scores(model, toxicity.Cells(model.contents), [text])
    monkeypatch.setattr(toxicity, "PIECE", 1000)
    monkeypatch.setattr(toxicity.pieces, "__defaults__", (1000,))
    assert np.allclose(toxicity.scores(model, toxicity.Cells(model.contents), [text]), whole)
    for t in (text, "ü😀".encode() * 1000, b"", None):
        parts = list(toxicity.pieces(t))
        assert b"".join(p or b"" for p in parts) == (t or b"") and all(len(p or b"") <= 1000 for p in parts)
        assert all((p or b"").decode() is not None for p in parts)


def test_op11_held_out(spark, sf):
    """Held-out toxic rows are found and clean rows left alone; labels of held-out rows change nothing."""
    sf = sf.replace("sf0.001", "sf0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = queries.QUERIES["op11_toxicity"](spark, sf).collect()
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in found)
    held = [(r.predicted, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    toxic = sum(y for _, y in held)
    assert sum(p and y for p, y in held) >= 0.75 * toxic and sum(p and not y for p, y in held) <= 0.02 * (len(held) - toxic)


# 12: hard negatives


def plain_negatives(rows, anchor, positives=5, negatives=10, low=30, high=90):
    rows = [(i, [math.floor(256 * x) for x in v], k) for i, v, k in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last, out = (lambda i: (i is None, i or 0)), []
    for n, (a, v, label) in enumerate(rows):
        if not anchor(a):
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, k) for m, (i, w, k) in enumerate(rows) if m != n]
        scored.sort(key=lambda r: (-r[0], last(r[1])))
        for score, p, _ in [r for r in scored if r[2] == label][:positives]:
            fits = [r for r in scored if r[2] != label and low * score <= 100 * r[0] <= high * score][:negatives]
            out += [(a, p, k + 1, i, score, s) for k, (s, i, _) in enumerate(fits)]
    return Counter(out)


def points(seed, n, width=6, labels=3):
    r = random.Random(seed)
    return [(r.choice([i, i, i, None, i // 2]), [r.uniform(-1, 1) for _ in range(width)], r.randrange(labels)) for i in range(n)]


KIND = "vec_id long, embedding array<double>, label int, key string, id int, row int, slot int"


@pytest.mark.parametrize("block", [16384, 3])
def test_op12_against_a_plain_version(spark, monkeypatch, block):
    """Ties, repeated and null ids, repeated rows, ragged and bad vectors, and several blocks."""
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = points(1, 120) + points(1, 30) + [(200, None, 1), (201, [1.0, None], 1), (202, [float("nan")] * 6, 1), (203, [1.0], None), (204, [float("inf")], 0), (210, [], 0), (220, [0.5, 0.25], 1), (220, [0.5, 0.25], 1), (230, [0.0] * 9, 2)]
    made = spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], KIND).repartition(5)
    found = hard_negatives.mine(made, F.col("vec_id") % 10 == 0)
    assert Counter(map(tuple, found.collect())) == plain_negatives(rows, lambda i: i is not None and i % 10 == 0)


def test_op12_empty(spark):
    made = spark.createDataFrame([(*r, "k", 1, 2, 3) for r in points(2, 20)], KIND)
    assert hard_negatives.mine(made.where("false"), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(made, F.lit(False)).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1, "", 1, 2, 3)], KIND)
    assert hard_negatives.mine(alone, F.col("vec_id") == 0).count() == 0


def test_op12_beyond_doubles():
    """Sums that doubles can't hold are made in whole numbers, and held to 64 bits."""
    a, b = np.array([[2.0**40, 1.0], [2.0**60, 0.0]]), np.array([[2.0**20, 1.0], [-(2.0**60), 3.0]])
    assert hard_negatives.products(a, b).tolist() == [[2**60 + 1, -(2**63)], [2**63 - 1, -(2**63)]]
    assert hard_negatives.products(np.array([[3.0, 4.0]]), np.array([[1.0]])).tolist() == [[3.0]]


# 13: importance resampling


def plain_resample(rows, items, buckets=10_000, most=1, least=20, percent=10, seed=2024):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return "".join(c if c.isascii() and (c.islower() or c.isdigit()) or not c.isascii() else " " for c in low).split(" ")

    def features(t):
        w = [x for x in words(t) if x]
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    docs = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in items for b in features(x)[1])
    big_s, big_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for i, n, f in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return Counter(map(tuple, out))


def test_op13_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name in ("op12_hard_negatives", "op13_importance_resampling"):
        df = queries.QUERIES[name](spark, sf)
        want = con.execute(queries.ORACLES[name])
        columns = [d[0] for d in want.description]
        assert Counter(map(tuple, df.select(*columns).collect())) == Counter(want.fetchall()) and df.count()


@pytest.mark.parametrize("most", [1, 3])
def test_op13_awkward(spark, odd, most):
    """Ties, repeated and null ids and rows; at two words nearly all can be drawn, and half are."""
    items = ["mixed case word3 word4", None, ""]
    target = spark.createDataFrame([(t,) for t in items], "text string")
    found = importance.resample(odd.repartition(3), target, most=most, least_words=1, percent=50)
    assert Counter(map(tuple, found.collect())) == plain_resample(AWKWARD, items, most=most, least=1, percent=50)
    assert importance.resample(odd.where("false"), target).count() == 0
    assert Counter(map(tuple, importance.resample(odd, target.where("false"), least_words=1).collect())) == plain_resample(AWKWARD, [], least=1)
    with pytest.raises(ValueError, match="buckets"):
        importance.resample(odd, target, buckets=1 << 21)


def test_op13_many_partitions(spark):
    """Ranks are without gaps whatever the number of partitions, with scores that tie."""
    rows = [(i % 400, " ".join(["alpha", "beta"][i % 2] for _ in range(25))) for i in range(2000)]
    docs, target = spark.createDataFrame(rows, "doc_id long, text string").repartition(23), spark.createDataFrame([("alpha",)], "text string")
    assert Counter(map(tuple, importance.resample(docs, target).collect())) == plain_resample(rows, ["alpha"])


# tables in the shared folder


def test_tables_that_stay(spark, sf, tmp_path, monkeypatch):
    """After its result is read, each query has left only the tables that the result reads; none holds a copy of all texts but the pipeline's last."""
    import corpus_pipeline

    def left(run):
        folder = tmp_path / run.__name__
        monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{folder}")
        assert run(spark, sf).count()
        return sorted(re.sub("-[0-9a-f]{32}$", "", p.name) for p in folder.iterdir())

    assert left(queries.QUERIES["op3_exact_dedup"]) == ["dedup-classes", "dedup-rows"]
    assert left(queries.QUERIES["op8_simhash_near_dedup"]) == ["simhash-marks", "simhash-named"]
    assert left(queries.QUERIES["op12_hard_negatives"]) == ["negatives"]
    assert left(queries.QUERIES["op13_importance_resampling"]) == ["ranked"]
    assert left(corpus_pipeline.run) == ["dedup-classes", "dedup-rows", "pipeline", "simhash-marks", "simhash-named"]
