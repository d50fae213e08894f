"""Every query of the library against its SQL on whole tables."""

import duckdb
import pytest

from granary.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def text(x):
    if isinstance(x, float):
        return f"{x:.6g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(text, x)) + "]"
    return str(x)


def table(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    want = duck.execute(ORACLES[name])
    assert table(df.collect(), df.columns) == table(want.fetchall(), [d[0] for d in want.description])


def test_queries_without_sql(spark, sf):
    hashed = QUERIES["fn03_fnv1a"](spark, sf).join(spark.read.parquet(f"{sf}/customer.parquet"), "c_custkey").collect()
    for r in hashed:
        h = 0xCBF29CE484222325
        for b in r.c_name.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        assert r.hash % 2**64 == h and r.bucket == (h - 2**64 if h >> 63 else h) % 1000
    chosen = QUERIES["top02_greedy_exclusive"](spark, sf).collect()
    entities = [e for r in chosen for e in (r.a, r.b)]
    assert len(entities) == len(set(entities)) and max(sum(r.bucket == b for r in chosen) for b in {r.bucket for r in chosen}) <= 3


def test_top02_goes_past_crowded_ranks(spark, tmp_path):
    """Nation 0 holds nearly all orders of each priority; the few others are found at any rank, and too few are an error."""
    buckets = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    spark.createDataFrame([(c, 0 if c < 100 else c - 99) for c in range(115)], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    orders = [(k, k % 100, b) for k, b in enumerate(b for b in buckets for _ in range(400))] + [(9000 + c, c, buckets[c % 5]) for c in range(100, 115)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    chosen = QUERIES["top02_greedy_exclusive"](spark, str(tmp_path)).collect()
    assert [sum(r.bucket == b for r in chosen) for b in buckets] == [3] * 5 and len({r.a for r in chosen}) == 15
    spark.createDataFrame(orders[:-6], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(str(tmp_path / "few" / "orders.parquet"))
    spark.read.parquet(str(tmp_path / "customer.parquet")).write.parquet(str(tmp_path / "few" / "customer.parquet"))
    with pytest.raises(ValueError, match="only"):
        QUERIES["top02_greedy_exclusive"](spark, str(tmp_path / "few"))
