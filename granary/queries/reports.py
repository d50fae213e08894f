"""Queries for fits, boards as text, fingerprints, field comparisons, observations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import scalar as S
from granary.operators import evaluation as E
from granary.operators.relations import field_mismatches, observations
from granary.session import table

from . import Registry

REGISTRY = query = Registry()
_RIDGES = [0.0, 1.0, 10.0, 100.0, 1000.0]
_PIECES = {"p": 1, "n": 4, "b": 8, "r": 10}


@query(
    "num03_ridge_grid",
    f"""WITH s AS (SELECT sum(l_quantity * l_quantity) AS xx, sum(l_quantity * d) AS xz, sum(d * d) AS zz, sum(l_quantity * y) AS xy, sum(d * y) AS zy
      FROM (SELECT l_quantity, round(l_discount * 100) AS d, floor(l_extendedprice) AS y FROM lineitem)), r(ridge) AS (VALUES {", ".join(f"({x}::DOUBLE)" for x in _RIDGES)})
    SELECT ridge, round(((zz + ridge) * xy - xz * zy) / ((xx + ridge) * (zz + ridge) - xz * xz), 4) AS w1,
      round(((xx + ridge) * zy - xz * xy) / ((xx + ridge) * (zz + ridge) - xz * xz), 4) AS w2 FROM s, r""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", F.round(F.col("l_discount") * 100).alias("d"), F.floor("l_extendedprice").alias("y"))
    return E.ridge_grid(rows, "l_quantity", "d", "y", _RIDGES)


def _count(x):
    return f"(length(text) - length(replace(text, '{x}', '')))"


@query("fn16_signed_material", "SELECT doc_id, " + " + ".join(f"{v} * ({_count(k.upper())} - {_count(k)})" for k, v in _PIECES.items()) + " AS material FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.signed_material(F.col("text"), _PIECES).alias("material"))


@query("fn26_rotated_swap", "SELECT p_partkey, reverse(translate(p_brand, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')) AS turned FROM part")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.rotated_swap(F.col("p_brand")).alias("turned"))


@query("agg25_wrapping_fingerprint", "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(CAST('0x' || substr(sha256(l_orderkey || ':' || l_linenumber), 1, 16) AS UBIGINT) AS HUGEINT)) % 18446744073709551616::HUGEINT AS VARCHAR) AS fingerprint FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return E.wrapping_fingerprint(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_orderkey", "l_linenumber"])


@query(
    "jon14_field_mismatches",
    """WITH j AS (SELECT c_custkey, s_suppkey, c_nationkey, s_nationkey, c_acctbal, s_acctbal FROM customer FULL JOIN supplier ON c_custkey = s_suppkey)
    SELECT f AS field, count(*) FILTER (WHERE c_custkey IS NULL) AS only_right, count(*) FILTER (WHERE s_suppkey IS NULL) AS only_left,
      count(*) FILTER (WHERE c_custkey IS NOT NULL AND s_suppkey IS NOT NULL AND a IS DISTINCT FROM b) AS differing
    FROM (SELECT c_custkey, s_suppkey, 'nationkey' AS f, CAST(c_nationkey AS DOUBLE) AS a, CAST(s_nationkey AS DOUBLE) AS b FROM j UNION ALL SELECT c_custkey, s_suppkey, 'acctbal', c_acctbal, s_acctbal FROM j) GROUP BY 1""",
)
def _(spark, sf_dir):
    left = table(spark, sf_dir, "customer").selectExpr("c_custkey AS key", "c_nationkey AS nationkey", "c_acctbal AS acctbal")
    right = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS key", "s_nationkey AS nationkey", "s_acctbal AS acctbal")
    return field_mismatches(left, right, "key", ["nationkey", "acctbal"])


@query(
    "fn11_observations",
    """WITH o AS (SELECT user_id, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'view') AS n_markers, count(value) FILTER (WHERE value > 0) AS n_positive, count(value) FILTER (WHERE value = 0) AS n_zero,
      last(value ORDER BY ts, event_id) FILTER (WHERE value IS NOT NULL) AS last_value, max(value) AS max_value FROM events GROUP BY 1)
    SELECT user_id, n_events, n_positive, n_zero, last_value, max_value,
      CASE WHEN n_markers > 1 THEN 'ambiguous' WHEN last_value IS NULL THEN 'no_score' WHEN n_markers = 0 THEN 'protocol_failure' ELSE 'exact' END AS status FROM o""",
)
def _(spark, sf_dir):
    return observations(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", F.col("event_type") == "view")


@query("snk06_markdown_rows", "SELECT '| ' || r_name || ' | ' || count(n_nationkey) || ' |' AS line FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def _(spark, sf_dir):
    counts = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.expr("r_regionkey = n_regionkey"), "left").groupBy("r_name").agg(F.count("n_nationkey").alias("n"))
    return counts.select(S.markdown_row("r_name", "n").alias("line"))
