"""Positions with a teacher's and a candidate's score: orders are positions, priorities are games, customers are candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import table

GAMES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["exact", "bound", "mate", "missing"]

#: The same as scores(), for DuckDB.
SQL = """
    s AS (
      SELECT o_orderkey AS position, o_orderpriority AS game, o_orderkey % 2 = 0 AS first_side,
        CASE o_orderstatus WHEN 'F' THEN 'exact' WHEN 'O' THEN 'bound' ELSE 'mate' END AS teacher_status,
        CAST(floor(o_totalprice) AS BIGINT) % 2001 - 1000 AS teacher_cp,
        CASE WHEN c_custkey IS NULL OR c_mktsegment = 'MACHINERY' THEN 'missing' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'bound' ELSE 'exact' END AS candidate_status,
        CASE WHEN c_custkey IS NOT NULL AND c_mktsegment NOT IN ('MACHINERY', 'HOUSEHOLD') THEN CAST(floor(c_acctbal) AS BIGINT) % 1501 END AS candidate_cp
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(position, game, first_side, teacher_status, teacher_cp, candidate_status, candidate_cp); the plan is on the outer side (JON-06)."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"), "left")
    status = F.expr("CASE WHEN c_custkey IS NULL OR c_mktsegment = 'MACHINERY' THEN 'missing' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'bound' ELSE 'exact' END")
    return joined.select(
        F.col("o_orderkey").alias("position"),
        F.col("o_orderpriority").alias("game"),
        (F.col("o_orderkey") % 2 == 0).alias("first_side"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'exact' WHEN 'O' THEN 'bound' ELSE 'mate' END").alias("teacher_status"),
        (F.floor("o_totalprice").cast("long") % 2001 - 1000).alias("teacher_cp"),
        status.alias("candidate_status"),
        F.when(status == "exact", F.floor("c_acctbal").cast("long") % 1501).alias("candidate_cp"),
    )
