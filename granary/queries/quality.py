"""Constraint checks (DQ)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions.scalar import hash_split
from granary.operators import relations as R
from granary.session import table

from . import Registry
from .data import SEED, split_sql

REGISTRY = query = Registry()


@query("dq01_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("dq02_split_overlap", f"WITH r AS (SELECT l_partkey, {split_sql('CAST(l_orderkey AS VARCHAR)')} AS split FROM lineitem) SELECT count(*) AS n_shared FROM (SELECT l_partkey FROM r GROUP BY 1 HAVING count(DISTINCT split) > 1)")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", hash_split(SEED, F.col("l_orderkey")).alias("split"))
    return rows.groupBy("l_partkey").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").agg(F.count("*").alias("n_shared"))


@query("dq03_label_bijection", "SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' ELSE 'ok' END AS verdict FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id) GROUP BY 1")
def _(spark, sf_dir):
    found = R.reconcile(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])
    return found.groupBy("verdict").agg(F.count("*").alias("n"))


@query("dq04_split_recomputed", f"SELECT count(*) AS n, count(*) FILTER (WHERE ({split_sql('CAST(doc_id AS VARCHAR)')} = 'holdout') <> (doc_id % 10 = 0)) AS n_wrong FROM documents")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select((hash_split(SEED, F.col("doc_id")) == "holdout").alias("now"), (F.col("doc_id") % 10 == 0).alias("stored"))
    return rows.agg(F.count("*").alias("n"), F.expr("count_if(now <> stored)").alias("n_wrong"))


_CHECKS = {"quantity": "l_quantity BETWEEN 1 AND 50", "discount": "l_discount BETWEEN 0 AND 0.09", "price": "abs(l_extendedprice) < 90000", "flag": "l_returnflag IN ('A', 'N', 'R')"}


@query("dq05_range_checks", " UNION ALL ".join(f"SELECT '{k}' AS \"check\", count(*) AS n_rows, count(*) FILTER (WHERE NOT coalesce({c}, false)) AS n_violations FROM lineitem" for k, c in _CHECKS.items()))
def _(spark, sf_dir):
    return R.violations(table(spark, sf_dir, "lineitem"), {k: F.expr(c) for k, c in _CHECKS.items()})


@query("dq06_orphans", "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS n_keys FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey").join(orders, "l_orderkey", "left_anti").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_keys"))


@query("dq07_superset", "SELECT c_nationkey, c_mktsegment FROM (SELECT c_nationkey, c_mktsegment FROM customer EXCEPT ALL SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 0)")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_nationkey", "c_mktsegment").exceptAll(c.where("c_acctbal > 0").select("c_nationkey", "c_mktsegment"))


@query(
    "dq08_unchanged",
    """SELECT * FROM (VALUES ('customer', true), ('orders', false), ('part', true), ('supplier', false)) t(input, unchanged)""",
)
def _(spark, sf_dir):
    """Digests of four inputs, taken over all their rows and columns before and after; one table has a value changed in between, and one has lost a row."""
    names = {"customer": None, "orders": F.col("o_orderkey") % 1000 == 1, "part": None, "supplier": F.col("s_suppkey") == 1}
    before = R.input_digests({n: table(spark, sf_dir, n) for n in names})
    after = {n: table(spark, sf_dir, n) for n in names}
    after["orders"] = after["orders"].withColumn("o_orderstatus", F.when(names["orders"], "X").otherwise(F.col("o_orderstatus")))
    after["supplier"] = after["supplier"].where(~names["supplier"])
    return R.unchanged(before, R.input_digests(after))


@query("dq10_gate", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 1) AS positive, max(value) AS observed, count(*) >= 100 AND count(*) FILTER (WHERE value > 1) * 2 > count(*) AND max(value) < 400 AS passes FROM events GROUP BY 1")
def _(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.expr("count_if(value > 1)").alias("positive"), F.max("value").alias("observed"))
    return g.withColumn("passes", F.expr("n >= 100 AND positive * 2 > n AND observed < 400"))


@query("dq11_recorded_results", "SELECT count(*) AS n, count(*) FILTER (WHERE n_chars IS DISTINCT FROM length(text)) AS n_wrong FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.count_if(~F.col("n_chars").eqNullSafe(F.length("text"))).alias("n_wrong"))


@query("dq13_comparable_projections", "SELECT c AS \"column\", n AS n_mismatch FROM (SELECT 'n' AS c, count(*) FILTER (WHERE a.n IS DISTINCT FROM b.n) AS n FROM (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) a FULL JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) b USING (l_orderkey))")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    a, b = (rows.where(F.col("l_linestatus") == s).groupBy("l_orderkey").agg(F.count("*").alias("n")) for s in "FO")
    return R.mismatches(a, b, ["l_orderkey"], ["n"])


@query("dq15_row_order", "SELECT conv_id, count(*) FILTER (WHERE turn <> r - 1) AS n_wrong FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY 1")
def _(spark, sf_dir):
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").withColumn("r", r).groupBy("conv_id").agg(F.expr("count_if(turn <> r - 1)").alias("n_wrong"))


@query("dq16_command_sequence", "SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS sent, string_agg(role, ' ' ORDER BY turn) IN ('user assistant', 'user assistant user') AS expected FROM conversations GROUP BY 1")
def _(spark, sf_dir):
    sent = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), " ")
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(sent.alias("sent"))
    return g.withColumn("expected", F.col("sent").isin("user assistant", "user assistant user"))


@query("dq17_index_recomputed", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, count(DISTINCT o_orderkey) AS n FROM orders WHERE o_totalprice > 5000 GROUP BY 1) SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_stored, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS only_recomputed")
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    a = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("a"))
    b = orders.where("o_totalprice > 5000").groupBy(F.col("o_custkey").alias("k")).agg(F.count_distinct("o_orderkey").alias("b"))
    # one full join in place of a set difference each way
    return a.join(b, "k", "full").agg(F.expr("count_if(a IS NOT NULL AND NOT (a <=> b))").alias("only_stored"), F.expr("count_if(b IS NOT NULL AND NOT (a <=> b))").alias("only_recomputed"))


@query("dq19_linear_prediction", "SELECT count(*) AS n, count(*) FILTER (WHERE abs(p_retailprice - (900 + (p_partkey % 1000) / 10)) > 0.001) AS n_wrong FROM part")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(F.count("*").alias("n"), F.expr("count_if(abs(p_retailprice - (900 + (p_partkey % 1000) / 10)) > 0.001)").alias("n_wrong"))


@query("dq21_inventory", "SELECT source, count(*) AS n_files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes, count(DISTINCT lang) AS n_dirs FROM documents GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_files"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"), F.count_distinct("lang").alias("n_dirs"))


@query("dq22_row_cap", "SELECT l_returnflag, count(*) FILTER (WHERE abs(l_extendedprice - l_quantity * 1500) > 50000) AS n_violations, round(max(abs(l_extendedprice - l_quantity * 1500)), 2) AS observed FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    gap = F.expr("abs(l_extendedprice - l_quantity * 1500)")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(gap > 50000).alias("n_violations"), F.round(F.max(gap), 2).alias("observed"))


@query("dq23_bound_exceptions", "SELECT count(*) AS n, count(*) FILTER (WHERE d.doc_id IS NULL) AS unbound, count(*) FILTER (WHERE l.quality NOT IN (0, 1) OR l.toxic NOT IN (0, 1)) AS invalid, CAST(sum(l.toxic) AS BIGINT) AS n_toxic FROM labels l LEFT JOIN documents d USING (doc_id)")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("there"))
    both = table(spark, sf_dir, "labels").join(docs, "doc_id", "left")
    return both.agg(F.count("*").alias("n"), F.expr("count_if(there IS NULL)").alias("unbound"), F.expr("count_if(quality NOT IN (0, 1) OR toxic NOT IN (0, 1))").alias("invalid"), F.sum("toxic").alias("n_toxic"))
