"""Dataset-build queries: splits, dedup, decontamination, joins, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.scalar import canonical_json, hash_split, position_key
from granary.operators import relations as R
from granary.plans.dataset import build
from granary.session import table

from . import Registry

REGISTRY = query = Registry()
SEED = "granary-1"


def split_sql(identity: str) -> str:
    return f"CASE WHEN ('0x' || substr(sha256('{SEED}:' || {identity}), 1, 16))::UBIGINT % 10 = 0 THEN 'holdout' ELSE 'train' END"


def key_sql(text: str) -> str:
    return f"array_to_string(string_split(trim(regexp_replace({text}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), ' ')[1:3], ' ')"


@query("split_counts", f"WITH d AS (SELECT {split_sql('sha256(text)')} AS split, n_chars FROM documents) SELECT split, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM d GROUP BY 1")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(hash_split(SEED, F.sha2("text", 256)).alias("split"), "n_chars")
    return docs.groupBy("split").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@query("fn02_hash_split", f"SELECT o_orderkey, {split_sql('CAST(o_custkey AS VARCHAR)')} AS split FROM orders")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", hash_split(SEED, F.col("o_custkey")).alias("split"))


@query(
    "plan_dataset_build",
    f"""
    WITH g AS (SELECT conv_id, sha256(string_agg(text, ' ' ORDER BY turn)) AS digest FROM conversations WHERE text IS NOT NULL GROUP BY 1),
    u AS (SELECT digest, min(conv_id) AS conv_id, {split_sql('digest')} AS split FROM g GROUP BY 1),
    s AS (SELECT conv_id, turn, {key_sql('text')} AS key, split FROM conversations JOIN u USING (conv_id) WHERE turn % 2 = 0),
    c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM s WHERE key NOT IN (SELECT {key_sql('text')} FROM benchmark)),
    k AS (SELECT * FROM c WHERE r <= 3)
    SELECT conv_id, turn, key, split FROM k WHERE key NOT IN (SELECT key FROM k GROUP BY key HAVING count(DISTINCT split) > 1)""",
)
def _(spark, sf_dir):
    excluded = table(spark, sf_dir, "benchmark").select(position_key(F.col("text")).alias("key"))
    return build(table(spark, sf_dir, "conversations"), excluded, "conv_id", "turn", "text", SEED)


@query("flt01_position_keys", f"SELECT doc_id, {key_sql('text')} AS key FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", position_key(F.col("text")).alias("key"))


@query("flt02_semantic_keys", "SELECT p_size % 5 AS side, list_sort(string_split(p_name, ' ')) AS pieces, count(*) AS n FROM part GROUP BY 1, 2")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy((F.col("p_size") % 5).alias("side"), F.array_sort(F.split("p_name", " ")).alias("pieces")).agg(F.count("*").alias("n"))


@query("flt03_sampling_filter", "SELECT conv_id, turn FROM conversations WHERE turn >= 1 AND turn % 2 = 0")
def _(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("turn >= 1 AND turn % 2 = 0").select("conv_id", "turn")


@query("flt04_scale_exclusion", "SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE abs(l_extendedprice) >= 30000) AS excluded FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.expr("count_if(abs(l_extendedprice) >= 30000)").alias("excluded"))


@query("flt05_first_sample_per_source", "SELECT source, min(doc_id) AS doc_id FROM documents WHERE n_chars >= 100 GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("n_chars >= 100").groupBy("source").agg(F.min("doc_id").alias("doc_id"))


_REASONS = "CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN lang IS NULL THEN 'no_language' WHEN n_chars < 200 THEN 'short' WHEN lang <> 'en' THEN 'other_language' WHEN source LIKE 'src1%' THEN 'source' ELSE 'accepted' END"


@query("flt07_rejection_cascade", f"SELECT {_REASONS} AS reason, count(*) AS n FROM documents GROUP BY 1")
def _(spark, sf_dir):
    reason = R.first_reason([("empty", F.expr("text IS NULL OR text = ''")), ("no_language", F.expr("lang IS NULL")), ("short", F.expr("n_chars < 200")), ("other_language", F.expr("lang <> 'en'")), ("source", F.col("source").startswith("src1"))])
    return table(spark, sf_dir, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("flt08_eligibility", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE least(c_acctbal, o_totalprice / 50) >= 1000 AND abs(c_acctbal - o_totalprice / 50) <= 3000")
def _(spark, sf_dir):
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    ratings = F.array("c_acctbal", F.col("o_totalprice") / 50)
    return both.where((F.array_min(ratings) >= 1000) & (F.array_max(ratings) - F.array_min(ratings) <= 3000)).select("o_orderkey")


@query("flt09_ordered_exclusion", "SELECT CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) THEN 'customer' WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25) THEN 'no_line' ELSE 'kept' END AS reason, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf_dir):
    good = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("has_customer"))
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("has_line", F.lit(True))
    flags = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(good, "o_custkey", "left").join(lines, "o_orderkey", "left")
    reason = R.first_reason([("customer", F.col("has_customer").isNull()), ("no_line", F.col("has_line").isNull())], "kept")
    return flags.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("flt16_public_projection", "SELECT c_custkey, c_mktsegment, sha256(lower(c_name)) AS user_key FROM customer")
def _(spark, sf_dir):
    from granary.functions.scalar import user_key

    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", user_key(F.col("c_name")).alias("user_key"))


@query("flt19_new_users", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100) AND user_id % 7 <> 0")
def _(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.where("user_id % 7 <> 0").select("user_id").distinct().join(ev.where("event_type = 'signup' AND value > 100").select("user_id").distinct(), "user_id", "left_anti")


@query("jon01_labels_on_documents", "SELECT d.doc_id, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", "toxic")


@query("jon02_exclude_keys", f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND {key_sql('text')} NOT IN (SELECT {key_sql('text')} FROM benchmark)")
def _(spark, sf_dir):
    excluded = table(spark, sf_dir, "benchmark").select(position_key(F.col("text")).alias("key")).distinct()
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", position_key(F.col("text")).alias("key")).join(excluded, "key", "left_anti").select("doc_id")


@query("jon03_drop_shared_keys", f"WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, {split_sql('CAST(l_orderkey AS VARCHAR)')} AS split FROM lineitem) SELECT * FROM r WHERE l_partkey NOT IN (SELECT l_partkey FROM r GROUP BY 1 HAVING count(DISTINCT split) > 1)")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", hash_split(SEED, F.col("l_orderkey")).alias("split"))
    return R.drop_shared(rows, ["l_partkey"], "split")


@query("jon04_reserved_flags", "SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount = 0.1) AS reserved, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_tax = 0) AS untaxed FROM part")
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.expr("bool_or(l_returnflag = 'R' AND l_discount = 0.1)").alias("reserved"), F.expr("bool_or(l_tax = 0)").alias("untaxed"))
    none = F.lit(False)
    return table(spark, sf_dir, "part").select("p_partkey").join(lines, "p_partkey", "left").select("p_partkey", F.coalesce("reserved", none).alias("reserved"), F.coalesce("untaxed", none).alias("untaxed"))


@query("jon05_default_classification", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'normal' WHEN toxic = 1 THEN 'toxic' ELSE 'checked' END AS kind FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, sf_dir):
    kinds = table(spark, sf_dir, "labels").select("doc_id", F.expr("CASE WHEN toxic = 1 THEN 'toxic' ELSE 'checked' END").alias("kind"))
    return table(spark, sf_dir, "documents").select("doc_id").join(kinds, "doc_id", "left").select("doc_id", F.coalesce("kind", F.lit("normal")).alias("kind"))


@query("jon07_work_matrix", "SELECT item_id, CAST(r AS INTEGER) AS repetition, e AS engine FROM benchmark, range(1, 4) t(r), (VALUES ('teacher'), ('candidate')) v(e)")
def _(spark, sf_dir):
    return R.work_matrix(table(spark, sf_dir, "benchmark").select("item_id"), 3, ["teacher", "candidate"])


@query(
    "jon08_reconcile",
    """
    WITH a AS (SELECT o_orderkey AS k, count(*) AS n_expected FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS n_observed FROM lineitem GROUP BY 1)
    SELECT k AS orderkey, coalesce(n_expected, 0) AS n_expected, coalesce(n_observed, 0) AS n_observed,
      CASE WHEN n_expected IS NULL THEN 'extra' WHEN n_observed IS NULL THEN 'missing' WHEN n_observed > n_expected THEN 'duplicate' ELSE 'ok' END AS verdict
    FROM a FULL JOIN b USING (k)""",
)
def _(spark, sf_dir):
    expected = table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("orderkey"))
    return R.reconcile(expected, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey")), ["orderkey"])


@query("jon09_regression_union", "SELECT o_orderkey, 'canonical' AS selection FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'regression' FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3")
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = orders.join(table(spark, sf_dir, "customer").where("c_nationkey = 3"), F.expr("o_custkey = c_custkey"))
    return orders.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("canonical").alias("selection")).unionByName(found.select("o_orderkey", F.lit("regression").alias("selection")))


@query("jon10_pilot_subset", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 4)")
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber >= 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey").join(lines, "o_orderkey", "left_semi")


@query("jon11_join_and_count_missing", "SELECT count(*) AS n, count(l.doc_id) AS matched, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    return both.agg(F.count("*").alias("n"), F.count("has").alias("matched"), F.expr("count(*) - count(has)").alias("missing"))


@query("jon12_default_weights", "SELECT l_returnflag, round(sum(l_quantity * CASE l_returnflag WHEN 'R' THEN 2.5 WHEN 'A' THEN 0.5 ELSE 1.0 END), 2)::DOUBLE AS weighted FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    from granary.functions.scalar import weight_of

    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity") * weight_of(F.lit("R=2.5,A=0.5"), F.col("l_returnflag")))
    return rows.toDF("l_returnflag", "w").groupBy("l_returnflag").agg(F.round(F.sum("w"), 2).alias("weighted"))


@query("jon13_memoised_labels", "SELECT d.doc_id, coalesce(l.quality, CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END) AS quality, l.doc_id IS NULL AS computed FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    both = docs.join(labels.withColumn("known", F.lit(True)), "doc_id", "left")
    return both.select("doc_id", F.coalesce("quality", F.expr("CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END")).alias("quality"), F.col("known").isNull().alias("computed"))


@query("jon16_unique_owner", "SELECT c_nationkey, min(c_custkey) AS owner FROM customer WHERE c_acctbal > 9900 GROUP BY 1 HAVING count(*) = 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_acctbal > 9900").groupBy("c_nationkey").agg(F.min("c_custkey").alias("owner"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("set01_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 10")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey").subtract(table(spark, sf_dir, "lineitem").where("l_quantity > 10").select("l_partkey"))


@query("set01_intersection", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("set02_bag_union", "SELECT origin, count(*) AS n FROM (SELECT 'customer' AS origin, c_nationkey FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY 1")
def _(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("origin"), F.col("c_nationkey").alias("nation"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_nationkey").alias("nation"))).groupBy("origin").agg(F.count("*").alias("n"))


@query("agg23_set_digest", "SELECT source, count(*) AS n, CAST(sum(('0x' || substr(sha256(t), 1, 15))::UBIGINT::HUGEINT) AS VARCHAR) AS digest FROM (SELECT DISTINCT source, text AS t FROM documents) GROUP BY 1")
def _(spark, sf_dir):
    return R.set_digest(table(spark, sf_dir, "documents"), "source", "text")


@query("agg24_sequence_digest", "SELECT conv_id, count(*) AS n, sha256(string_agg(text, ' ' ORDER BY turn)) AS digest FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    return R.sequence_digest(table(spark, sf_dir, "conversations").where("text IS NOT NULL"), ["conv_id"], "turn", "text")


@query("agg26_content_groups", "SELECT sha256(text) AS content, count(*) AS n, count(DISTINCT source) AS n_sources, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("content")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"), F.min("doc_id").alias("first"))


@query("snk03_canonical_json", """SELECT c_custkey, sha256('{"k":' || c_custkey || ',"n":' || coalesce(CAST(nullif(c_nationkey, 3) AS VARCHAR), 'null') || ',"s":"' || c_mktsegment || '"}') AS identity FROM customer""")
def _(spark, sf_dir):
    json = canonical_json(F.col("c_custkey").alias("k"), F.expr("nullif(c_nationkey, 3)").alias("n"), F.col("c_mktsegment").alias("s"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(json, 256).alias("identity"))


@query("snk05_pivoted_observations", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'click') AS click, round(max(value) FILTER (WHERE event_type = 'purchase'), 2) AS top_purchase FROM events GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.expr("count_if(event_type = 'view')").alias("view"), F.expr("count_if(event_type = 'click')").alias("click"), F.expr("round(max(value) filter (where event_type = 'purchase'), 2)").alias("top_purchase"))


@query("snk09_new_content", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en' AND text IS NOT NULL)")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "lang", F.sha2("text", 256).alias("content"))
    return docs.join(docs.where("lang = 'en'").select("content").distinct(), "content", "left_anti").select("doc_id")


@query("snk12_opening_book", "WITH p AS (SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS moves FROM lineitem GROUP BY 1) SELECT substr(moves, 1, k) AS prefix, substr(moves, k + 1, 1) AS move, count(*) AS n FROM p, range(0, 3) t(k) WHERE length(moves) > k GROUP BY 1, 2 HAVING count(*) >= 5")
def _(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")))
    games = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(ordered, lambda x: x["l_returnflag"]), "").alias("moves"))
    plies = games.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).where(F.length("moves") > F.col("k"))
    return plies.groupBy(F.expr("substr(moves, 1, k)").alias("prefix"), F.expr("substr(moves, k + 1, 1)").alias("move")).agg(F.count("*").alias("n")).where("n >= 5")
