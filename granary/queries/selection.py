"""Windows, ordering, top-k and selection (WIN, TOP)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions.scalar import seeded_rank
from granary.operators import relations as R
from granary.session import table

from . import Registry

REGISTRY = query = Registry()


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("win01_first_turns", "SELECT conv_id, turn, role FROM conversations WHERE turn < 2")
def _(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("turn < 2").select("conv_id", "turn", "role")


@query("win02_cap_after_filters", "SELECT event_id, user_id, CAST(rank AS INTEGER) AS rank FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events WHERE event_type <> 'error' AND value >= 10) WHERE rank <= 32")
def _(spark, sf_dir):
    rows = _events(spark, sf_dir).where("event_type <> 'error' AND value >= 10")
    return R.first_per_group(rows, ["user_id"], [F.col("ts"), F.col("event_id")], 32).select("event_id", "user_id", "rank")


@query("win03_keep_first", "SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def _(spark, sf_dir):
    return R.keep_first(table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source", "lang"], ["doc_id"])


@query("win05_islands", "WITH p AS (SELECT DISTINCT user_id, CAST(floor(value) AS BIGINT) AS spot FROM events WHERE value < 60), n AS (SELECT *, spot - row_number() OVER (PARTITION BY user_id ORDER BY spot) AS island FROM p) SELECT user_id, min(spot) AS first, max(spot) AS last, count(*) AS n FROM n GROUP BY user_id, island")
def _(spark, sf_dir):
    points = _events(spark, sf_dir).where("value < 60").select("user_id", F.floor("value").cast("long").alias("spot"))
    return R.islands(points, "user_id", "spot")


@query("win06_prefix_histories", "SELECT conv_id, turn, string_agg(role, '>') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS history FROM conversations")
def _(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("role").over(w), ">").alias("history"))


@query("win07_first_middle_last", "WITH n AS (SELECT conv_id, turn, turn + 1 AS ply, max(turn + 1) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, ply FROM n WHERE ply IN (1, (n + 1) // 2, n)")
def _(spark, sf_dir):
    n = F.max(F.col("turn") + 1).over(Window.partitionBy("conv_id"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("ply"), n.alias("n"))
    return rows.where("ply IN (1, (n + 1) div 2, n)").select("conv_id", "ply")


@query("win08_turn_alternation", "WITH l AS (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, count(*) FILTER (WHERE role = before) AS n_repeats FROM l GROUP BY 1")
def _(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(w))
    return rows.groupBy("conv_id").agg(F.expr("count_if(role = before)").alias("n_repeats"))


@query("win09_offset_order", "WITH l AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, count(*) FILTER (WHERE value < before) AS n_decreases FROM l GROUP BY 1")
def _(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(spark, sf_dir).withColumn("before", F.lag("value").over(w)).groupBy("user_id").agg(F.expr("count_if(value < before)").alias("n_decreases"))


@query("win10_last_value", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, arg_max(value, (ts, event_id)) AS last_value, max(value) AS max_value FROM events GROUP BY 1")
def _(spark, sf_dir):
    order = F.struct("ts", "event_id")
    return _events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", order).alias("last_type"), F.max_by("value", order).alias("last_value"), F.max("value").alias("max_value"))


@query("win11_ordinals", "SELECT c_custkey, c_mktsegment || '-' || lpad(CAST(row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS VARCHAR), 3, '0') AS ordinal FROM customer")
def _(spark, sf_dir):
    w = Window.partitionBy("c_mktsegment", "c_nationkey").orderBy("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.format_string("%s-%03d", "c_mktsegment", F.row_number().over(w)).alias("ordinal"))


@query("win12_first_seen_order", "SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY 1")
def _(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(F.min("event_id").alias("first_seen"))


@query("win13_shared_axis", "WITH m AS (SELECT max(abs(value)) AS top FROM events), e AS (SELECT top, pow(10, floor(log10(top))) AS unit FROM m) SELECT CAST(unit * CASE WHEN top <= unit THEN 1 WHEN top <= 2 * unit THEN 2 WHEN top <= 5 * unit THEN 5 ELSE 10 END AS BIGINT) AS lim FROM e")
def _(spark, sf_dir):
    top = _events(spark, sf_dir).agg(F.max(F.abs("value")).alias("top")).withColumn("unit", F.expr("pow(10, floor(log10(top)))"))
    return top.select(F.expr("cast(unit * CASE WHEN top <= unit THEN 1 WHEN top <= 2 * unit THEN 2 WHEN top <= 5 * unit THEN 5 ELSE 10 END as bigint)").alias("lim"))


@query("win14_last_valid", "SELECT user_id, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS last_purchase FROM events GROUP BY 1")
def _(spark, sf_dir):
    valid = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    return _events(spark, sf_dir).groupBy("user_id").agg(F.max_by("value", valid).alias("last_purchase"))


@query("top01_seeded_rank", "SELECT doc_id FROM documents ORDER BY sha256('seed' || chr(0) || doc_id || chr(0) || source), doc_id LIMIT 20")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", seeded_rank("seed", F.col("doc_id"), F.col("source")).alias("rank"))
    return docs.orderBy("rank", "doc_id").limit(20).select("doc_id")


@query("top03_membership", "WITH t AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_quantity DESC, l_suppkey, l_partkey)[1:3] AS top, arg_min(l_suppkey, (l_extendedprice, l_suppkey)) AS best FROM lineitem GROUP BY 1) SELECT l_orderkey, list_contains(top, best) AS hit FROM t")
def _(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("l_quantity")).alias("q"), "l_suppkey", "l_partkey")))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.slice(ordered, 1, 3), lambda x: x["l_suppkey"]).alias("top"), F.min_by("l_suppkey", F.struct("l_extendedprice", "l_suppkey")).alias("best"))
    return g.select("l_orderkey", F.expr("array_contains(top, best)").alias("hit"))


@query(
    "top04_last_iteration",
    """
    WITH i AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iteration FROM events),
    g AS (SELECT user_id, iteration, count(*) AS n, count(DISTINCT event_type) AS kinds FROM i WHERE iteration > 0 GROUP BY 1, 2)
    SELECT user_id, CAST(max(iteration) AS BIGINT) AS iteration, arg_max(n, iteration) AS n, arg_max(kinds, iteration) >= 3 AS complete FROM g GROUP BY 1""",
)
def _(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    marked = _events(spark, sf_dir).withColumn("iteration", F.sum(F.expr("CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END")).over(w)).where("iteration > 0")
    g = marked.groupBy("user_id", "iteration").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))
    return g.groupBy("user_id").agg(F.max("iteration").alias("iteration"), F.max_by("n", "iteration").alias("n"), (F.max_by("kinds", "iteration") >= 3).alias("complete"))


@query("top06_canonical_lists", "WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) SELECT p_partkey, w = list_sort(list_distinct(w)) AS canonical FROM w")
def _(spark, sf_dir):
    w = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", (w == F.array_sort(F.array_distinct(w))).alias("canonical"))


@query("top07_seeded_permutation", "SELECT item_id, CAST(row_number() OVER (ORDER BY sha256('shuffle' || chr(0) || item_id)) AS INTEGER) AS at FROM benchmark")
def _(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", seeded_rank("shuffle", F.col("item_id")).alias("r"))
    return R.ranked(items, [F.asc("r")], "at").select("item_id", (F.col("at") + 1).cast("int").alias("at"))


@query(
    "top07_generator_permutation",
    f"""WITH RECURSIVE b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark),
    r AS (
      SELECT (SELECT count(*) FROM b) AS last, {(42 ^ R.MIX) % 2**64}::HUGEINT AS state, (SELECT list(i ORDER BY i) FROM b) AS places
      UNION ALL
      SELECT last - 1, s, CASE WHEN last < 2 THEN places ELSE list_transform(places, lambda x, k: CASE k WHEN last THEN places[j] WHEN j THEN places[last] ELSE x END) END
      FROM (SELECT *, CAST(s % last AS BIGINT) + 1 AS j FROM (SELECT *, (state * {R.MULTIPLIER} + {R.INCREMENT}) % 18446744073709551616 AS s FROM r WHERE last > 1)))
    SELECT item_id, CAST(spot - 1 AS INTEGER) AS "at" FROM (SELECT unnest(places) AS i, unnest(range(1, len(places) + 1)) AS spot FROM r WHERE last = 1) JOIN b USING (i)""",
)
def _(spark, sf_dir):
    return R.seeded_permutation(table(spark, sf_dir, "benchmark"), "item_id", 42)


@query("top08_cap_per_source", "SELECT doc_id, source, CAST(rank AS INTEGER) AS rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('cap' || chr(0) || doc_id)) AS rank FROM documents) WHERE rank <= 5")
def _(spark, sf_dir):
    return R.first_per_group(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], [seeded_rank("cap", F.col("doc_id"))], 5)


@query("top09_batches", "WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) SELECT conv_id, CAST((r - 1) // 2 AS INTEGER) AS batch, count(*) AS n FROM r GROUP BY 1, 2")
def _(spark, sf_dir):
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", F.floor((r - 1) / 2).cast("int").alias("batch")).groupBy("conv_id", "batch").agg(F.count("*").alias("n"))


@query("top10_truncate", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query(
    "top02_greedy_exclusive",
    """WITH RECURSIVE c AS (
      SELECT row_number() OVER (ORDER BY bucket, r) AS i, * FROM (SELECT o_orderpriority AS bucket, CAST(o_orderkey AS VARCHAR) AS id, 'n' || c_nationkey AS a, 's' || c_custkey AS b, sha256('pick' || chr(0) || o_orderkey) AS r FROM orders JOIN customer ON o_custkey = c_custkey)),
    s AS (
      SELECT 0::BIGINT AS i, '' AS bucket, 0 AS taken, []::VARCHAR[] AS used, false AS ok
      UNION ALL
      SELECT i, bucket, taken + CASE WHEN ok THEN 1 ELSE 0 END, CASE WHEN ok THEN list_concat(used, [a, b]) ELSE used END, ok
      FROM (SELECT c.i, c.bucket, c.a, c.b, s.used, t.taken, t.taken < 3 AND NOT list_has_any(s.used, [c.a, c.b]) AS ok FROM s JOIN c ON c.i = s.i + 1, LATERAL (SELECT CASE WHEN c.bucket = s.bucket THEN s.taken ELSE 0 END AS taken) t))
    SELECT bucket, id, a, b FROM s JOIN c USING (i, bucket) WHERE ok""",
)
def _(spark, sf_dir):
    """An entity is a customer's nation or the customer; all orders are candidates."""
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    both = both.select(F.col("o_orderpriority").alias("bucket"), seeded_rank("pick", F.col("o_orderkey")).alias("rank"), F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("a"), F.concat(F.lit("s"), "c_custkey").alias("b"))
    from granary.plans.scoring import GAMES

    return R.pick_exclusive(both, GAMES, 3)
