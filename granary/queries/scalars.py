"""Scalar functions over whole tables (FN, FLT-14, FLT-20, SRC-07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import scalar as S
from granary.functions.fnv import fnv1a
from granary.plans.scoring import SQL, scores
from granary.session import table
from granary.sources.records import strict_json

from . import Registry

REGISTRY = query = Registry()


@query("fn01_sha256", "SELECT doc_id, sha256(text) AS sha FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query(
    "fn03_fnv1a",
    """WITH h AS (SELECT c_custkey, list_reduce(list_transform(range(1, length(c_name) + 1), lambda k: ascii(c_name[k])::HUGEINT), lambda h, b: xor(h, b) * 1099511628211 % 18446744073709551616, 14695981039346656037::HUGEINT) AS h FROM customer),
    w AS (SELECT c_custkey, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS hash FROM h)
    SELECT c_custkey, hash, (hash % 1000 + 1000) % 1000 AS bucket FROM w""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", fnv1a("c_name").alias("hash")).withColumn("bucket", F.pmod(F.col("hash"), F.lit(1000)))


@query("fn04_opening_key", "SELECT conv_id, sha256(string_agg(role, chr(0) ORDER BY turn)) AS opening FROM conversations WHERE turn < 12 GROUP BY 1")
def _(spark, sf_dir):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return table(spark, sf_dir, "conversations").where("turn < 12").groupBy("conv_id").agg(F.sha2(F.array_join(ordered, "\u0000"), 256).alias("opening"))


@query("fn05_inclusive_limit", "SELECT p_partkey, CASE WHEN p_partkey > 0 THEN p_partkey + p_partkey // 100 END AS lim FROM part")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.inclusive_limit(F.col("p_partkey")).alias("lim"))


@query("fn06_perspective", f"WITH {SQL} SELECT position, CASE WHEN first_side THEN teacher_cp ELSE -teacher_cp END AS absolute_cp, CASE WHEN teacher_status <> 'bound' THEN NULL WHEN (teacher_cp > 0) = first_side THEN 'lower' ELSE 'upper' END AS absolute_bound FROM s")
def _(spark, sf_dir):
    bound = F.expr("CASE WHEN teacher_status = 'bound' THEN CASE WHEN teacher_cp > 0 THEN 'lower' ELSE 'upper' END END")
    return scores(spark, sf_dir).select("position", S.flip_score(F.col("teacher_cp"), F.col("first_side")).alias("absolute_cp"), S.flip_bound(bound, F.col("first_side")).alias("absolute_bound"))


@query("fn07_blend_half_even", f"WITH {SQL} SELECT position, CAST(round_even((teacher_cp + candidate_cp) / 2.0, 0) AS BIGINT) AS blend FROM s WHERE candidate_cp IS NOT NULL")
def _(spark, sf_dir):
    return scores(spark, sf_dir).where("candidate_cp IS NOT NULL").select("position", S.blend_half_even(F.col("teacher_cp"), F.col("candidate_cp")).alias("blend"))


@query("fn08_even_rounding", "SELECT p_partkey, CAST(2 * round_even(p_retailprice / 2, 0) AS BIGINT) AS even FROM part")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.even_integer(F.col("p_retailprice")).alias("even"))


@query("fn09_quantise", "SELECT c_custkey, CAST(round_even(greatest(least(c_acctbal * 64, 32767), -32767), 0) AS INTEGER) AS nearest, CAST(trunc(greatest(least(c_acctbal * 64, 32767), -32767)) AS INTEGER) AS cut FROM customer")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.quantise(F.col("c_acctbal")).alias("nearest"), S.quantise(F.col("c_acctbal"), nearest=False).alias("cut"))


_TOKEN = "CASE o_orderkey % 5 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '-0' WHEN 3 THEN '+' || (o_custkey % 30) ELSE '-' || (o_custkey % 30) END"


@query("fn13_mate_tokens", f"WITH t AS (SELECT o_orderkey, {_TOKEN} AS token FROM orders) SELECT o_orderkey, CASE WHEN token LIKE '-%' THEN 'other' ELSE 'self' END AS winner, TRY_CAST(replace(replace(token, '+', ''), '-', '') AS INTEGER) AS distance FROM t")
def _(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_TOKEN).alias("token"))
    return t.select("o_orderkey", S.mate_winner(F.col("token")).alias("winner"), S.mate_distance(F.col("token")).alias("distance"))


@query("fn17_coordinates", "SELECT p_partkey, translate(CAST(p_size % 9 + 1 AS VARCHAR), '123456789', 'abcdefghi') || CAST(p_partkey % 9 + 1 AS VARCHAR) AS square FROM part")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.translate((F.col("p_size") % 9 + 1).cast("string"), "123456789", "abcdefghi"), (F.col("p_partkey") % 9 + 1).cast("string")).alias("square"))


@query("fn18_forbidden_text", r"SELECT doc_id, regexp_matches(text, '(?:^|\s)/(?:home|root|mnt|Users)/|\b192\.168\.|\b[0-9a-f]{64}\b') AS forbidden FROM documents WHERE text IS NOT NULL")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", S.forbidden(F.col("text")).alias("forbidden"))


@query("fn19_validators", "SELECT c_custkey, regexp_matches(c_name, '^Customer#[0-9]{9}$') AS valid, regexp_matches(c_mktsegment, '^[A-Z]{9}$') AS nine FROM customer")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").rlike("^Customer#[0-9]{9}$").alias("valid"), F.col("c_mktsegment").rlike("^[A-Z]{9}$").alias("nine"))


@query("fn21_learning_rates", "SELECT l_linenumber, count(*) AS n, round(max(CASE WHEN l_linenumber < 2 THEN 0.01 * (l_linenumber + 1) / 2 ELSE 0.01 * 0.5 * (1 + cos(3.141592653589793 * least(greatest(l_linenumber - 2, 0) / 5, 1.0))) END), 8)::DOUBLE AS rate FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    steps = table(spark, sf_dir, "lineitem").select("l_linenumber", S.learning_rate(F.col("l_linenumber"), 0.01, 2, 7).alias("rate"))
    return steps.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.max("rate"), 8).alias("rate"))


@query("fn22_result_targets", "SELECT o_orderstatus, o_orderkey % 2 = 0 AS first_side, max(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 600 ELSE -600 END * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) AS target FROM orders GROUP BY 1, 2")
def _(spark, sf_dir):
    side = (F.col("o_orderkey") % 2 == 0).alias("first_side")
    result = F.expr("CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 600 ELSE -600 END")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", side).agg(F.max(S.flip_score(result, F.col("o_orderkey") % 2 == 0)).alias("target"))


@query("fn23_linear_blends", f"WITH {SQL} SELECT position, round(0.7 * coalesce(candidate_cp, teacher_cp) + 0.3 * teacher_cp, 4)::DOUBLE AS blend FROM s")
def _(spark, sf_dir):
    return scores(spark, sf_dir).select("position", F.round(F.lit(0.7) * F.coalesce("candidate_cp", "teacher_cp") + F.lit(0.3) * F.col("teacher_cp"), 4).alias("blend"))


@query("fn24_pairwise_loss", "SELECT l_returnflag, round(avg(ln(1 + exp(-abs(m))) + greatest(-m, 0)), 6) AS loss FROM (SELECT l_returnflag, (l_quantity - 25) / 10 AS m FROM lineitem) GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(S.pairwise_logistic((F.col("l_quantity") - 25) / 10)), 6).alias("loss"))


@query("fn29_classification_priority", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN n_chars = 0 THEN 'terminal' WHEN n_chars < 100 THEN 'short' WHEN source = 'src0' THEN 'forced' ELSE 'normal' END AS kind FROM documents) GROUP BY 1")
def _(spark, sf_dir):
    from granary.operators.relations import first_reason

    kind = first_reason([("terminal", F.expr("n_chars = 0")), ("short", F.expr("n_chars < 100")), ("forced", F.expr("source = 'src0'"))], "normal")
    return table(spark, sf_dir, "documents").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("fn31_elapsed", "SELECT user_id, epoch_us(max(ts) FILTER (WHERE event_type = 'purchase')) - epoch_us(min(ts) FILTER (WHERE event_type = 'view')) AS elapsed_us FROM events GROUP BY 1")
def _(spark, sf_dir):
    micros = lambda kind, f: f(F.when(F.col("event_type") == kind, F.unix_micros(F.col("ts").cast("timestamp"))))
    return table(spark, sf_dir, "events").groupBy("user_id").agg((micros("purchase", F.max) - micros("view", F.min)).alias("elapsed_us"))


@query("flt14_clamp", "SELECT c_custkey, greatest(least(c_acctbal, 3000), -500)::DOUBLE AS clamped FROM customer WHERE abs(c_acctbal) < 9000")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("abs(c_acctbal) < 9000").select("c_custkey", F.greatest(F.least("c_acctbal", F.lit(3000.0)), F.lit(-500.0)).alias("clamped"))


@query("flt20_safe_paths", r"SELECT page_id, regexp_matches(url, '^https?://[^/]+(?:/[A-Za-z0-9._~-]+)*/?$') AND NOT contains(url, '..') AS safe FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", (F.col("url").rlike(r"^https?://[^/]+(?:/[A-Za-z0-9._~-]+)*/?$") & ~F.contains("url", F.lit(".."))).alias("safe"))


@query("src07_strict_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", strict_json(F.col("props"), "struct<k: bigint>")["k"].alias("k"))
