"""Scoring queries (AGG, JON-06, TOP-03/05, DQ-12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import evaluation as E
from granary.operators.fitting import fit_rows, l1_fit_rows, sparse_gram
from granary.operators.relations import repeatability
from granary.plans.scoring import GAMES, SQL, STATUSES, scores
from granary.session import table

from . import Registry

REGISTRY = query = Registry()
_ERR = f"WITH {SQL}, e AS (SELECT *, candidate_cp - teacher_cp AS err FROM s WHERE teacher_status = 'exact')"
_GROUP = """
    SELECT game, count(*) FILTER (WHERE teacher_status = 'exact') AS n_mask, count(candidate_cp - teacher_cp) FILTER (WHERE teacher_status = 'exact') AS n_cand,
      CAST(sum(abs(candidate_cp - teacher_cp)) FILTER (WHERE teacher_status = 'exact') AS BIGINT) AS abs_sum,
      CAST(sum(candidate_cp - teacher_cp) FILTER (WHERE teacher_status = 'exact') AS BIGINT) AS signed_sum,
      max(abs(candidate_cp - teacher_cp)) FILTER (WHERE teacher_status = 'exact') AS max_abs FROM s GROUP BY game"""
_MAE = "CASE WHEN n_mask > 0 AND n_mask = n_cand THEN round(abs_sum / n_mask, 6) END"


def mask():
    return F.col("teacher_status") == "exact"


def groups(spark, sf_dir, full=False):
    rows = scores(spark, sf_dir)
    return E.masked_group_error(rows.where("candidate_cp IS NOT NULL") if full else rows, "game", mask(), "teacher_cp", "candidate_cp")


@query("jon06_scores", f"WITH {SQL} SELECT * FROM s")
def _(spark, sf_dir):
    return scores(spark, sf_dir)


@query("agg01_masked_group_error", f"WITH {SQL}, g AS ({_GROUP}) SELECT *, {_MAE} AS mae FROM g")
def _(spark, sf_dir):
    return groups(spark, sf_dir)


@query("agg02_equal_group_mean", f"WITH {SQL}, g AS ({_GROUP.replace('FROM s', 'FROM s WHERE candidate_cp IS NOT NULL')}), m AS (SELECT {_MAE} AS mae FROM g) SELECT count(*) AS n_groups, count(mae) AS n_defined, round(CASE WHEN count(mae) = 5 THEN avg(mae) END, 6) AS mean FROM m")
def _(spark, sf_dir):
    return E.equal_group_mean(groups(spark, sf_dir, full=True), "mae", len(GAMES))


@query("agg03_exact_fraction_parts", f"WITH {SQL}, g AS ({_GROUP}) SELECT game, abs_sum AS num, n_cand AS den, abs_sum // gcd(abs_sum, n_cand) AS low_num, n_cand // gcd(abs_sum, n_cand) AS low_den FROM g")
def _(spark, sf_dir):
    g = groups(spark, sf_dir).select("game", F.col("abs_sum").alias("num"), F.col("n_cand").alias("den"))
    # Euclid's steps on 64-bit integers, at most 92 of them
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(F.col("num").alias("a"), F.col("den").alias("b")), lambda x, _: F.when(x["b"] == 0, x).otherwise(F.struct(x["b"].alias("a"), (x["a"] % x["b"]).alias("b"))), lambda x: x["a"])
    g = g.withColumn("d", gcd)
    return g.select("game", "num", "den", F.expr("num div d").alias("low_num"), F.expr("den div d").alias("low_den"))


@query("agg04_micro_diagnostics", f"{_ERR} SELECT count(err) AS n, round(avg(abs(err)), 6) AS mae, round(avg(err), 6) AS bias, max(abs(err)) AS max_abs FROM e")
def _(spark, sf_dir):
    e = scores(spark, sf_dir).where(mask()).withColumn("err", F.expr("candidate_cp - teacher_cp"))
    return e.agg(F.count("err").alias("n"), F.round(F.avg(F.abs("err")), 6).alias("mae"), F.round(F.avg("err"), 6).alias("bias"), F.max(F.abs("err")).alias("max_abs"))


def _cells(lefts, rights):
    of = lambda xs: ", ".join(f"('{x}')" for x in xs)
    return f"a(teacher_status) AS (VALUES {of(lefts)}), b(candidate_status) AS (VALUES {of(rights)})"


@query("agg05_contingency", f"WITH {SQL}, {_cells(STATUSES, STATUSES)} SELECT a.teacher_status, b.candidate_status, count(s.position) AS n FROM a CROSS JOIN b LEFT JOIN s ON s.teacher_status = a.teacher_status AND s.candidate_status = b.candidate_status GROUP BY 1, 2")
def _(spark, sf_dir):
    return E.contingency(scores(spark, sf_dir), "teacher_status", "candidate_status", STATUSES, STATUSES)


_OPER = "CASE WHEN {0} = 'missing' THEN 'missing' WHEN {0} IN ('exact', 'bound', 'mate') THEN 'scored' ELSE 'failed' END"


@query("agg06_operational_table", f"WITH {SQL}, o AS (SELECT {_OPER.format('teacher_status')} AS t, {_OPER.format('candidate_status')} AS c FROM s), k(x) AS (VALUES ('scored'), ('missing'), ('failed')) SELECT a.x AS t, b.x AS c, count(o.t) AS n FROM k a CROSS JOIN k b LEFT JOIN o ON o.t = a.x AND o.c = b.x GROUP BY 1, 2")
def _(spark, sf_dir):
    o = scores(spark, sf_dir).select(F.expr(_OPER.format("teacher_status")).alias("t"), F.expr(_OPER.format("candidate_status")).alias("c"))
    kinds = ["scored", "missing", "failed"]
    return E.contingency(o, "t", "c", kinds, kinds)


@query("agg07_status_counts", f"WITH {SQL} SELECT game, {', '.join(f'''count(*) FILTER (WHERE candidate_status = '{k}') AS n_{k}''' for k in STATUSES)}, count(*) FILTER (WHERE candidate_status NOT IN ('exact', 'bound', 'mate', 'missing')) AS n_unknown FROM s GROUP BY game")
def _(spark, sf_dir):
    return E.status_counts(scores(spark, sf_dir), "game", "candidate_status", STATUSES)


@query("agg08_distribution", f"WITH {SQL} SELECT game, count(candidate_cp) AS n, min(candidate_cp) AS least, {', '.join(f'round(quantile_cont(candidate_cp, {p / 100}), 6) AS p{p}' for p in (50, 95, 99))}, max(candidate_cp) AS most FROM s GROUP BY game")
def _(spark, sf_dir):
    return E.distribution(scores(spark, sf_dir), "game", "candidate_cp")


_THRESHOLDS = [0, 50, 100, 250, 500, 1000, 2000]


@query("agg09_accuracy_curve", f"{_ERR}, t(threshold) AS (VALUES {', '.join(f'({t})' for t in _THRESHOLDS)}), c AS (SELECT threshold, game, count(*) AS n, count(*) FILTER (WHERE abs(err) <= threshold) AS hits FROM t CROSS JOIN e WHERE err IS NOT NULL GROUP BY 1, 2) SELECT threshold, count(*) AS n_groups, CAST(sum(hits) AS BIGINT) AS hits, round(avg(hits / n), 6) AS accuracy FROM c GROUP BY 1")
def _(spark, sf_dir):
    e = scores(spark, sf_dir).where(mask()).withColumn("err", F.expr("candidate_cp - teacher_cp"))
    return E.accuracy_curve(e, "game", "err", _THRESHOLDS)


@query("agg10_bound_violations", f"WITH {SQL} SELECT game, count(*) AS n_bounds, count(*) FILTER (WHERE first_side AND candidate_cp < teacher_cp) AS below_lower, count(*) FILTER (WHERE NOT first_side AND candidate_cp > teacher_cp) AS above_upper, count(*) FILTER (WHERE candidate_cp IS NULL) AS unknown FROM s WHERE teacher_status = 'bound' GROUP BY game")
def _(spark, sf_dir):
    b = scores(spark, sf_dir).where("teacher_status = 'bound'").groupBy("game")
    return b.agg(F.count("*").alias("n_bounds"), F.expr("count_if(first_side AND candidate_cp < teacher_cp)").alias("below_lower"), F.expr("count_if(NOT first_side AND candidate_cp > teacher_cp)").alias("above_upper"), F.expr("count_if(candidate_cp IS NULL)").alias("unknown"))


@query("agg11_winner_agreement", f"WITH {SQL} SELECT count(*) FILTER (WHERE sign(teacher_cp) = sign(candidate_cp)) AS same, count(*) FILTER (WHERE sign(teacher_cp) <> sign(candidate_cp)) AS other, round(avg(abs(candidate_cp) - abs(teacher_cp)), 6) AS mean_delta, round(avg(abs(abs(candidate_cp) - abs(teacher_cp))), 6) AS mean_abs_delta FROM s WHERE teacher_status = 'mate' AND candidate_cp IS NOT NULL")
def _(spark, sf_dir):
    m = scores(spark, sf_dir).where("teacher_status = 'mate' AND candidate_cp IS NOT NULL")
    d = F.expr("abs(candidate_cp) - abs(teacher_cp)")
    return m.agg(F.expr("count_if(sign(teacher_cp) = sign(candidate_cp))").alias("same"), F.expr("count_if(sign(teacher_cp) <> sign(candidate_cp))").alias("other"), F.round(F.avg(d), 6).alias("mean_delta"), F.round(F.avg(F.abs(d)), 6).alias("mean_abs_delta"))


_NODES = "CAST(floor(value * 100) AS BIGINT)"


@query("agg12_evidence_states", f"SELECT CASE WHEN event_type = 'error' THEN 'invalid' WHEN event_type = 'signup' THEN 'missing' ELSE 'evidence' END AS state, count(*) AS n, count(*) FILTER (WHERE {_NODES} > 5000) AS above_n, count(*) FILTER (WHERE {_NODES} > 5050) AS above_limit, max(greatest({_NODES} - 5000, 0)) AS max_overrun FROM events GROUP BY 1")
def _(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.expr("CASE WHEN event_type = 'error' THEN 'invalid' WHEN event_type = 'signup' THEN 'missing' ELSE 'evidence' END").alias("state"), F.expr("cast(floor(value * 100) as bigint)").alias("m"))
    return ev.groupBy("state").agg(F.count("*").alias("n"), F.expr("count_if(m > 5000)").alias("above_n"), F.expr("count_if(m > 5000 + 5000 div 100)").alias("above_limit"), F.expr("max(greatest(m - 5000, 0))").alias("max_overrun"))


@query("agg13_evidence_by_engine", f"SELECT event_type AS engine, count(*) FILTER (WHERE {_NODES} > 100) AS positive, count(*) FILTER (WHERE {_NODES} <= 100) AS zero, max({_NODES}) AS observed_max FROM events GROUP BY 1")
def _(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), F.expr("cast(floor(value * 100) as bigint)").alias("m"))
    return ev.groupBy("engine").agg(F.expr("count_if(m > 100)").alias("positive"), F.expr("count_if(m <= 100)").alias("zero"), F.max("m").alias("observed_max"))


@query("agg14_coverage_by_type", f"WITH {SQL} SELECT teacher_status, first_side, count(*) AS n, count(candidate_cp) AS covered FROM s GROUP BY 1, 2")
def _(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("teacher_status", "first_side").agg(F.count("*").alias("n"), F.count("candidate_cp").alias("covered"))


@query("agg15_merge_repetitions", "WITH r AS (SELECT o_orderkey % 3 AS repetition, o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1, 2) SELECT o_orderstatus, count(*) AS repetitions, CAST(sum(n) AS BIGINT) AS n, max(top) AS top FROM r GROUP BY 1")
def _(spark, sf_dir):
    r = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 3).alias("repetition"), "o_orderstatus").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    return r.groupBy("o_orderstatus").agg(F.count("*").alias("repetitions"), F.sum("n").alias("n"), F.max("top").alias("top"))


@query("agg17_calibration", "SELECT CAST(least(floor(l_discount * 10 * 10), 9) AS INTEGER) AS bucket, count(*) AS n, round(sum(l_discount * 10), 4) AS predicted, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS actual FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("p"), F.expr("CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END").alias("a"))
    return E.calibration(rows, "p", "a")


@query("agg18_regression_metrics", "SELECT l_returnflag, count(*) AS n, round(avg(abs(l_extendedprice / 1000 - l_quantity)), 4) AS mae, round(sqrt(avg((l_extendedprice / 1000 - l_quantity) ** 2)), 4) AS rmse, round(avg(l_extendedprice / 1000 - l_quantity), 4) AS bias, round(stddev_pop(l_extendedprice / 1000), 4) AS spread, round(covar_pop(l_quantity, l_extendedprice / 1000) / nullif(stddev_pop(l_extendedprice / 1000) * stddev_pop(l_quantity), 0), 6) AS pearson FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("predicted", F.col("l_extendedprice") / 1000)
    return E.regression_metrics(rows, "l_returnflag", "l_quantity", "predicted")


@query("agg19_paired_deltas", f"WITH {SQL} SELECT game, count(*) AS n, round(avg(abs(CAST(floor(candidate_cp / 64) AS BIGINT) * 64 - candidate_cp)), 6) AS mean_abs, max(abs(CAST(floor(candidate_cp / 64) AS BIGINT) * 64 - candidate_cp)) AS max_abs, max(abs(CAST(floor(candidate_cp / 64) AS BIGINT) * 64 - candidate_cp)) <= 63 AS in_bound FROM s WHERE candidate_cp IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    d = F.expr("abs(cast(floor(candidate_cp / 64) as bigint) * 64 - candidate_cp)")
    return scores(spark, sf_dir).where("candidate_cp IS NOT NULL").groupBy("game").agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean_abs"), F.max(d).alias("max_abs"), (F.max(d) <= 63).alias("in_bound"))


@query("agg20_integer_static_metrics", f"{_ERR} SELECT count(err) AS n, CAST(sum(abs(err)) AS BIGINT) AS absolute_error_sum, CAST(sum(err * err) AS BIGINT) AS square_sum FROM e")
def _(spark, sf_dir):
    e = scores(spark, sf_dir).where(mask()).withColumn("err", F.expr("candidate_cp - teacher_cp"))
    return e.agg(F.count("err").alias("n"), F.sum(F.abs("err")).alias("absolute_error_sum"), F.sum(F.expr("err * err")).alias("square_sum"))


@query("agg21_reanalysis_summary", f"WITH {SQL} SELECT count(*) FILTER (WHERE teacher_status = 'exact') AS n_exact, count(*) FILTER (WHERE teacher_status = 'bound') AS n_bounded, count(*) FILTER (WHERE teacher_cp % 10 = candidate_cp % 10) AS n_match, min(teacher_cp) AS least, max(teacher_cp) AS most FROM s")
def _(spark, sf_dir):
    return scores(spark, sf_dir).agg(F.count_if(mask()).alias("n_exact"), F.expr("count_if(teacher_status = 'bound')").alias("n_bounded"), F.expr("count_if(teacher_cp % 10 = candidate_cp % 10)").alias("n_match"), F.min("teacher_cp").alias("least"), F.max("teacher_cp").alias("most"))


_FEATURES = ["p_size", "q", "d"]
_FSQL = "WITH f AS (SELECT CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(l_linenumber AS BIGINT) AS p_size, CAST(floor(l_extendedprice) AS BIGINT) AS y FROM lineitem) "


@query("agg27_sufficient_statistics", _FSQL + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, CAST(sum({_FEATURES[i]} * {(_FEATURES + ['y'])[j]}) AS BIGINT) AS s FROM f" for i in range(3) for j in [*range(i, 3), -1]))
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("cast(l_quantity as bigint) q", "cast(round(l_discount * 100) as bigint) d", "cast(l_linenumber as bigint) p_size", "cast(floor(l_extendedprice) as bigint) y")
    return E.sufficient_statistics(rows, _FEATURES, "y")


@query("agg28_gram_matrix", "WITH z AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 1000 + 0.5) AS BIGINT) AS v FROM embeddings) SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, CAST(sum(a.v * b.v) AS BIGINT) AS s FROM z a JOIN z b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2")
def _(spark, sf_dir):
    return E.gram(table(spark, sf_dir, "embeddings"), "embedding")


@query("agg29_side_weights", "SELECT l_linestatus, count(*) AS n, round(0.5 * (SELECT count(*) FROM lineitem) / count(*), 8) AS weight FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return E.side_weights(table(spark, sf_dir, "lineitem"), "l_linestatus")


@query("agg30_weighted_loss", f"{_ERR} SELECT round(sum(w * err * err) / sum(w), 4) AS weighted, round(avg(err * err), 4) AS raw FROM (SELECT CAST(err AS DOUBLE) AS err, CASE WHEN first_side THEN 2.0 ELSE 1.0 END AS w FROM e WHERE err IS NOT NULL)")
def _(spark, sf_dir):
    e = scores(spark, sf_dir).where(mask() & F.col("candidate_cp").isNotNull()).select(F.expr("cast(candidate_cp - teacher_cp as double)").alias("err"), F.expr("CASE WHEN first_side THEN 2.0D ELSE 1.0D END").alias("w"))
    return e.agg(F.round(F.sum(F.expr("w * err * err")) / F.sum("w"), 4).alias("weighted"), F.round(F.avg(F.expr("err * err")), 4).alias("raw"))


@query("agg31_rounding_audit", f"WITH {SQL} SELECT count(*) AS n, count(*) FILTER (WHERE (teacher_cp + candidate_cp) % 2 <> 0) AS n_half, sum(CASE WHEN (teacher_cp + candidate_cp) % 2 <> 0 THEN 0.5 ELSE 0 END)::DOUBLE AS abs_sum FROM s WHERE candidate_cp IS NOT NULL")
def _(spark, sf_dir):
    half = F.expr("(teacher_cp + candidate_cp) % 2 <> 0")
    return scores(spark, sf_dir).where("candidate_cp IS NOT NULL").agg(F.count("*").alias("n"), F.count_if(half).alias("n_half"), F.sum(F.when(half, 0.5).otherwise(0.0)).alias("abs_sum"))


@query("agg32_quantisation_stats", "WITH v AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), q AS (SELECT x * 64 AS y, round_even(x * 64, 0) AS n FROM v) SELECT count(*) AS n, count(*) FILTER (WHERE trunc(y) <> n) AS changed, round(max(abs(n - y)), 6) AS max_error, round(avg(abs(n - y)), 6) AS mean_error FROM q")
def _(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.explode("embedding").alias("x")).select((F.col("x").cast("double") * 64).alias("y"))
    v = v.withColumn("n", F.rint("y"))
    cut = F.when(F.col("y") < 0, F.ceil("y")).otherwise(F.floor("y"))
    return v.agg(F.count("*").alias("n"), F.count_if(cut != F.col("n")).alias("changed"), F.round(F.max(F.abs(F.expr("n - y"))), 6).alias("max_error"), F.round(F.avg(F.abs(F.expr("n - y"))), 6).alias("mean_error"))


@query("agg33_hit_rate", f"WITH {SQL}, h AS (SELECT game, count(*) AS denominator, count(candidate_cp) AS observed, count(*) FILTER (WHERE candidate_cp % 4 = abs(teacher_cp) % 4) AS hits FROM s GROUP BY 1) SELECT *, CASE WHEN observed = denominator THEN round(hits / denominator, 6) END AS rate FROM h")
def _(spark, sf_dir):
    h = scores(spark, sf_dir).groupBy("game").agg(F.count("*").alias("denominator"), F.count("candidate_cp").alias("observed"), F.expr("count_if(candidate_cp % 4 = abs(teacher_cp) % 4)").alias("hits"))
    return h.withColumn("rate", F.when(F.expr("observed = denominator"), F.round(F.expr("hits / denominator"), 6)))


@query("agg36_selection_counts", "SELECT source, count(*) FILTER (WHERE lang = 'en') AS n_en, count(*) FILTER (WHERE lang = 'de') AS n_de, count(*) FILTER (WHERE lang IS NULL OR lang NOT IN ('en', 'de')) AS n_unknown FROM documents GROUP BY 1")
def _(spark, sf_dir):
    return E.status_counts(table(spark, sf_dir, "documents"), "source", "lang", ["en", "de"])


@query("win04_repeatability", "SELECT l_orderkey, count(*) AS n, count(DISTINCT coalesce(l_returnflag, '~') || '|' || coalesce(l_linestatus, '~')) AS n_states, count(*) = 3 AND count(DISTINCT coalesce(l_returnflag, '~') || '|' || coalesce(l_linestatus, '~')) = 1 AS repeatable FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return repeatability(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"], 3)


@query("top05_rank_candidates", f"{_ERR} SELECT k AS ridge, CAST(sum(abs(err) + k * (position % 3)) AS BIGINT) AS error FROM e CROSS JOIN (VALUES (1), (10), (100)) g(k) WHERE err IS NOT NULL GROUP BY 1 ORDER BY error, ridge DESC LIMIT 1")
def _(spark, sf_dir):
    e = scores(spark, sf_dir).where(mask() & F.col("candidate_cp").isNotNull())
    tall = e.select("position", F.expr("candidate_cp - teacher_cp").alias("err"), F.explode(F.array(F.lit(1), F.lit(10), F.lit(100))).alias("ridge"))
    return tall.groupBy("ridge").agg(F.sum(F.expr("abs(err) + ridge * (position % 3)")).alias("error")).orderBy("error", F.desc("ridge")).limit(1)


@query("dq12_decision", f"{_ERR}, d AS (SELECT sum(abs(err)) FILTER (WHERE first_side) AS a, count(err) FILTER (WHERE first_side) AS na, sum(abs(err)) FILTER (WHERE NOT first_side) AS b, count(err) FILTER (WHERE NOT first_side) AS nb, count(*) FILTER (WHERE first_side AND abs(err) <= 300) AS ha, count(*) FILTER (WHERE NOT first_side AND abs(err) <= 300) AS hb FROM e) SELECT CASE WHEN b * na < a * nb AND hb * na >= ha * nb THEN 'adopt' WHEN b * na < a * nb OR hb * na > ha * nb THEN 'hold' ELSE 'reject' END AS decision FROM d")
def _(spark, sf_dir):
    e = scores(spark, sf_dir).where(mask()).withColumn("err", F.expr("candidate_cp - teacher_cp"))
    d = e.agg(*[F.expr(x) for x in ("sum(abs(err)) filter (where first_side) a", "count(err) filter (where first_side) na", "sum(abs(err)) filter (where not first_side) b", "count(err) filter (where not first_side) nb", "count_if(first_side and abs(err) <= 300) ha", "count_if(not first_side and abs(err) <= 300) hb")])
    # cross products of integers: an exact comparison of fractions
    return d.select(F.expr("CASE WHEN b * na < a * nb AND hb * na >= ha * nb THEN 'adopt' WHEN b * na < a * nb OR hb * na > ha * nb THEN 'hold' ELSE 'reject' END").alias("decision"))


#: Sparse rows: the indicator of a supplier's class and, by the line's number, a quantity, a discount or both.
_MODE = "CAST(l_suppkey % 7 AS INTEGER)"


@query(
    "agg28_sparse_gram",
    f"""WITH r AS (SELECT {_MODE} AS m, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS d, l_linenumber % 3 AS k, CAST(floor(l_extendedprice) AS BIGINT) % 2000 - 900 AS y, row_number() OVER () AS row FROM lineitem),
    f AS (SELECT row, m AS i, 1::BIGINT AS z, y FROM r UNION ALL SELECT row, 7, q, y FROM r WHERE k <> 2 UNION ALL SELECT row, 8, d, y FROM r WHERE k <> 0)
    SELECT a.i, b.i AS j, CAST(sum(a.z * b.z) AS BIGINT) AS s FROM f a JOIN f b ON a.row = b.row AND a.i <= b.i GROUP BY 1, 2 HAVING sum(a.z * b.z) <> 0
    UNION ALL SELECT i, -1, CAST(sum(z * y) AS BIGINT) FROM f GROUP BY 1 HAVING sum(z * y) <> 0""",
)
def _(spark, sf_dir):
    """Exact sums over sparse rows, after a proof that none can pass 2^53."""
    return sparse_gram(_sparse(spark, sf_dir), "i", "z", "y", 9)


def _sparse(spark, sf_dir):
    mode, q, d = "CAST(l_suppkey % 7 AS INT)", "CAST(l_quantity AS BIGINT)", "CAST(round(l_discount * 100) AS BIGINT)"
    i = f"CASE l_linenumber % 3 WHEN 0 THEN array({mode}, 7) WHEN 1 THEN array({mode}, 7, 8) ELSE array({mode}, 8) END"
    z = f"CASE l_linenumber % 3 WHEN 0 THEN array(1L, {q}) WHEN 1 THEN array(1L, {q}, {d}) ELSE array(1L, {d}) END"
    return table(spark, sf_dir, "lineitem").selectExpr(f"{i} AS i", f"{z} AS z", "CAST(floor(l_extendedprice) AS BIGINT) % 2000 - 900 AS y")


#: Ridge, prior, and the cap of 2 w0 + 3 w1.
_RIDGE, _PRIOR, _CAP = 2.0, (1.0, 4.0), 60.0


@query(
    "num02_constrained_ridge",
    f"""WITH s AS (SELECT avg(q * q) + {_RIDGE} AS a, avg(q * d) AS b, avg(d * d) + {_RIDGE} AS c, avg(q * y) + {_RIDGE * _PRIOR[0]} AS p, avg(d * y) + {_RIDGE * _PRIOR[1]} AS r
      FROM (SELECT CAST(l_quantity AS DOUBLE) AS q, CAST(round(l_discount * 100) AS DOUBLE) AS d, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 2000 AS DOUBLE) AS y FROM lineitem)),
    o AS ( -- the unconstrained point, and the best of each edge
      SELECT (c * p - b * r) / (a * c - b * b) AS x, (a * r - b * p) / (a * c - b * b) AS z FROM s
      UNION ALL SELECT 0, least(greatest(r / c, 0), {_CAP} / 3) FROM s
      UNION ALL SELECT least(greatest(p / a, 0), {_CAP} / 2), 0 FROM s
      UNION ALL SELECT x, ({_CAP} - 2 * x) / 3 FROM (SELECT least(greatest((p - 2 * r / 3 - b * {_CAP} / 3 + 4 * c * {_CAP} / 18) / (a - 4 * b / 3 + 4 * c / 9), 0), {_CAP} / 2) AS x FROM s)),
    w AS (SELECT x, z FROM o, s WHERE x >= -1e-9 AND z >= -1e-9 AND 2 * x + 3 * z <= {_CAP} + 1e-9 ORDER BY a * x * x + 2 * b * x * z + c * z * z - 2 * p * x - 2 * r * z LIMIT 1)
    SELECT 0 AS feature, round(x, 3) AS weight FROM w UNION ALL SELECT 1, round(z, 3) FROM w""",
)
def _(spark, sf_dir):
    """Two features, weights of 0 or more and a weighted cap; the SQL compares the edges of the triangle."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("array(0, 1) AS i", "array(CAST(l_quantity AS BIGINT), CAST(round(l_discount * 100) AS BIGINT)) AS z", "CAST(floor(l_extendedprice) AS BIGINT) % 2000 AS y")
    found = fit_rows(rows, "i", "z", "y", 2, _RIDGE, list(_PRIOR), [([0, 1], [2.0, 3.0], _CAP)])
    return found.select("feature", F.round("weight", 3).alias("weight"))


#: Ridge and radius of the ball.
_L1_RIDGE, _RADIUS = 1, 12.0


@query(
    "num04_certified_l1_fit",
    f"""WITH s AS (SELECT sum(q * q) + {_L1_RIDGE} AS a, sum(q * d) AS b, sum(d * d) + {_L1_RIDGE} AS c, sum(q * y) AS p, sum(d * y) AS r
      FROM (SELECT CAST(l_quantity AS DOUBLE) AS q, CAST(round(l_discount * 100) AS DOUBLE) AS d, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 2000 AS DOUBLE) AS y FROM lineitem)),
    o AS ( -- the free point, and the best of each of the diamond's edges (u t, v (radius - t))
      SELECT (c * p - b * r) / (a * c - b * b) AS x, (a * r - b * p) / (a * c - b * b) AS z FROM s
      UNION ALL SELECT u * t, v * ({_RADIUS} - t) FROM (
        SELECT u, v, least(greatest(({_RADIUS} * (c - b * u * v) + p * u - r * v) / (a - 2 * b * u * v + c), 0), {_RADIUS}) AS t FROM s, (VALUES (1, 1), (1, -1), (-1, 1), (-1, -1)) e(u, v))),
    w AS (SELECT x, z FROM o, s WHERE abs(x) + abs(z) <= {_RADIUS} + 1e-9 ORDER BY (a * x * x + 2 * b * x * z + c * z * z) / 2 - p * x - r * z LIMIT 1)
    SELECT 0 AS feature, round(x, 3) AS weight, true AS proved FROM w UNION ALL SELECT 1, round(z, 3), true FROM w""",
)
def _(spark, sf_dir):
    """Two features on an L1 ball; proved says that the exact gap is at most a millionth of a row's loss. The SQL compares the edges of the diamond."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("array(0, 1) AS i", "array(CAST(l_quantity AS BIGINT), CAST(round(l_discount * 100) AS BIGINT)) AS z", "CAST(floor(l_extendedprice) AS BIGINT) % 2000 AS y")
    near = 1e-6 * max(1, rows.count())
    found = l1_fit_rows(rows, "i", "z", "y", 2, _L1_RIDGE, _RADIUS, near)
    top, below = (F.nullif(F.split_part("gap", F.lit("/"), F.lit(k)), F.lit("")).cast("double") for k in (1, 2))
    return found.select("feature", F.round("weight", 3).alias("weight"), (top / F.coalesce(below, F.lit(1.0)) <= near).alias("proved"))
