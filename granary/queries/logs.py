"""Queries over engine logs. The lines are made from `events`, whose types and ids say what each line holds. The SQL of FN-10 reads the lines; that of the others knows what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.log_lines import is_primary, log_line
from granary.operators import attempts as A
from granary.session import checkpointed, scratch_folder, table
from granary.sources import attempts as S

from . import Registry

REGISTRY = query = Registry()

#: Lines by event: n nodes, c centipawns, k the kind of a click.
_EVENTS = "SELECT event_id, user_id, event_type AS t, event_id % 6 AS k, event_id % 1300 AS n, CAST(floor(coalesce(value, 0)) AS BIGINT) - 50 AS c FROM events"


def _log(spark, sf_dir) -> DataFrame:
    """(attempt, seq, direction, line, offset_ns), an attempt being a user."""
    ev = table(spark, sf_dir, "events").selectExpr("event_id AS seq", "user_id AS attempt", "event_type AS t", "event_id % 6 AS k", "event_id % 1300 AS n", "CAST(floor(coalesce(value, 0D)) AS BIGINT) - 50 AS c")
    line = F.expr("""CASE
        WHEN t = 'signup' THEN 'go nodes 1200'
        WHEN t = 'purchase' THEN concat('bestmove ', if(seq % 4 = 0, 'resign', '7g7f'))
        WHEN t = 'view' THEN concat('info depth 3 nodes ', n, ' score cp ', c, ' pv 7g7f 3c3d')
        WHEN t = 'click' THEN CASE k
            WHEN 0 THEN concat('info depth 3 nodes ', n, ' score cp ', c, ' lowerbound pv 7g7f')
            WHEN 1 THEN concat('info string score cp 1 nodes ', n)
            WHEN 2 THEN concat('info depth 4 score mate -3 nodes ', n, ' pv 7g7f')
            WHEN 3 THEN concat('info depth 4 score cp x nodes ', n, ' pv 7g7f')
            WHEN 4 THEN concat('info nodes ', n, ' nodes ', n, ' score cp ', c, ' pv 7g7f')
            ELSE concat('info depth 2 nodes ', n) END
        ELSE concat('info depth 5 string free score cp ', c) END""")
    return ev.select("attempt", "seq", F.when(F.col("t") == "signup", "send").otherwise("receive").alias("direction"), line.alias("line"), (F.col("c") + 50).alias("offset_ns"))


def _plan(spark, sf_dir) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("attempt")).distinct()
    return users.selectExpr("attempt", "attempt % 2 = 0 AS first_side", "1200L AS requested_nodes", "'candidate' AS engine", "'normal' AS position_type", "false AS in_check", "30 AS legal_moves", "CAST(NULL AS STRING) AS sole_move", "CAST(array() AS ARRAY<STRING>) AS mating_moves")


#: The line of an event; engines also report counts beyond 64 bits.
_LINE = """CASE WHEN event_type = 'signup' THEN 'go nodes 1200' WHEN event_type = 'purchase' THEN 'bestmove 7g7f'
    WHEN event_id % 8 = 0 THEN concat('info depth 3 nodes ', n, ' score cp ', c, ' pv 7g7f 3c3d')
    WHEN event_id % 8 = 1 THEN concat('info depth 3 nodes ', n, ' score cp ', c, ' lowerbound pv 7g7f')
    WHEN event_id % 8 = 2 THEN concat('info depth ', n, '00000000000000000001 score mate -', n, ' pv 7g7f')
    WHEN event_id % 8 = 3 THEN concat('info depth 4 score cp x nodes ', n, ' pv 7g7f')
    WHEN event_id % 8 = 4 THEN concat('info nodes ', n, ' nodes ', c, ' score cp ', c, ' pv 7g7f')
    WHEN event_id % 8 = 5 THEN concat('info depth 2 nodes 9', n, '0000000000000000000 score cp -', n)
    WHEN event_id % 8 = 6 THEN concat('info string score cp 1 nodes ', n) ELSE concat('info depth 5 string free score cp ', c) END"""
_LINES = "SELECT event_id, event_type, event_id % 1300 + 1 AS n, CAST(floor(coalesce(value, 0)) AS BIGINT) - 50 AS c FROM events"


@query(
    "fn10_log_lines",
    rf"""WITH l AS (SELECT event_id, {_LINE} AS line FROM ({_LINES})),
    h AS (SELECT *, starts_with(line, 'info ') AND NOT starts_with(line, 'info string') AS is_info, regexp_replace(line, ' (pv|string) .*$', '') AS head FROM l),
    n AS (SELECT *, regexp_extract_all(head, ' nodes (\S+)', 1) AS said, regexp_extract(head, ' depth (\S+)', 1) AS deep, regexp_extract(head, ' score (cp|mate) ([+-]?[0-9]+)( |$)', 2) AS raw, contains(head, ' score ') AS scored FROM h),
    v AS (SELECT *, TRY_CAST(said[1] AS BIGINT) AS nodes FROM n)
    SELECT event_id, is_info, CASE WHEN is_info THEN TRY_CAST(deep AS BIGINT) END AS depth, CASE WHEN is_info AND raw <> '' THEN regexp_extract(head, ' score (\S+)', 1) END AS kind, CASE WHEN is_info AND raw <> '' THEN raw END AS raw,
      CASE WHEN is_info AND raw <> '' THEN coalesce(nullif(regexp_extract(head, ' (lowerbound|upperbound)$', 1), ''), 'exact') END AS bound,
      CASE WHEN is_info AND NOT (scored AND raw = '') THEN nullif(regexp_extract(line, ' pv (.*)$', 1), '') END AS pv,
      CASE WHEN is_info AND scored AND raw = '' THEN 'malformed_score' WHEN is_info AND deep <> '' AND TRY_CAST(deep AS BIGINT) IS NULL THEN 'overflow_depth_value' END AS parse_error,
      CASE WHEN is_info AND len(said) = 1 THEN nodes END AS nodes,
      CASE WHEN NOT is_info THEN NULL WHEN len(said) = 0 THEN 'missing' WHEN len(said) > 1 THEN 'ambiguous' WHEN nodes IS NULL THEN 'overflow' WHEN nodes < 0 THEN 'negative' ELSE 'present' END AS node_evidence
    FROM v""",
)
def _(spark, sf_dir):
    """The SQL reads the text of each line by regular expressions."""
    events = table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "event_id % 1300 + 1 AS n", "CAST(floor(coalesce(value, 0D)) AS BIGINT) - 50 AS c")
    lines = events.select("event_id", log_line(F.expr(_LINE)).alias("p"))
    return lines.select("event_id", "p.is_info", "p.depth", "p.kind", "p.raw", "p.bound", F.array_join("p.pv", " ").alias("pv"), "p.parse_error", "p.nodes", "p.node_evidence")


@query("flt12_primary_lines", f"WITH e AS ({_EVENTS}) SELECT user_id, count(*) FILTER (WHERE t = 'view' OR t = 'click' AND k IN (0, 2, 4)) AS n_primary FROM e GROUP BY 1")
def _(spark, sf_dir):
    lines = _log(spark, sf_dir).select(F.col("attempt").alias("user_id"), log_line(F.col("line")).alias("p"))
    return lines.groupBy("user_id").agg(F.count_if(is_primary(F.col("p"))).alias("n_primary"))


#: Observations by user, from the events alone.
_OBSERVED = f"""e AS ({_EVENTS}),
    g AS (SELECT user_id, max(event_id) FILTER (WHERE t = 'signup') AS go FROM e GROUP BY 1),
    a AS (SELECT e.* FROM e JOIN g USING (user_id) WHERE go IS NULL OR event_id > go),
    s AS (SELECT user_id, min(event_id) FILTER (WHERE t = 'purchase') AS stop FROM a GROUP BY 1),
    w AS (SELECT a.*, t = 'view' OR t = 'click' AND k IN (0, 2, 4) AS scored, t = 'view' OR t = 'click' AND k IN (0, 2, 3, 5) AS counted FROM a JOIN s USING (user_id) WHERE stop IS NULL OR event_id <= stop),
    f AS (
      SELECT user_id, max(event_id) FILTER (WHERE t = 'purchase') AS best, max(event_id) FILTER (WHERE scored) AS spot, count(*) FILTER (WHERE scored) AS info_count,
        arg_max(n, event_id) FILTER (WHERE counted) AS last_nodes, max(n) FILTER (WHERE counted) AS max_nodes, count(*) FILTER (WHERE counted) AS n_valid, count(*) FILTER (WHERE counted AND n = 0) AS n_zero,
        count(*) FILTER (WHERE t = 'click' AND k = 3) AS n_bad, count(*) FILTER (WHERE t = 'click' AND k = 4) AS n_double
      FROM w GROUP BY 1),
    r AS (
      SELECT g.user_id, f.*, l.t, l.k, l.c, CASE
          WHEN best IS NULL THEN 'missing_bestmove' WHEN n_bad > 0 THEN 'malformed_score' WHEN spot IS NULL THEN 'no_primary_scored_pv' WHEN best % 4 = 0 THEN 'special_bestmove'
          WHEN n_double > 0 THEN 'ambiguous_node_evidence' WHEN n_zero > 0 THEN 'zero_nodes_without_exception' WHEN max_nodes > 1212 THEN 'node_count_above_limit' END AS failure_reason
      FROM g LEFT JOIN f USING (user_id) LEFT JOIN w l ON l.event_id = f.spot),
    o AS (
      SELECT user_id, failure_reason, CASE WHEN failure_reason IN ('missing_bestmove', 'malformed_score') THEN 'protocol_failure' WHEN failure_reason IN ('no_primary_scored_pv', 'special_bestmove') THEN 'no_score'
          WHEN failure_reason IS NOT NULL THEN 'node_budget_failure' WHEN t = 'click' AND k = 2 THEN 'mate' WHEN t = 'click' AND k = 0 THEN 'bound_cp' ELSE 'exact_cp' END AS status,
        CASE WHEN t = 'view' OR k = 4 THEN CASE WHEN user_id % 2 = 0 THEN c ELSE -c END END AS score_cp_first,
        CASE WHEN t = 'click' AND k = 0 THEN CASE WHEN user_id % 2 = 0 THEN 'lowerbound' ELSE 'upperbound' END WHEN spot IS NOT NULL THEN 'exact' END AS score_bound_first,
        CASE WHEN t = 'click' AND k = 2 THEN '-3' END AS score_mate, coalesce(info_count, 0) AS info_count, last_nodes AS last_reported_nodes, max_nodes AS max_reported_nodes,
        n_valid AS node_evidence_valid_count, n_zero AS node_evidence_zero_count
      FROM r)"""


def _observed(spark, sf_dir) -> DataFrame:
    return A.observe(_log(spark, sf_dir), _plan(spark, sf_dir))


@query("fn11_observed_attempts", f"WITH {_OBSERVED} SELECT * FROM o")
def _(spark, sf_dir):
    return _observed(spark, sf_dir).select(F.col("attempt").alias("user_id"), "failure_reason", "status", "score_cp_first", "score_bound_first", "score_mate", "info_count", "last_reported_nodes", "max_reported_nodes", "node_evidence_valid_count", "node_evidence_zero_count")


@query("flt11_evidence_rows", f"WITH {_OBSERVED} SELECT user_id, coalesce(max_reported_nodes > 0, false) AS positive FROM o WHERE status IN ('exact_cp', 'bound_cp', 'mate', 'no_score')")
def _(spark, sf_dir):
    """Technical failures give no evidence; the rest say whether they report a positive number of nodes."""
    rows = _observed(spark, sf_dir).where(F.col("status").isin(*A.SCORED, "no_score"))
    return rows.select(F.col("attempt").alias("user_id"), F.coalesce(F.col("max_reported_nodes") > 0, F.lit(False)).alias("positive"))


@query(
    "dq11_revalidated_attempts",
    f"""WITH {_OBSERVED} SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'missing' WHEN user_id % 5 = 0 OR user_id % 3 = 0 THEN 'changed' ELSE 'ok' END AS verdict,
      CASE WHEN user_id % 7 = 0 THEN '' WHEN user_id % 5 = 0 AND user_id % 3 = 0 THEN 'status,info_count' WHEN user_id % 5 = 0 THEN 'status' WHEN user_id % 3 = 0 THEN 'info_count' ELSE '' END AS fields FROM o""",
)
def _(spark, sf_dir):
    """Records with a status of their own for every fifth attempt and a wrong count for every third; every seventh is lost."""
    derived = _observed(spark, sf_dir)
    status = F.when(F.col("attempt") % 5 == 0, "other").otherwise(F.col("status"))
    recorded = derived.where("attempt % 7 <> 0").withColumns({"status": status, "info_count": F.col("info_count") + F.when(F.col("attempt") % 3 == 0, 1).otherwise(0)})
    found = A.revalidated(recorded, derived)
    return found.select(F.col("attempt").alias("user_id"), "verdict", F.array_join("fields", ",").alias("fields"))


@query(
    "src15_attempt_files",
    f"""WITH {_OBSERVED}, x AS (SELECT *, CASE WHEN user_id % 7 = 0 THEN 'stray' WHEN user_id % 5 = 0 THEN 'changed' ELSE 'ok' END AS fault FROM o)
    SELECT user_id, fault, CASE WHEN fault = 'ok' THEN status END AS status FROM x UNION ALL SELECT DISTINCT -1 - user_id, 'no_log', NULL FROM events WHERE user_id % 11 = 0""",
)
def _(spark, sf_dir):
    """Attempts written as files. Every seventh loses its record, every fifth record has another hash, and some records have no log; what is sound is observed anew from its file and equals its record."""
    path, plan = scratch_folder(spark, "attempts"), _plan(spark, sf_dir)
    log = _log(spark, sf_dir)
    S.write_attempts(A.observe(log, plan).select("attempt", "status"), log, path)
    records = spark.read.schema(f"attempt bigint, status string, {S.LOG}").json(f"{path}/records")
    sha = F.when(F.col("attempt") % 5 == 0, F.sha2("log_sha256", 256)).otherwise(F.col("log_sha256"))
    lost = plan.where("attempt % 11 = 0").selectExpr("-1 - attempt AS attempt", "'lost' AS status", "1L AS log_bytes", "'x' AS log_sha256")
    damaged = records.where("attempt % 7 <> 0").withColumn("log_sha256", sha).unionByName(lost)
    raw = S.raw_logs(spark, path)
    found = checkpointed(S.faults(damaged, S.logs(raw)))
    sound = found.where("fault = 'ok'").select("attempt")
    events = S.log_events(raw.join(sound, "attempt", "left_semi"))
    observed = checkpointed(A.observe(events, plan.join(sound, "attempt", "left_semi")).select("attempt", "status"))
    same = A.revalidated(records.join(sound, "attempt", "left_semi").select("attempt", "status"), observed).where("verdict = 'ok'").select("attempt")
    return found.join(observed.join(same, "attempt", "left_semi"), "attempt", "left").select(F.col("attempt").alias("user_id"), "fault", "status")


@query(
    "src16_log_faults",
    """WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'send' WHEN 'purchase' THEN 'runner' WHEN 'error' THEN 'other' ELSE 'receive' END AS d, event_id % 3 = 0 AS said, floor(value) AS spot FROM events),
    l AS (SELECT *, lag(spot) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e),
    f AS (SELECT user_id, count(*) AS n_events, count(*) FILTER (WHERE spot < before) AS n_backwards, count(*) FILTER (WHERE d = 'runner') AS n_outcomes,
        count(*) FILTER (WHERE spot IS NULL OR d = 'other' OR d = 'runner' AND said) AS n_invalid, arg_max(d, event_id) AS last FROM l GROUP BY 1)
    SELECT user_id, n_events, n_backwards, n_outcomes, n_invalid, n_backwards = 0 AND n_outcomes = 1 AND n_invalid = 0 AND last = 'runner' AS ok FROM f""",
)
def _(spark, sf_dir):
    direction = "CASE event_type WHEN 'signup' THEN 'send' WHEN 'purchase' THEN 'runner' WHEN 'error' THEN 'other' ELSE 'receive' END AS direction"
    log = table(spark, sf_dir, "events").selectExpr("user_id AS attempt", "event_id AS seq", direction, "if(event_id % 3 = 0, 'said', '') AS line", "CAST(floor(value) AS BIGINT) AS offset_ns")
    return A.log_faults(log).withColumnRenamed("attempt", "user_id")


@query(
    "dq16_sent_lines",
    """WITH s AS (SELECT user_id, list(event_type ORDER BY event_id) AS sent FROM events WHERE event_type <> 'view' GROUP BY 1), u AS (SELECT DISTINCT user_id FROM events),
    x AS (SELECT user_id, coalesce(sent, []) AS sent, CASE WHEN user_id % 2 = 0 THEN coalesce(sent, []) ELSE coalesce(sent, [])[1:2] END AS lines FROM u LEFT JOIN s USING (user_id))
    SELECT user_id, sent = lines OR sent = list_append(lines, 'quit') AS ok FROM x""",
)
def _(spark, sf_dir):
    """Sent lines are the types of events that aren't views; attempts of odd users expect only the first two."""
    log = table(spark, sf_dir, "events").selectExpr("user_id AS attempt", "event_id AS seq", "if(event_type = 'view', 'receive', 'send') AS direction", "event_type AS line")
    sent = log.groupBy("attempt").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("direction") == "send", F.struct("seq", "line")))), lambda x: x["line"]).alias("lines"))
    expected = sent.select("attempt", F.when(F.col("attempt") % 2 == 0, F.col("lines")).otherwise(F.slice("lines", 1, 2)).alias("lines"))
    return A.sent_as_expected(log, expected).withColumnRenamed("attempt", "user_id")


@query(
    "fn12_zero_exceptions",
    """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'forced_single' WHEN 1 THEN 'mate_in_one' WHEN 2 THEN 'terminal_resign' END AS exception FROM orders""",
)
def _(spark, sf_dir):
    """Orders are observations: of each eight, three are one of the exceptions, and five lack one of its conditions."""
    k = "o_orderkey % 8"
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"if({k} IN (2, 6), 'teacher', 'candidate') AS engine",
        f"CASE WHEN {k} IN (0, 3, 4) THEN 'forced_single_legal_move' WHEN {k} IN (1, 5, 7) THEN 'mate_in_one_available' ELSE 'terminal_checkmate' END AS position_type",
        f"{k} IN (0, 2, 3, 4, 6) AS in_check", f"CASE WHEN {k} = 0 OR {k} = 3 THEN 1 WHEN {k} = 4 THEN 2 WHEN {k} = 2 OR {k} = 6 THEN 0 ELSE 9 END AS legal_moves", "'7g7f' AS sole_move", "array('7g7f', '2g2f') AS mating_moves",
        f"if({k} IN (2, 6), 'resign', '7g7f') AS bestmove", f"if({k} IN (2, 6), 'resign', 'normal') AS bestmove_kind", f"if({k} = 7, array('7g7f', '3c3d'), array(if({k} IN (2, 6), 'resign', '7g7f'))) AS pv", f"if({k} IN (2, 6), 'resign', '7g7f') AS pv_head",
        f"if({k} IN (0, 3, 4), 'cp', 'mate') AS score_kind", "'exact' AS score_bound", f"CASE WHEN {k} IN (1, 7) THEN '1' WHEN {k} = 5 THEN '2' WHEN {k} = 2 THEN '-1' WHEN {k} = 6 THEN '-3' END AS score_mate",
        "3L AS node_evidence_valid_count", f"if({k} = 3, 2L, 3L) AS node_evidence_zero_count", "0L AS node_evidence_invalid_count", "'present' AS evidence_at_score", "0L AS reported_nodes_at_score", "0L AS last_reported_nodes",
    )
    return rows.select("o_orderkey", A.zero_exception().alias("exception"))
