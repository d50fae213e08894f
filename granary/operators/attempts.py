"""Attempts of an engine from raw event logs: log checks, observations, zero-node exceptions, verdicts against recorded results.

An event is (attempt, seq, direction, line, offset_ns); the last of an attempt is a runner outcome. All work is on
aggregates of an attempt's events; a log line is parsed once, where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.log_lines import is_primary, log_line
from granary.streaming.events import last_window

#: The forms of a normal move.
MOVE = r"^([1-9][a-i][1-9][a-i]\+?|[PLNSGBR]\*[1-9][a-i])$"
SCORED = ["exact_cp", "bound_cp", "mate"]


def log_faults(events: DataFrame) -> DataFrame:
    """(attempt, n_events, n_backwards, n_outcomes, n_invalid, ok) of raw logs (SRC-16).

    Offsets must not go back, each event must be sent, received or an outcome, an outcome's line is empty, and the last event
    is the only outcome. A null offset, direction or line is invalid.
    """
    w = Window.partitionBy("attempt").orderBy("seq")
    outcome = F.col("direction") == "runner"
    good = F.when(outcome, F.col("line") == "").otherwise(F.col("direction").isin("send", "receive") & F.col("line").isNotNull()) & F.col("offset_ns").isNotNull()
    rows = events.withColumn("before", F.lag("offset_ns").over(w))
    out = rows.groupBy("attempt").agg(
        F.count("*").alias("n_events"), F.count_if(F.col("offset_ns") < F.col("before")).alias("n_backwards"), F.count_if(outcome).alias("n_outcomes"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("n_invalid"), F.max_by("direction", "seq").alias("last"),
    )
    ok = (F.col("n_backwards") == 0) & (F.col("n_outcomes") == 1) & (F.col("n_invalid") == 0) & F.coalesce(F.col("last") == "runner", F.lit(False))
    return out.select("attempt", "n_events", "n_backwards", "n_outcomes", "n_invalid", ok.alias("ok"))


def current_lines(events: DataFrame) -> DataFrame:
    """What was received after an attempt's last `go nodes N` up to and with its first `bestmove` after that (STR-03).

    An attempt without a `go` is read from its start.
    """
    go = (F.col("direction") == "send") & F.col("line").rlike("^go nodes [0-9]+$")
    best = (F.col("direction") == "receive") & F.col("line").startswith("bestmove")
    return last_window(events, "attempt", ["seq"], go, best, keep_stop=True).where(F.col("direction") == "receive")


def observe(events: DataFrame, plan: DataFrame) -> DataFrame:
    """One observation per attempt of plan (attempt, first_side, requested_nodes, engine, position_type, in_check, legal_moves, sole_move, mating_moves) (FN-11).

    The last primary line gives the score; a bound is never replaced by an exact score before it, and mate is never turned
    into a number. Node evidence of all lines counts. A malformed score anywhere fails the attempt; so do node counts that
    are malformed, missing, negative, ambiguous, beyond 64 bits, over N + N div 100, or zero without an exception of zero_exception().
    """
    lines = current_lines(events).select("attempt", "seq", "line", log_line(F.col("line")).alias("p"))
    best = F.col("line").startswith("bestmove")
    primary = is_primary(F.col("p"))
    scored = F.when(primary, F.struct("seq", "line", F.col("p.kind").alias("kind"), F.col("p.raw").alias("raw"), F.col("p.bound").alias("bound"), F.col("p.pv").alias("pv"), F.col("p.nodes").alias("nodes"), F.col("p.node_evidence").alias("evidence")))
    present = F.col("p.node_evidence") == "present"
    has = lambda verdict: F.bool_or(F.coalesce(F.array_contains("p.node_verdicts", verdict), F.lit(False)))
    found = lines.groupBy("attempt").agg(
        F.min(F.when(best, F.struct("seq", "line"))).alias("best"),
        F.max(scored).alias("s"),
        F.count_if(primary).alias("info_count"),
        F.max(F.when(F.col("p.time").isNotNull(), F.struct("seq", F.col("p.time").alias("time")))).getField("time").alias("engine_time_ms"),
        F.max(F.when(present, F.struct("seq", F.col("p.nodes").alias("n")))).getField("n").alias("last_reported_nodes"),
        F.max(F.when(present, F.col("p.nodes"))).alias("max_reported_nodes"),
        F.coalesce(F.sum(F.size("p.node_verdicts")), F.lit(0)).alias("node_evidence_count"),
        F.count_if(present).alias("node_evidence_valid_count"),
        F.count_if(F.col("p.is_info") & ~F.col("p.node_evidence").isin("present", "missing") | F.array_contains("p.node_verdicts", "missing")).alias("node_evidence_invalid_count"),
        F.count_if(present & (F.col("p.nodes") > 0)).alias("node_evidence_positive_count"),
        F.count_if(present & (F.col("p.nodes") == 0)).alias("node_evidence_zero_count"),
        F.coalesce(F.sum("p.malformed_scores"), F.lit(0)).alias("malformed_scores"),
        *[has(v).alias(f"any_{v}") for v in ("malformed", "missing", "negative", "overflow")],
        F.bool_or(F.col("p.node_evidence") == "ambiguous").alias("any_ambiguous"),
    )
    rows = plan.join(found, "attempt", "left")
    move = F.get(F.split("best.line", r"\s+"), F.lit(1))
    rows = rows.withColumns({"raw_bestmove_line": F.col("best.line"), "bestmove": F.nullif(move, F.lit(""))})
    kind = F.when(F.col("bestmove").isin("resign", "win"), F.col("bestmove")).when(F.col("bestmove").rlike(MOVE), "normal").when(F.col("bestmove").isNotNull(), "other_special")
    value, first = F.when(F.col("s.kind") == "cp", F.col("s.raw").try_cast("bigint")), F.col("first_side")
    turned = F.when(first, F.col("s.bound")).when(F.col("s.bound") == "lowerbound", "upperbound").when(F.col("s.bound") == "upperbound", "lowerbound").otherwise(F.col("s.bound"))
    exact, mate = F.col("s.bound") == "exact", F.when(F.col("s.kind") == "mate", F.col("s.raw"))
    winner = F.when(mate.rlike("^-"), "other").when(mate.isNotNull(), "self")
    rows = rows.withColumns(
        {
            "bestmove_kind": kind, "pv": F.col("s.pv"), "pv_head": F.get("s.pv", F.lit(0)), "score_kind": F.col("s.kind"), "raw_score_line": F.col("s.line"),
            "reported_cp": value, "reported_cp_first": F.when(first, value).otherwise(F.try_subtract(F.lit(0), value)), "score_cp": F.when(exact, value), "score_cp_first": F.when(exact, F.when(first, value).otherwise(F.try_subtract(F.lit(0), value))),
            "score_bound": F.col("s.bound"), "score_bound_first": turned, "score_mate": mate, "mate_sign": F.when(mate.isNotNull(), F.regexp_extract(mate, "^[+-]?", 0)),
            "mate_distance": F.greatest(mate.try_cast("bigint"), F.try_subtract(F.lit(0), mate.try_cast("bigint"))), "mate_distance_known": F.when(mate.isNotNull(), mate.rlike("[0-9]")),
            "winner": winner, "winner_first": F.when(winner.isNotNull(), (winner == "self") == first), "reported_nodes_at_score": F.col("s.nodes"), "evidence_at_score": F.col("s.evidence"), "info_count": F.coalesce("info_count", F.lit(0)),
        }
    )
    rows = rows.withColumn("zero_exception", zero_exception())
    special = F.coalesce(F.col("bestmove_kind") != "normal", F.lit(True))
    reason = (
        F.when(F.col("best").isNull(), "missing_bestmove")
        .when(F.col("bestmove").isNull(), "empty_bestmove")
        .when(F.col("malformed_scores") > 0, "malformed_score")
        .when(F.col("s").isNull(), "no_primary_scored_pv")
        .when(special & (F.coalesce(F.col("zero_exception"), F.lit("")) != "terminal_resign"), "special_bestmove")
        .when(~special & (F.col("pv_head") != F.col("bestmove")), "pv_bestmove_mismatch")
    )
    budget = (
        F.when(F.col("requested_nodes").isNull(), F.lit(None))
        .when(F.col("any_malformed"), "malformed_node_evidence")
        .when(F.col("any_missing"), "missing_node_evidence")
        .when(F.col("any_negative"), "negative_node_evidence")
        .when(F.col("any_overflow"), "node_count_above_limit")
        .when(F.col("any_ambiguous"), "ambiguous_node_evidence")
        .when(F.col("reported_nodes_at_score").isNull() | F.col("last_reported_nodes").isNull(), "missing_node_evidence")
        .when((F.col("node_evidence_zero_count") > 0) & F.col("zero_exception").isNull(), "zero_nodes_without_exception")
        .when(F.col("max_reported_nodes") > F.col("requested_nodes") + F.floor(F.col("requested_nodes") / 100), "node_count_above_limit")
    )
    rows = rows.withColumn("failure_reason", F.coalesce(reason, budget))
    status = (
        F.when(F.col("failure_reason").isin("missing_bestmove", "empty_bestmove", "malformed_score", "pv_bestmove_mismatch"), "protocol_failure")
        .when(F.col("failure_reason").isin("no_primary_scored_pv", "special_bestmove"), "no_score")
        .when(F.col("failure_reason").isNotNull(), "node_budget_failure")
        .when(F.col("score_kind") == "mate", "mate")
        .otherwise(F.when(exact, "exact_cp").otherwise("bound_cp"))
    )
    return rows.withColumn("status", status).select("attempt", *OBSERVED)


#: Columns of an observation.
OBSERVED = [
    "status", "failure_reason", "bestmove", "bestmove_kind", "pv", "pv_head", "score_kind", "reported_cp", "reported_cp_first", "score_cp", "score_cp_first", "score_bound", "score_bound_first", "score_mate", "mate_sign", "mate_distance",
    "mate_distance_known", "winner", "winner_first", "reported_nodes_at_score", "evidence_at_score", "last_reported_nodes", "max_reported_nodes", "node_evidence_count", "node_evidence_valid_count", "node_evidence_invalid_count",
    "node_evidence_positive_count", "node_evidence_zero_count", "malformed_scores", "engine_time_ms", "info_count", "zero_exception", "raw_score_line", "raw_bestmove_line",
]


def zero_exception() -> Column:
    """Which exception, if any, lets an observation report zero nodes (FN-12): forced_single, mate_in_one, terminal_resign.

    All its node evidence must be valid and zero. forced_single: the candidate in check plays its only legal move with an
    exact numeric score. mate_in_one: it plays a mating move, which is its whole line, for mate 1. terminal_resign: the
    teacher, mated, resigns with mate -1.
    """
    zeros = (F.col("node_evidence_valid_count") > 0) & (F.col("node_evidence_zero_count") == F.col("node_evidence_valid_count")) & (F.col("node_evidence_invalid_count") == 0) & (F.col("evidence_at_score") == "present")
    exact = F.col("score_bound") == "exact"
    single = (F.col("engine") == "candidate") & (F.col("position_type") == "forced_single_legal_move") & F.col("in_check") & (F.col("legal_moves") == 1) & (F.col("score_kind") == "cp") & exact
    single = single & (F.col("bestmove_kind") == "normal") & (F.col("bestmove") == F.col("sole_move")) & (F.col("pv_head") == F.col("sole_move"))
    one = (F.col("engine") == "candidate") & (F.col("position_type") == "mate_in_one_available") & ~F.col("in_check") & (F.col("score_mate") == "1") & exact
    one = one & F.array_contains("mating_moves", F.col("bestmove")) & (F.size("pv") == 1) & (F.col("pv_head") == F.col("bestmove"))
    resign = (F.col("engine") == "teacher") & (F.col("position_type") == "terminal_checkmate") & F.col("in_check") & (F.col("legal_moves") == 0) & (F.col("bestmove") == "resign")
    resign = resign & (F.col("score_mate") == "-1") & exact & (F.size("pv") == 1) & (F.col("pv_head") == "resign") & (F.col("reported_nodes_at_score") == 0) & (F.col("last_reported_nodes") == 0)
    return F.when(zeros & single, "forced_single").when(zeros & one, "mate_in_one").when(resign, "terminal_resign")


def revalidated(recorded: DataFrame, observed: DataFrame) -> DataFrame:
    """(attempt, verdict, fields): recorded observations against those derived again from the raw logs (SRC-15, DQ-11).

    ok, missing (no record), extra (no log) or changed, with the names of the fields that differ; null is a value.
    """
    fields = [c for c in observed.columns if c != "attempt"]
    a = recorded.select("attempt", F.struct(*fields).alias("a"))
    b = observed.select("attempt", F.struct(*fields).alias("b"))
    differ = F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in fields]), lambda x: x.isNotNull())
    both = a.join(b, "attempt", "full")
    lone = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "extra")
    rows = both.select("attempt", lone.alias("lone"), F.when(lone.isNull(), differ).otherwise(F.array().cast("array<string>")).alias("fields"))
    return rows.select("attempt", F.coalesce("lone", F.when(F.size("fields") > 0, "changed").otherwise("ok")).alias("verdict"), "fields")


def sent_as_expected(events: DataFrame, expected: DataFrame) -> DataFrame:
    """(attempt, ok): the lines sent, in order, are those of expected (attempt, lines), with or without a last `quit` (DQ-16)."""
    sent = events.where(F.col("direction") == "send").groupBy("attempt").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("sent"))
    both = expected.join(sent, "attempt", "left")
    lines = F.transform("sent", lambda x: x["line"])
    return both.select("attempt", F.coalesce((lines == F.col("lines")) | (lines == F.concat("lines", F.array(F.lit("quit")))), F.size("lines") == 0).alias("ok"))
