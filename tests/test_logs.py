"""Log lines, attempts, datasets and exports on literals."""

import itertools
import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from granary import catalog
from granary.functions import boards as B
from granary.functions.log_lines import read_line
from granary.functions.scalar import user_key
from granary.operators import attempts as A
from granary.operators import relations as R
from granary.sources import datasets as D


@pytest.mark.parametrize(
    "line, want",
    [
        ("info depth 3 multipv 1 nodes 10 score cp -5 lowerbound pv 7g7f 3c3d", {"depth": 3, "kind": "cp", "raw": "-5", "bound": "lowerbound", "pv": ["7g7f", "3c3d"], "nodes": 10, "node_evidence": "present", "parse_error": None}),
        ("info nodes 1 nodes 2 score mate -0", {"kind": "mate", "raw": "-0", "nodes": None, "node_evidence": "ambiguous", "node_verdicts": ["valid", "valid"]}),
        ("info depth 1 string diagnostic score cp 77 nodes 3", {"depth": 1, "node_evidence": "missing", "parse_error": None}),
        ("info depth 3 score pv nodes 9 pv a", {"parse_error": "malformed_score", "malformed_scores": 1, "nodes": 9, "node_evidence": "present"}),
        ("info score cp x nodes 7 score cp 3 pv a", {"parse_error": "malformed_score", "malformed_scores": 1, "nodes": 7}),
        ("info nodes pv a b", {"pv": ["a", "b"], "node_verdicts": ["missing"], "node_evidence": "missing"}),
        ("info nodes nodes 4", {"node_verdicts": ["missing", "valid"], "node_evidence": "ambiguous"}),
        ("info pv a nodes 5 string score cp 1", {"pv": ["a", "nodes", "5"], "node_evidence": "missing"}),
        ("info depth x score cp 3 pv a", {"depth": None, "kind": "cp", "parse_error": "malformed_depth_value"}),
        ("info foo 3 score cp 3 nodes 2", {"parse_error": "unknown_info_field:foo", "nodes": 2}),
        ("info score mate + nodes -4", {"raw": "+", "node_evidence": "negative", "nodes": -4}),
        ("info nodes 1x score cp", {"node_evidence": "malformed", "parse_error": "malformed_score", "malformed_scores": 1}),
        ("info depth 99999999999999999999999 score cp 5 pv a", {"depth": None, "kind": "cp", "parse_error": "overflow_depth_value"}),
        ("info nodes 9223372036854775808 time -0009223372036854775808", {"nodes": None, "node_verdicts": ["overflow"], "node_evidence": "overflow", "time": -(1 << 63)}),
        ("info nps " + "9" * 9000, {"nps": None, "parse_error": "overflow_nps_value"}), ("info depth " + "0" * 9000 + "7", {"depth": 7, "parse_error": None}),
        ("info depth", {"parse_error": "missing_depth_value"}), ("info string score cp 9", None), ("info", None), ("bestmove 7g7f", None), (None, None),
    ],
)
def test_read_line(line, want):
    found = read_line(line)
    assert found is want if want is None else {k: found.get(k) for k in want} == want


def log(attempt, *lines):
    return [(attempt, i, "send" if x.startswith("go") else "runner" if not x else "receive", x, i) for i, x in enumerate(lines)]


PLAN = "attempt string, first_side boolean, requested_nodes long, engine string, position_type string, in_check boolean, legal_moves int, sole_move string, mating_moves array<string>"
LOGS = {
    "exact": ["go nodes 5", "info score cp 1 nodes 5 pv x", "bestmove x", "go nodes 100", "info score cp 9 nodes 50 pv 7g7f", "info score cp -30 nodes 101 pv 7g7f 3c3d", "bestmove 7g7f", "info score cp 5 nodes 7 pv x"],
    "bound": ["go nodes 100", "info score cp 9 nodes 50 pv 7g7f", "info score cp 40 upperbound nodes 60 pv 7g7f", "bestmove 7g7f"],
    "mate": ["go nodes 100", "info score mate - nodes 50 pv 7g7f", "bestmove 7g7f"],
    "above": ["go nodes 100", "info score cp 9 nodes 102 pv 7g7f", "bestmove 7g7f"],
    "zero": ["go nodes 100", "info score cp 9 nodes 0 pv 7g7f", "bestmove 7g7f"],
    "forced": ["go nodes 100", "info score cp 9 nodes 0 pv 7g7f", "bestmove 7g7f"],
    "resign": ["go nodes 100", "info score mate -1 nodes 0 pv resign", "bestmove resign"],
    "special": ["go nodes 100", "info score cp 9 nodes 5 pv 7g7f", "bestmove win"],
    "mismatch": ["go nodes 100", "info score cp 9 nodes 5 pv 2g2f", "bestmove 7g7f"],
    "malformed": ["go nodes 100", "info score cp x nodes 5", "info score cp 9 nodes 5 pv 7g7f", "bestmove 7g7f"],
    "rank": ["go nodes 100", "info multipv 2 score cp 9 nodes 5 pv 7g7f", "bestmove 7g7f"],
    "silent": ["go nodes 100", "info nodes 3"],
    "double": ["go nodes 100", "info score cp 9 nodes 5 nodes 6 pv 7g7f", "bestmove 7g7f"],
    "no nodes": ["go nodes 100", "info score cp 9 pv 7g7f", "bestmove 7g7f"],
}


def test_observations(spark):
    events = spark.createDataFrame([e for k, lines in LOGS.items() for e in log(k, *lines)], "attempt string, seq int, direction string, line string, offset_ns long")
    kinds = {"forced": ("candidate", "forced_single_legal_move", True, 1, "7g7f"), "resign": ("teacher", "terminal_checkmate", True, 0, None)}
    plan = spark.createDataFrame([(k, False, 100, *kinds.get(k, ("candidate", "normal", False, 30, None)), None) for k in [*LOGS, "absent"]], PLAN)
    seen = A.observe(events, plan)
    found = {r.attempt: r for r in seen.collect()}
    assert {k: (r.status, r.failure_reason) for k, r in found.items()} == {
        "exact": ("exact_cp", None), "bound": ("bound_cp", None), "mate": ("mate", None), "forced": ("exact_cp", None), "resign": ("mate", None), "above": ("node_budget_failure", "node_count_above_limit"),
        "zero": ("node_budget_failure", "zero_nodes_without_exception"), "special": ("no_score", "special_bestmove"), "mismatch": ("protocol_failure", "pv_bestmove_mismatch"), "malformed": ("protocol_failure", "malformed_score"),
        "rank": ("no_score", "no_primary_scored_pv"), "silent": ("protocol_failure", "missing_bestmove"), "absent": ("protocol_failure", "missing_bestmove"),
        "double": ("node_budget_failure", "ambiguous_node_evidence"), "no nodes": ("node_budget_failure", "missing_node_evidence"),
    }
    r = found["exact"]
    assert (r.score_cp, r.score_cp_first, r.pv, r.last_reported_nodes, r.max_reported_nodes, r.info_count) == (-30, 30, ["7g7f", "3c3d"], 101, 101, 2)
    assert found["bound"].score_cp is None and found["bound"].reported_cp_first == -40 and found["bound"].score_bound_first == "lowerbound"
    assert (found["mate"].score_mate, found["mate"].mate_distance, found["mate"].mate_distance_known, found["mate"].winner_first) == ("-", None, False, True)
    assert found["forced"].zero_exception == "forced_single" and found["resign"].zero_exception == "terminal_resign"
    changed = seen.where("attempt <> 'zero'").withColumn("info_count", F.when(F.col("attempt") == "rank", 9).otherwise(F.col("info_count")))
    verdicts = {r.attempt: (r.verdict, r.fields) for r in A.revalidated(changed, seen.where("attempt <> 'bound'")).collect()}
    assert (verdicts["zero"], verdicts["bound"], verdicts["rank"], verdicts["exact"]) == (("missing", []), ("extra", []), ("changed", ["info_count"]), ("ok", []))


def test_logs_and_sent_lines(spark):
    rows = [*log("good", "go nodes 1", "x", ""), *log("open", "go nodes 1", "x"), ("back", 0, "send", "a", 5), ("back", 1, "runner", "", 3), ("two", 0, "runner", "", 1), ("two", 1, "runner", "", 2), ("said", 0, "runner", "x", 1), ("odd", 0, "other", "", 1), ("odd", 1, "runner", "", None)]
    events = spark.createDataFrame(rows, "attempt string, seq int, direction string, line string, offset_ns long")
    assert {r.attempt for r in A.log_faults(events).collect() if r.ok} == {"good"}
    sent = spark.createDataFrame([("a", 1, "send", "usi"), ("a", 0, "receive", "x"), ("a", 2, "send", "quit"), ("b", 2, "send", "usi"), ("b", 1, "send", "go")], "attempt string, seq int, direction string, line string")
    expected = spark.createDataFrame([("a", ["usi"]), ("b", ["usi", "go"]), ("c", ["usi"])], "attempt string, lines array<string>")
    assert {r.attempt: r.ok for r in A.sent_as_expected(sent, expected).collect()} == {"a": True, "b": False, "c": False}


def test_dataset_on_files(spark, tmp_path):
    """Written, read back, and refused after a change; sorted keys and nulls in the lines."""
    games = [(f"g{i}", i, "p", "train" if i % 2 else "holdout") for i in range(4)]
    positions = spark.createDataFrame([(g, k, 1, f"{g} b {k}", s) for g, _, _, s in games for k in range(3)], D.POSITIONS)
    labels = positions.selectExpr("0 AS label_depth", "CAST(ply * 10 AS BIGINT) AS score_cp", "sfen", "split", "if(ply = 1, NULL, 'own') AS teacher")
    path = str(tmp_path / "set")
    manifest = D.write_dataset(positions, labels, spark.createDataFrame(games, D.GAMES), path).collect()
    assert {r.name.split("/")[0] for r in manifest} == {"positions", "labels", "games"} and all(r.bytes > 0 for r in manifest)
    read = D.read_dataset(spark, path)
    assert [x.count() for x in read] == [12, 12, 4] and sorted(read[0].select(*positions.columns).collect()) == sorted(positions.collect())
    part = next((tmp_path / "set/data/labels/split=train").glob("*.json"))
    lines = [json.loads(x) for x in part.read_text().splitlines()]
    assert all(list(x) == sorted(x) and "teacher" in x for x in lines)
    assert [r.score_cp for r in D.split_rows(*read[:2], "train", ["game_id", "ply"]).collect()] == [0, 10, 20] * 2
    assert D.inventory_digest(D.inventory(spark, f"{path}/data")).first().n_files == len(manifest)
    part.write_text(part.read_text() + "\n")
    part.with_name(f".{part.name}.crc").unlink()  # the local file system's own checksum, which a store does not have
    with pytest.raises(ValueError, match="manifest"):
        D.read_dataset(spark, path)


def test_public_export(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "/home/x"), ("b", 2, "y")], "name string, n int, path string")
    manifest = D.export_public(rows, ["n", "name"], str(tmp_path / "out")).collect()
    text = "".join(p.read_text() for p in (tmp_path / "out/data").glob("*.json"))
    assert {r.name for r in manifest} == {p.name for p in (tmp_path / "out/data").glob("*.json") if p.stat().st_size} and sorted(text.splitlines()) == ['{"n":1,"name":"a"}', '{"n":2,"name":"b"}']
    with pytest.raises(ValueError, match="path"):
        D.export_public(rows, ["path"], str(tmp_path / "other"))
    with pytest.raises(Exception):
        D.export_public(rows, ["n"], str(tmp_path / "out"))


def test_game_files_and_pages(spark, tmp_path):
    (tmp_path / "in/below").mkdir(parents=True)
    for name in ("in/a.csa", "in/below/b.csa", "in/c.txt"):
        (tmp_path / name).write_text(f"text\nof {name}")
    assert sorted(r.text for r in D.game_files(spark, str(tmp_path / "in")).collect()) == ["text\nof in/a.csa", "text\nof in/below/b.csa"]
    pages = spark.createDataFrame([('x.attrs=["a","b"];',), ('x.attrs=["a",1];',), ("x.attrs=[oops];",), ("none",), (None,)], "h string")
    assert [r[0] for r in pages.select(D.embedded_list(F.col("h"))).collect()] == [["a", "b"], None, None, None, None]
    payloads = spark.createDataFrame([('{"games":[{"id":"x","length":3}]}',), ('{"games":5}',), ("[",), ('{"games":[],"games":[]}',)], "p string")
    assert [r[0] for r in payloads.select(D.history(F.col("p"))).collect()] == [[Row(id="x", created=None, length=3)], None, None, None]


def test_maps_and_search(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    assert sorted(tuple(r) for r in R.union_exact(a, a.where("k < 3"), "k", "v").collect()) == [(1, "x"), (2, "y"), (3, None)]
    for other in ((2, "z"), (3, "x")):
        with pytest.raises(Exception, match="conflicting"):
            R.union_exact(a, spark.createDataFrame([other], "k int, v string"), "k", "v").collect()
    shares = spark.createDataFrame([("p", 1), ("p", 2), ("q", 2), ("q", 3), ("r", 3), ("r", 4), ("s", 9)], "place string, member int")
    start = spark.createDataFrame([(1,)], "member int")
    assert {r.member: r.distance for r in R.frontier(shares, start).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert {r.member for r in R.frontier(shares, start, target=2).collect()} == {1, 2}
    assert R.frontier(shares, start.where("member > 1")).count() == 0
    ids = spark.createDataFrame([("Straße",), ("STRASSE",)], "i string").select(user_key(F.col("i"))).distinct()
    assert ids.count() == 1


@pytest.mark.parametrize("near", [0, 3, 500_000])
def test_frontier_of_a_random_graph(spark, monkeypatch, near):
    """Distances as a plain search finds them, whether a frontier is broadcast or dealt out; null places and members lead nowhere."""
    r = random.Random(near)
    monkeypatch.setattr(R, "NEAR", near)
    rows = [(r.randrange(40) if r.random() < 0.95 else None, r.randrange(60) if r.random() < 0.95 else None) for _ in range(90)]
    shares = spark.createDataFrame(rows, "place int, member int")
    want, newest = {0: 0}, {0}
    while newest:
        places = {p for p, m in rows if m in newest and p is not None}
        newest = {m for p, m in rows if p in places and m is not None} - want.keys()
        want |= {m: max(want.values()) + 1 for m in newest}
    assert {x.member: x.distance for x in R.frontier(shares, spark.createDataFrame([(0,)], "member int")).collect()} == want


def test_near_frontiers_leave_the_shares_where_they_are(spark):
    """Rounds that reach little of a table shuffle little of it."""
    shares = spark.range(200_000).selectExpr("CAST(id AS BIGINT) AS place", "explode(array(id, id + 1)) AS member").where("place < 5 OR place >= 10")
    store, known = spark.sparkContext._jsc.sc().statusStore(), set()

    def shuffled():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        stages = [found.apply(k) for k in range(found.size())]
        new = [x.shuffleWriteBytes() for x in stages if x.stageId() not in known]
        known.update(x.stageId() for x in stages)
        return sum(new)

    shuffled()
    assert R.frontier(shares, spark.range(1).selectExpr("id AS member")).count() == 6
    assert shuffled() < 300_000  # 400,000 rows take several times as much


def test_sentences(spark):
    start = "lnsgkgsnl/1r5b1/ppppppppp/9/9/9/PPPPPPPPP/1B5R1/LNSGKGSNL b - 1"
    cases = {start: True, start.replace(" b ", " x "): False, start.replace("- 1", "- 0"): False, start.replace("-", "P"): False, start.replace("9/9/9", "9/9/8"): False, start.replace("LNSGKGSNL", "LNSG1GSNL"): False,
             "4k4/9/9/9/9/9/9/9/4K4 w 2R2b18p 7": True, "4k4/9/9/9/9/9/9/9/4K4 w 3R 7": False, "4k4/9/9/9/4+P4/9/9/9/4K4 w PP 7": False, "4k4/9/9/9/4+G4/9/9/9/4K4 w - 7": False, "": False}
    rows = spark.createDataFrame([(s, v) for s, v in cases.items()], "s string, v boolean")
    assert [r.s for r in rows.where(B.sentence_valid(F.col("s")) != F.col("v")).collect()] == []
    r = spark.createDataFrame([(start,)], "s string").select(B.active_features(F.col("s"), 0).alias("a"), B.active_features(F.col("s"), 1).alias("b"), B.material(F.col("s")).alias("m")).first()
    assert len(r.a) == len(r.b) == 40 and sorted(x ^ 1 for x in r.a) == sorted(r.b) and r.m == 0 and r.a == sorted(r.a)
    promoted = spark.createDataFrame([("+r3k4/9/9/9/9/9/9/9/4K4 b 2pB 1",)], "s string").select(B.active_features(F.col("s"), 0).alias("a"), B.material(F.col("s")).alias("m")).first()
    assert promoted.a[0] == 13 * 2 + 1 and promoted.a[-3:] == [2268 + 34, 2268 + 76, 2268 + 77] and promoted.m == 890 - 1300 - 200


def test_features_of_random_boards(spark, sf):
    """Against a plain version; the board is made once a row, not once a square, and a small table's rows go to all cores."""
    r = random.Random(3)
    pieces = [s + c for c in "PLNSGBRK" for s in ("", "+") if s + c not in ("+G", "+K")]
    order = [p for p in pieces if "+" not in p] + ["+P", "+L", "+N", "+S", "+B", "+R"]
    rows = []
    for n in range(60):
        cells = {at: r.choice([str.upper, str.lower])(r.choice(pieces)) for at in range(81) if r.random() < 0.4}
        ranks = [[cells.get(9 * k + i, "") for i in range(9)] for k in range(9)]
        board = "/".join("".join(str(len(list(g))) if not c else "".join(g) for c, g in itertools.groupby(rank)) for rank in ranks)
        hand = {(c, side): r.choice([0, 0, 1, 2, m]) for side in (0, 1) for c, m in B.SET.items()}
        text = "".join((str(k) if k > 1 else "") + (c.lower() if side else c) for (c, side), k in hand.items() if k) or "-"
        want = []
        for view in (0, 1):
            found = sorted((at % 9 * 9 + at // 9) * 28 + 2 * order.index(x.upper()) + (x.islower() != view) for at, x in cells.items())
            for (c, side), k in hand.items():
                first = B.HAND_START + (2 * side + view) * B.HAND_SIZE + B.HAND_OFFSETS["PLNSGBR".index(c)]
                found += range(first, first + k)
            want.append(found)
        rows.append((n, f"{board} b {text} 1", *want))
    made = spark.createDataFrame(rows, "n int, s string, a array<int>, b array<int>")
    found = made.select("n", "a", "b", *[B.active_features(F.col("s"), k).alias(f"f{k}") for k in (0, 1)])
    assert [x.n for x in found.collect() if x.a != x.f0 or x.b != x.f1] == []
    plan = made.select(B.active_features(F.col("s"), 0).alias("f"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("replace(") == 2 * len(B.PROMOTED) + 10
    for name in ("fn15_active_features", "fn27_sparse_network"):
        assert catalog.QUERIES[name](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_no_line_stops_a_job(spark):
    """Lines of random words of the format, numbers of any size among them, and what is observed of them."""
    r = random.Random(7)
    words = ["depth", "seldepth", "time", "nodes", "nps", "multipv", "score", "cp", "mate", "lowerbound", "pv", "string", "currmove", "7g7f", "x", "+", "-", "-0", "3", "-9223372036854775808", "9" * 25, "-" + "8" * 5000, "1200", "é", "\x00"]
    lines = ["info " + " ".join(r.choice(words) for _ in range(r.randrange(12))) for _ in range(2000)]
    lines += ["info depth 1 nodes 5 score cp -9223372036854775808 pv 7g7f", "info score mate -9223372036854775808 nodes 5 pv 7g7f"]
    rows = [(i // 4, 10 * i + k, d, x, 0) for i, line in enumerate(lines) for k, (d, x) in enumerate([("send", "go nodes 1200"), ("receive", line), ("receive", "bestmove 7g7f")])]
    events = spark.createDataFrame(rows, "attempt long, seq long, direction string, line string, offset_ns long")
    plan = events.selectExpr("attempt", "attempt % 2 = 0 AS first_side", "1200L AS requested_nodes", "'candidate' AS engine", "'normal' AS position_type", "false AS in_check", "30 AS legal_moves", "CAST(NULL AS STRING) AS sole_move", "CAST(array() AS ARRAY<STRING>) AS mating_moves").distinct()
    assert len(A.observe(events, plan).collect()) == plan.count() == len({a for a, *_ in rows})


def test_turned_boards(spark):
    made = [
        ("4k4/9/9/9/2+P6/9/9/9/4K4 b R2Pb3p 7", "4k4/9/9/9/9/9/9/9/4K4 b - 1", "lnsgkgsnl/1r5b1/ppppppppp/9/9/9/PPPPPPPPP/1B5R1/LNSGKGSNL b - 1", "4k4/9/3+r5/9/9/1n7/9/9/4K3+b w 2G18P 40"),
        ("4k4/9/9/9/6+p2/9/9/9/4K4 w B3Pr2p 7", "4k4/9/9/9/9/9/9/9/4K4 w - 1", "lnsgkgsnl/1r5b1/ppppppppp/9/9/9/PPPPPPPPP/1B5R1/LNSGKGSNL w - 1", "+B3k4/9/9/7N1/9/9/5+R3/9/4K4 b 2g18p 40"),
    ]
    rows = spark.createDataFrame(list(zip(*made)), "s string, want string").withColumn("t", B.turned(F.col("s")))
    back, kept = B.turned(F.col("t")), B.material(F.col("t")) == B.material(F.col("s"))
    for r in rows.select("s", "want", "t", back.alias("back"), B.sentence_valid(F.col("t")).alias("valid"), kept.alias("kept")).collect():
        assert r.t == r.want and r.back == r.s and r.valid and r.kept
