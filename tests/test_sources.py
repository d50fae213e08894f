"""Sources, scalar functions and streams on small literals."""

import hashlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from granary.functions import scalar as S
from granary.functions.fnv import fnv1a
from granary.operators import evaluation as E
from granary.operators import relations as R
from granary.sources import datasets as D
from granary.sources import records
from granary.streaming.events import counts_by_window, ingest, last_window, state_folder


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_games(spark):
    board = "\n".join(records.BOARD)
    head = "V2.2\nN+a\nN-b\nPI\n+\n"
    texts = {
        "ok": head + "+7776FU\n-3334FU\n%TORYO", "board": f"N+a\r\nN-b\r\n{board}\r\n+\r\n+7776FU\r\n-3334FU\r\n", "turn": head + "+7776FU\n+3334FU", "none": head, "bad": head + "+77FU", "null": None, "nul": head + "+7776FU\x00",
        "one name": "N+a\nPI\n+\n+7776FU", "no board": "N+a\nN-b\n+\n+7776FU", "two boards": head.replace("PI", "PI\n" + board) + "+7776FU", "names turned": head.replace("N+a\nN-b", "N-b\nN+a") + "+7776FU", "white first": head.replace("\n+\n", "\n-\n") + "-3334FU",
        "other board": head.replace("PI", board.replace("-OU", " * ")) + "+7776FU",
    }
    found = {r.id: r for r in records.games(spark.createDataFrame(list(texts.items()), "id string, t string"), "id", "t").collect()}
    want = hashlib.sha256((board + "\n+\n+7776FU\n-3334FU\n").encode()).hexdigest()
    assert found["ok"].moves == ["+7776FU", "-3334FU"] and found["ok"].canonical_sha256 == found["board"].canonical_sha256 == want
    assert {k for k, r in found.items() if r.valid} == {"ok", "board"} and found["null"].plies == 0


def test_listing(spark):
    text = "Path = a/x.pack\nSize = 10\n\nPath = a/../y.pack\nSize = 2\n\nPath = b/z.pack\nSize = 3\n\nPath = a/x.txt\nSize = 1"
    assert records.listing(spark.createDataFrame([(text,)], "t string"), "t", "a/", ".pack").collect() == [Row(path="a/x.pack", size=10)]


def test_strict_json(spark, tmp_path):
    rows = spark.createDataFrame([('{"k": 1}',), ('{"k": 1, "k": 2}',), ("{",), (None,)], "t string").select(records.strict_json(F.col("t"), "struct<k: bigint>")["k"].alias("k"))
    assert [r.k for r in rows.collect()] == [1, None, None, None]
    (tmp_path / "x.json").write_text('{"a": true}\n')
    with pytest.raises(Exception):
        records.json_lines(spark, str(tmp_path / "x.json"), "a bigint").collect()
    assert records.catalogue(spark, str(tmp_path / "x.json"), "a bigint").first().corrupt


def test_verified_files(spark, tmp_path):
    for name, data in (("a", b"1"), ("b", b"22"), ("d", b"4")):
        (tmp_path / name).write_bytes(data)
    manifest = spark.createDataFrame([("a", hashlib.sha256(b"1").hexdigest(), 1), ("b", "0" * 64, 2), ("c", "0" * 64, 1)], "name string, sha256 string, bytes long")
    assert {r.name: r.verdict for r in records.verified_files(spark, str(tmp_path), manifest).collect()} == {"a": "ok", "b": "changed", "c": "missing", "d": "extra"}


def test_scalars(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (-1, -2), (-1, 0), (3, 3)], "a long, b long")
    assert [r[0] for r in pairs.select(S.blend_half_even(F.col("a"), F.col("b"))).collect()] == [2, 2, -2, 0, 3]
    mates = spark.createDataFrame([("+",), ("-",), ("-0",), ("0",), ("5",), ("-7",)], "t string").select(S.mate_winner(F.col("t")).alias("w"), S.mate_distance(F.col("t")).alias("d")).collect()
    assert [(m.w, m.d) for m in mates] == [("self", None), ("other", None), ("other", 0), ("self", 0), ("self", 5), ("other", 7)]
    ids = spark.range(500).select("id", S.hash_split("s", F.col("id")).alias("x")).collect()
    assert all((r.x == "holdout") == (int(hashlib.sha256(f"s:{r.id}".encode()).hexdigest()[:16], 16) % 10 == 0) for r in ids)
    with pytest.raises(Exception):
        one(spark, w=S.weight_of(F.concat(F.lit("a=1,a=2"), F.col("id").cast("string")), F.lit("a")))
    assert [r[0] for r in spark.createDataFrame([("",), (None,), ("a",)], "t string").select(fnv1a("t")).collect()] == [0xCBF29CE484222325 - 2**64, None, 0xAF63DC4C8601EC8C - 2**64]


def test_evaluation_edges(spark):
    rows = spark.createDataFrame([("a", 1.0, 5), ("a", 1.0, 6), ("b", None, None)], "g string, x double, y int")
    assert [tuple(r)[1:] for r in E.distribution(rows, "g", "y").orderBy("g").collect()] == [(2, 5, 5.5, 5.95, 5.99, 6), (0, None, None, None, None, None)]
    assert {r.g: r.pearson for r in E.regression_metrics(rows, "g", "x", "y").collect()} == {"a": None, "b": None}
    masked = {r.g: r.mae for r in E.masked_group_error(spark.createDataFrame([("a", 1, 2), ("a", 1, None), ("b", 1, 3)], "g string, t long, c long"), "g", F.lit(True), "t", "c").collect()}
    assert masked == {"a": None, "b": 2.0}
    empty = rows.where("false")
    assert E.contingency(empty, "g", "g", ["a"], ["a", "b"]).count() == 2 and E.gram(spark.createDataFrame([], "v array<float>"), "v").count() == 0


def test_relations(spark):
    rows = spark.createDataFrame([("k", "train", 1), ("k", "holdout", 2), ("m", "train", 3), ("m", "train", 4)], "k string, split string, i int")
    assert sorted(r.i for r in R.drop_shared(rows, ["k"], "split").collect()) == [3, 4]
    assert sorted(r.i for r in R.keep_first(rows, ["k"], ["i"]).collect()) == [1, 3]


def test_streams(spark, tmp_path):
    ev = spark.createDataFrame([(1, "x"), (2, "go"), (3, "a"), (4, "go"), (5, "b"), (6, "stop"), (7, "c")], "i int, e string").withColumn("k", F.lit(1))
    assert [r.i for r in last_window(ev, "k", ["i"], F.col("e") == "go", F.col("e") == "stop").collect()] == [5]
    assert sorted(r.i for r in last_window(ev, "k", ["i"], F.col("e") == "go", F.col("e") == "stop", keep_stop=True).collect()) == [5, 6]
    assert sorted(r.i for r in last_window(ev, "k", ["i"], F.col("e") == "none", F.col("e") == "stop").collect()) == [1, 2, 3, 4, 5]
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    ev.write.json(src)
    for _ in range(2):
        ingest(spark, src, "i int, e string, k int", out, state_folder(mark, source=src, version=1))
    assert spark.read.parquet(out).count() == 7
    ingest(spark, src, "i int, e string, k int", out + "2", state_folder(mark, source=src, version=2))  # other settings start anew
    assert spark.read.parquet(out + "2").count() == 7
    timed = spark.readStream.schema("i int, e string, k int").json(src).withColumn("ts", F.timestamp_seconds("i"))
    q = counts_by_window(timed, "ts", "e").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 7


def test_boards_and_reports(spark):
    start = "lnsgkgsnl/1r5b1/ppppppppp/9/9/9/PPPPPPPPP/1B5R1/LNSGKGSNL"
    rows = [(start, True), ("9/9/9/9/9/9/9/9/8+P", True), ("9/9/9/9/9/9/9/9/8+", False), ("9/9", False), ("", False), (None, None)]
    df = spark.createDataFrame(rows, "board string, valid boolean")
    got = df.select("valid", S.board_valid(F.col("board")).alias("v"), S.rotated_swap(F.col("board")).alias("r"), S.signed_material(F.col("board"), {"p": 1, "+p": 6}).alias("m")).collect()
    assert [r.v for r in got] == [r.valid for r in got]
    assert got[0].r == start and got[1].r == "+p8/9/9/9/9/9/9/9/9"
    assert [r.m for r in got] == [0, 6, 0, 0, 0, None]
    text = spark.createDataFrame([("V2.2\nN+ann\nN-bob\n+7776FU", "a|b", None)], "game string, x string, y int")
    r = text.select(S.anonymised(F.col("game")).alias("g"), S.markdown_row("x", "y").alias("m")).first()
    assert r.g == "V2.2\nN+player\nN-player\n+7776FU" and r.m == "| a\\|b |  |"


def test_manifest_is_made_by_many_tasks(spark, tmp_path):
    """Files are hashed by as many tasks as their bytes ask for, not by the one that writes the manifest."""
    rows = spark.range(4).selectExpr("string(id) AS game_id", "0 AS ply", "1 AS schema_version", "concat('p', id) AS sfen", "concat('s', id) AS split")
    labels = rows.selectExpr("0 AS label_depth", "1L AS score_cp", "sfen", "split", "'own' AS teacher")
    games = rows.selectExpr("game_id", "0 AS game_index", "game_id AS pack", "split")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        manifest = D.write_dataset(rows, labels, games, str(tmp_path / "set"))
        assert len(list((tmp_path / "set/manifest").glob("part-*"))) > 1 and manifest.distinct().count() == manifest.count() >= 9
        assert [x.count() for x in D.read_dataset(spark, str(tmp_path / "set"))] == [4, 4, 4]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_mean_of_means_beyond_doubles(spark):
    groups = spark.createDataFrame([(30637086, 1200750), (30535308, 1199100), (30630192, 1200150)], "total long, n long")
    assert tuple(E.exact_mean_of_means(groups, "total", "n").first()) == ("132195593784515940000", "5183997488696250000")
