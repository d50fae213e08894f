"""Queries that write files to the shared folder and read them back through the library's sources, and texts read as files hold them."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.scalar import anonymised
from granary.session import scratch_folder, table
from granary.sources import datasets as D
from granary.sources import records

from . import Registry
from .data import split_sql

REGISTRY = query = Registry()


@query(
    "snk04_dataset_round_trip",
    f"WITH d AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) % 2001 AS cp, {split_sql('CAST(o_custkey AS VARCHAR)')} AS split FROM orders) SELECT split, count(*) AS n, count(*) FILTER (WHERE k % 9 <> 0) AS n_named, CAST(sum(cp) AS BIGINT) AS score FROM d GROUP BY 1",
)
def _(spark, sf_dir):
    """Orders as positions of games, their customers: written with a manifest, read back under it, and joined."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("game_id"), F.col("o_orderkey"), (F.floor("o_totalprice").cast("long") % 2001).alias("score_cp"), D.hash_split("granary-1", F.col("o_custkey")).alias("split"))
    positions = rows.select("game_id", F.lit(0).alias("ply"), F.lit(1).alias("schema_version"), F.col("o_orderkey").cast("string").alias("sfen"), "split")
    labels = rows.select(F.lit(0).alias("label_depth"), "score_cp", F.col("o_orderkey").cast("string").alias("sfen"), "split", F.when(F.col("o_orderkey") % 9 != 0, "own").alias("teacher"))
    games = rows.select("game_id", F.lit(0).alias("game_index"), F.col("game_id").alias("pack"), "split").distinct()
    path = scratch_folder(spark, "dataset")
    D.write_dataset(positions, labels, games, path)
    positions, labels, games = D.read_dataset(spark, path)
    both = positions.join(games.select("game_id"), "game_id").join(labels.select("sfen", "score_cp", "teacher"), "sfen")
    return both.groupBy("split").agg(F.count("*").alias("n"), F.count("teacher").alias("n_named"), F.sum("score_cp").alias("score"))


@query("src06_json_lines", "SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey::BIGINT END AS n FROM customer")
def _(spark, sf_dir):
    path = scratch_folder(spark, "lines")
    table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_name AS name", "if(c_custkey % 3 = 0, NULL, c_nationkey) AS n").write.json(path)
    return records.json_lines(spark, path, "k bigint, name string, n bigint")


@query("src20_run_catalogue", "SELECT count(*) FILTER (WHERE c_custkey % 4 <> 0) AS n_runs, count(*) FILTER (WHERE c_custkey % 4 = 0) AS n_corrupt FROM customer")
def _(spark, sf_dir):
    """Every fourth line ends too early."""
    path = scratch_folder(spark, "runs")
    table(spark, sf_dir, "customer").select(F.expr("""concat('{"run":"r', c_custkey, '","n":', c_nationkey, if(c_custkey % 4 = 0, '', '}'))""")).write.text(path)
    found = records.catalogue(spark, path, "run string, n bigint")
    return found.agg(F.count_if(F.col("corrupt").isNull() & F.col("run").isNotNull()).alias("n_runs"), F.count_if(F.col("corrupt").isNotNull()).alias("n_corrupt"))


@query("src13_archive_members", "SELECT 'packs/' || p_partkey || '.pack' AS path, p_size::BIGINT AS size FROM part WHERE p_partkey % 4 <> 0")
def _(spark, sf_dir):
    """A listing of three members a part: a pack, whose path climbs out for every fourth, a text, and one in another folder."""
    text = F.expr("concat('Path = packs/', if(p_partkey % 4 = 0, '../', ''), p_partkey, '.pack\\nSize = ', p_size, '\\n\\nPath = packs/', p_partkey, '.txt\\nSize = 1\\n\\nPath = other/', p_partkey, '.pack\\nSize = 2\\n')")
    return records.listing(table(spark, sf_dir, "part").select(text.alias("t")), "t", "packs/", ".pack")


_BOARD = "\\n".join(records.BOARD)


@query(
    "src04_game_texts",
    f"""WITH b AS (SELECT replace('{_BOARD}', '\\n', chr(10)) AS board)
    SELECT p_partkey AS id, p_partkey % 7 = 0 AS valid, CASE WHEN p_partkey % 7 IN (3, 4) THEN 1 WHEN p_partkey % 7 = 5 THEN 0 ELSE 2 END AS plies,
      sha256(board || chr(10) || '+' || chr(10) || CASE WHEN p_partkey % 7 IN (3, 4) THEN '+7776FU' || chr(10) WHEN p_partkey % 7 = 5 THEN '' ELSE '+7776FU' || chr(10) || CASE WHEN p_partkey % 7 = 6 THEN '+3334FU' ELSE '-3334FU' END || chr(10) END) AS canonical_sha256 FROM part, b""",
)
def _(spark, sf_dir):
    """Of seven texts one is valid; the others lack a name or the board, have a bad second move, one more board, no move, or a side that moves twice."""
    text = F.expr("""concat('V2.2\\nN+a\\n', if(p_partkey % 7 = 1, '', 'N-b\\n'), if(p_partkey % 7 = 2, '', 'PI\\n'), if(p_partkey % 7 = 4, 'P1-KY\\n', ''), '+\\n', if(p_partkey % 7 = 5, '', '+7776FU\\n'),
      CASE p_partkey % 7 WHEN 3 THEN '-333FU' WHEN 4 THEN '' WHEN 5 THEN '' WHEN 6 THEN '+3334FU' ELSE '-3334FU' END, '\\n%TORYO\\n')""")
    return records.games(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("t")), "id", "t").select("id", "valid", "plies", "canonical_sha256")


@query("snk10_anonymised_games", "SELECT c_custkey, 'N+player' || chr(10) || 'N-player' || chr(10) || '+7776FU' AS game FROM customer")
def _(spark, sf_dir):
    text = F.concat(F.lit("N+"), "c_name", F.lit("\nN-"), F.reverse("c_name"), F.lit("\n+7776FU"))
    return table(spark, sf_dir, "customer").select("c_custkey", anonymised(text).alias("game"))


@query("snk08_public_export", "SELECT s_suppkey AS n, s_name AS name FROM supplier")
def _(spark, sf_dir):
    """Two allowed columns go out; a third, which holds a path, does not."""
    path = scratch_folder(spark, "public")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"), F.col("s_name").alias("name"), F.concat(F.lit("/home/"), "s_name").alias("file"))
    D.export_public(rows, ["n", "name"], path)
    return spark.read.schema("n bigint, name string").json(f"{path}/data")


@query("snk11_public_comparison", """SELECT l_returnflag, '{"baseline":{"mae":' || CAST(CAST(floor(avg(l_quantity)) AS BIGINT) AS VARCHAR) || ',"n":' || count(*) || '},"candidate":{"mae":' || CAST(CAST(floor(avg(l_linenumber)) AS BIGINT) AS VARCHAR) || ',"n":' || count(*) || '},"group":"' || l_returnflag || '"}' AS line FROM lineitem GROUP BY 1""")
def _(spark, sf_dir):
    """A nested record of both models' figures and nothing else of the run."""
    side = lambda c: F.struct(F.floor(F.avg(c)).alias("mae"), F.count("*").alias("n"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(side("l_quantity").alias("baseline"), side("l_linenumber").alias("candidate"))
    return rows.select("l_returnflag", F.to_json(F.struct("baseline", "candidate", F.col("l_returnflag").alias("group"))).alias("line"))


@query("src19_game_files", "SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1")
def _(spark, sf_dir):
    """A folder for each region, and in it a file of its nations, found below the top."""
    path = scratch_folder(spark, "games")
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "\n").alias("value"))
    rows.repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    found = D.game_files(spark, path, "*.txt")
    return found.select(F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("int").alias("k"), F.size(F.split(F.rtrim(F.regexp_replace("text", "\n$", "")), "\n")).cast("long").alias("n"))


@query("src03_verified_files", "SELECT * FROM (VALUES ('changed', 1::BIGINT), ('extra', 1), ('missing', 1), ('ok', 3)) t(verdict, n)")
def _(spark, sf_dir):
    """Five files, one for each region; the manifest has a wrong hash for one, leaves one out and names one that is not there."""
    path = scratch_folder(spark, "files")
    regions = table(spark, sf_dir, "region").select("r_name", F.col("r_regionkey").alias("k"))
    regions.repartition("k").write.partitionBy("k").text(path)
    files = records.inventory(spark, path).withColumn("k", F.regexp_extract("name", "k=([0-9]+)", 1).cast("int"))
    manifest = files.where("k <> 4").select("name", F.when(F.col("k") == 3, F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"), "bytes")
    manifest = manifest.unionByName(spark.range(1).select(F.lit("absent").alias("name"), F.lit("0" * 64).alias("sha256"), F.lit(1).cast("long").alias("bytes")))
    return records.verified_files(spark, path, manifest).groupBy("verdict").agg(F.count("*").alias("n"))
