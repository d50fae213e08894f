"""Queries over whole datasets, manifests, snapshots, boards and small filters, each over whole tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import boards as B
from granary.functions.scalar import canonical_json, position_key
from granary.operators import evaluation as E
from granary.operators import nested as N
from granary.operators import relations as R
from granary.operators.network import Network, forward_sparse
from granary.session import spread, table
from granary.sources import datasets as D

from . import Registry
from .data import key_sql, split_sql

REGISTRY = query = Registry()
SEED = "granary-1"
_TEACHER = "external:own"


def _dataset(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents are positions, their sources games; labels of the table give scores, some out of range or without a position."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    game = F.sha2(F.coalesce("source", F.lit("")), 256)
    split = D.hash_split(SEED, game)
    positions = docs.select(game.alias("game_id"), F.col("doc_id").cast("int").alias("ply"), F.when(F.col("doc_id") % 50 == 0, 2).otherwise(1).alias("schema_version"), F.col("text").alias("sfen"), split.alias("split"))
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality")
    labels = docs.join(marks, "doc_id").select(F.lit(0).alias("label_depth"), (F.col("n_chars") * 8 * F.col("quality")).alias("score_cp"), F.col("text").alias("sfen"), split.alias("split"), F.when(F.col("doc_id") % 40 == 0, "other").otherwise(_TEACHER).alias("teacher"))
    index = F.length(F.coalesce("source", F.lit(""))) + F.ascii(F.substring(F.coalesce("source", F.lit("x")), -1, 1))
    games = docs.where("doc_id % 3 <> 0").select("source").distinct().select(game.alias("game_id"), index.alias("game_index"), F.lit("pack").alias("pack"), F.when(index % 2 == 0, split).otherwise("train").alias("split"))
    return positions, labels, games


_GAME = "sha256(coalesce(source, ''))"
_INDEX = "(length(coalesce(source, '')) + ascii(right(coalesce(source, 'x'), 1)))"
_DATASET = f"""
    d AS (SELECT doc_id, text, {key_sql('text')} AS key, n_chars, {_GAME} AS game, {split_sql(_GAME)} AS split FROM documents),
    l AS (SELECT text, split, n_chars * 8 * quality AS cp, doc_id % 40 = 0 AS strange FROM d JOIN labels USING (doc_id)),
    g AS (SELECT game, i, own, CASE WHEN i % 2 = 0 THEN own ELSE 'train' END AS split FROM (SELECT DISTINCT {_GAME} AS game, {_INDEX} AS i, {split_sql(_GAME)} AS own FROM documents WHERE doc_id % 3 <> 0))"""


@query(
    "src08_dataset_faults",
    f"""WITH {_DATASET}
    SELECT 'repeated_sentence' AS "check", count(*) AS n_violations FROM (SELECT 1 FROM d GROUP BY split, text HAVING count(*) > 1)
    UNION ALL SELECT 'repeated_key', count(*) FROM (SELECT 1 FROM d GROUP BY split, key HAVING count(*) > 1)
    UNION ALL SELECT 'unknown_game', count(*) FROM d WHERE game NOT IN (SELECT game FROM g)
    UNION ALL SELECT 'schema_version', count(*) FROM d WHERE doc_id % 50 = 0
    UNION ALL SELECT 'repeated_label', count(*) FROM (SELECT 1 FROM l GROUP BY split, text HAVING count(*) > 1)
    UNION ALL SELECT 'invalid_label', count(*) FROM l WHERE strange OR cp >= 30000
    UNION ALL SELECT 'position_without_label', count(*) FROM (SELECT DISTINCT split, text FROM d WHERE (split, text) NOT IN (SELECT (split, text) FROM l))
    UNION ALL SELECT 'label_without_position', 0
    UNION ALL SELECT 'repeated_game', count(*) FROM (SELECT 1 FROM g GROUP BY game HAVING count(*) > 1)
    UNION ALL SELECT 'repeated_place', count(*) FROM (SELECT 1 FROM g GROUP BY i HAVING count(*) > 1)
    UNION ALL SELECT 'invalid_game', count(*) FROM g WHERE i >= 60 OR split <> own""",
)
def _(spark, sf_dir):
    return D.dataset_faults(*_dataset(spark, sf_dir), SEED, _TEACHER, 60)


@query("src09_split_rows", f"WITH {_DATASET} SELECT doc_id AS ply, sha256(d.text) AS sentence, max(cp) AS score_cp FROM d JOIN l ON d.text = l.text AND d.split = l.split WHERE d.split = 'holdout' GROUP BY 1, 2")
def _(spark, sf_dir):
    positions, labels, _games = _dataset(spark, sf_dir)
    one = labels.groupBy("split", "sfen").agg(F.max("score_cp").alias("score_cp"))
    return D.split_rows(positions, one, "holdout", ["ply"]).select("ply", F.sha2("sfen", 256).alias("sentence"), "score_cp")


@query("src21_cached_labels", "SELECT doc_id, greatest(least(n_chars * 8 * quality, 2000), -2000) AS score_cp FROM documents JOIN labels USING (doc_id) WHERE doc_id % 40 <> 0 AND n_chars * 8 * quality < 30000")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    labels = docs.select(F.lit(0).alias("label_depth"), (F.col("n_chars") * 8 * F.col("quality")).alias("score_cp"), F.col("doc_id").alias("sfen"), F.when(F.col("doc_id") % 40 == 0, "other").otherwise(_TEACHER).alias("teacher"))
    return D.labels_for(labels, 0, _TEACHER).withColumnRenamed("sfen", "doc_id")


@query("num06_train_view", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN p ELSE (p + m) // 2 + CASE WHEN (p + m) % 2 = 0 THEN 0 ELSE ((p + m) // 2) % 2 END END AS score_cp, CASE WHEN o_orderkey % 3 = 0 THEN 'external:own' ELSE 'blend' END AS teacher FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 2001 AS p, o_custkey % 700 AS m FROM orders)")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "if(o_orderkey % 3 = 0, 'holdout', 'train') AS split", "CAST(floor(o_totalprice) AS BIGINT) % 2001 AS score_cp", "o_custkey % 700 AS material", f"'{_TEACHER}' AS teacher")
    return D.train_view(rows, F.col("material"), "blend").select("o_orderkey", "score_cp", "teacher")


@query("snk02_sorted_json_lines", """SELECT c_custkey, '{"acctbal":' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) || ',"name":"' || c_name || '","segment":' || CASE WHEN c_custkey % 4 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}' AS line FROM customer""")
def _(spark, sf_dir):
    parts = {"segment": F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")), "name": F.col("c_name"), "acctbal": F.floor("c_acctbal").cast("long")}
    return table(spark, sf_dir, "customer").select("c_custkey", canonical_json(*[parts[k].alias(k) for k in sorted(parts)]).alias("line"))


@query(
    "agg34_inventory_digest",
    """WITH f AS (SELECT substr(sha256('doc-' || doc_id), 1, 4) AS p, n_chars, concat_ws(' ', 'doc-' || doc_id, n_chars, sha256(text)) AS line FROM documents),
    l AS (SELECT p, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM f GROUP BY 1),
    n AS (SELECT substr(p, 1, 2) AS p, sha256(string_agg(concat_ws(' ', p, digest), chr(10) ORDER BY p)) AS digest FROM l GROUP BY substr(p, 1, 2))
    SELECT (SELECT count(*) FROM f) AS n_files, (SELECT CAST(sum(n_chars) AS BIGINT) FROM f) AS bytes, sha256(string_agg(concat_ws(' ', p, digest), chr(10) ORDER BY p)) AS digest FROM n""",
)
def _(spark, sf_dir):
    """Documents are files; the real inventory of a folder is sources.datasets.inventory()."""
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("name"), F.col("n_chars").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    return D.inventory_digest(files)


@query("src11_embedded_lists", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [p_brand, p_type] END AS attrs FROM part")
def _(spark, sf_dir):
    text = F.expr("""CASE p_partkey % 3 WHEN 0 THEN concat('<script>x.attrs=["', p_brand, '","', p_type, '"];</script>') WHEN 1 THEN concat('<script>x.attrs=["', p_brand, '",1];</script>') ELSE concat('<p>', p_name, '</p>') END""")
    return table(spark, sf_dir, "part").select("p_partkey", D.embedded_list(text).alias("attrs"))


@query("src10_history_games", "SELECT c_custkey, 'g' || c_custkey AS id, c_nationkey::BIGINT AS length FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, 'h' || c_custkey, NULL FROM customer WHERE c_custkey % 5 <> 0")
def _(spark, sf_dir):
    """A payload of two games a customer; every fifth repeats a key and so isn't one."""
    payload = F.expr("""concat('{"games":[{"id":"g', c_custkey, '","created":"x","length":', c_nationkey, '},{"id":"h', c_custkey, '"}]', if(c_custkey % 5 = 0, ',"games":[]}', '}'))""")
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(D.history(payload)).alias("g")).select("c_custkey", "g.id", "g.length")


@query(
    "dq18_snapshot_faults",
    """WITH r AS (SELECT conv_id AS c, count(*) AS plies, sha256(string_agg(coalesce(text, ''), ' ' ORDER BY turn)) AS canonical FROM conversations GROUP BY 1)
    SELECT 'id' AS "check", count(*) FILTER (WHERE c % 11 = 0) AS n_violations FROM r
    UNION ALL SELECT 'source_id', count(*) FILTER (WHERE c % 13 = 0) FROM r
    UNION ALL SELECT 'content', count(*) FILTER (WHERE c % 7 = 0 AND c % 17 <> 0) FROM r
    UNION ALL SELECT 'names', count(*) FILTER (WHERE c % 19 = 0 AND c % 17 <> 0) FROM r
    UNION ALL SELECT 'plies', count(*) FILTER (WHERE c % 5 = 0 AND c % 17 <> 0) FROM r
    UNION ALL SELECT 'canonical', 0
    UNION ALL SELECT 'repeated_game', count(*) FROM (SELECT 1 FROM r GROUP BY canonical HAVING count(*) > 1)
    UNION ALL SELECT 'repeated_source', 0
    UNION ALL SELECT 'missing_file', count(*) FILTER (WHERE c % 17 = 0) FROM r
    UNION ALL SELECT 'extra_file', 1
    UNION ALL SELECT 'buckets', 3""",
)
def _(spark, sf_dir):
    """Conversations are games; each check has faults of its own, and the expected buckets are one row too many and one number off."""
    games = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("plies"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " ").alias("moves"))
    games = games.withColumns({"canonical": F.sha2("moves", 256), "split": F.when(F.col("conv_id") % 2 == 0, "development").otherwise("final"), "file": F.concat(F.when(F.col("conv_id") % 19 == 0, "N+x\n").otherwise("N+black\nN-white\n"), F.col("conv_id").cast("string"))})
    # more than a hundred games: the form has two digits, so ids go by hundreds, told apart by the source
    snapshot = F.concat("split", F.when(F.col("conv_id") % 11 == 0, "_").otherwise("-"), F.lpad((F.col("conv_id") % 100).cast("string"), 2, "0"))
    source = F.concat(F.lpad(F.lower(F.conv(F.col("conv_id").cast("string"), 10, 16)), 23, "0"), F.when(F.col("conv_id") % 13 == 0, "G").otherwise("0"))
    records = games.select(
        F.col("conv_id"), snapshot.alias("shown"), "split", F.lit("blitz").alias("game_type"), source.alias("source_id"), F.when(F.col("conv_id") % 7 == 0, "0").otherwise(F.sha2("file", 256)).alias("sha256"),
        (F.col("plies") + F.when(F.col("conv_id") % 5 == 0, 1).otherwise(0)).alias("plies"), "canonical",
    )
    files = games.where("conv_id % 17 <> 0").select("conv_id", F.col("file").alias("text"), "plies", "canonical").unionByName(spark.range(1).selectExpr("-1L AS conv_id", "'N+black\nN-white\n' AS text", "1L AS plies", "'x' AS canonical"))
    counts = records.groupBy("split", "game_type").agg(F.count("*").alias("n"))
    expected = counts.withColumn("n", F.col("n") + (F.col("split") == "final").cast("long")).unionByName(spark.range(1).selectExpr("'final' AS split", "'rapid' AS game_type", "1L AS n"))
    return D.snapshot_faults(records.withColumnRenamed("shown", "snapshot_id"), files, expected, key=("conv_id", "conv_id"))


@query("fn14_valid_sentences", "SELECT p_partkey, p_partkey % 5 = 0 AS valid FROM part")
def _(spark, sf_dir):
    """Of five parts one is a valid position; the others have ten squares, two black kings, too many pawns, and a piece named twice in the hands."""
    board = F.expr("CASE p_partkey % 5 WHEN 1 THEN '4k5/9/9/9/9/9/9/9/4K4 b - 1' WHEN 2 THEN '4k4/9/9/9/9/9/9/9/3KK4 b - 1' WHEN 3 THEN '4k4/9/9/9/+P8/9/9/9/4K4 b 12P6p 1' WHEN 4 THEN '4k4/9/9/9/9/9/9/9/4K4 b 2PP 1' ELSE concat('4k4/9/9/9/', 1 + p_size % 7, '+P', 7 - p_size % 7, '/9/9/9/4K4 w ', 1 + p_size % 17, 'p ', p_partkey + 1) END")
    return table(spark, sf_dir, "part").select("p_partkey", B.sentence_valid(board).alias("valid"))


#: A pawn of the first side on the fifth rank, kings, h pawns in the first side's hand.
_SENTENCE = "concat('4k4/9/9/9/', if(x > 0, string(x), ''), 'P', if(x < 8, string(8 - x), ''), '/9/9/9/4K4 ', if(p_partkey % 2 = 0, 'b', 'w'), ' ', CASE h WHEN 0 THEN '-' WHEN 1 THEN 'P' ELSE concat(h, 'P') END, ' 1')"
_BOARDS = "(SELECT p_partkey, p_size % 9 AS x, p_size % 5 AS h FROM part)"


def _positions(spark, sf_dir):
    """A sentence for each part."""
    rows = spread(table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size % 9 AS x", "p_size % 5 AS h"))
    return rows.selectExpr("p_partkey", f"{_SENTENCE} AS s")


@query(
    "fn15_active_features",
    f"""SELECT p_partkey, array_to_string(list_sort(list_concat([36 * 28 + 15, 44 * 28 + 14, (x * 9 + 4) * 28], list_transform(range(0, h), lambda c: 2268 + c))), ',') AS first,
      array_to_string(list_sort(list_concat([36 * 28 + 14, 44 * 28 + 15, (x * 9 + 4) * 28 + 1], list_transform(range(0, h), lambda c: 2268 + 38 + c))), ',') AS second FROM {_BOARDS}""",
)
def _(spark, sf_dir):
    rows = _positions(spark, sf_dir)
    return rows.select("p_partkey", *[F.array_join(B.active_features(F.col("s"), k), ",").alias(name) for k, name in enumerate(("first", "second"))])


@query(
    "fn26_turned_boards",
    f"""SELECT p_partkey, '4k4/9/9/9/' || CASE WHEN x < 8 THEN CAST(8 - x AS VARCHAR) ELSE '' END || 'p' || CASE WHEN x > 0 THEN CAST(x AS VARCHAR) ELSE '' END || '/9/9/9/4K4 ' || CASE WHEN p_partkey % 2 = 0 THEN 'w ' ELSE 'b ' END
      || CASE h WHEN 0 THEN '-' WHEN 1 THEN 'p' ELSE h || 'p' END || ' 1' AS turned FROM {_BOARDS}""",
)
def _(spark, sf_dir):
    """Each position seen from the other side."""
    rows = _positions(spark, sf_dir)
    return rows.select("p_partkey", B.turned(F.col("s")).alias("turned"))


@query("fn16_material_with_hands", f"SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN 100 * (1 + h) ELSE -100 * (1 + h) END AS BIGINT) AS material FROM {_BOARDS}")
def _(spark, sf_dir):
    rows = _positions(spark, sf_dir)
    return rows.select("p_partkey", B.material(F.col("s")).alias("material"))


#: Weights by rule, in quarters and eighths, so that sums are exact in 32 bits: features, units, hidden units.
_FEATURES, _UNITS, _WIDTH = 2344, 4, 3
_FT, _L2 = "({f} * 7 + {c} * 13) % 401 - 150", "(({r} * 5 + {h} * 3) % 9 - 4) / 4.0"


def _network() -> Network:
    f, c, r, h = np.arange(_FEATURES)[:, None], np.arange(_UNITS), np.arange(2 * _UNITS)[:, None], np.arange(_WIDTH)
    return Network((f * 7 + c * 13) % 401 - 150, 20 * c - 30, ((r * 5 + h * 3) % 9 - 4) / 4.0, h - 0.5, (h + 1) / 8.0, 16.0)


@query(
    "fn27_sparse_network",
    f"""WITH b AS (SELECT p_partkey, p_partkey % 2 AS side, x, h FROM {_BOARDS}),
    f AS (
      SELECT p_partkey, side AS seat, unnest(list_concat([36 * 28 + 15, 44 * 28 + 14, (x * 9 + 4) * 28], list_transform(range(0, h), lambda c: 2268 + c))) AS f FROM b
      UNION ALL SELECT p_partkey, 1 - side, unnest(list_concat([36 * 28 + 14, 44 * 28 + 15, (x * 9 + 4) * 28 + 1], list_transform(range(0, h), lambda c: 2268 + 38 + c))) FROM b),
    a AS (SELECT p_partkey, seat, c, greatest(0, least(8128, sum({_FT.format(f="f", c="c")}) + 20 * c - 30)) / 64.0::DOUBLE AS v FROM f, range(0, {_UNITS}) u(c) GROUP BY p_partkey, seat, c),
    l AS (SELECT p_partkey, h, greatest(0, least(127, sum(v * ({_L2.format(r=f"(seat * {_UNITS} + c)", h="h")})) + h - 0.5)) AS v FROM a, range(0, {_WIDTH}) w(h) GROUP BY p_partkey, h)
    SELECT p_partkey, CAST((sum(v * (h + 1) / 8.0) + 16) / 64.0 AS FLOAT) AS output, CAST(trunc((sum(v * (h + 1) / 8.0) + 16) / 64.0) AS BIGINT) AS score FROM l GROUP BY 1""",
)
def _(spark, sf_dir):
    """Sentences become active features of both sides, and these an evaluation for the side to move."""
    rows = _positions(spark, sf_dir)
    sides = rows.select("p_partkey", *[B.active_features(F.col("s"), k).alias(f"side{k}") for k in (0, 1)])
    black = F.col("p_partkey") % 2 == 0
    seats = sides.select("p_partkey", F.when(black, F.col("side0")).otherwise(F.col("side1")).alias("own"), F.when(black, F.col("side1")).otherwise(F.col("side0")).alias("other"))
    return forward_sparse(seats, "p_partkey", "own", "other", _network())


_SIZE, _HIDDEN = 16, 4
_W1 = [[((7 * i + 3 * j) % 5 - 2) / 2 for i in range(_SIZE)] for j in range(_HIDDEN)]
_W2 = [(j % 3) - 1.5 for j in range(_HIDDEN)]
_UNIT = "greatest(0, least(2, list_inner_product(CAST(embedding AS DOUBLE[])[1:16], {w}::DOUBLE[]) + 0.25))"


@query("fn27_forward_pass", "SELECT vec_id, round(" + " + ".join(f"{_W2[j]} * {_UNIT.format(w=_W1[j])}" for j in range(_HIDDEN)) + " + 0.5, 4) AS output FROM embeddings")
def _(spark, sf_dir):
    """The first 16 numbers of each vector through a clipped layer of four units and an output."""
    return E.forward(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _W1, [0.25] * _HIDDEN, _W2, 0.5, 2.0).select("vec_id", F.round("output", 4).alias("output"))


@query(
    "num01_paired_design",
    "SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE (q - k) % 2 <> 0) AS n_odd, CAST(sum((q - k) // 2) FILTER (WHERE (q - k) % 2 = 0) AS BIGINT) AS z_sum, CAST(sum(t - q * 30) FILTER (WHERE (q - k) % 2 = 0) AS BIGINT) AS d_sum FROM (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS q, l_linenumber::BIGINT AS k, CAST(floor(l_extendedprice) AS BIGINT) % 2000 AS t FROM lineitem) GROUP BY 1",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag", "CAST(l_quantity AS BIGINT) AS us", "CAST(l_linenumber AS BIGINT) AS them", "CAST(floor(l_extendedprice) AS BIGINT) % 2000 AS teacher", "CAST(l_quantity AS BIGINT) * 30 AS material")
    design = E.paired_design(rows, ["us"], ["them"], "teacher", "material")
    return design.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("n_odd"), F.sum("z0").alias("z_sum"), F.sum("d").alias("d_sum"))


@query("flt06_bots", "SELECT c_custkey, c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0 AS bot FROM customer")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat(if(c_custkey % 3 = 0, ':', ''), c_custkey) AS id", "concat(if(c_custkey % 5 = 0, ':', ''), c_name) AS name", "if(c_custkey % 7 = 0, 'BoT_x', if(c_custkey % 2 = 0, NULL, 'robot_')) AS avatar")
    return rows.select("c_custkey", R.looks_like_bot(F.col("id"), F.col("name"), F.col("avatar")).alias("bot"))


@query("flt10_top3_eligible", "SELECT l_orderkey, count(*) AS n_moves FROM lineitem GROUP BY 1 HAVING count(*) >= 4 AND bool_and(l_returnflag <> 'R')")
def _(spark, sf_dir):
    """Orders are positions, lines legal moves; a returned line makes the position special."""
    positions = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey")).agg(F.count("*").alias("n_moves"), F.when(F.bool_or(F.col("l_returnflag") == "R"), "special").otherwise("normal").alias("position_type"))
    return positions.where((F.col("position_type") == "normal") & (F.col("n_moves") >= 4)).select("l_orderkey", "n_moves")


@query("flt13_game_filters", "SELECT conv_id, turn FROM conversations WHERE conv_id % 4 <> 0 AND turn >= 2 AND turn % 2 = 0 AND role <> 'system'")
def _(spark, sf_dir):
    """Both ratings at least 1; from turn 2 every second one; not in check or a capture, which a system turn stands for."""
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", "conv_id % 4 AS black", "if(conv_id % 4 = 0, NULL, 2) AS white")
    rated = R.rated(rows, ["black", "white"], 1)
    return R.sampled_plies(rated, "turn", 2, 2, F.col("role") == "system").select("conv_id", "turn")


@query("flt15_labelled_only", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("flt17_compact_metadata", """SELECT c_custkey, '{"id":"' || c_custkey || '","players":[{"id":"a' || c_custkey || '"' || CASE WHEN c_nationkey % 2 = 0 THEN ',"name":"' || c_name || '"' ELSE '' END || '}]}' AS compact FROM customer""")
def _(spark, sf_dir):
    game = F.struct(F.col("c_custkey").cast("string").alias("id"), F.array(F.struct(F.concat(F.lit("a"), "c_custkey").alias("id"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_name")).alias("name"), F.lit("secret").alias("email"))).alias("players"), F.lit("x").alias("token"))
    return table(spark, sf_dir, "customer").select("c_custkey", R.compact(game, ["id"], "players", ["id", "name"]).alias("compact"))


@query("flt18_same_execution", "SELECT c_custkey, c_custkey % 3 <> 0 AS same FROM customer")
def _(spark, sf_dir):
    """Options of two runs, of which only the model's file and output may differ."""
    options = lambda file, hash_: F.create_map(F.lit("EvalFile"), F.lit(file), F.lit("Hash"), hash_, F.lit("Threads"), F.lit("1"))
    a, b = options("a.bin", F.lit("16")), options("b.bin", F.when(F.col("c_custkey") % 3 == 0, "32").otherwise("16"))
    return table(spark, sf_dir, "customer").select("c_custkey", R.same_but(a, b, ["EvalFile", "NnueOutput"]).alias("same"))


@query("set03_exact_union", "SELECT DISTINCT o_custkey AS key, o_custkey * 2 AS value FROM orders UNION SELECT c_custkey, c_custkey * 2 FROM customer")
def _(spark, sf_dir):
    left = table(spark, sf_dir, "orders").selectExpr("o_custkey AS key", "o_custkey * 2 AS value")
    return R.union_exact(left, table(spark, sf_dir, "customer").selectExpr("c_custkey AS key", "c_custkey * 2 AS value"), "key", "value")


#: Two texts of one customer: nested, with the differences that the key's remainders bring. In Spark's and DuckDB's SQL alike.
_LEFT = """concat('{"id":', c_custkey, ',"name":"', c_name, '","tags":[1,2,{"seg":"', c_mktsegment, '","deep":[[', c_nationkey, '],{}]}],"rate":1.50,"open":true,"none":null}')"""
_RIGHT = """concat('{"open":', CASE WHEN c_custkey % 5 = 1 THEN '1' ELSE 'true' END, ',"rate":', CASE WHEN c_custkey % 7 = 2 THEN '1.25' ELSE '1.5' END, ',"id":', c_custkey, CASE WHEN c_custkey % 3 = 1 THEN '.0' ELSE '' END,
    ',"name":"', c_name, '","tags":[', CASE WHEN c_custkey % 4 = 3 THEN '2,1' ELSE '1,2' END, ',{"deep":[[', c_nationkey, CASE WHEN c_custkey % 6 = 5 THEN ',7' ELSE '' END, '],{}],"seg":"', CASE WHEN c_custkey % 8 = 4 THEN 'X' ELSE c_mktsegment END, '"}]', CASE WHEN c_custkey % 9 = 8 THEN '' ELSE ',"none":null' END, '}')"""
_FLAT = """(SELECT c_custkey, replace(regexp_replace(replace(t.fullkey, '$', ''), '[.\\[]', '/', 'g'), ']', '') AS path,
      CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'double' ELSE 'integer' END AS kind,
      CASE WHEN t.type = 'VARCHAR' THEN t.atom ->> '$' WHEN t.type = 'DOUBLE' THEN CAST(CAST(t.atom AS DOUBLE) AS VARCHAR) WHEN t.type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN CAST(t.atom AS VARCHAR) END AS value FROM customer, json_tree(CAST({} AS JSON)) t)""".replace("\\\\", "\\")
_DIFFERENCES = f"""SELECT c_custkey, path, CASE WHEN a.kind IS NULL THEN 'added' WHEN b.kind IS NULL THEN 'removed' WHEN a.kind <> b.kind THEN 'retyped' ELSE 'changed' END AS change,
      a.kind AS left_kind, a.value AS left_value, b.kind AS right_kind, b.value AS right_value
    FROM {_FLAT.format(_LEFT)} a FULL JOIN {_FLAT.format(_RIGHT)} b USING (c_custkey, path) WHERE a.kind IS DISTINCT FROM b.kind OR a.value IS DISTINCT FROM b.value"""


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(_LEFT).alias("a"), F.expr(_RIGHT).alias("b"))


@query("dq14_structural_differences", f"SELECT * FROM ({_DIFFERENCES}) WHERE NOT (path = '/rate' AND change = 'changed' OR regexp_matches(path, '^/tags/[0-9]+$') AND change = 'changed')")
def _(spark, sf_dir):
    """Added, removed, retyped and changed paths of nested records; another rate and another number among the tags are allowed. The SQL reads the JSON texts."""
    allowed = spark.createDataFrame([("/rate", "changed"), ("/tags/*", "changed")], "shape string, change string")
    return N.differences(_texts(spark, sf_dir), "c_custkey", "a", "b", allowed)


@query("dq20_strict_equality", f"SELECT c_custkey, c_custkey NOT IN (SELECT c_custkey FROM ({_DIFFERENCES})) AS equal FROM customer")
def _(spark, sf_dir):
    return N.strictly_equal(_texts(spark, sf_dir), "c_custkey", "a", "b")


@query("agg03_exact_equal_group_mean", "WITH g AS (SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS HUGEINT) AS s, count(*)::HUGEINT AS n FROM lineitem GROUP BY 1), p AS (SELECT product(n)::HUGEINT AS den, count(*) AS k FROM g) SELECT CAST(sum(s * (den // n)) AS VARCHAR) AS numerator, CAST(any_value(den * k) AS VARCHAR) AS denominator FROM g, p")
def _(spark, sf_dir):
    groups = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("total"), F.count("*").alias("n"))
    return E.exact_mean_of_means(groups, "total", "n")


@query(
    "agg16_merged_accumulators",
    """WITH q AS (SELECT CAST(l_quantity AS BIGINT) AS v FROM lineitem), c AS (SELECT b, count(*) FILTER (WHERE least(v // 5, 9) = b) AS n FROM q, range(0, 10) t(b) GROUP BY b)
    SELECT count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * v) AS BIGINT) AS squares, min(v) AS least, max(v) AS most, (SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY b) FROM c) AS buckets FROM q""",
)
def _(spark, sf_dir):
    """Accumulators of each supplier's lines, merged: the same as over all lines."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("v"))
    merged = E.merged(E.accumulated(rows, ["l_suppkey"], "v", F.least(F.floor(F.col("v") / 5), F.lit(9)).cast("int"), 10), 10)
    return merged.select("n", "total", "squares", "least", "most", F.array_join("buckets", ",").alias("buckets"))


@query("agg22_disposition_counts", "SELECT o_orderstatus AS state, coalesce(o_orderpriority, 'none') AS reason, count(*) AS n FROM orders GROUP BY 1, 2")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("state"), F.coalesce("o_orderpriority", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "agg35_training_diagnostics",
    "SELECT l_returnflag, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS spread, round(avg(CASE WHEN v = 0 THEN 1 ELSE 0 END), 6) AS dead, round(avg(CASE WHEN v >= 0.1 THEN 1 ELSE 0 END), 6) AS saturated, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(corr(v, l_tax), 6) AS pearson FROM (SELECT *, l_discount AS v FROM lineitem) GROUP BY 1",
)
def _(spark, sf_dir):
    return E.diagnostics(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_discount", "l_tax", 0.1)


@query("dq09_bucket_equality", "WITH c AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), e AS (SELECT c_mktsegment, n + CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS n FROM c) (SELECT * FROM c EXCEPT ALL SELECT * FROM e) UNION ALL (SELECT * FROM e EXCEPT ALL SELECT * FROM c)")
def _(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    expected = counts.withColumn("n", F.col("n") + (F.col("c_mktsegment") == "BUILDING").cast("long"))
    return R.bag_difference(counts, expected)


@query(
    "flt09_four_exclusions",
    f"""WITH d AS (SELECT doc_id, source, {key_sql('text')} AS key FROM documents)
    SELECT CASE WHEN source IN (SELECT source FROM documents WHERE lang = 'fr' AND doc_id % 50 = 0) THEN 'frozen_game' WHEN source IN (SELECT source FROM documents WHERE lang = 'es' AND doc_id % 50 = 1) THEN 'reserved_game'
      WHEN key IN (SELECT {key_sql('text')} FROM documents WHERE doc_id % 10 = 3) THEN 'frozen_board' WHEN key IN (SELECT {key_sql('text')} FROM documents WHERE doc_id % 10 = 7) THEN 'reserved_board' ELSE 'kept' END AS reason, count(*) AS n FROM d GROUP BY 1""",
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", position_key(F.col("text")).alias("key"))
    sets = {
        "frozen_game": (docs.where("lang = 'fr' AND doc_id % 50 = 0"), "source"), "reserved_game": (docs.where("lang = 'es' AND doc_id % 50 = 1"), "source"),
        "frozen_board": (docs.where("doc_id % 10 = 3"), "key"), "reserved_board": (docs.where("doc_id % 10 = 7"), "key"),
    }
    return R.ordered_exclusion(docs, sets, "kept").groupBy("reason").agg(F.count("*").alias("n"))
