"""Datasets on files: positions and labels by split, the manifest of their files, checks of a whole dataset, and public exports.

A dataset is a folder of JSON lines, positions/split=.../ and labels/split=.../, and a manifest with each file's bytes and
SHA-256. Writing and hashing are Spark jobs; a file holds at most FILE_ROWS rows, which bounds what is hashed at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.scalar import forbidden, hash_split, position_key
from granary.sources.records import inventory, strict_json

FILE_ROWS = 500_000
POSITIONS = "game_id string, ply int, schema_version int, sfen string, split string"
LABELS = "label_depth int, score_cp bigint, sfen string, split string, teacher string"
GAMES = "game_id string, game_index int, pack string, split string"


def write_json_lines(rows: DataFrame, path: str, *by: str) -> None:
    """JSON lines with keys in sorted order, nulls kept, one folder for each value of `by` (SNK-02)."""
    rows.select(*sorted(rows.columns)).write.option("ignoreNullFields", "false").option("maxRecordsPerFile", FILE_ROWS).partitionBy(*by).json(path)


def inventory_digest(files: DataFrame) -> DataFrame:
    """One row (n_files, bytes, digest) of the files' names, sizes and hashes, whatever their order (AGG-34).

    The digest is a tree by the first hex digits of the names' SHA-256: each of up to 65,536 leaves digests its sorted lines,
    each of up to 256 nodes its sorted leaves, and the root its nodes. So no group gathers more than a 65,536th part of the files.
    """
    total = {"n": F.coalesce(F.sum("n"), F.lit(0)).cast("long"), "bytes": F.coalesce(F.sum("bytes"), F.lit(0))}
    rows = files.select(F.substring(F.sha2("name", 256), 1, 4).alias("at"), F.lit(1).alias("n"), "bytes", F.concat_ws(" ", "name", "bytes", "sha256").alias("line"))

    def digested(by: list[str]) -> DataFrame:
        lines = F.array_join(F.array_sort(F.collect_list("line")), "\n")
        return rows.groupBy(*by).agg(*[c.alias(k) for k, c in total.items()], F.sha2(lines, 256).alias("digest"))

    for digits in (4, 2):
        rows = digested(["at"]).select(F.substring("at", 1, digits - 2).alias("at"), "n", "bytes", F.concat_ws(" ", "at", "digest").alias("line"))
    return digested([]).select(F.col("n").alias("n_files"), "bytes", "digest")


def write_dataset(positions: DataFrame, labels: DataFrame, games: DataFrame, path: str) -> DataFrame:
    """Write a dataset and its manifest of files; returns the manifest as read back (SNK-04)."""
    spark = positions.sparkSession
    for name, rows in (("positions", positions), ("labels", labels)):
        write_json_lines(rows, f"{path}/data/{name}", "split")
    write_json_lines(games.withColumn("part", F.lit(0)), f"{path}/data/games", "part")
    inventory(spark, f"{path}/data").write.json(f"{path}/manifest")
    return spark.read.schema("name string, bytes long, sha256 string").json(f"{path}/manifest")


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(positions, labels, games) of a dataset whose files are as its manifest says; else an error that names a file (SRC-08, SRC-03)."""
    manifest = spark.read.schema("name string, bytes long, sha256 string").json(f"{path}/manifest").withColumnsRenamed({"bytes": "m_bytes", "sha256": "m_sha"})
    both = manifest.join(inventory(spark, f"{path}/data"), "name", "full")
    wrong = both.where(~(F.col("bytes").eqNullSafe(F.col("m_bytes")) & F.col("sha256").eqNullSafe(F.col("m_sha")))).select("name").limit(1).collect()
    if wrong:
        raise ValueError(f"dataset content differs from its manifest: {wrong[0].name}")
    return tuple(spark.read.schema(s).json(f"{path}/data/{n}", mode="FAILFAST") for n, s in (("positions", POSITIONS), ("labels", LABELS), ("games", GAMES)))


def _counted(name: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.lit(name).alias("check"), F.count("*").alias("n_violations"))


def _repeats(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).count().where("count > 1")


def dataset_faults(positions: DataFrame, labels: DataFrame, games: DataFrame, seed: str, teacher: str, cap: int) -> DataFrame:
    """(check, n_violations) of a whole dataset (SRC-08, JON-15).

    Positions: sentences and keys are unique in a split, the game is known, the schema version is 1. Labels: one for each
    position of the split and none else, scores strictly under 30,000, depth 0, the teacher's name. Games: unique ids and
    places, an index under cap, and the split that follows from the id. All counts are aggregates; nothing is gathered.
    """
    keyed = positions.withColumn("key", position_key(F.col("sfen")))
    owners = games.select(F.col("game_id").alias("known")).distinct()
    on = ["split", "sfen"]
    bad_label = ~((F.abs("score_cp") < 30000) & (F.col("label_depth") == 0) & (F.col("teacher") == teacher))
    bad_game = ~((F.col("game_index") >= 0) & (F.col("game_index") < cap) & (F.col("split") == hash_split(seed, F.col("game_id"))))
    checks = {
        "repeated_sentence": _repeats(positions, "split", "sfen"),
        "repeated_key": _repeats(keyed, "split", "key"),
        "unknown_game": positions.join(owners, F.col("game_id") == F.col("known"), "left_anti"),
        "schema_version": positions.where(~F.coalesce(F.col("schema_version") == 1, F.lit(False))),
        "repeated_label": _repeats(labels, "split", "sfen"),
        "invalid_label": labels.where(F.coalesce(bad_label, F.lit(True))),
        "position_without_label": positions.select(*on).distinct().join(labels.select(*on), on, "left_anti"),
        "label_without_position": labels.select(*on).distinct().join(positions.select(*on), on, "left_anti"),
        "repeated_game": _repeats(games, "game_id"),
        "repeated_place": _repeats(games, "pack", "game_index"),
        "invalid_game": games.where(F.coalesce(bad_game, F.lit(True))),
    }
    found = None
    for name, rows in checks.items():
        one = _counted(name, rows)
        found = one if found is None else found.unionByName(one)
    return found


def split_rows(positions: DataFrame, labels: DataFrame, split: str, order: list[str]) -> DataFrame:
    """(sfen, score_cp) of one split in the order of its positions: the labels' own order does not matter (SRC-09, JON-01)."""
    scores = labels.where(F.col("split") == split).select("sfen", "score_cp")
    return positions.where(F.col("split") == split).join(scores, "sfen").orderBy(*order).select(*order, "sfen", "score_cp")


def labels_for(labels: DataFrame, depth: int, teacher: str) -> DataFrame:
    """(sfen, score_cp) of cached labels of one depth and teacher; mate scores are dropped, others cut to 2,000 (SRC-21)."""
    own = labels.where((F.col("label_depth") == depth) & (F.col("teacher") == teacher) & (F.abs("score_cp") < 30000))
    return own.select("sfen", F.greatest(F.least("score_cp", F.lit(2000)), F.lit(-2000)).alias("score_cp"))


def train_view(labels: DataFrame, material: Column, identity: str) -> DataFrame:
    """Labels with the train split's scores replaced by the blend with material, half to even, under a new teacher's name; all else as it was (NUM-06)."""
    from granary.functions.scalar import blend_half_even

    train = F.col("split") == "train"
    return labels.withColumns({"score_cp": F.when(train, blend_half_even(F.col("score_cp"), material)).otherwise(F.col("score_cp")), "teacher": F.when(train, identity).otherwise(F.col("teacher"))})


def embedded_list(html: Column) -> Column:
    """The strings of the list that a page's script assigns to `.attrs`; null if there is none or it holds anything else (SRC-11)."""
    text = F.nullif(F.regexp_extract(html, r"\.attrs=(\[[^;]*\]);", 1), F.lit(""))
    kinds = F.schema_of_variant(F.try_parse_json(text))
    return F.when(kinds.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.from_json(text, "array<string>"))


def history(payload: Column) -> Column:
    """The games of a history payload {"games": [{id, created, length}]}, null if it isn't one (SRC-10)."""
    return strict_json(payload, "struct<games: array<struct<id: string, created: string, length: bigint>>>")["games"]


def game_files(spark: SparkSession, path: str, pattern: str = "*.csa") -> DataFrame:
    """(path, text) of all files of a pattern in a folder and those below it (SRC-19)."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def snapshot_faults(records: DataFrame, files: DataFrame, buckets: DataFrame, key: tuple[str, str] = ("snapshot_id", "snapshot_id")) -> DataFrame:
    """(check, n_violations) of a frozen selection (DQ-18, DQ-09).

    records (snapshot_id, split, game_type, source_id, sha256, plies, canonical) against files (text, plies, canonical), joined
    by the columns of key: ids have their split's form, source ids 24 hexadecimal digits, contents, plies and canonical hashes agree,
    names are replaced, canonical hashes and source ids are unique, files are those of the records, and buckets (split,
    game_type, n) have the numbers that are expected.
    """
    found = files.select(F.col(key[1]).alias("file"), "text", F.sha2("text", 256).alias("f_sha"), F.col("plies").alias("f_plies"), F.col("canonical").alias("f_canonical"))
    both = records.join(found, F.col(key[0]) == F.col("file"), "left")
    on = both.where(F.col("f_sha").isNotNull())
    actual = records.groupBy("split", "game_type").agg(F.count("*").alias("n"))
    checks = {
        "id": records.where(~F.coalesce(F.col("snapshot_id").rlike("^(development|final)-[0-9]{2}$") & F.col("snapshot_id").startswith(F.col("split")), F.lit(False))),
        "source_id": records.where(~F.coalesce(F.col("source_id").rlike("^[0-9a-f]{24}$"), F.lit(False))),
        "content": on.where(F.col("f_sha") != F.col("sha256")),
        "names": on.where(~F.col("text").contains("N+black\nN-white\n") | F.col("text").contains("(")),
        "plies": on.where(~F.col("plies").eqNullSafe(F.col("f_plies"))),
        "canonical": on.where(~F.col("canonical").eqNullSafe(F.col("f_canonical"))),
        "repeated_game": _repeats(records, "canonical"),
        "repeated_source": _repeats(records, "source_id"),
        "missing_file": both.where(F.col("f_sha").isNull()),
        "extra_file": found.join(records, F.col(key[0]) == F.col("file"), "left_anti"),
        "buckets": actual.exceptAll(buckets.select("split", "game_type", "n")).unionByName(buckets.select("split", "game_type", "n").exceptAll(actual)),
    }
    out = None
    for name, rows in checks.items():
        one = _counted(name, rows)
        out = one if out is None else out.unionByName(one)
    return out


def export_public(rows: DataFrame, allowed: list[str], path: str) -> DataFrame:
    """Write the allowed columns as JSON lines with a manifest; refuse a folder that is there, or any text that must not go out (SNK-08, SNK-11, FLT-16)."""
    spark, public = rows.sparkSession, rows.select(*allowed)
    leaks = public.where(forbidden(F.concat_ws(" ", *[F.col(c).cast("string") for c in allowed]))).limit(1).collect()
    if leaks:
        raise ValueError("a row holds a path, a private address or a long hexadecimal id")
    public.select(*sorted(allowed)).write.mode("error").option("maxRecordsPerFile", FILE_ROWS).json(f"{path}/data")
    inventory(spark, f"{path}/data").write.mode("error").json(f"{path}/manifest")
    return spark.read.schema("name string, bytes long, sha256 string").json(f"{path}/manifest")
