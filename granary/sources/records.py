"""Reading strict records: JSON lines with a fixed schema, game texts, manifests, file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The standard board of the game notation.
BOARD = [
    "P1-KY-KE-GI-KI-OU-KI-GI-KE-KY", "P2 * -HI *  *  *  *  * -KA * ", "P3-FU-FU-FU-FU-FU-FU-FU-FU-FU", "P4 *  *  *  *  *  *  *  *  * ", "P5 *  *  *  *  *  *  *  *  * ",
    "P6 *  *  *  *  *  *  *  *  * ", "P7+FU+FU+FU+FU+FU+FU+FU+FU+FU", "P8 * +KA *  *  *  *  * +HI * ", "P9+KY+KE+GI+KI+OU+KI+GI+KE+KY",
]


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a fixed schema; a value of another type is an error (SRC-06)."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def catalogue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with (corrupt string) set for lines that don't parse (SRC-20)."""
    return spark.read.schema(f"{schema}, corrupt string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="corrupt")


def strict_json(text: Column, schema: str) -> Column:
    """A struct from a JSON text; duplicate keys and malformed texts give null (SRC-07)."""
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, content) of all data files in a folder and below it, names relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", path.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return files.select(name.alias("name"), F.col("length").alias("bytes"), "content").where(~F.col("name").startswith("_"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of all data files in a folder and below it, names relative to it (AGG-34)."""
    return binary_files(spark, path).select("name", "bytes", F.sha2("content", 256).alias("sha256"))


def verified_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(name, bytes, sha256, verdict) of manifest rows against the files at path: ok, missing, extra or changed (SRC-03)."""
    files = inventory(spark, path).withColumnsRenamed({"bytes": "found_bytes", "sha256": "found_sha"})
    both = manifest.join(files, "name", "full")
    verdict = F.when(F.col("found_sha").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when((F.col("found_sha") == F.col("sha256")) & (F.col("found_bytes") == F.col("bytes")), "ok").otherwise("changed")
    return both.select("name", F.coalesce("found_bytes", "bytes").alias("bytes"), F.coalesce("found_sha", "sha256").alias("sha256"), verdict.alias("verdict"))


def games(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, moves, plies, canonical_sha256, valid) of game texts: two names, the standard board, a turn line `+`, moves (SRC-04, WIN-08).

    The board is `PI`, once, or its nine lines. A move is a sign, four digits and two capitals; the sides alternate from +. A
    text isn't valid without exactly one name a side, with another board or turn line, a malformed move, no move, or a NUL.
    Other lines count for nothing. The canonical text is the board's lines, the turn line and the moves, each with a line
    feed. Null texts aren't valid and have no moves.
    """
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\r\n|\r|\n"), lambda x: x != "")
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lines.alias("lines"))
    like = lambda pattern: F.filter("lines", lambda x: x.rlike(pattern))
    rows = rows.select("id", "text", "lines", like(r"^[+-][0-9]{4}[A-Z]{2}$").alias("moves"), like("^[+-][0-9]").alias("like_moves"), like("^P[1-9]").alias("board"), like("^N[+-]").alias("names"), like("^[+-]$").alias("turns"))
    compact = F.size(F.filter("lines", lambda x: x == "PI"))
    board = F.when(F.size("board") == 0, compact == 1).otherwise((F.col("board") == F.lit(BOARD)) & (compact == 0))
    names = (F.size("names") == 2) & F.get("names", F.lit(0)).startswith("N+") & F.get("names", F.lit(1)).startswith("N-")
    alternate = F.forall(F.transform("moves", lambda x, i: F.substring(x, 1, 1) == F.when(i % 2 == 0, "+").otherwise("-")), lambda ok: ok)
    valid = board & names & (F.col("turns") == F.array(F.lit("+"))) & (F.size("moves") > 0) & (F.size("moves") == F.size("like_moves")) & alternate & ~F.contains("text", F.lit("\x00"))
    canonical = F.concat(F.array_join(F.concat(F.lit(BOARD), F.array(F.lit("+")), "moves"), "\n"), F.lit("\n"))
    return rows.select("id", "moves", F.size("moves").alias("plies"), F.sha2(canonical, 256).alias("canonical_sha256"), F.coalesce(valid, F.lit(False)).alias("valid"))


def listing(texts: DataFrame, text_col: str, prefix: str, suffix: str) -> DataFrame:
    """Members of archive listings (blocks of `key = value` lines, blank lines between), safe paths only (SRC-13, SRC-14)."""
    blocks = texts.select(F.explode(F.split(F.col(text_col), r"\n\s*\n")).alias("block")).where(F.col("block").contains(" = "))
    fields = blocks.select(F.str_to_map(F.trim("block"), F.lit("\n"), F.lit(" = ")).alias("m")).select(F.col("m")["Path"].alias("path"), F.col("m")["Size"].try_cast("long").alias("size"))
    safe = ~F.col("path").rlike(r"(^|/)\.\.(/|$)|^/|\\")
    return fields.where(F.col("path").startswith(prefix) & F.col("path").endswith(suffix) & safe)
