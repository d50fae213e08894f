"""Operator 3, exact dedup by deterministic block naming. DataFrame functions only.

A text (white space normalised) is cut into blocks of a fixed number of characters. Equal blocks get one integer name:
blocks are dealt by value and sorted, and a block's name is the place of its first row. Then, level by level, adjacent
pairs of names are named in the same way until each document has one name. Two documents with equally many blocks have
the same name if and only if their texts are equal; no hash decides equality.

Rows are told apart by a row number that is written once, so null and repeated ids do no harm. Skew: blocks or pairs with
more than hot_limit() rows (found by counting, combined before the shuffle) are named once for each distinct value and joined
by broadcast, at most HOT_BLOCKS of them; the rest are sorted, and no value has more rows than that limit. Every level is
written to the shared folder; what no later step reads is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, cut, discard, drop_rows, hot_limit, join_hot, number_rows

#: Stands for the missing right half of a pair.
NONE = -1
#: Hot blocks at most, of about 1 KB each: they are broadcast.
HOT_BLOCKS = 20_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 1024, carried: str | None = None) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256, n_blocks, class_name.

    Null text is the empty text. Of equal texts the smallest id stays; null ids come last. Of repeated rows (same id,
    same text) exactly one is kept; rows that repeat an id with another text are rows of their own. A very long text has
    more blocks, hence more levels; a row of the blocks table holds one block. An empty table gives an empty result. Other
    columns are not read, but for the column `carried`, if given, which comes last in the result as it is. The result reads
    two tables of ids, names and digests, dedup-rows and dedup-classes; all others are deleted on the way.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE, " ")
    more = ["more"] if carried else []
    texts = docs.select(F.col(id_col).alias("id"), norm.alias("norm"), F.monotonically_increasing_id().alias("row"), *[F.col(carried).alias(c) for c in more])
    blocks = F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    meta = cut(
        texts.select("id", "row", *more, F.sha2("norm", 256).alias("text_sha256"), blocks.alias("blocks")).withColumn("hashes", F.transform("blocks", lambda b: F.xxhash64(b))),
        "dedup-meta",
    )
    largest, total = meta.agg(F.max(F.size("hashes")), F.sum(F.size("hashes"))).first()
    done = [meta.where(F.size("hashes") == 0).select("row", F.lit(0).alias("n_blocks"), F.lit(0).cast("long").alias("name"))]
    levels = []
    if largest:
        first_names, used = _first_names(meta, total)
        level = cut(first_names, "dedup-names")
        discard(*used)
        while True:
            levels.append(level)
            done.append(level.where("n = 1").select("row", "n_blocks", "name"))
            largest = (largest + 1) // 2 if largest > 1 else 0
            if not largest:
                break
            level = _next_names(level.where("n > 1"))
    names = done[0]
    for x in done[1:]:
        names = names.unionByName(x)
    rows = cut(meta.select("id", "text_sha256", "row", *more).join(names.hint("merge"), "row"), "dedup-rows")
    discard(meta, *levels)
    first = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    classes = cut(
        rows.groupBy("n_blocks", "name").agg(F.min(first).alias("first"), F.count("*").alias("group_size")).select(
            "n_blocks", "name", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size", F.col("group_size").alias("times")
        ),
        "dedup-classes",
    )
    return join_hot(rows, classes, ["n_blocks", "name"], "times", "inner").select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "n_blocks", F.col("name").alias("class_name"), *[F.col(c).alias(carried) for c in more]
    )


def _first_names(meta: DataFrame, total: int) -> tuple[DataFrame, list[DataFrame]]:
    """Names of all blocks: row, i, n, n_blocks, name; a block's text is shuffled once. And the tables that they read but for meta."""
    counts = meta.select(F.explode("hashes").alias("b")).groupBy("b").count()
    hot = cut(counts.where(F.col("count") > hot_limit(total, HOT_BLOCKS)).select("b"), "dedup-hot")
    rows = meta.select("row", F.size("blocks").alias("n"), F.posexplode(F.arrays_zip("blocks", "hashes")).alias("i", "x"))
    rows = rows.select("row", "n", "i", F.col("x.blocks").alias("block"), F.col("x.hashes").alias("b"))
    out = ["row", "i", "n", F.col("n").alias("n_blocks"), "name"]
    none = hot.isEmpty()
    cold = rows if none else rows.join(F.broadcast(hot), "b", "left_anti")
    cold = cold.repartition("block").sortWithinPartitions("block", "row", "i").withColumn("place", F.monotonically_increasing_id())
    cold = cold.withColumn("name", F.min("place").over(Window.partitionBy("block"))).select(*out)
    if none:
        return cold, [hot]
    common = rows.join(F.broadcast(hot), "b")
    names = cut(common.select("block").distinct().sort("block").withColumn("name", F.lit(NONE - 1) - F.monotonically_increasing_id()), "dedup-hot-names")
    return cold.unionByName(common.join(F.broadcast(names), "block").select(*out)), [hot, names]


def _next_names(level: DataFrame) -> DataFrame:
    """Names of the adjacent pairs of a level; only integers are shuffled."""
    at = F.expr("i % 2")
    pairs = level.groupBy("row", F.expr("cast(i div 2 as int)").alias("i")).agg(
        F.max(F.when(at == 0, F.col("name"))).alias("a"),
        F.coalesce(F.max(F.when(at == 1, F.col("name"))), F.lit(NONE)).alias("b"),
        F.expr("cast(max((n + 1) div 2) as int)").alias("n"),
        F.max("n_blocks").alias("n_blocks"),
    )
    pairs = cut(pairs, "dedup-pairs")
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("times"))
    names = cut(counts.sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id()), "dedup-pair-names")
    named = cut(join_hot(pairs, names, ["a", "b"], "times", "inner").drop("a", "b"), "dedup-names")
    discard(pairs, names)
    return named


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """docs with one row of each class of equal texts, the smallest id's (null last; of equal ids the first row).

    The columns are as they were, whatever their names; null text is the empty text; an empty table stays empty. stored
    says that docs is a table as read from files (see number_rows).
    """
    numbered, row = number_rows(docs, stored)
    return drop_rows(numbered, row, exact_dedup(numbered, id_col, text_col, carried=row).where(~F.col("kept")))
