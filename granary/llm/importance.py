"""Resampling towards a target distribution: hashed n-gram gains, document weights and a draw by Gumbel scores, all in Spark SQL.

Each text becomes an array of n-grams, which is exploded; an n-gram's bucket is its CRC-32 modulo the number of buckets. Two
grouped counts give each bucket a gain, a table of as many rows as there are buckets and so of known size, which is joined by
broadcast. The draw is a distributed sort: each row knows its place in its partition, and the partitions' row counts, one
number each, give the places before it. No task or driver holds the rows that are ranked.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import cut, discard, is_stored, number_rows

#: What stands between words: runs of ASCII characters other than a-z and digits. Words are runs of all others.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most buckets: the gain table that is broadcast has a row a bucket.
MOST_BUCKETS = 1 << 20
_PLACE = (1 << 33) - 1  # monotonically_increasing_id holds the partition above these bits


def words(text: str) -> Column:
    """Words of a text with A-Z in lower case; null has none. split() passes over a text once; regexp_extract_all() copies it for each match."""
    text = F.coalesce(F.col(text), F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))  # lower() is the faster, and the same for ASCII
    return F.array_remove(F.split(low, BETWEEN), "")


def n_grams(found: Column, most: int) -> Column:
    """All runs of 1 to `most` consecutive words, joined by one space; repeats stay. found: a column of the table, as it is looked up for each run."""

    def of(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(found) - (n - 1)), lambda i: F.array_join(F.slice(found, i, F.lit(n)), " "))
        return F.when(F.size(found) >= n, runs).otherwise(F.array().cast("array<string>"))

    return found if most == 1 else F.concat(found, *[of(n) for n in range(2, most + 1)])


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = 10_000, most: int = 1) -> DataFrame:
    """(bucket, gain) of the buckets that occur: floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))).

    s and t count the features of docs and of target in the bucket, S and T in all. The result reads a table of at most
    `buckets` rows.
    """
    if buckets > MOST_BUCKETS:
        raise ValueError(f"the gain table is broadcast: at most {MOST_BUCKETS} buckets")

    def of(rows: DataFrame, s: int, t: int) -> DataFrame:
        grams = rows.select(words(text_col).alias("__words")).select(F.explode(n_grams(F.col("__words"), most)).alias("gram"))
        return grams.select((F.crc32("gram") % buckets).alias("bucket"), F.lit(s).alias("s"), F.lit(t).alias("t"))

    counts = cut(of(docs, 1, 0).unionByName(of(target, 0, 1)).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "bucket-counts")
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    ratio = (F.col("t") + F.lit(1.0)) * F.lit(float(total.s + buckets)) / ((F.col("s") + F.lit(1.0)) * F.lit(float(total.t + buckets)))
    found = counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))
    found.cut_path = counts.cut_path
    return found


def gumbel(key: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln((h + 0.5) / 2^32))) with h the first 8 hex digits of the SHA-256 of `seed:key`."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, buckets: int = 10_000, most: int = 1, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank) of every row of docs; rank is null where the row isn't drawn.

    weight sums the gains of a row's features, 0 where it has none; score adds a Gumbel draw from the id alone, so the draw
    is the same on every run. Of the rows with `least_words` words the share `percent`, rounded down, with the highest
    scores is drawn; ties go to the smaller id, null last (null ids draw as the empty id), then to the earlier row. Null
    texts have no words. Repeated rows count and rank each for itself; other columns are not read, whatever their names; an
    empty table gives an empty result, and an empty target gives negative gains to frequent buckets only. The result reads
    one table of ids and numbers in the shared folder.
    """
    numbered, row = number_rows(docs, is_stored(docs))
    gain = gains(docs, target, text_col, buckets, most)
    texts = numbered.select(F.col(row).alias("__row"), F.col(id_col).alias("__id"), words(text_col).alias("__words")).withColumn("n_words", F.size("__words").cast("long"))
    each = texts.select("__row", "__id", "n_words", F.explode_outer(n_grams(F.col("__words"), most)).alias("gram"))  # the number is taken first: words don't go along with each n-gram
    each = each.select("__row", "__id", "n_words", (F.crc32("gram") % buckets).alias("bucket")).join(F.broadcast(gain), "bucket", "left")
    weighed = each.groupBy("__row", "__id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    able = F.col("n_words") >= least_words
    scored = weighed.withColumns({"score": F.col("weight") + gumbel(F.col("__id"), seed), "able": able})
    ordered = scored.orderBy(F.desc("able"), F.desc("score"), F.asc_nulls_last("__id"), "__row").drop("__row")
    ordered = cut(ordered.withColumn("place", F.monotonically_increasing_id()), "ranked")
    discard(gain, *([numbered] if hasattr(numbered, "cut_path") else []))
    return _ranked(ordered, percent).withColumnRenamed("__id", id_col)


def _ranked(ordered: DataFrame, percent: int) -> DataFrame:
    """Ranks from places in partitions; rows that can be drawn come first. Only a number for each partition reaches the driver."""
    part = F.shiftrightunsigned("place", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("able").alias("able")).orderBy("part").collect()
    drawn = percent * sum(r.able for r in sizes) // 100
    before, at = [], 0
    for r in sizes:
        before.append((r.part, at))
        at += r.n
    offsets = ordered.sparkSession.createDataFrame(before, "part long, before long")
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit(_PLACE)) + 1
    joined = ordered.withColumn("part", part).join(F.broadcast(offsets), "part", "left")
    return joined.select("__id", "n_words", "n_features", "weight", "score", F.when(F.col("able") & (rank <= drawn), rank).alias("rank"))
