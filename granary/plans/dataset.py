"""The dataset build: identity, dedup, split, sampling filters, decontamination, caps, shared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.scalar import hash_split, position_key
from granary.operators.relations import drop_shared, first_per_group, keep_first, sequence_digest


def build(rows: DataFrame, excluded: DataFrame, game: str, ply: str, text: str, seed: str, every: int = 2, cap: int = 3) -> DataFrame:
    """(game, ply, key, split) of sampled rows.

    Games with equal sequences count once (the smallest id stays); a game's split follows from its sequence alone; every
    `every`-th ply is sampled; keys in `excluded` (key) go; at most `cap` rows a game stay; keys in both splits leave both.
    """
    games = sequence_digest(rows, [game], ply, text).select(game, "digest")
    games = keep_first(games, ["digest"], [game]).withColumn("split", hash_split(seed, F.col("digest")))
    sampled = rows.where(F.col(ply) % every == 0).withColumn("key", position_key(F.col(text))).join(games, game)
    clean = sampled.join(excluded.select("key").distinct(), "key", "left_anti")
    return drop_shared(first_per_group(clean, [game], [F.col(ply)], cap).select(game, ply, "key", "split"), ["key"], "split")
