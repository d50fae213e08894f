"""Joins, set operations, windows, selection and constraint checks over keys. None collects rows or groups."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.session import checkpointed


def reconcile(expected: DataFrame, observed: DataFrame, key: list[str]) -> DataFrame:
    """(key, n_expected, n_observed, verdict): ok, missing, extra or duplicate (JON-08, DQ-03, DQ-09, DQ-21).

    Both sides are counted by key first, so repeated rows never multiply in the join.
    """
    a = expected.groupBy(*key).agg(F.count("*").alias("n_expected"))
    b = observed.groupBy(*key).agg(F.count("*").alias("n_observed"))
    both = a.join(b, key, "full").na.fill(0, ["n_expected", "n_observed"])
    verdict = F.when(F.col("n_expected") == 0, "extra").when(F.col("n_observed") == 0, "missing").when(F.col("n_observed") > F.col("n_expected"), "duplicate").otherwise("ok")
    return both.withColumn("verdict", verdict)


def drop_shared(rows: DataFrame, key: list[str], split: str) -> DataFrame:
    """rows whose key is owned by one split only; shared keys leave both (JON-03). min = max needs no set of splits."""
    owned = rows.groupBy(*key).agg(F.min(split).alias("__a"), F.max(split).alias("__b")).where("__a = __b").select(*key)
    return rows.join(owned, key, "left_semi")


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a total order (WIN-03). An aggregate, not a window: hot keys are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    first = rows.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("__row"))
    return first.select(*key, *[F.col("__row")[c].alias(c) for c in order + rest]).select(*rows.columns)


def first_per_group(rows: DataFrame, group: list[str], order: list[Column], cap: int) -> DataFrame:
    """At most cap rows a group after all filters (WIN-01, WIN-02, TOP-08); Spark prunes each task to cap rows before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def mismatches(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(column, n_mismatch) over the union of keys, null-safe (JON-14, DQ-08, DQ-13, DQ-14)."""
    a = left.select(*key, F.lit(True).alias("__l"), *[F.col(c).alias(f"__l_{c}") for c in columns])
    b = right.select(*key, F.lit(True).alias("__r"), *[F.col(c).alias(f"__r_{c}") for c in columns])
    both = a.join(b, key, "full")
    lone = F.col("__l").isNull() | F.col("__r").isNull()
    counts = both.agg(*[F.count_if(lone | ~F.col(f"__l_{c}").eqNullSafe(F.col(f"__r_{c}"))).alias(c) for c in columns])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_mismatch")) for c in columns])))


def work_matrix(items: DataFrame, repetitions: int, engines: list[str]) -> DataFrame:
    """Every item with each repetition and engine, by generators over constants; no join (JON-07)."""
    return items.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions)))).withColumn("engine", F.explode(F.array(*map(F.lit, engines))))


def islands(rows: DataFrame, group: str, position: str) -> DataFrame:
    """(group, first, last, n) of runs of consecutive positions (WIN-05)."""
    w = Window.partitionBy(group).orderBy(position)
    numbered = rows.select(group, position).distinct().withColumn("island", F.col(position) - F.row_number().over(w))
    return numbered.groupBy(group, "island").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n")).drop("island")


def set_digest(rows: DataFrame, group: str, value: str) -> DataFrame:
    """An order-independent digest of a group's distinct values without gathering them: the sum of 60 hash bits, and a count (AGG-23, AGG-25)."""
    h = F.conv(F.substring(F.sha2(F.col(value).cast("string"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.select(group, value).distinct().groupBy(group).agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("digest"))


def sequence_digest(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """The SHA-256 of a group's values in order (AGG-24); for groups that fit a row, such as games and conversations."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("string"))
    return rows.groupBy(*group).agg(F.count("*").alias("n"), F.sha2(F.array_join(ordered, " "), 256).alias("digest"))


def repeatability(rows: DataFrame, key: list[str], state: list[str], expected: int) -> DataFrame:
    """(key, n, n_states, repeatable): one distinct state and the expected number of attempts; null is a state (WIN-04)."""
    s = F.sha2(F.to_json(F.struct(*state), {"ignoreNullFields": "false"}), 256)
    out = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(s).alias("n_states"))
    return out.withColumn("repeatable", (F.col("n") == expected) & (F.col("n_states") == 1))


def first_reason(reasons: list[tuple[str, Column]], accepted: str = "accepted") -> Column:
    """The first reason that holds, in order (FLT-07, FLT-09)."""
    out = F.when(F.coalesce(reasons[0][1], F.lit(False)), reasons[0][0])
    for name, test in reasons[1:]:
        out = out.when(F.coalesce(test, F.lit(False)), name)
    return out.otherwise(accepted)


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, n_rows, n_violations) of row constraints in one pass; null counts as a violation (DQ-05, DQ-22)."""
    counts = rows.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.col("n").alias("n_rows"), F.col(k).alias("n_violations")) for k in checks])))


def pick_exclusive(candidates: DataFrame, buckets: list[str], per_bucket: int) -> DataFrame:
    """(bucket, id, a, b): greedy selection in rank order, bucket by bucket, an entity (a or b) at most once over all buckets (TOP-02).

    candidates: (bucket, rank, id, a, b), ranks unique in a bucket; one with a null entity is never chosen. A candidate that ranks first among all that share an
    entity with it is chosen by the greedy rule whatever the others do; so a round takes all of these at once, drops those
    that share an entity with them, and goes on with the rest. As only the first `per_bucket` count, candidates that rank
    after so many chosen ones are dropped too. A round is two aggregates and two joins and cuts its lineage; a bucket that
    can't be filled is an error. The driver holds a rank and a count a round.
    """
    spark = candidates.sparkSession
    schema = candidates.select("bucket", "id", "a", "b").schema
    picked: list[DataFrame] = []
    used: DataFrame | None = None

    def entities(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(F.array("a", "b")).alias("entity"))

    def without(rows: DataFrame, taken: DataFrame) -> DataFrame:
        return rows.join(taken.withColumnRenamed("entity", "a"), "a", "left_anti").join(taken.withColumnRenamed("entity", "b"), "b", "left_anti")

    for bucket in buckets:
        left = candidates.where(F.col("bucket") == bucket).select("rank", "id", "a", "b")
        left, chosen = (without(left, used) if used else left), None
        while True:
            first = left.select("rank", F.explode(F.array("a", "b")).alias("entity")).groupBy("entity").agg(F.min("rank").alias("best"))
            firsts = left.join(first.select(F.col("entity").alias("a"), F.col("best").alias("best_a")), "a").join(first.select(F.col("entity").alias("b"), F.col("best").alias("best_b")), "b")
            round_ = checkpointed(firsts.withColumn("now", (F.col("rank") == F.col("best_a")) & (F.col("rank") == F.col("best_b"))).select("rank", "id", "a", "b", "now"))
            now = round_.where("now").drop("now")
            chosen = now if chosen is None else checkpointed(chosen.unionByName(now))
            last = chosen.orderBy("rank").limit(per_bucket).agg(F.count("*").alias("n"), F.max("rank").alias("rank")).first()
            left = without(round_.where("NOT now").drop("now"), entities(now).distinct())
            if last.n == per_bucket:  # those after the last of them can't be among the first
                left = left.where(F.col("rank") < last.rank)
            left = checkpointed(left)
            if left.isEmpty():
                break
        if last.n < per_bucket:
            raise ValueError(f"only {last.n} of {per_bucket} candidates satisfy bucket {bucket}")
        best = checkpointed(chosen.where(F.col("rank") <= last.rank).select(F.lit(bucket).alias("bucket"), "id", "a", "b"))
        picked.append(best)
        used = entities(best) if used is None else checkpointed(used.unionByName(entities(best)))
    result = spark.createDataFrame([], schema)
    for rows in picked:
        result = result.unionByName(rows)
    return result


def field_mismatches(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per field: rows only on one side, and rows on both whose values differ, null being a value (JON-14).

    One merge join on the key and one pass of counts; keys are unique on each side, so none is hot.
    """
    a = left.select(F.col(key).alias("a_key"), *[F.col(f).alias(f"a_{f}") for f in fields])
    b = right.select(F.col(key).alias("b_key"), *[F.col(f).alias(f"b_{f}") for f in fields])
    joined = a.join(b, F.col("a_key") == F.col("b_key"), "full")
    both = F.col("a_key").isNotNull() & F.col("b_key").isNotNull()
    counts = joined.agg(
        F.count_if(F.col("a_key").isNull()).alias("only_right"),
        F.count_if(F.col("b_key").isNull()).alias("only_left"),
        *[F.count_if(both & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))).alias(f"d{i}") for i, f in enumerate(fields)],
    )
    return counts.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col("only_right"), F.col("only_left"), F.col(f"d{i}").alias("differing")) for i, f in enumerate(fields)])))


def observations(events: DataFrame, group: str, order: list[str], value: str, marker: Column) -> DataFrame:
    """One classified observation per group: evidence counts, the last and the largest value, and a status (FN-11).

    More than one marker is `ambiguous`, no value `no_score`, no marker `protocol_failure`, else `exact`. All are partial
    aggregates (the last value is the value of the largest order key), so a hot group is combined before the shuffle.
    """
    v = F.col(value)
    out = events.groupBy(group).agg(
        F.count("*").alias("n_events"),
        F.count_if(marker).alias("markers"),
        F.count_if(v > 0).alias("n_positive"),
        F.count_if(v == 0).alias("n_zero"),
        F.max(F.when(v.isNotNull(), F.struct(*order, v.alias("value")))).getField("value").alias("last_value"),
        F.max(v).alias("max_value"),
    )
    status = F.when(F.col("markers") > 1, "ambiguous").when(F.col("last_value").isNull(), "no_score").when(F.col("markers") == 0, "protocol_failure").otherwise("exact")
    return out.select(group, "n_events", "n_positive", "n_zero", "last_value", "max_value", status.alias("status"))


def looks_like_bot(identity: Column, name: Column, avatar: Column) -> Column:
    """An id or a name that begins with a colon, or an avatar that begins with bot_ in any case (FLT-06); nulls are empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return text(identity).startswith(":") | text(name).startswith(":") | F.lower(text(avatar)).startswith("bot_")


def rated(games: DataFrame, ratings: list[str], least: float) -> DataFrame:
    """Games whose ratings are all there and at least `least`; all games if that is 0 or less (FLT-13)."""
    if least <= 0:
        return games
    return games.where(F.forall(F.array(*ratings), lambda r: F.coalesce(r >= least, F.lit(False))))


def sampled_plies(rows: DataFrame, ply: str, first: int, every: int, loud: Column) -> DataFrame:
    """Every `every`-th ply from `first` on that isn't loud, that is, in check or a capture (FLT-03, FLT-13)."""
    return rows.where((F.col(ply) >= first) & (F.col(ply) % every == 0) & ~F.coalesce(loud, F.lit(False)))


def compact(game: Column, fields: list[str], players: str, player_fields: list[str]) -> Column:
    """A nested record as JSON with the named fields of the game and its players only; a field that is null is left out (FLT-17)."""
    inner = F.transform(game[players], lambda p: F.struct(*[p[f].alias(f) for f in player_fields]))
    return F.to_json(F.struct(*[game[f].alias(f) for f in fields], inner.alias(players)))


def same_but(left: Column, right: Column, ignored: list[str]) -> Column:
    """Whether two maps are equal but for the ignored keys (FLT-18)."""
    entries = lambda m: F.array_sort(F.map_entries(F.map_filter(m, lambda k, _: ~k.isin(ignored))))
    return entries(left) == entries(right)


def union_exact(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """The union of two maps; a key with two values is an error that names it (SET-03). Null is a value."""
    both = left.select(key, value).unionByName(right.select(key, value))
    one = both.groupBy(key).agg(F.min(value).alias("__a"), F.max(value).alias("__b"), (F.count(value) < F.count("*")).alias("__null"))
    clash = (F.col("__a") != F.col("__b")) | (F.col("__null") & F.col("__a").isNotNull())
    error = F.raise_error(F.concat(F.lit("conflicting values of key "), F.col(key).cast("string"))).cast(left.schema[value].dataType)
    return one.select(key, F.when(F.coalesce(clash, F.lit(False)), error).otherwise(F.col("__a")).alias(value))


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, once for each time; none if the bags are equal (DQ-09)."""
    return left.exceptAll(right).unionByName(right.exceptAll(left))


def ordered_exclusion(rows: DataFrame, sets: dict[str, tuple[DataFrame, str]], kept: str) -> DataFrame:
    """rows with `reason`: the first of the sets, in order, that holds the row's value of the set's column, else `kept` (FLT-09).

    Each set is made distinct first, so no row multiplies; a null value is in no set.
    """
    for i, (members, column) in enumerate(sets.values()):
        rows = rows.join(members.select(F.col(column).alias(f"__v{i}")).distinct(), F.col(column) == F.col(f"__v{i}"), "left")
    reason = first_reason([(name, F.col(f"__v{i}").isNotNull()) for i, name in enumerate(sets)], kept)
    return rows.withColumn("reason", reason).drop(*[f"__v{i}" for i in range(len(sets))])


#: Rows of a frontier that are broadcast: of more, the shares are dealt out by key for a merge join.
NEAR = 500_000


def frontier(shares: DataFrame, start: DataFrame, target: int | None = None) -> DataFrame:
    """(member, distance) by breadth-first search over shares (place, member) from start (member), until nothing new or `target` members (STR-07).

    A round is two joins through the places of the newest members that no round before it has reached, never all pairs. A
    frontier of NEAR rows at most is broadcast, so that the shares are read where they are; they are dealt out only in the
    rounds that reach much of them, which are few however large the table. Each round's new members and places are written
    once to the shared folder, and the shares are read twice a round. The last round is whole, so more than `target` may be found.
    """

    def through(by: str, near: DataFrame, n: int, to: str) -> DataFrame:
        near = F.broadcast(near.select(by)) if n <= NEAR else near.select(by).hint("merge")
        return shares.where(F.col(to).isNotNull()).join(near, by, "left_semi").select(to).distinct()

    def unseen(rows: DataFrame, levels: list[DataFrame], on: str) -> DataFrame:
        return rows.join(reduce(DataFrame.union, [x.select(on) for x in levels]), on, "left_anti") if levels else rows

    def written(rows: DataFrame) -> tuple[DataFrame, int]:
        rows = checkpointed(rows)
        return rows, rows.count()

    newest, n = written(start.select("member").distinct().withColumn("distance", F.lit(0)))
    known, seen, total = [newest], [], n
    for distance in range(1, 1 << 31):
        if not n or (distance > 1 and target and total >= target):
            break
        places, n = written(unseen(through("member", newest, n, "place"), seen, "place"))
        if not n:
            break
        seen.append(places)
        newest, n = written(unseen(through("place", places, n, "member"), known, "member").withColumn("distance", F.lit(distance)))
        if n:
            known, total = [*known, newest], total + n
    return reduce(DataFrame.unionByName, known)


#: The multiplier and increment of the 64-bit linear congruential generator, and what a seed is mixed with.
MULTIPLIER, INCREMENT, MIX = 6_364_136_223_846_793_005, 1_442_695_040_888_963_407, 0xD1B54A32D192ED03


def ranked(rows: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """rows with their places, from 0, in a total order: a range-partitioned sort, written once, and the rows of the partitions before.

    Only a number for each partition reaches the driver; the result reads a table in the shared folder.
    """
    placed = checkpointed(rows.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()))
    part, at = F.shiftrightunsigned("__place", 33), 0
    before = []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        before.append((r.part, at))
        at += r["count"]
    offsets = rows.sparkSession.createDataFrame(before, "__part long, __before long")
    joined = placed.join(F.broadcast(offsets), part == F.col("__part"))
    return joined.withColumn(rank, F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))).drop("__place", "__part", "__before")


def generator_draws(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(step, other) for steps n - 1 to 1: the generator's draw for each, modulo step + 1.

    A draw depends on its number alone: after t draws the state is an affine function of the first, which is reached by
    doubling. Each task skips to its steps and goes on from there in 64-bit words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column(0).to_numpy()  # t-th draw, from 0, of a run of numbers
            if len(t):
                power, add, base, plus, k = 1, 0, MULTIPLIER, INCREMENT, int(t[0])
                while k:
                    if k & 1:
                        power, add = power * base % 2**64, (add * base + plus) % 2**64
                    base, plus, k = base * base % 2**64, plus * (base + 1) % 2**64, k >> 1
                start = (power * ((seed ^ MIX) % 2**64) + add) % 2**64
                powers = np.multiply.accumulate(np.full(len(t), MULTIPLIER, np.uint64))
                sums = np.add.accumulate(np.concatenate([[np.uint64(1)], powers[:-1]]))
                state = powers * np.uint64(start) + np.uint64(INCREMENT) * sums
                step = n - 1 - t
                yield pa.RecordBatch.from_arrays([pa.array(step), pa.array((state % (step + 1).astype(np.uint64)).astype(np.int64))], names=["step", "other"])

    return spark.range(max(0, n - 1)).mapInArrow(run, "step long, other long")


def seeded_permutation(rows: DataFrame, order: str, seed: int) -> DataFrame:
    """(order, at): the place of each row, taken in ascending order of a unique column, after a Fisher-Yates shuffle by the generator (TOP-07).

    Step i, from the last place down to 1, swaps places i and h(i) <= i, and place i is never touched again. So it ends with
    what h(i) held just before: what the nearest earlier step k > i with h(k) = h(i) put there, which is what place k held
    before step k, or else h(i) itself, the first content. What place k held before its step is found in the same way from
    the nearest earlier step that drew k. These links form chains of logarithmic length, followed for all places at once by
    doubling: a few joins, for any number of rows.
    """
    numbered = ranked(rows.select(order), [F.asc(order)], "index")
    n = numbered.count()
    spark = rows.sparkSession
    draws = checkpointed(generator_draws(spark, n, seed))
    proper = draws.where("step <> other")
    places = spark.range(n).select(F.col("id").alias("place"))
    link = proper.groupBy(F.col("other").alias("place")).agg(F.min("step").alias("to"))  # the nearest earlier step that drew the place
    chain = checkpointed(places.join(link, "place", "left").select("place", F.coalesce("to", "place").alias("to")))
    moved = chain.where("place <> to").count()
    while moved:
        further = chain.select(F.col("place").alias("to"), F.col("to").alias("beyond"))
        longer = checkpointed(chain.join(further, "to").select("place", F.col("beyond").alias("to"), (F.col("beyond") != F.col("to")).alias("moved")))
        chain, moved = longer.drop("moved"), longer.where("moved").count()
    held = chain.select(F.col("place").alias("step"), F.col("to").alias("held"))  # by each place before its step
    earlier = F.min("step").over(Window.partitionBy("other").orderBy("step").rowsBetween(1, 1))
    source = proper.withColumn("source", earlier).select("step", F.coalesce("source", F.lit(-1)).alias("source"), "other")
    found = source.join(held.withColumnRenamed("step", "source"), "source", "left").select(F.col("step").alias("at"), F.coalesce("held", "other").alias("index"))
    still = held.join(proper.select("step"), "step", "left_anti").select(F.col("step").alias("at"), F.col("held").alias("index"))  # place 0, and steps that swapped nothing
    return numbered.join(found.unionByName(still), "index").select(order, F.col("at").cast("int" if n < 1 << 31 else "long").alias("at"))


def input_digests(inputs: dict[str, DataFrame]) -> DataFrame:
    """(input, n, digest) of each table: the number of its rows and the sum of 60 bits of each row's SHA-256, whatever their order; partial sums, nothing gathered (DQ-08)."""
    found = None
    for name, rows in inputs.items():
        text = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
        h = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)")
        one = rows.agg(F.lit(name).alias("input"), F.count("*").alias("n"), F.coalesce(F.sum(h).cast("string"), F.lit("0")).alias("digest"))
        found = one if found is None else found.unionByName(one)
    return found


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """(input, unchanged) over the inputs of both; one that is missing on a side has changed (DQ-08)."""
    b = after.select("input", F.struct("n", "digest").alias("b"))
    return before.select("input", F.struct("n", "digest").alias("a")).join(b, "input", "full").select("input", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("unchanged"))
