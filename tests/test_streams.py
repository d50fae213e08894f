"""Streams with keyed state against plain versions, for random cuts and restarts."""

import random
from collections import Counter

from pyspark.sql import Row
from pyspark.sql import functions as F

from granary.streaming.windows import LastWindow, append, read_gathered, read_windows, windowed


def plain(rows):
    """Windows (key, at, id) and what was gathered, key by key in order."""
    inside, gathered = Counter(), {}
    for key in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == key)
        last = max((i for i, r in enumerate(own) if r[2] == "go"), default=-1)
        if last >= 0:
            gathered[key] = (len(own) - last, len({r[2] for r in own[last:]}))
        for at, i, kind in own[last + 1 :]:
            if kind == "stop":
                break
            inside[(key, at, i)] += 1
    return inside, gathered


def test_any_cut_and_order(spark, tmp_path):
    """Rows come in random order in batches, one of them empty, and a new query resumes for each; a null key is a key."""
    r = random.Random(5)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), r.randrange(40) * 60_000_000, i, r.choice(["go", "stop", "a", "a", "b", "b"])) for i in range(150)] + [(4, 5, 900, "a"), (4, 6, 901, "b"), (5, 7, 902, "stop"), (5, 8, 903, "a"), (6, 9, 904, "go")]
    r.shuffle(rows)
    source, sink, state = (str(tmp_path / x) for x in ("source", "sink", "state"))
    schema = "key long, at long, id long, kind string"
    for part in (rows[:60], rows[60:61], rows[61:]):
        made = spark.createDataFrame(part, schema).selectExpr("key", "timestamp_micros(at) AS ts", "id", "kind")
        made.unionByName(spark.sql("SELECT 9L AS key, CAST(NULL AS TIMESTAMP) AS ts, 1L AS id, 'go' AS kind")).coalesce(2).write.mode("append").parquet(source)
        append(windowed(spark.readStream.schema(made.schema).parquet(source), "key", "ts", "id", "kind", "go", "2 hours"), sink, state)
    found = spark.read.parquet(sink)
    inside, gathered = plain(rows)
    assert Counter((x.key, x.at, x.id) for x in read_windows(found, "key", F.col("kind") == "stop").collect()) == inside
    assert {x.key: (x.n, x.kinds) for x in read_gathered(found, "key").collect()} == gathered


def test_state_is_dropped(spark, tmp_path):
    """Rows older than the watermark leave the state, and a start after them still begins a window."""
    source, sink, state = (str(tmp_path / x) for x in ("source", "sink", "state"))
    hour = 3_600_000_000
    parts = [[(1, 0, 1, "go"), (1, 1, 2, "a")], [(1, 5 * hour, 3, "a")], [(1, 9 * hour, 4, "go"), (1, 0, 5, "go")], [(1, 10 * hour, 6, "b")]]
    for part in parts:
        made = spark.createDataFrame(part, "key long, at long, id long, kind string").selectExpr("key", "timestamp_micros(at) AS ts", "id", "kind")
        made.coalesce(1).write.mode("append").parquet(source)
        append(windowed(spark.readStream.schema(made.schema).parquet(source), "key", "ts", "id", "kind", "go", "1 hour"), sink, state)
    found = spark.read.parquet(sink)
    assert [tuple(x) for x in read_windows(found, "key", F.col("kind") == "stop").select("id", "kind").collect()] == [(6, "b")]
    kept = spark.read.format("statestore").option("stateVarName", "open").option("flattenCollectionTypes", "true").load(state)
    assert {x.at for x in kept.selectExpr("list_element.at AS at").collect()} <= {9 * hour, 10 * hour}


class Counted:
    """A state that counts its uses; on a cluster each is a message to the JVM."""

    def __init__(self, uses, value):
        self.uses, self.value, self.empty = uses, value, value

    def __getattr__(self, name):
        def use(*args):
            self.uses.append(name)
            if name in ("update", "put", "clear"):
                self.value = args[0] if args else self.empty
            return bool(self.value) if name == "exists" else self.value

        return use


def test_few_uses_of_the_state():
    """A key's batch takes five messages at most, and one that brings nothing to keep takes two."""
    uses, watermark = [], [0]
    handle = type("Handle", (), {"getValueState": lambda *_: Counted(uses, None), "getListState": lambda *_: Counted(uses, []), "registerTimer": lambda *_: uses.append("timer")})()
    timers = type("Timers", (), {"getCurrentWatermarkInMs": lambda _: watermark[0]})()
    window = LastWindow("key", "go")
    window.init(handle)

    def batch(*rows):
        uses.clear()
        return [tuple(x) for x in window.handleInputRows((1,), iter([Row(key=1, ts=None, at=at, id=i, kind=kind) for at, i, kind in rows]), timers)]

    assert batch((5, 1, "a"), (6, 2, "go"), (7, 3, "b")) == [(1, 6, 2, "go", 6, 2), (1, 7, 3, "b", 6, 2)] and len(uses) <= 5
    assert batch((8, 4, "c")) == [(1, 8, 4, "c", 6, 2)] and len(uses) <= 4
    watermark[0] = 1
    uses.clear()
    assert list(window.handleExpiredTimer((1,), timers, None)) == [] and uses == ["get", "clear"]
    assert batch((4, 5, "late")) == [] and len(uses) == 2
