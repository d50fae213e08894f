"""Queries over ordered events (STR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators.relations import frontier
from granary.session import scratch_folder, table
from granary.streaming.events import ingest, last_window, state_folder
from granary.streaming.windows import append, read_gathered, read_windows, windowed

from . import Registry

REGISTRY = query = Registry()


@query(
    "str03_marker_window",
    """
    WITH g AS (SELECT user_id, max((ts, event_id)) AS go FROM events WHERE event_type = 'signup' GROUP BY 1),
    a AS (SELECT e.* FROM events e LEFT JOIN g USING (user_id) WHERE go IS NULL OR (e.ts, e.event_id) > go),
    s AS (SELECT user_id, min((ts, event_id)) AS stop FROM a WHERE event_type = 'purchase' GROUP BY 1)
    SELECT event_id, user_id, event_type FROM a LEFT JOIN s USING (user_id) WHERE stop IS NULL OR (ts, event_id) < stop""",
)
def _(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return last_window(ev, "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "purchase").select("event_id", "user_id", "event_type")


@query("str02_consecutive_groups", "SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("str06_resume", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0 AND event_type <> 'error')")
def _(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "event_type")
    return ev.select("event_id").join(ev.where("event_id % 3 = 0 AND event_type <> 'error'").select("event_id"), "event_id", "left_anti")


@query("str07_frontier", "WITH RECURSIVE f(k, d) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT n.k, d + 1 FROM f, LATERAL (SELECT l2.l_partkey AS k FROM lineitem l1 JOIN lineitem l2 ON l1.l_orderkey = l2.l_orderkey WHERE l1.l_partkey = f.k) n WHERE d < 7) SELECT k AS partkey, min(d) AS distance FROM f GROUP BY 1")
def _(spark, sf_dir):
    """All parts that share an order with part 0, or with one that does, and so on. The SQL stops after seven rounds, by when the test tables have no more."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("place"), F.col("l_partkey").alias("member"))
    return frontier(lines, spark.range(1).select(F.col("id").alias("member"))).select(F.col("member").alias("partkey"), "distance")


@query("str06_resumed_ingest", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def _(spark, sf_dir):
    """Events arrive as files in two parts; ingestion stops between them and resumes, and a third run finds nothing new."""
    source, sink, state = (scratch_folder(spark, x) for x in ("arrivals", "sink", "state"))
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    for part in (rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), None):
        if part is not None:
            part.write.mode("append").json(source)
        ingest(spark, source, "event_id long, event_type string", sink, state_folder(state, source="events", version=1))
    return spark.read.parquet(sink).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("str08_state_by_settings", "SELECT event_type, CAST(2 * count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    """The same settings resume, so a second run adds nothing; other settings have a state and a sink of their own and read all files again."""
    source, sink, state = (scratch_folder(spark, x) for x in ("arrivals", "sink", "state"))
    table(spark, sf_dir, "events").select("event_id", "event_type").write.json(source)
    for version in (1, 1, 2):
        ingest(spark, source, "event_id long, event_type string", f"{sink}/{version}", state_folder(state, source="events", version=version))
    return spark.read.parquet(f"{sink}/1").unionByName(spark.read.parquet(f"{sink}/2")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("str04_reset_on_marker", "WITH m AS (SELECT user_id, max(event_id) AS go FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT e.user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events e JOIN m USING (user_id) WHERE event_id >= go GROUP BY 1")
def _(spark, sf_dir):
    """What each user has gathered since the last event that starts anew, that event included; users without one have nothing."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    started = ev.where("event_type = 'signup'").groupBy("user_id").agg(F.max("event_id").alias("go"))
    return ev.join(started, "user_id").where("event_id >= go").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))


def _streamed(spark, sf_dir):
    """The events arrive as files in three parts by time; the stream stops after each, and a new one resumes from its checkpoint."""
    source, sink, state = (scratch_folder(spark, x) for x in ("arrivals", "sink", "state"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    first, last = (F.unix_micros(f("ts")) for f in (F.min, F.max))
    span = rows.agg(first.alias("a"), last.alias("b")).first()
    if span.a is None:
        rows.write.parquet(source)
    else:
        part = F.least(F.lit(2), F.floor((F.unix_micros("ts") - span.a) * 3 / (span.b - span.a + 1)))
    for k in range(3):
        if span.a is not None:
            rows.where(part == k).write.mode("append").parquet(source)
        stream = windowed(spark.readStream.schema(rows.schema).parquet(source), "user_id", "ts", "event_id", "event_type", "signup", "1 hour")
        append(stream, sink, state)
    return spark.read.schema("user_id bigint, at bigint, id bigint, kind string, start_at bigint, start_id bigint").parquet(sink)


@query(
    "str03_streamed_window",
    """
    WITH g AS (SELECT user_id, max((ts, event_id)) AS go FROM events WHERE event_type = 'signup' GROUP BY 1),
    a AS (SELECT e.* FROM events e LEFT JOIN g USING (user_id) WHERE go IS NULL OR (e.ts, e.event_id) > go),
    s AS (SELECT user_id, min((ts, event_id)) AS stop FROM a WHERE event_type = 'purchase' GROUP BY 1)
    SELECT event_id, user_id, event_type FROM a LEFT JOIN s USING (user_id) WHERE stop IS NULL OR (ts, event_id) < stop""",
)
def _(spark, sf_dir):
    """The windows of str03_marker_window, from a stream with keyed state."""
    found = read_windows(_streamed(spark, sf_dir), "user_id", F.col("kind") == "purchase")
    return found.select(F.col("id").alias("event_id"), "user_id", F.col("kind").alias("event_type"))


@query("str04_streamed_reset", "WITH m AS (SELECT user_id, max((ts, event_id)) AS go FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT e.user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events e JOIN m USING (user_id) WHERE (ts, event_id) >= go GROUP BY 1")
def _(spark, sf_dir):
    """What each user has gathered since the last event that starts anew, from a stream with keyed state."""
    return read_gathered(_streamed(spark, sf_dir), "user_id")
