"""Attempts as files: a record of each, and its raw log in a file of its own, paired by name and recorded hash (SRC-15)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.records import binary_files

EVENT = "attempt bigint, seq bigint, direction string, line string, offset_ns bigint"
#: What a record says of its log.
LOG = "log_bytes bigint, log_sha256 string"


def raw_logs(spark: SparkSession, path: str) -> DataFrame:
    """(attempt, name, bytes, content) of the raw logs under path. Their folders, one an attempt, are listed here, once for all that is made of it."""
    return binary_files(spark, f"{path}/raw").withColumn("attempt", F.regexp_extract("name", r"attempt=(-?[0-9]+)/", 1).try_cast("bigint"))


def logs(raw: DataFrame) -> DataFrame:
    """(attempt, files, bytes, sha256) of raw_logs(): an attempt's number of files, and one of them."""
    one = F.min(F.struct("name", "bytes", F.sha2("content", 256).alias("sha256")))
    return raw.groupBy("attempt").agg(F.count("*").alias("files"), one.alias("one")).select("attempt", "files", "one.bytes", "one.sha256")


def log_events(raw: DataFrame) -> DataFrame:
    """The columns of EVENT of raw_logs(), whose files are read whole; a line that is no event is an error."""
    lines = raw.select("attempt", F.explode(F.split(F.decode("content", "UTF-8"), r"\r\n?|\n")).alias("line")).where("line <> ''")
    return lines.select("attempt", F.from_json("line", EVENT.split(", ", 1)[1], {"mode": "FAILFAST"}).alias("event")).select("attempt", "event.*")


def _digests(lines: DataFrame) -> DataFrame:
    """(attempt, log_bytes, log_sha256) of lines (attempt, value) that lie together and in order: what the attempt's file holds."""
    schema = lines.select("attempt", F.lit(0).cast("bigint").alias("log_bytes"), F.lit("").alias("log_sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, size, sha = None, 0, None
        for batch in batches:
            done = []
            for a, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if sha is None or a != attempt:
                    done += [] if sha is None else [(attempt, size, sha.hexdigest())]
                    attempt, size, sha = a, 0, hashlib.sha256()
                size += len(value) + 1
                sha.update(value + b"\n")
            yield rows(batch, done)
            last = batch
        if sha is not None:
            yield rows(last, [(attempt, size, sha.hexdigest())])

    def rows(batch: pa.RecordBatch, done: list[tuple]) -> pa.RecordBatch:
        types = [batch.schema.field(0).type, pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=schema.names)

    return lines.mapInArrow(run, schema)


def write_attempts(records: DataFrame, events: DataFrame, path: str) -> None:
    """A log file for each attempt of events (attempt, seq, direction, line, offset_ns), in order of seq, and then the records with their logs' sizes and hashes.

    events must give the same rows whenever it is read: sizes and hashes are those of the lines, not of files read back.
    """
    fields = [c for c in events.columns if c != "attempt"]
    lines = events.select("attempt", "seq", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))
    ordered = lines.repartition("attempt").sortWithinPartitions("attempt", "seq", "value").select("attempt", "value")
    ordered.write.partitionBy("attempt").text(f"{path}/raw")
    records.join(_digests(ordered), "attempt", "left").write.option("ignoreNullFields", "false").json(f"{path}/records")


def faults(records: DataFrame, found: DataFrame) -> DataFrame:
    """(attempt, fault) of each attempt: ok, or the first of no_log, stray (no record), repeated (several records), several_logs and changed (size or hash).

    records (attempt, log_bytes, log_sha256), found as of logs(). A null attempt, and a log whose folder names none, is stray.
    """
    a = records.groupBy("attempt").agg(F.count("*").alias("n"), F.min("log_bytes").alias("log_bytes"), F.min("log_sha256").alias("log_sha256"))
    both = a.join(found, "attempt", "full")
    same = (F.col("log_bytes") == F.col("bytes")) & (F.col("log_sha256") == F.col("sha256"))
    fault = (
        F.when(F.col("attempt").isNull() | F.col("n").isNull(), "stray").when(F.col("files").isNull(), "no_log").when(F.col("n") > 1, "repeated")
        .when(F.col("files") > 1, "several_logs").when(~F.coalesce(same, F.lit(False)), "changed").otherwise("ok")
    )
    return both.select("attempt", fault.alias("fault"))


def read_attempts(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, events) of attempts whose files are as recorded; schema is that of a record's own fields. Else an error that names an attempt.

    Nothing is read of a log that has no record, and no record stands without its log: a stray file is an error too.
    """
    records = spark.read.schema(f"attempt bigint, {schema}, {LOG}").json(f"{path}/records", mode="FAILFAST")
    raw = raw_logs(spark, path)
    wrong = faults(records, logs(raw)).where("fault <> 'ok'").orderBy("attempt").first()
    if wrong:
        raise ValueError(f"attempt {wrong.attempt}: {wrong.fault}")
    return records.drop("log_bytes", "log_sha256"), log_events(raw)
