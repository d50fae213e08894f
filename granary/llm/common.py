"""Shared helpers: tables in the shared folder, joins with hot keys, byte-bounded Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: ASCII white space, as a Java or Python regular expression.
WHITE = r"[\x20\x09-\x0D]+"
#: A key with more than 1 / FEW of the rows is hot; so is one with over COLD_ROWS rows, unless more than MANY keys could be.
FEW, COLD_ROWS, MANY = 2_000, 2_000_000, 50_000
#: Bytes of text that are held as Python objects at once.
BATCH_BYTES = 4 << 20


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where that is unset and the master is this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost no rework."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of cut() on which nothing that is still to be computed depends."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.cut_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def hot_limit(rows: int, many: int = MANY) -> int:
    """Rows that a key may have and be joined like any other; fewer than max(FEW, many) keys can have more."""
    return int(max(100, min(rows / FEW, max(COLD_ROWS, rows / many))))


def join_hot(left: DataFrame, right: DataFrame, on: list[str], count: str, how: str = "left") -> DataFrame:
    """Join left to right on non-null keys, where right has one row a key and in column `count` the rows that the key has in left.

    Keys with more than hot_limit() rows are joined by broadcast, at most MANY of them whatever the input's size; the rest
    by a merge join at every size, in which a key has COLD_ROWS rows at most, or 1 / MANY of very large inputs. Both inputs
    should be tables, as they are read twice.
    """
    limit = hot_limit(right.agg(F.sum(count)).first()[0] or 0)
    hot = right.where(F.col(count) > limit)
    cold = right.where(F.col(count) <= limit).drop(count).hint("merge")
    if hot.isEmpty():
        return left.join(cold, on, how)
    hot = hot.drop(count)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return left.join(F.broadcast(hot), on, "inner").unionByName(rest)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores after it until df has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def is_stored(docs: DataFrame) -> bool:
    """Whether docs, which must be a table as it was read or made, was read from Parquet files; these number their rows."""
    if "_metadata" in map(str.lower, docs.columns):
        return False
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def number_rows(docs: DataFrame, stored: bool = False) -> tuple[DataFrame, str]:
    """docs with a column that tells its rows apart in all later joins, and its name.

    The rows of a stored table have a file and a place in it (two files share a 64-bit hash with a chance of 10^-9 among
    10^5). Other rows are numbered and written once to the shared folder.
    """
    row = free_name(docs, "__row")
    if stored:
        return docs.withColumn(row, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))), row
    return cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def drop_rows(numbered: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """Rows of number_rows() that aren't in dropped (row), without that column; ids decide nothing."""
    return numbered.join(dropped.select(row), row, "left_anti").drop(row)


def rest() -> None:
    """Give memory that is free back to the system: a Python worker stays, idle, beside later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def filter_texts(docs: DataFrame, text_col: str, test: Callable[[], Callable[[list[bytes | None]], list[bool]]], limit: int = BATCH_BYTES) -> DataFrame:
    """docs with the rows whose text passes, the columns as they were; test() is called once a task. The decision stays with its row."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = test()
        for batch in batches:
            for start, texts in slices(batch.column(at), limit):
                yield batch.slice(start, len(texts)).filter(pa.array(passes(texts), pa.bool_()))
        rest()

    return docs.mapInArrow(run, docs.schema)


def slices(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, list]]:
    """(first row, values) of parts of a string or binary column of at most `limit` bytes, or one value.

    Strings come as UTF-8 bytes; null comes as None.
    """
    column = column.cast(pa.large_binary())
    ends = pa.array([], pa.int64()) if not len(column) else pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.binary_length(column), 0).cast(pa.int64()))
    ends, start, n = ends.to_numpy(zero_copy_only=False), 0, len(column)
    base = 0
    while start < n:
        stop = max(start + 1, int(ends.searchsorted(base + limit, "right")))
        yield start, column.slice(start, stop - start).to_pylist()
        base, start = int(ends[stop - 1]), stop
