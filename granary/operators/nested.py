"""Nested JSON values as rows of (path, type, value), and comparisons of them (DQ-14, DQ-20). Variant functions only: no Python on the executors.

A level of nesting is a pass over the values that are still nested, and cuts its lineage, so any depth is reached and no value
is held but its own row. Paths are JSON pointers; a path's shape has `*` for each place in a list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.session import checkpointed

NESTED = ["object", "array"]
#: Rows whose texts are compared in one task.
TASK_ROWS = 10_000


def parsed(text: Column) -> Column:
    """A variant of a JSON text; null for null, for malformed text, for text after the value and for objects that repeat a key.

    The parser passes over what follows a value, so the text is read as the first of two list items, of which the second is
    the text's own digest.
    """
    digest = F.sha2(text, 256)
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]')))
    whole = F.try_variant_get(pair, "$[1]", "string").eqNullSafe(digest) & F.try_variant_get(pair, "$[2]", "variant").isNull()
    return F.when(whole, F.try_parse_json(text))


def kind_of(value: Column) -> Column:
    """object, array, string, boolean, null, integer or double. A number with a point or an exponent is double.

    Numbers beyond 64 bits are integers if they have no fraction and up to 38 digits, else doubles.
    """
    name = F.schema_of_variant(value)
    digits = F.regexp_extract(name, r"^DECIMAL\(([0-9]+),0\)$", 1).try_cast("int")
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "VOID", "null").when(name == "BOOLEAN", "boolean")
        .when(name == "STRING", "string").when((name == "BIGINT") | (digits > 18), "integer").otherwise("double")
    )


def text_of(value: Column, kind: Column) -> Column:
    """A value as text, by its kind: doubles in one form whatever they were written as; null for what is nested, and for null."""
    number = F.try_variant_get(value, "$", "double")
    return F.when(kind == "double", F.when(number == 0, "0.0").otherwise(number.cast("string"))).when(~kind.isin(*NESTED, "null"), F.try_variant_get(value, "$", "string"))


def flatten(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """(*key, path, shape, kind, value) of every value, nested ones too, in the JSON text of each row.

    A null text has no values; one that parsed() refuses has the single kind `malformed`. An empty list or object is a row
    like any other. The result reads a table for each level of nesting in the shared folder.
    """
    value = F.col("__value")
    names = [f"__{i}" for i in range(len(key))]
    level = rows.where(F.col(text).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(key, names)], F.lit("").alias("path"), F.lit("").alias("shape"), parsed(F.col(text)).alias("__value"))
    levels = []
    while True:
        kind = F.when(value.isNull(), "malformed").otherwise(kind_of(value))
        level = checkpointed(level.withColumn("kind", kind).withColumn("value", text_of(value, F.col("kind"))))
        levels.append(level.drop("__value"))
        nested = level.where(F.col("kind").isin(NESTED))
        if nested.isEmpty():
            break
        step = F.replace(F.replace("key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        own = F.concat(F.lit("/"), F.when(F.col("kind") == "object", step).otherwise(F.col("pos").cast("string")))
        any_ = F.concat(F.lit("/"), F.when(F.col("kind") == "object", step).otherwise("*"))
        inner = nested.select(*names, "path", "shape", "kind", "__value").lateralJoin(rows.sparkSession.tvf.variant_explode(value.outer()))
        level = inner.select(*names, F.concat("path", own).alias("path"), F.concat("shape", any_).alias("shape"), F.col("value").alias("__value"))
    every = reduce(DataFrame.unionByName, levels)
    return every.select(*[F.col(n).alias(k) for k, n in zip(key, names)], "path", "shape", "kind", "value")


def differences(rows: DataFrame, key: str, left: str, right: str, allowed: DataFrame | None = None) -> DataFrame:
    """(key, path, change, left_kind, left_value, right_kind, right_value): where the values of two JSON texts of a row differ (DQ-14).

    change is `added` or `removed` for a path that one side has, `retyped` for other kinds, `changed` for other values of one
    kind, and `malformed` where a text is refused, even if both are. allowed (shape, change) lists differences that are none.
    Keys are unique. Rows and both sides meet in one aggregate by key and path, not in a join. A table's bytes say little of
    the values in its texts, so rows are dealt out TASK_ROWS a task, before they are flattened and again by key before they meet.
    """
    parts = -(-rows.count() // TASK_ROWS) or 1
    rows = rows.select(key, left, right).repartition(parts)
    sides = [rows.select(F.col(key).alias("__key"), F.lit(side).alias("__side"), F.col(c).alias("__text")) for side, c in enumerate((left, right))]
    flat = flatten(sides[0].unionByName(sides[1]), ["__key", "__side"], "__text").repartition(parts, "__key")
    of = lambda side: F.max(F.when(F.col("__side") == side, F.struct("kind", "value")))
    both = flat.groupBy("__key", "path").agg(F.min("shape").alias("shape"), of(0).alias("a"), of(1).alias("b"))
    change = (
        F.when((F.col("a.kind") == "malformed") | (F.col("b.kind") == "malformed"), "malformed").when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed")
        .when(F.col("a.kind") != F.col("b.kind"), "retyped").when(~F.col("a.value").eqNullSafe(F.col("b.value")), "changed")
    )
    found = both.withColumn("change", change).where("change IS NOT NULL")
    if allowed is not None:
        found = found.join(allowed.select("shape", "change").distinct(), ["shape", "change"], "left_anti")
    return found.select(F.col("__key").alias(key), "path", "change", F.col("a.kind").alias("left_kind"), F.col("a.value").alias("left_value"), F.col("b.kind").alias("right_kind"), F.col("b.value").alias("right_value"))


def strictly_equal(rows: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, equal): whether two JSON texts of a row hold the same value with the same types (DQ-20).

    true is not 1 and 1 is not 1.0, but 1.0 is 1.00 and 1e0; keys of an object may come in any order, items of a list may not.
    Null if a text is null; false if one is malformed or repeats a key.
    """
    unlike = differences(rows, key, left, right).select(F.col(key).alias("__unlike")).distinct()
    both = F.col(left).isNotNull() & F.col(right).isNotNull()
    return rows.join(unlike, F.col(key) == F.col("__unlike"), "left").select(key, F.when(both, F.col("__unlike").isNull()).alias("equal"))
