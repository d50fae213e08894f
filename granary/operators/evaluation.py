"""Scoring: masked group errors, equal-group means, contingency tables, curves, distributions.

All are partial aggregates, so what is shuffled is a row per task and group, and hot groups do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def masked_group_error(rows: DataFrame, group: str, mask: Column, teacher: str, candidate: str) -> DataFrame:
    """Per group: sizes, partial numerators, and the MAE as (abs_sum, n_mask), null unless every masked row has a candidate (AGG-01)."""
    error = F.when(mask, F.col(candidate) - F.col(teacher))
    out = rows.groupBy(group).agg(
        F.count_if(mask).alias("n_mask"), F.count(error).alias("n_cand"), F.sum(F.abs(error)).alias("abs_sum"), F.sum(error).alias("signed_sum"), F.max(F.abs(error)).alias("max_abs")
    )
    return out.withColumn("mae", F.when((F.col("n_mask") > 0) & (F.col("n_mask") == F.col("n_cand")), F.round(F.col("abs_sum") / F.col("n_mask"), 6)))


def equal_group_mean(groups: DataFrame, value: str, expected: int) -> DataFrame:
    """The mean of group values, null unless `expected` groups have one (AGG-02)."""
    return groups.agg(F.count("*").alias("n_groups"), F.count(value).alias("n_defined"), F.round(F.when(F.count(value) == expected, F.avg(value)), 6).alias("mean"))


def contingency(rows: DataFrame, left: str, right: str, lefts: list[str], rights: list[str]) -> DataFrame:
    """A dense table (left, right, n) with zeros, from one pass over the rows (AGG-05, AGG-06)."""
    cells = [(a, b) for a in lefts for b in rights]
    counts = rows.agg(*[F.count_if((F.col(left) == a) & (F.col(right) == b)).alias(f"c{i}") for i, (a, b) in enumerate(cells)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(a).alias(left), F.lit(b).alias(right), F.col(f"c{i}").alias("n")) for i, (a, b) in enumerate(cells)])))


def status_counts(rows: DataFrame, group: str, status: str, kinds: list[str]) -> DataFrame:
    """A count of each status per group, zeros included (AGG-07, AGG-22, AGG-36)."""
    return rows.groupBy(group).agg(*[F.count_if(F.col(status) == k).alias(f"n_{k}") for k in kinds], F.count_if(F.col(status).isNull() | ~F.col(status).isin(kinds)).alias("n_unknown"))


def distribution(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Exact count, min, p50, p95, p99 and max, interpolated at (n - 1) p; no values give nulls (AGG-08)."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = rows.groupBy(group).agg(F.count(value).alias("n"), F.min(value).alias("least"), p.alias("p"), F.max(value).alias("most"))
    return out.select(group, "n", "least", *[F.round(F.col("p")[i], 6).alias(k) for i, k in enumerate(("p50", "p95", "p99"))], "most")


def accuracy_curve(rows: DataFrame, group: str, error: str, thresholds: list[int]) -> DataFrame:
    """Per threshold the equal-group mean of the share of errors within it (AGG-09)."""
    counts = rows.where(F.col(error).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), *[F.count_if(F.abs(error) <= t).alias(f"t{t}") for t in thresholds])
    tall = counts.select(group, "n", F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("hits")) for t in thresholds])))
    return tall.groupBy("threshold").agg(F.count("*").alias("n_groups"), F.sum("hits").alias("hits"), F.round(F.avg(F.col("hits") / F.col("n")), 6).alias("accuracy"))


def regression_metrics(rows: DataFrame, group: str, truth: str, predicted: str) -> DataFrame:
    """MAE, RMSE, bias, moments and Pearson's r, null where a side is constant (AGG-18, AGG-20)."""
    e = F.col(predicted) - F.col(truth)
    out = rows.groupBy(group).agg(
        F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.stddev_pop(predicted).alias("spread"), F.covar_pop(truth, predicted).alias("cov"), F.stddev_pop(truth).alias("truth_spread")
    )
    r = F.try_divide("cov", F.col("spread") * F.col("truth_spread"))
    return out.select(group, "n", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "bias", "spread")], F.round(r, 6).alias("pearson"))


def calibration(rows: DataFrame, probability: str, actual: str, buckets: int = 10) -> DataFrame:
    """Sums of predicted and actual values in equal bins of the predicted probability (AGG-17)."""
    b = F.least(F.floor(F.col(probability) * buckets), F.lit(buckets - 1)).cast("int")
    return rows.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum(probability), 4).alias("predicted"), F.sum(actual).alias("actual"))


def side_weights(rows: DataFrame, side: str) -> DataFrame:
    """0.5 * total / count of each side (AGG-29); the window is over the counts, a row a side."""
    counts = rows.groupBy(side).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select(side, "n", F.round(0.5 * total / F.col("n"), 8).alias("weight"))


def sufficient_statistics(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """Exact integer X'X and X'y as (i, j, s) in one pass; j = -1 is the target (AGG-27)."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))] + [(i, -1) for i in range(len(features))]
    of = {**dict(enumerate(features)), -1: target}
    sums = rows.agg(*[F.sum(F.col(of[i]).cast("long") * F.col(of[j]).cast("long")).alias(f"s{k}") for k, (i, j) in enumerate(pairs)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{k}").alias("s")) for k, (i, j) in enumerate(pairs)])))


def gram(vectors: DataFrame, column: str, scale: int = 1000) -> DataFrame:
    """Exact integer Gram matrix of scaled, rounded vectors as (i, j, s): numpy per batch, then sums (AGG-28).

    A batch yields one row per pair of dimensions, so the shuffle has tasks x dimensions^2 rows whatever the number of vectors.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = None
        for batch in batches:
            rows = batch.column(0).drop_null()
            if len(rows):
                z = np.floor(np.asarray(rows.flatten()).astype(np.float64).reshape(len(rows), -1) * scale + 0.5).astype(np.int64)
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "s"])

    return vectors.select(column).mapInArrow(run, "i int, j int, s long").groupBy("i", "j").agg(F.sum("s").alias("s"))


def ridge_grid(rows: DataFrame, first: str, second: str, target: str, ridges: list[float]) -> DataFrame:
    """(ridge, w1, w2) for each ridge from one pass of partial sums; two features without intercept, in closed form (NUM-03).

    A singular system gives null weights.
    """
    x, z, y = F.col(first).cast("double"), F.col(second).cast("double"), F.col(target).cast("double")
    sums = rows.agg(F.sum(x * x).alias("xx"), F.sum(x * z).alias("xz"), F.sum(z * z).alias("zz"), F.sum(x * y).alias("xy"), F.sum(z * y).alias("zy"))
    tall = sums.withColumn("ridge", F.explode(F.array(*map(F.lit, ridges)))).withColumn("det", F.expr("(xx + ridge) * (zz + ridge) - xz * xz"))
    w1, w2 = F.expr("(zz + ridge) * xy - xz * zy"), F.expr("(xx + ridge) * zy - xz * xy")
    return tall.select("ridge", F.round(F.try_divide(w1, "det"), 4).alias("w1"), F.round(F.try_divide(w2, "det"), 4).alias("w2"))


def wrapping_fingerprint(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Per group an order-independent fingerprint: the sum of the rows' 64-bit hashes modulo 2^64, as text (AGG-25)."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", *columns), 256), 1, 16), 16, 10).cast("decimal(28,0)")
    wrapped = F.sum(h) % F.lit("18446744073709551616").cast("decimal(38,0)")
    return rows.groupBy(group).agg(F.count("*").alias("n"), wrapped.cast("decimal(20,0)").cast("string").alias("fingerprint"))


def exact_mean_of_means(groups: DataFrame, total: str, n: str) -> DataFrame:
    """(numerator, denominator) of the mean of group means, exact (AGG-03): a group's mean is total / n, and groups are few.

    The denominator is the product of all n times their number, as decimals of 38 digits; beyond that it is an error.
    """
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    rows = groups.agg(F.collect_list(F.struct(wide(total).alias("s"), wide(n).alias("n"))).alias("g"))
    exact = lambda c: c.cast("decimal(38,0)")
    product = F.aggregate("g", F.lit(1).cast("decimal(38,0)"), lambda a, x: exact(a * x["n"]))
    rows = rows.withColumn("den", product)
    top = F.aggregate("g", F.lit(0).cast("decimal(38,0)"), lambda a, x: exact(a + exact(x["s"] * exact(F.floor(F.col("den") / x["n"])))))
    return rows.select(top.cast("string").alias("numerator"), exact(F.col("den") * F.size("g")).cast("string").alias("denominator"))


def accumulated(rows: DataFrame, group: list[str], value: str, bucket: Column, buckets: int) -> DataFrame:
    """One mergeable accumulator a group: n, total, squares, least, most, counts by bucket (AGG-16)."""
    v = F.col(value)
    counts = F.array(*[F.count_if(bucket == b) for b in range(buckets)])
    return rows.groupBy(*group).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.min(v).alias("least"), F.max(v).alias("most"), counts.alias("buckets"))


def merged(accumulators: DataFrame, buckets: int, group: list[str] | None = None) -> DataFrame:
    """The sum of accumulators; of none it is the empty one, with null extremes (AGG-15, AGG-16)."""
    zero = F.lit(0).cast("long")
    counts = F.array(*[F.coalesce(F.sum(F.col("buckets")[b]), zero) for b in range(buckets)])
    return accumulators.groupBy(*(group or [])).agg(
        F.coalesce(F.sum("n"), zero).alias("n"), F.coalesce(F.sum("total"), zero).alias("total"), F.coalesce(F.sum("squares"), zero).alias("squares"), F.min("least").alias("least"), F.max("most").alias("most"), counts.alias("buckets")
    )


def diagnostics(rows: DataFrame, group: str, value: str, other: str, full: float) -> DataFrame:
    """Training diagnostics of a group's values (AGG-35): moments, shares of zeros (dead) and of values at `full` or more (saturated), quantiles, Pearson's r with another column, null where a side is constant."""
    v, w = F.col(value), F.col(other)
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
    out = rows.groupBy(group).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("spread"), F.avg((v == 0).cast("int")).alias("dead"), F.avg((v >= full).cast("int")).alias("saturated"), p.alias("p"), F.covar_pop(value, other).alias("cov"), F.stddev_pop(w).alias("o")
    )
    r = F.try_divide("cov", F.col("spread") * F.col("o"))
    return out.select(group, "n", *[F.round(c, 6).alias(c) for c in ("mean", "spread", "dead", "saturated")], *[F.round(F.col("p")[i], 6).alias(k) for i, k in enumerate(("p50", "p95"))], F.round(r, 6).alias("pearson"))


def paired_design(rows: DataFrame, us: list[str], them: list[str], teacher: str, material: str) -> DataFrame:
    """rows with z0, z1, ...: half the difference of each pair of features, and d: teacher less material (NUM-01).

    A row is valid if all differences are even; of others z and d are null, so they enter no sum.
    """
    difference = [F.col(a) - F.col(b) for a, b in zip(us, them, strict=True)]
    valid = F.lit(True)
    for x in difference:
        valid = valid & (x % 2 == 0)
    valid = F.coalesce(valid, F.lit(False))
    halves = {f"z{i}": F.when(valid, (x / 2).cast("long")) for i, x in enumerate(difference)}
    return rows.withColumns({"valid": valid, "d": F.when(valid, F.col(teacher) - F.col(material))} | halves)


def forward(vectors: DataFrame, id_col: str, column: str, hidden: list[list[float]], bias: list[float], out: list[float], out_bias: float, clip: float) -> DataFrame:
    """(id, output) of a layer clipped to [0, clip] and a linear output, numpy by batches (FN-27). Weights are of fixed size; a null vector gives null."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        w, b, v = np.array(hidden).T, np.array(bias), np.array(out)
        for batch in batches:
            found = np.full(batch.num_rows, np.nan)
            there = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            if there.any():
                x = np.stack([np.asarray(r, np.float64)[: len(w)] for r in batch.column(1).drop_null().to_pylist()])
                found[there] = np.clip(x @ w + b, 0, clip) @ v + out_bias
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, mask=~there)], names=[id_col, "output"])

    rows = vectors.select(id_col, column)
    return rows.mapInArrow(run, rows.select(id_col, F.lit(None).cast("double").alias("output")).schema)
