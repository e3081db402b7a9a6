"""Reference bands: how metrics are distributed in each difficulty bucket, and where a chart lies in them."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import KEYS

#: Lower bounds of the star-rating buckets.
BUCKETS = [(0.0, "Easy"), (2.0, "Normal"), (2.7, "Hard"), (4.0, "Insane"), (5.3, "Expert"), (6.5, "Expert+")]


def sr_bucket(sr: Column) -> Column:
    """Difficulty bucket of a star rating; negative ratings are Expert+ like those from 6.5."""
    out = F.when((sr >= 0) & (sr < 2.0), "Easy")
    for (low, name), (high, _) in zip(BUCKETS[1:], BUCKETS[2:], strict=False):
        out = out.when((sr >= low) & (sr < high), name)
    return out.otherwise("Expert+")


def melt(metrics: DataFrame, ids: list[str], keys: list[str] | None = None) -> DataFrame:
    """(ids, metric, value) with a row for each non-null value."""
    keys = [k for k in keys or KEYS if k in metrics.columns]
    wide = metrics.select(*ids, *[F.col(k).cast("double").alias(k) for k in keys])
    return wide.unpivot(ids, keys, "metric", "value").where("value is not null")


def nearest_rank(values: DataFrame, by: list[str], value: str = "value", at: tuple[float, ...] = (0.1, 0.9)) -> DataFrame:
    """(by, p10, p90, ...): the element at floor(q * (n - 1)) of each group's sorted values, never interpolated.

    Values are counted first, so a group's window holds its distinct values only.
    """
    return ranked(values.groupBy(*by, value).agg(F.count("*").alias("_k")), by, value, at)


def ranked(counted: DataFrame, by: list[str], value: str, at: tuple[float, ...]) -> DataFrame:
    """Nearest ranks of distinct values with their counts (_k)."""
    upto = F.sum("_k").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumns({"_upto": upto, "_n": F.sum("_k").over(Window.partitionBy(*by))})
    picks = [F.min(F.when(F.col("_upto") > F.floor(F.lit(q) * (F.col("_n") - 1)), F.col(value))).alias(f"p{round(100 * q)}") for q in at]
    return placed.groupBy(*by).agg(*picks)


#: Parts into which a column is cut before its quantiles are looked up.
PARTS = 128


def quantiles(rows: DataFrame, value: str, at: tuple[float, ...], interpolated: bool = False) -> list[float | None]:
    """Exact quantiles of a whole column, by nearest rank or interpolated; None without values.

    A sketch cuts the range into PARTS about equal parts (the sketch only balances them), whose sizes tell in which part
    a rank lies.  Values are counted within the few parts that are asked for, so that no task orders the whole column.
    """
    values = rows.select(F.col(value).cast("double").alias("v")).where("v is not null")
    n, edges = values.agg(F.count("*"), F.percentile_approx("v", [i / PARTS for i in range(1, PARTS)], 1000)).first()
    if not n:
        return [None] * len(at)
    edges = sorted(set(edges))
    part = F.size(F.filter(F.lit(edges), lambda e: e < F.col("v")))
    binned = values.withColumn("part", part)
    sizes = {r.part: r["count"] for r in binned.groupBy("part").count().collect()}
    start, upto = {}, 0
    for p in sorted(sizes):
        start[p], upto = upto, upto + sizes[p]
    ranks = sorted({r for q in at for r in ((math.floor(q * (n - 1)), math.ceil(q * (n - 1))) if interpolated else (math.floor(q * (n - 1)),))})
    home = {r: max(p for p in start if start[p] <= r) for r in ranks}
    counted = binned.where(F.col("part").isin(sorted(set(home.values())))).groupBy("part", "v").count()
    seen = F.sum("count").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    picks = counted.withColumn("seen", seen).agg(*[F.min(F.when((F.col("part") == p) & (F.col("seen") > r - start[p]), F.col("v"))).alias(f"r{r}") for r, p in home.items()]).first()
    low = [picks[f"r{math.floor(q * (n - 1))}"] for q in at]
    if not interpolated:
        return low
    high, where = [picks[f"r{math.ceil(q * (n - 1))}"] for q in at], [q * (n - 1) for q in at]
    return [a if a == b else (math.ceil(w) - w) * a + (w - math.floor(w)) * b for a, b, w in zip(low, high, where, strict=True)]


def exact_mean(value: str) -> Column:
    """Mean of values of at most 6 digits, from their exact sum, to 12 digits: the same for any order of the rows."""
    return F.bround(F.sum(F.col(value).cast("decimal(20,6)")).cast("double") / F.count(value), 12)


def corpus_bands(metrics: DataFrame) -> DataFrame:
    """(bucket, metric, n, mean, std, p10, p90) of all charts; metrics needs star_rating and metric columns."""
    long = melt(metrics.where("n_objects >= 2").withColumn("bucket", sr_bucket(F.col("star_rating"))), ["bucket"])
    moments = long.groupBy("bucket", "metric").agg(F.count("*").alias("n"), F.bround(exact_mean("value"), 3).alias("mean"), F.bround(F.stddev_pop("value"), 3).alias("std"))
    ranks = nearest_rank(long, ["bucket", "metric"]).select("bucket", "metric", F.bround("p10", 3).alias("p10"), F.bround("p90", 3).alias("p90"))
    return moments.join(ranks, ["bucket", "metric"])


STATE = ["bucket", "metric", "value"]


def band_state(metrics: DataFrame) -> DataFrame:
    """(bucket, metric, value, count): all that bands need of charts, a row for each distinct value.

    States add up: merged states of two sets of charts are the state of both together.
    """
    long = melt(metrics.where("n_objects >= 2").withColumn("bucket", sr_bucket(F.col("star_rating"))), ["bucket"])
    return long.groupBy(*STATE).agg(F.count("*").alias("count"))


def merge_states(state: DataFrame, *deltas: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """state with further states added, and that of charts which are gone taken away."""
    rows = reduce(DataFrame.unionByName, [state, *deltas, *([gone.withColumn("count", -F.col("count"))] if gone is not None else [])])
    return rows.groupBy(*STATE).agg(F.sum("count").alias("count")).where("count != 0")


def bands_of(state: DataFrame) -> DataFrame:
    """(bucket, metric, n, mean, std, p10, p90), as corpus_bands has them, from a state."""
    by = ["bucket", "metric"]
    total = F.sum(F.col("value").cast("decimal(20,6)") * F.col("count")).cast("double")
    means = state.groupBy(*by).agg(F.sum("count").alias("n"), F.bround(total / F.sum("count"), 12).alias("middle"))
    away = F.col("count") * F.pow(F.col("value") - F.col("middle"), 2)
    spread = state.join(F.broadcast(means), by).groupBy(*by).agg(F.first("n").alias("n"), F.bround(F.first("middle"), 3).alias("mean"), F.bround(F.sqrt(F.sum(away) / F.first("n")), 3).alias("std"))  # a row for each band
    ranks = ranked(state.withColumnRenamed("count", "_k"), by, "value", (0.1, 0.9)).select(*by, F.bround("p10", 3).alias("p10"), F.bround("p90", 3).alias("p90"))
    return spread.join(ranks, by)


def distribution_summary(values: DataFrame, value: str) -> DataFrame:
    """One row: n, mean, median, p10, p90, min and max of a column, 4 digits; quantiles by nearest rank."""
    p10, median, p90 = (F.lit(v).cast("double") for v in quantiles(values, value, (0.1, 0.5, 0.9)))
    v = F.col(value).cast("double")
    stats = {"mean": F.avg(v), "median": median, "p10": p10, "p90": p90, "min": F.min(v), "max": F.max(v)}
    return values.agg(F.count(v).alias("n"), *[F.bround(c, 4).alias(k) for k, c in stats.items()]).where("n > 0")


def z_scores(metrics: DataFrame, bands: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """(ids, metric, value, mean, std, z, in_range) of each banded metric; z has 2 digits."""
    ids = ids or ["chart_id"]
    long = melt(metrics.withColumn("bucket", sr_bucket(F.col("star_rating"))), [*ids, "bucket"])
    z = F.bround((F.col("value") - F.col("mean")) / F.expr("coalesce(nullif(std, 0), 1e-9)"), 2)
    joined = long.join(bands, ["bucket", "metric"])
    return joined.select(*ids, "metric", "value", "mean", "std", z.alias("z"), F.col("value").between(F.col("p10"), F.col("p90")).alias("in_range"))


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """(metric, l, r) of two tables (metric, value), each metric of either."""
    return left.select("metric", F.col("value").alias("l")).join(right.select("metric", F.col("value").alias("r")), "metric", "full_outer")


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(metric, bucket, change, same_sign): relative change of band means, and whether all buckets agree in sign."""
    both = old.select("bucket", "metric", F.col("mean").alias("before")).join(new.select("bucket", "metric", F.col("mean").alias("after")), ["bucket", "metric"])
    moved = both.withColumn("change", F.bround(F.try_divide(F.col("after") - F.col("before"), F.abs("before")), 4))
    signs = moved.groupBy("metric").agg((F.countDistinct(F.signum("change")) == 1).alias("same_sign"))
    return moved.join(signs, "metric").select("metric", "bucket", "change", "same_sign")
