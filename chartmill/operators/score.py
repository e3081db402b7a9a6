"""Scoring charts against bands, ranking candidates, and reports about both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bands import exact_mean, melt, nearest_rank, quantiles, sr_bucket
from .metrics import in_time, type_flags

#: Families, their weights, and the weights of their metrics.
FAMILIES = {
    "rhythm": (2.0, {"on_quarter_grid_ratio": 3.0, "density_per_s": 1.5}),
    "spacing_aim": (1.0, {"mean_spacing_px": 1.0, "std_spacing_px": 1.0, "jump_ratio": 1.0}),
    "flow": (0.6, {"stream_ratio": 1.5, "mean_turn_angle_deg": 1.0, "reversal_ratio": 0.75, "stream_spacing_cv": 1.0, "stack_ratio": 0.5}),
    "slider_shape": (1.0, {"slider_ratio": 1.0, "curved_slider_ratio": 1.0, "sv_changes_per_min": 0.75, "new_combo_ratio": 0.5, "slider_anchor_spread_px": 0.75, "slider_overlap_ratio": 0.5}),
    "accents": (0.4, {"kiai_ratio": 0.5, "hitsound_ratio": 0.5}),
}


def family_weights(spark: SparkSession) -> DataFrame:
    rows = [(f, i, w, m, v) for i, (f, (w, ms)) in enumerate(FAMILIES.items()) for m, v in ms.items()]
    return spark.createDataFrame(rows, "family string, family_ord int, family_w double, metric string, metric_w double")


def band_score(value: Column, p10: Column, p90: Column) -> Column:
    """1 inside the band, falling to 0 at half a band's width outside it."""
    half = F.greatest((p90 - p10) / 2, F.lit(1e-9))
    out = F.when(value < p10, p10 - value).when(value > p90, value - p90).otherwise(0.0)
    return F.greatest(F.lit(0.0), 1 - out / half)


def metric_scores(metrics: DataFrame, bands: DataFrame, weights: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, metric, family, family_ord, family_w, metric_w, s): band score of each metric with a usable band."""
    usable = bands.where("p90 > p10").select("bucket", "metric", "p10", "p90").join(weights, "metric")
    long = melt(metrics.withColumn("bucket", sr_bucket(F.col("star_rating"))), [*ids, "bucket"])
    return long.join(usable, ["bucket", "metric"]).select(*ids, "metric", "family", "family_ord", "family_w", "metric_w", band_score(F.col("value"), F.col("p10"), F.col("p90")).alias("s"))


def families(metrics: DataFrame, bands: DataFrame, weights: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, family, family_ord, family_w, score, per_metric): weighted mean of the band scores of a family's usable
    metrics, and the entries of their map."""
    scored = metric_scores(metrics, bands, weights, ids)
    entries = F.collect_list(F.struct("metric", F.bround("s", 3).alias("s"))).alias("per_metric")
    return scored.groupBy(*ids, "family", "family_ord", "family_w").agg((F.sum(F.col("metric_w") * F.col("s")) / F.sum("metric_w")).alias("score"), entries)


def quality(metrics: DataFrame, bands: DataFrame, weights: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """(ids, quality, family, per_metric): family-weighted mean of the family scores, and the maps of family and metric
    scores; a chart without any usable band has quality 0 and empty maps."""
    ids = ids or ["chart_id"]
    entry = F.struct("family", F.bround("score", 3).alias("score"))
    maps = [F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("family"), F.map_from_entries(F.sort_array(F.flatten(F.collect_list("per_metric")))).alias("per_metric")]
    got = families(metrics, bands, weights, ids).groupBy(*ids).agg((F.sum(F.col("family_w") * F.col("score")) / F.sum("family_w")).alias("quality"), *maps)
    empty = F.create_map().cast("map<string,double>")
    return metrics.select(*ids).join(got, ids, "left").select(*ids, F.coalesce("quality", F.lit(0.0)).alias("quality"), F.coalesce("family", empty).alias("family"), F.coalesce("per_metric", empty).alias("per_metric"))


def effective_weights(weights: DataFrame) -> DataFrame:
    """(metric, weight): a metric's share of the final quality if all are usable."""
    return weights.withColumn("weight", F.col("family_w") * F.col("metric_w") / F.sum("metric_w").over(Window.partitionBy("family"))).select("metric", "weight")


def playability(events: DataFrame, limit: float = 10.0) -> DataFrame:
    """(chart_id, penalty, playability): share of pairs that need a cursor faster than limit px/ms.

    A slider is left at its end time, from its tail if it has an odd number of slides, else from its head.
    """
    leaves = type_flags(events).withColumn("shaped", F.col("is_slider") & (F.size("curve_points") > 0))
    tail = F.col("shaped") & (F.col("slides") % 2 != 0)
    at = lambda c: F.when(tail, F.element_at("curve_points", -1)[c]).otherwise(F.col(c))
    left = leaves.withColumns({"lx": at("x"), "ly": at("y"), "lt": F.when(F.col("shaped"), F.expr("coalesce(nullif(end_time, 0), time)")).otherwise(F.col("time"))})
    nxt = {f"n{c}": F.lead(c).over(in_time()) for c in ("x", "y", "time")}
    pairs = left.withColumns(nxt).withColumn("dt", F.col("ntime") - F.col("lt"))
    fast = F.hypot((F.col("lx") - F.col("nx")).cast("double"), (F.col("ly") - F.col("ny")).cast("double")) / F.col("dt") > limit
    rates = pairs.groupBy("chart_id").agg(F.count_if((F.col("dt") > 0) & fast).alias("bad"), F.count_if(F.col("dt") > 0).alias("n"))
    return rates.select("chart_id", F.coalesce(F.try_divide("bad", "n"), F.lit(0.0)).alias("penalty")).withColumn("playability", 1 - F.col("penalty"))


def sr_closeness(achieved: Column, target: Column, tolerance: float = 0.5) -> Column:
    """1 at the target, a half at the tolerance; 0 for an unknown rating."""
    return F.coalesce(1 / (1 + F.pow((achieved - target) / max(tolerance, 1e-6), 2)), F.lit(0.0))


def reward(scored: DataFrame, weight: float = 0.35, tolerance: float = 0.5) -> DataFrame:
    """scored (quality, playability, achieved_sr, target_sr) with sr_closeness and reward, 4 digits."""
    close = sr_closeness(F.col("achieved_sr"), F.col("target_sr"), tolerance)
    w = min(1.0, max(0.0, weight))
    total = ((1 - w) * F.col("quality") + w * close) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("playability")))
    return scored.withColumns({"reward": F.bround(total, 4), "sr_closeness": F.bround(close, 4), "quality": F.bround("quality", 4)})


def bottom_n(rewards: DataFrame, n: int, value: str = "reward", key: str = "chart_id") -> DataFrame:
    """The n rows with the least value; ties by key."""
    return rewards.orderBy(value, key).limit(n)


def worst_family(scores: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, family) with the least score; the first family wins ties."""
    return scores.groupBy(*ids).agg(F.min_by("family", F.struct("score", "family_ord")).alias("family"))


def best_of_n(candidates: DataFrame) -> DataFrame:
    """One row a job: winner (greatest reward, least index on ties), mean and greatest reward, lift and count."""
    out = candidates.groupBy("job_id").agg(
        F.max_by("idx", F.struct("reward", -F.col("idx"))).alias("winner"), F.bround(F.avg("reward"), 9).alias("mean_reward"), F.max("reward").alias("max_reward"), F.count("*").alias("n_completed")
    )
    return out.withColumn("lift", F.bround(F.col("max_reward") - F.col("mean_reward"), 9))


def match_attempts(attempts: DataFrame, tolerance: float = 0.4) -> DataFrame:
    """(job_id, chosen): the first attempt within the tolerance, else the closest one before the first unrated one;
    -1 if there is none."""
    upto = Window.partitionBy("job_id").orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    seen = attempts.withColumns({"stopped": F.count_if(F.col("achieved_sr").isNull()).over(upto), "err": F.abs(F.col("achieved_sr") - F.col("target_sr"))})
    live = F.col("stopped") == 0
    first = F.min(F.when(live & (F.col("err") <= tolerance), F.col("iter")))
    closest = F.min_by("iter", F.when(live, F.struct("err", "iter")))
    return seen.groupBy("job_id").agg(first.alias("first"), closest.alias("closest")).select("job_id", F.coalesce("first", "closest", F.lit(-1)).cast("long").alias("chosen"))


def best_checkpoint(log: DataFrame) -> DataFrame:
    """log with best: whether the epoch's loss is less than all before it in its run."""
    before = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    lowest = F.min("val_loss").over(before)
    return log.withColumn("best", lowest.isNull() | (F.col("val_loss") < lowest))


def calibration(rewards: DataFrame) -> DataFrame:
    """(dim, key, n, mean): mean reward overall and by bucket, 4 digits; one aggregation for all dimensions."""
    grouped = rewards.groupingSets([[], [F.col("bucket")]], "bucket").agg(F.count("*").alias("n"), F.bround(exact_mean("reward"), 4).alias("mean"), F.grouping_id().alias("level"))
    return grouped.select(F.when(F.col("level") == 1, "overall").otherwise("bucket").alias("dim"), F.coalesce("bucket", F.lit("all")).alias("key"), "n", "mean")


def calibration_report(scored: DataFrame, defects: list[str] | None = None) -> DataFrame:
    """(dim, key, n, mean, median, p10, p90, min, max): rewards, qualities and closeness overall, rewards and qualities by
    bucket, family and metric scores, defect rates and playability; quantiles by nearest rank, all with 4 digits.

    scored: reward, quality, sr_closeness, playability, bucket, the maps family and per_metric, and defect columns.
    A chart is melted to its entries, and all statistics come from their counts by value.
    """
    one = lambda dim, key, value: F.struct(F.lit(dim).alias("dim"), key.alias("key"), value.cast("double").alias("value"))
    fixed = [one("overall", F.lit(c), F.col(c)) for c in ("reward", "quality", "sr_closeness")] + [one("playability", F.lit("all"), F.col("playability"))]
    fixed += [one(f"bucket_{c}", F.col("bucket"), F.col(c)) for c in ("reward", "quality")] + [one("defect", F.lit(c), F.col(c)) for c in defects or []]
    entries = lambda column, dim: F.transform(F.map_entries(column), lambda e: one(dim, e["key"], e["value"]))
    maps = [entries("family", "family"), entries("per_metric", "metric")]
    long = scored.select(F.explode(F.concat(F.array(*fixed), *maps)).alias("e")).select("e.*").where("value is not null")
    ranks = nearest_rank(long, ["dim", "key"], at=(0.1, 0.5, 0.9))
    stats = long.groupBy("dim", "key").agg(F.count("*").alias("n"), exact_mean("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    names = {"mean": "mean", "p50": "median", "p10": "p10", "p90": "p90", "min": "min", "max": "max"}
    return stats.join(ranks, ["dim", "key"]).select("dim", "key", "n", *[F.bround(c, 4).alias(n) for c, n in names.items()])


def nested_report(report: DataFrame, scored: DataFrame, bottom: int = 20) -> DataFrame:
    """One row, as an audit is written: n_scored, overall, playability, per_bucket, per_family, per_metric, per_defect and
    bottom_n with the charts of the least rewards and their worst family.

    report is calibration_report's, of some hundred rows whatever the corpus; its statistics become structs in maps.
    """
    told = report.withColumn("s", F.struct("n", "mean", "median", "p10", "p90", "min", "max"))
    of = lambda dim, value: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("dim") == dim, F.struct("key", value))))).alias
    one = told.groupBy().agg(
        of("overall", F.col("s"))("overall"), F.first(F.when(F.col("dim") == "playability", F.col("s")), True).alias("playability"),
        of("bucket_reward", F.col("s"))("r"), of("bucket_quality", F.col("s"))("q"), of("family", F.col("s"))("per_family"), of("metric", F.col("mean"))("per_metric"), of("defect", F.col("mean"))("per_defect"),
    )
    worst = F.get(F.sort_array(F.transform(F.map_entries("family"), lambda e: F.struct(e["value"].alias("value"), e["key"].alias("key")))), F.lit(0))["key"]
    tail = scored.orderBy("reward", "chart_id").limit(bottom).select(F.struct("reward", "chart_id", worst.alias("worst_family")).alias("c"))
    tail = tail.groupBy().agg(F.sort_array(F.collect_list("c")).alias("bottom_n"))
    per_bucket = F.map_zip_with("r", "q", lambda _, r, q: F.struct(r.alias("reward"), q.alias("quality"))).alias("per_bucket")
    sizes = scored.agg(F.count("*").alias("n_scored"))
    whole = sizes.join(one, F.lit(True)).join(tail, F.lit(True))  # one row each
    return whole.select("n_scored", "overall", "playability", per_bucket, "per_family", "per_metric", "per_defect", "bottom_n")


def probe_mean(scored: DataFrame, charts: DataFrame, by: str = "audio_id", value: str = "reward") -> DataFrame:
    """One row: the mean value of the first chart of each audio file, 6 digits, and how many there are; songs without a
    scored first chart are left out."""
    first = charts.groupBy(by).agg(F.min("chart_id").alias("chart_id"))
    return scored.join(first, "chart_id", "left_semi").agg(F.bround(F.avg(value), 6).alias("probe"), F.count(value).alias("probes"))


def lever_sweep(rows: DataFrame, lever: Column, metrics: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """(knob, by, names): mean of each metric, 6 digits, for every value of a lever; metrics names columns of rows."""
    return rows.groupBy(lever.alias("knob"), *by or []).agg(*[F.bround(F.avg(c), 6).alias(n) for n, c in metrics.items()])


def best_of_n_report(candidates: DataFrame, aborted: DataFrame | None = None) -> DataFrame:
    """One row a job: winner, reward_mean, reward_max, n_completed, n_aborted, steps_saved and the rows of the candidates
    that completed, by index; aborted is early_abort's result, whose aborted candidates take no part.

    A job has a handful of candidates, so its rows are one array.
    """
    lost = None if aborted is None else aborted.where("aborted").select("job_id", F.col("cand").cast("long").alias("idx"), "steps_saved")
    live = candidates if lost is None else candidates.join(lost.select("job_id", "idx"), ["job_id", "idx"], "left_anti")
    rows = F.array_sort(F.collect_list(F.struct("idx", *[c for c in candidates.columns if c not in ("job_id", "idx")]))).alias("candidates")
    best = live.groupBy("job_id").agg(F.max_by("idx", F.struct("reward", -F.col("idx"))).alias("winner"), F.bround(F.avg("reward"), 9).alias("reward_mean"), F.max("reward").alias("reward_max"), F.count("*").alias("n_completed"), rows)
    stops = candidates.select("job_id").distinct().select("job_id", F.lit(0).alias("n_aborted"), F.lit(0).alias("steps_saved")) if lost is None else lost.groupBy("job_id").agg(F.count("*").alias("n_aborted"), F.sum("steps_saved").alias("steps_saved"))
    return best.join(stops, "job_id", "left").na.fill(0, ["n_aborted", "steps_saved"])


def next_target(current: Column, target: Column, achieved: Column) -> Column:
    """The rating to aim at next: eight tenths of the miss added, within 1 and 11; null after an unrated attempt."""
    return F.when(achieved.isNotNull(), F.least(F.lit(11.0), F.greatest(F.lit(1.0), current + 0.8 * (target - achieved))))


def target_sweep(metrics: DataFrame, bands: DataFrame, shown: list[str]) -> DataFrame:
    """(chart_id, target_sr, achieved_sr, shown metrics, in_band, scored) of charts made for a target: the bucket is that
    of the achieved rating, star_rating."""
    counts = sr_sweep(metrics, bands)
    out = metrics.join(counts, "chart_id", "left")
    return out.select("chart_id", "target_sr", F.col("star_rating").alias("achieved_sr"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in shown], F.coalesce("in_band", F.lit(0)).alias("in_band"), F.coalesce("scored", F.lit(0)).alias("scored"))


def ab_compare_without(a: DataFrame, b: DataFrame, keys: list[str], outliers: DataFrame) -> DataFrame:
    """One row: ab_compare of all, and the mean difference without the named outliers (a table of keys)."""
    calm = ab_compare(a.join(outliers, keys, "left_anti"), b, keys).select(F.col("mean_delta").alias("mean_delta_without"))
    return ab_compare(a, b, keys).crossJoin(calm)  # one row each


def ab_compare(a: DataFrame, b: DataFrame, keys: list[str], margin: float = 0.02) -> DataFrame:
    """One row: wins, losses and ties of b over a by more than the margin, and the mean difference."""
    both = a.select(*keys, F.col("reward").alias("ra")).join(b.select(*keys, F.col("reward").alias("rb")), keys).withColumn("d", F.col("rb") - F.col("ra"))
    return both.agg(F.count_if(F.col("d") > margin).alias("wins"), F.count_if(F.col("d") < -margin).alias("losses"), F.count_if(F.abs("d") <= margin).alias("ties"), F.bround(F.avg("d"), 4).alias("mean_delta"))


def norm_summary(log: DataFrame, value: str, thresholds: tuple[float, ...]) -> DataFrame:
    """One row: mean, median, p99 and maximum of a step log's column, and how many steps exceed each threshold."""
    median, p99 = (F.lit(q).cast("double") for q in quantiles(log, value, (0.5, 0.99), True))
    return log.agg(
        F.bround(F.avg(value), 4).alias("mean"), F.bround(median, 4).alias("median"), F.bround(p99, 4).alias("p99"),
        F.bround(F.max(value), 4).alias("max"), *[F.count_if(F.col(value) > t).alias(f"over_{i}") for i, t in enumerate(thresholds, 1)],
    )


def sr_sweep(metrics: DataFrame, bands: DataFrame) -> DataFrame:
    """(chart_id, in_band, scored): metrics inside the band of the chart's own bucket, of those with a band."""
    long = melt(metrics.withColumn("bucket", sr_bucket(F.col("star_rating"))), ["chart_id", "bucket"])
    return long.join(bands, ["bucket", "metric"]).groupBy("chart_id").agg(F.count_if(F.col("value").between(F.col("p10"), F.col("p90"))).alias("in_band"), F.count("*").alias("scored"))


def monotonic(sweep: DataFrame, slack: float = 0.3) -> DataFrame:
    """(job_id, monotonic): achieved ratings don't fall by more than the slack from one index to the next."""
    nxt = F.lead("achieved_sr").over(Window.partitionBy("job_id").orderBy("idx"))
    return sweep.withColumn("ok", F.coalesce(F.col("achieved_sr") <= nxt + slack, F.lit(True))).groupBy("job_id").agg(F.bool_and("ok").alias("monotonic"))
