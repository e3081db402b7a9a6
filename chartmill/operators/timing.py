"""Tempo and velocity in force: as-of joins as one union and one window, and what follows from them.

Control points and events of a chart are put in one order: by time, red points, then green ones, then events, then
lines.  What is in force at an event is the last value before it, so a join is one sort of both tables, whatever
the number of points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHART = "chart_id"


def velocity() -> Column:
    """Slider velocity that a control point sets: red resets it to 1."""
    return F.expr("case when not uninherited and beat_length < 0 then -100.0D / beat_length else 1.0D end")


def with_timing(events: DataFrame, points: DataFrame, charts: DataFrame) -> DataFrame:
    """events with beat_length and sv in force, duration (ms) and end_time of sliders.

    Before the first red point its tempo holds; a chart without one has 500 ms; without a point the velocity is 1.  A
    point without a time is never in force, and nothing is at an event without one.
    """
    reds = F.expr("case when uninherited then beat_length end")
    marks = points.select(CHART, F.col("time").cast("double").alias("at"), F.when(F.col("uninherited"), 0).otherwise(1).alias("kind"), "line_no", reds.alias("red"), velocity().alias("set_sv"))
    rows = events.withColumns({"at": F.col("time").cast("double"), "kind": F.lit(2)})
    order = Window.partitionBy(CHART).orderBy(F.asc_nulls_last("at"), "kind", "line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    joined = rows.unionByName(marks, allowMissingColumns=True).withColumns({"tempo": F.when(F.col("at").isNotNull(), F.last("red", True).over(so_far)), "first_red": F.first("red", True).over(whole), "last_sv": F.when(F.col("at").isNotNull(), F.last("set_sv", True).over(so_far))})
    timed = joined.where("kind = 2").withColumns({"beat_length": F.coalesce("tempo", "first_red", F.lit(500.0)), "sv": F.coalesce("last_sv", F.lit(1.0))}).drop("at", "kind", "red", "set_sv", "tempo", "first_red", "last_sv")
    speed = "slider_multiplier * 100 * sv"
    scaled = timed.join(charts.select(CHART, "slider_multiplier"), CHART)
    return scaled.withColumn("duration", F.expr(f"case when (type & 2) = 0 then 0.0D when {speed} <= 0 then 0.0D else length / ({speed}) * beat_length * slides end")).withColumn(
        "end_time", F.expr("case when (type & 8) != 0 then end_time when (type & 2) != 0 then cast(bround(time + duration, 0) as bigint) else time end")
    )


def chart_bpm(points: DataFrame) -> DataFrame:
    """(chart_id, bpm) from the first red point with a real tempo, 3 digits."""
    return primary_timing(points).select(CHART, F.expr("bround(bpm, 3)").alias("bpm"))


def primary_timing(points: DataFrame) -> DataFrame:
    """(chart_id, bpm, offset_ms, meter, beat_length) of each chart's first red point with a real tempo."""
    first = points.where("uninherited and beat_length > 0").groupBy(CHART).agg(F.min_by(F.struct("time", "meter", "beat_length"), F.struct("time", "line_no")).alias("p"))
    return first.select(CHART, (60000.0 / F.col("p.beat_length")).alias("bpm"), F.col("p.time").alias("offset_ms"), F.greatest(F.lit(1), "p.meter").alias("meter"), F.col("p.beat_length").alias("beat_length"))


def in_order() -> WindowSpec:
    """Control points in the order in which they take effect; those without a time come last."""
    return Window.partitionBy(CHART).orderBy(F.asc_nulls_last("time"), F.when(F.col("uninherited"), 0).otherwise(1), F.asc_nulls_last("line_no"))


def sv_changes(points: DataFrame) -> DataFrame:
    """(chart_id, sv_changes): how often the velocity changes by more than 0.001, beginning with 1."""
    before = F.lag("v", 1, 1.0).over(in_order())
    return points.withColumn("v", velocity()).withColumn("before", before).groupBy(CHART).agg(F.count_if(F.abs(F.col("v") - F.col("before")) > 1e-3).alias("sv_changes"))


def kiai_spans(points: DataFrame, ends: DataFrame) -> DataFrame:
    """(chart_id, start, end) from each on point to the next off point; an open span ends at ends' last_end."""
    flags = points.withColumn("kiai", F.expr("(effects & 1) != 0"))
    edges = flags.withColumn("was", F.lag("kiai", 1, False).over(in_order())).where("kiai != was")
    spans = edges.withColumn("next_time", F.lead("time").over(in_order())).where("kiai")
    return spans.join(ends.select(CHART, "last_end"), CHART, "left").select(CHART, F.col("time").alias("start"), F.coalesce("next_time", F.col("last_end").cast("double"), F.lit(0.0)).alias("end"))


def last_ends(events: DataFrame) -> DataFrame:
    """(chart_id, last_end) of the last event in time order."""
    return events.groupBy(CHART).agg(F.max_by("end_time", F.struct("time", "line_no")).alias("last_end"))


def beat_grid(points: DataFrame, durations: DataFrame) -> DataFrame:
    """(chart_id, beat_ms, is_downbeat): beats of each red point up to the next one, or to duration_ms."""
    reds = points.where("uninherited and beat_length > 0")
    until = F.lead("time").over(Window.partitionBy(CHART).orderBy("time", "line_no"))
    spans = reds.withColumn("until", until).join(durations, CHART).withColumn("until", F.coalesce("until", "duration_ms"))
    n = F.expr("cast(ceil((until - 1e-6D - time) / beat_length) as bigint)")
    beats = spans.withColumn("n", n).where("n > 0").select(CHART, "time", "beat_length", "meter", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    return beats.select(CHART, (F.col("time") + F.col("k") * F.col("beat_length")).alias("beat_ms"), (F.col("k") % F.greatest(F.lit(1), "meter") == 0).alias("is_downbeat"))


def octave_fold(bpm: str, low: float = 89.0, high: float = 205.0) -> Column:
    """A tempo outside [low, high) doubled or halved into it; 0 if it isn't positive."""
    up = f"{bpm} * power(2.0D, ceil(log2({low}D / {bpm})))"
    down = f"{bpm} / power(2.0D, floor(log2({bpm} / {high}D)) + 1)"
    return F.expr(f"case when {bpm} <= 0 then 0.0D when {bpm} < {low}D then {up} when {bpm} >= {high}D then {down} else {bpm} end")


def tempo_estimate(beats: DataFrame, key: str = "song_id", given: DataFrame | None = None) -> DataFrame:
    """(key, bpm, offset_ms) from the median time between beats, folded.

    Fewer than two beats, or a median of 0, give the tempo of given (key, bpm), folded too, or 0 without one, and two
    beats at least the offset of the first, else 0.  Songs of given without any beat are told as well.
    """
    gaps = beats.withColumn("gap", F.col("beat_ms") - F.lag("beat_ms").over(Window.partitionBy(key).orderBy("beat_ms", "line_no")))
    found = gaps.groupBy(key).agg(F.count("*").alias("n"), F.expr("percentile(gap, 0.5D)").alias("gap"), F.min("beat_ms").alias("first"))
    if given is not None:
        found = found.join(given.groupBy(key).agg(F.max(F.col("bpm").cast("double")).alias("told")), key, "full")
    told = "coalesce(told, 0.0D)" if given is not None else "0.0D"
    raw = found.withColumn("raw", F.expr(f"case when coalesce(n, 0) < 2 or gap <= 0 then {told} else 60000.0D / gap end"))
    return raw.select(key, F.bround(octave_fold("raw"), 3).alias("bpm"), F.expr("case when coalesce(n, 0) < 2 then 0.0D else bround(first, 1) end").alias("offset_ms"))


def tempo_eval(pred: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Errors of predicted tempo and offset: bpm_err, exact, octave, phase_err (ms) and bucket."""
    ratios = "array(0.25D, 0.3333333333333333D, 0.5D, 0.6666666666666666D, 1.5D, 2.0D, 3.0D, 4.0D)"
    beat = "(60000.0D / ref_bpm)"
    phase = f"pmod(pred_offset - ref_offset, {beat})"
    out = pred.selectExpr("*", "abs(pred_bpm - ref_bpm) as bpm_err", f"least({phase}, {beat} - {phase}) as phase_err")
    out = out.withColumn("exact", F.col("bpm_err") <= tolerance)
    near = f"exists({ratios}, r -> abs(pred_bpm - ref_bpm * r) <= greatest({tolerance}D, 0.02D * ref_bpm * r))"
    bucket = "case when phase_err < 5 then 'excellent' when phase_err < 10 then 'good' when phase_err < 20 then 'playable' else 'off' end"
    return out.withColumns({"octave": F.expr(f"exact or {near}"), "bucket": F.expr(bucket)})


def timing_summary(evaluated: DataFrame) -> DataFrame:
    """One row of shares, 3 digits."""
    share = lambda cond: F.expr(f"bround(avg(cast({cond} as int)), 3)")
    return evaluated.agg(
        F.count("*").alias("n"), share("exact").alias("exact_bpm_rate"), share("octave").alias("octave_rate"), share("bucket = 'excellent'").alias("offset_excellent_rate"),
        share("bucket != 'off'").alias("offset_playable_rate"), share("exact and bucket = 'excellent'").alias("exact_rate"),
    )


def grid_drift(grid: DataFrame, beats: DataFrame, key: str = "song_id") -> DataFrame:
    """(key, max_drift, mean_drift): distance of true beats from the grid offset + k * 60000 / bpm."""
    m = "pmod(beat_ms - offset_ms, 60000.0D / bpm)"
    off = beats.join(grid.where("bpm > 0"), key).withColumn("off", F.expr(f"least({m}, 60000.0D / bpm - {m})"))
    return off.groupBy(key).agg(F.max("off").alias("max_drift"), F.avg("off").alias("mean_drift"))
