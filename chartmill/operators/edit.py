"""Cleaning event sequences: trimming, breaks, snapping, clamping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .metrics import in_time

CHART = "chart_id"
#: Fixed values are the defaults of the functions below: gaps and lengths in ms, shares, and the playfield's size in px.


def breaks(events: DataFrame, min_gap: float = 3500, lead_out: float = 200, lead_in: float = 400, min_len: float = 800) -> DataFrame:
    """(chart_id, start, end) inside each gap of at least min_gap ms."""
    gaps = events.withColumn("next_time", F.lead("time").over(in_time())).where(F.col("next_time") - F.col("end_time") >= min_gap)
    spans = gaps.select(CHART, F.bround(F.col("end_time") + lead_out, 0).cast("long").alias("start"), F.bround(F.col("next_time") - lead_in, 0).cast("long").alias("end"))
    return spans.where(F.col("end") - F.col("start") >= min_len)


def _drop_tail(rows: DataFrame, limit: str) -> DataFrame:
    """Rows up to the last one whose gap before it is within the limit; the first always stays."""
    gap = F.col("time") - F.lag("end_time").over(in_time())
    numbered = rows.withColumns({"gap": gap, "i": F.row_number().over(in_time())})
    chart = Window.partitionBy(CHART)
    last = F.max(F.expr(f"case when i = 1 or not coalesce(gap > {limit}, false) then i end")).over(chart)
    return numbered.withColumn("last", last).where("i <= last").drop("gap", "i", "last")


def trim_ends(events: DataFrame, max_gap: float = 3000, trail_gap: float | None = None, spinner_tail: float = 1200, lead_cluster: int = 4, tail_outlier: float = 700, tail_mult: float = 6) -> DataFrame:
    """events without ends that silence separates from the body.

    Tail: events after a gap over trail_gap; then, with at least eight gaps, after one over the greater of tail_outlier
    and tail_mult medians; then a lone circle shortly after the last spinner.  Head: all before the first gap over
    max_gap among the first lead_cluster ones.  Charts of fewer than three events stay as they are.
    """
    trail = min(max_gap, 2200.0) if trail_gap is None else trail_gap
    chart = Window.partitionBy(CHART)
    rows = events.withColumn("size", F.count("*").over(chart))
    small, rows = rows.where("size < 3").drop("size"), rows.where("size >= 3").drop("size")
    rows = _drop_tail(rows, f"{trail}D")
    gap = F.lead("time").over(in_time()) - F.col("end_time")
    real = rows.withColumn("g", gap).withColumn("g", F.when(F.col("g") >= 0, F.col("g")))
    stats = real.groupBy(CHART).agg(F.count("g").alias("gaps"), F.expr("percentile(g, 0.5D)").alias("med"))
    floor = F.expr(f"case when gaps >= 8 then greatest({tail_outlier}D, {tail_mult}D * med) else double('infinity') end")
    rows = _drop_tail(rows.join(stats.select(CHART, floor.alias("floor")), CHART), "floor").drop("floor")
    here = in_time()
    phantom = F.lead("time").over(here).isNull() & (F.row_number().over(here) > 1) & F.expr("(type & 1) != 0") & F.col("after_spinner") & (F.col("since") >= 0) & (F.col("since") < spinner_tail)
    rows = rows.withColumns({"after_spinner": F.lag(F.expr("(type & 8) != 0")).over(here), "since": F.col("time") - F.lag("end_time").over(here)})
    rows = rows.withColumn("phantom", F.coalesce(phantom, F.lit(False))).where("not phantom").drop("phantom", "after_spinner", "since")
    numbered = rows.withColumns({"i": F.row_number().over(here), "g": F.lead("time").over(here) - F.col("end_time")})
    head = F.coalesce(F.min(F.when((F.col("g") > max_gap) & (F.col("i") <= lead_cluster), F.col("i"))).over(chart), F.lit(0))
    return numbered.withColumn("head", head).where("i > head").drop("i", "g", "head").unionByName(small)


def clamp_length(events: DataFrame, gap_frac: float = 0.9) -> DataFrame:
    """events (with timing) whose sliders end before a share of the gap to the next event; at least 10 px stay."""
    speed = "slider_multiplier * 100 * sv"
    longest = f"greatest(1.0D, coalesce(lead_time, time + 100000) - time) * {gap_frac}D / beat_length * ({speed}) / greatest(1, slides)"
    applies = f"(type & 2) != 0 and length > 0 and beat_length > 0 and {speed} > 0"
    rows = events.withColumn("lead_time", F.lead("time").over(in_time()))
    return rows.withColumn("length", F.expr(f"case when {applies} and length > {longest} then greatest(10.0D, {longest}) else length end")).drop("lead_time")


def snap_events(events: DataFrame, tempo: DataFrame, divisors: tuple[int, ...] = (4,), max_snap: float | None = None) -> DataFrame:
    """events moved to the nearest grid line of the chart's first tempo, the first divisor winning ties; an end moves
    with its start.  Only events within max_snap ms (default: 60, and half the finest interval) move."""
    limit = F.lit(max_snap) if max_snap is not None else F.least(F.lit(60.0), 0.5 * F.col("beat") / max(divisors))
    rows = events.join(tempo.select(CHART, F.col("beat_length").alias("beat"), F.col("offset_ms").alias("offset")), CHART, "left")
    line = lambda d: f"offset + bround((time - offset) / (beat / {d}), 0) * (beat / {d})"
    options = ", ".join(f"named_struct('far', abs({line(d)} - time), 'ord', {i}, 'grid', {line(d)})" for i, d in enumerate(divisors))
    rows = rows.withColumn("best", F.expr(f"array_min(array({options}))"))
    moves = (F.col("best.far") > 0) & (F.col("best.far") <= limit)
    shift = F.when(F.coalesce(moves, F.lit(False)), F.bround("best.grid", 0).cast("long") - F.col("time")).otherwise(F.lit(0))
    moved = rows.withColumn("shift", shift).withColumns({"time": F.col("time") + F.col("shift"), "end_time": F.col("end_time") + F.col("shift")})
    return moved.drop("beat", "offset", "best", "shift")


def snap_slider_ends(events: DataFrame, divisor: int = 4, gap_frac: float = 0.88) -> DataFrame:
    """events (with timing) whose sliders last a whole number of beat divisions, at least one, within the gap."""
    rows = events.withColumn("lead_time", F.lead("time").over(in_time())).withColumn("iv", F.col("beat_length") / divisor)
    speed = "slider_multiplier * 100 * sv"
    applies = f"(type & 2) != 0 and length > 0 and beat_length > 0 and {speed} > 0"
    gap = "greatest(iv, coalesce(lead_time, time + 10 * beat_length) - time)"
    k = f"greatest(1.0D, least(bround((end_time - time) / iv, 0), floor({gap} * {gap_frac}D / iv)))"
    rows = rows.withColumn("k", F.expr(f"case when {applies} then {k} end"))
    new = {"length": F.expr(f"case when k is null then length else greatest(10.0D, k * iv / beat_length * ({speed}) / greatest(1, slides)) end"), "end_time": F.expr("case when k is null then end_time else cast(bround(time + k * iv, 0) as bigint) end")}
    return rows.withColumns(new).drop("lead_time", "iv", "k")


def clamp_playfield(events: DataFrame, w: int = 512, h: int = 384) -> DataFrame:
    """events with heads and anchors inside the playfield; a slider longer than its polygon ends at its edge.

    The part beyond the last anchor follows the last leg's direction; end_time shrinks with the length.
    """
    clamp = lambda c, top: F.least(F.lit(top), F.greatest(F.lit(0), c))
    slider = F.expr("(type & 2) != 0 and size(curve_points) > 0 and length > 0")
    points = F.transform("curve_points", lambda p: F.struct(clamp(p["x"], w).alias("x"), clamp(p["y"], h).alias("y")))
    rows = events.withColumns({"slider": slider, "x": clamp(F.col("x"), w), "y": clamp(F.col("y"), h), "curve_points": F.when(slider, points).otherwise(F.col("curve_points"))})
    poly = g.polygon()
    rows = rows.withColumns({"poly_len": g.total(g.legs(poly)), "a": F.get(poly, F.size(poly) - 2), "b": F.element_at(poly, -1)})
    rows = rows.withColumns({"dx": F.col("b.x") - F.col("a.x"), "dy": F.col("b.y") - F.col("a.y")}).withColumn("norm", F.hypot(F.col("dx").cast("double"), F.col("dy").cast("double")))
    edge = lambda d, p, top: f"case when {d} / norm > 1e-6 then ({top} - {p}) / ({d} / norm) when {d} / norm < -1e-6 then (0 - {p}) / ({d} / norm) else norm * 10 end"
    extra = f"case when norm < 1e-6 then 0.0D else greatest(0.0D, least(norm * 10, {edge('dx', 'b.x', w)}, {edge('dy', 'b.y', h)})) end"
    rows = rows.withColumn("new_len", F.expr(f"case when slider and length > poly_len + 0.5 then poly_len + least(length - poly_len, {extra}) end"))
    shorter = "new_len < length - 0.5"
    end = F.expr(f"case when {shorter} then time + cast(bround((end_time - time) * new_len / length, 0) as bigint) else end_time end")
    length = F.expr(f"case when {shorter} then greatest(10.0D, new_len) else length end")
    return rows.withColumns({"end_time": end, "length": length}).drop("slider", "poly_len", "a", "b", "dx", "dy", "norm", "new_len")


def heads_moved(events: DataFrame, w: int = 512, h: int = 384) -> DataFrame:
    """(chart_id, moved, reshaped): how many heads of each chart clamp_playfield moves, and how many sliders it changes."""
    kept = clamp_playfield(events.withColumns({"_x": F.col("x"), "_y": F.col("y"), "_length": F.col("length"), "_points": F.col("curve_points")}), w, h)
    moved = F.expr("x != _x or y != _y")
    slider = F.expr("(type & 2) != 0 and size(_points) > 0 and _length > 0")
    return kept.groupBy(CHART).agg(F.count_if(moved).alias("moved"), F.count_if(slider & (moved | F.expr("length != _length or curve_points != _points"))).alias("reshaped"))


def merge_green(base: DataFrame, kiai: DataFrame, sections: DataFrame) -> DataFrame:
    """(chart_id, time, beat_length, effects) of the green points that carry both velocity sections and kiai spans.

    A point stands at each change of either, no earlier than a millisecond after the base point, unless nothing
    changes there.  base: (chart_id, time, effects), kiai: (chart_id, start, end), sections: (chart_id, time, sv).
    """
    edges = sections.select(CHART, "time").union(kiai.select(CHART, "start")).union(kiai.select(CHART, "end")).distinct()
    at = edges.join(base.select(CHART, F.col("time").alias("base_time"), F.expr("effects & 1").alias("base_kiai")), CHART).withColumn("gt", F.expr("greatest(cast(time as bigint), cast(base_time as bigint) + 1)"))
    kiai = kiai.where(F.col("end") > F.col("start"))
    marks = sections.select(CHART, F.col("time").cast("double").alias("gt"), "sv", F.lit(0).alias("step"), F.lit(0).alias("kind")).union(
        kiai.select(CHART, F.col("start").cast("double"), F.lit(None).cast("double"), F.lit(1), F.lit(0))).union(kiai.select(CHART, F.col("end").cast("double"), F.lit(None).cast("double"), F.lit(-1), F.lit(0)))
    rows = at.withColumns({"kind": F.lit(1), "gt": F.col("gt").cast("double"), "row": F.col("time")}).unionByName(marks, allowMissingColumns=True)
    so_far = Window.partitionBy(CHART).orderBy("gt", "kind", "row").rowsBetween(Window.unboundedPreceding, 0)
    state = rows.withColumns({"sv_now": F.coalesce(F.last("sv", True).over(so_far), F.lit(1.0)), "open": F.coalesce(F.sum("step").over(so_far), F.lit(0))}).where("kind = 1")
    state = state.select(CHART, F.col("gt").cast("long").alias("time"), F.col("row"), F.expr("bround(-100.0D / greatest(sv_now, 1e-3D), 4)").alias("beat_length"), F.expr("cast(open > 0 as int)").alias("effects"), "base_kiai")
    order = Window.partitionBy(CHART).orderBy("time", "row")
    was = state.withColumns({"b0": F.lag("beat_length", 1, -100.0).over(order), "e0": F.coalesce(F.lag("effects").over(order), F.col("base_kiai"))})
    return was.where("beat_length != b0 or effects != e0").select(CHART, "time", "beat_length", "effects")
