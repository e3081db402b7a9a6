"""Pattern metrics of charts.

Events are shuffled once, by chart; pairs and triples of neighbours are windows over that partitioning, and all
metrics of a chart are one aggregation over it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..plans.lineage import cut
from . import timing

CHART = "chart_id"
#: The metrics that corpus bands are made of.
KEYS = [
    "star_rating", "density_per_s", "circle_ratio", "slider_ratio", "spinner_ratio", "bezier_slider_ratio", "curved_slider_ratio", "new_combo_ratio",
    "mean_spacing_px", "std_spacing_px", "stream_ratio", "jump_ratio", "on_quarter_grid_ratio", "mean_turn_angle_deg", "reversal_ratio",
    "stream_spacing_cv", "slider_anchor_spread_px", "stack_ratio", "slider_overlap_ratio", "sv_changes_per_min", "kiai_ratio", "hitsound_ratio",
    "clap_ratio", "whistle_ratio", "finish_ratio",
]


def in_time() -> WindowSpec:
    """A chart's events in time order; equal times in line order."""
    return Window.partitionBy(CHART).orderBy("time", "line_no")


def type_flags(events: DataFrame) -> DataFrame:
    """events with is_circle, is_slider, is_spinner and is_new_combo."""
    return events.withColumns({name: F.col("type").bitwiseAND(bit) != 0 for name, bit in (("is_circle", 1), ("is_slider", 2), ("is_spinner", 8), ("is_new_combo", 4))})


def pair_delta(events: DataFrame) -> DataFrame:
    """events with dt and dist to the next event of the chart (null at the last)."""
    nxt = lambda c: F.lead(c).over(in_time())
    ahead = events.withColumns({"dt": nxt("time") - F.col("time"), "next_x": nxt("x"), "next_y": nxt("y")})
    return ahead.withColumn("dist", g.distance(F.col("x"), F.col("y"), F.col("next_x"), F.col("next_y"))).drop("next_x", "next_y")


def turn_angle(events: DataFrame) -> DataFrame:
    """events with turn: degrees between the legs before and after it; null at an end or if a leg is under a pixel."""
    step = {f"{d}{c}": (F.lead(c).over(in_time()) - F.col(c) if d == "out" else F.col(c) - F.lag(c).over(in_time())).cast("double") for c in "xy" for d in ("in", "out")}
    legs = events.withColumns(step).withColumns({"leg1": F.hypot("inx", "iny"), "leg2": F.hypot("outx", "outy")})
    cos = (F.col("inx") * F.col("outx") + F.col("iny") * F.col("outy")) / (F.col("leg1") * F.col("leg2"))
    turn = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))
    return legs.withColumn("turn", F.when((F.col("leg1") >= 1) & (F.col("leg2") >= 1), turn)).drop(*step, "leg1", "leg2")


def slider_overlap(events: DataFrame, charts: DataFrame, n: int = 12) -> DataFrame:
    """(chart_id, sliders, overlapping): sliders whose body comes within a circle's radius of a head that isn't a
    neighbour's.

    Heads stand in an index of distinct places, with the first and the last head there, by tiles of four radii; a place
    stands in each tile that comes within its reach.  A slider goes to the tiles that its body's points lie in, once to
    each and with those points alone, so what is shuffled is a few rows a slider and two or so a place.  The slider's own
    head and its neighbours' don't count: a place is hit if its first or its last head is none of the three.  The
    join stops at a part's first hit, and no list of places is made, which would have to be sorted for.
    """
    ranked = type_flags(events).withColumn("ord", F.row_number().over(in_time())).join(charts.select(CHART, F.greatest(F.lit(1.0), g.circle_radius(F.col("cs"))).alias("radius")), CHART)
    tile = lambda v: F.floor(v / (4 * F.col("radius")))
    tile_of = lambda p: F.struct(tile(p["px"]).alias("tx"), tile(p["py"]).alias("ty"))
    shaped = ranked.where("is_slider and size(curve_points) > 0")
    bodies = shaped.select(CHART, "ord", "radius", g.resampled(g.polygon(), n).alias("points"))
    dealt = bodies.withColumn("tile", F.explode(F.array_distinct(F.transform("points", tile_of))))
    parts = dealt.select(CHART, "tile.tx", "tile.ty", "ord", "radius", F.filter("points", lambda p: tile_of(p) == F.col("tile")).alias("points"))
    heads = ranked.groupBy(CHART, "x", "y").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.first("radius").alias("radius"))
    reach = lambda c: F.explode(F.sequence(tile(F.col(c) - F.col("radius") - 1), tile(F.col(c) + F.col("radius") + 1)))
    places = heads.withColumn("tx", reach("x")).withColumn("ty", reach("y")).drop("radius").alias("h")
    near = F.exists("points", lambda p: F.hypot(p["px"] - F.col("h.x"), p["py"] - F.col("h.y")) <= F.col("radius"))
    others = (F.col("h.first") < F.col("ord") - 1) | (F.col("h.last") > F.col("ord") + 1)
    same_tile = reduce(and_, [F.col(f"s.{c}") == F.col(f"h.{c}") for c in (CHART, "tx", "ty")])
    met = parts.alias("s").join(places, same_tile & others & near, "left_semi")
    hits = met.select(CHART, "ord").distinct().groupBy(CHART).agg(F.count("*").alias("hits"))
    sliders = shaped.groupBy(CHART).agg(F.count("*").alias("sliders"))
    return sliders.join(hits, CHART, "left").select(CHART, "sliders", F.coalesce("hits", F.lit(0)).alias("overlapping"))


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where den is 0 or null."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def chart_metrics(events: DataFrame, points: DataFrame, charts: DataFrame) -> DataFrame:
    """All metrics of each chart; a chart of fewer than two events has n_objects alone.

    events need end_time (see timing.with_timing).  Values are rounded half to even: 1 digit for pixels, degrees and
    seconds, 2 for rates, 3 for shares.
    """
    rows = type_flags(turn_angle(pair_delta(events))).join(timing.chart_bpm(points), CHART, "left")
    poly = g.polygon()
    slider = F.col("is_slider")
    shaped = slider & (F.size("curve_points") > 0)
    beats = F.when(F.col("bpm") > 0, F.col("dt") / (60000.0 / F.col("bpm")))
    rows = rows.withColumns(
        {
            "pair": F.col("dt") > 0,
            "nb": beats,
            "sagitta": F.when(slider, g.sagitta(poly)),
            "spread": F.when(shaped, F.least(F.lit(200.0), g.anchor_min_gap(poly))),
        }
    )
    pair, stream = F.col("pair"), F.col("pair") & (F.col("nb") <= 0.30) & (F.col("dist") <= 120)
    on_grid = pair & F.expr("least(abs(nb - bround(nb * 8, 0) / 8), abs(nb - bround(nb * 6, 0) / 6)) <= 0.03D")
    share = lambda cond: F.avg(cond.cast("int"))
    sums = rows.groupBy(CHART).agg(
        F.count("*").alias("n_objects"), F.max_by("end_time", F.struct("time", "line_no")).alias("last_end"), F.min("time").alias("first_time"), F.first("bpm", True).alias("bpm"),
        *[share(F.col(f"is_{k}")).alias(f"{k}_share") for k in ("circle", "slider", "spinner", "new_combo")],
        F.count_if(slider).alias("sliders"), F.count_if(slider & (F.col("curve_type") == "B")).alias("bezier"), F.count_if(F.col("sagitta") >= 10).alias("curved"),
        F.count_if(pair).alias("pairs"), F.avg(F.when(pair, F.col("dist"))).alias("mean_d"), F.stddev_pop(F.when(pair, F.col("dist"))).alias("std_d"),
        F.count_if(stream).alias("streams"), F.count_if(pair & (F.col("dist") >= 200)).alias("jumps"), F.count_if(on_grid).alias("on_grid"), F.count_if(pair & (F.col("dist") <= 3)).alias("stacks"),
        F.avg(F.when(stream, F.col("dist"))).alias("mean_s"), F.stddev_pop(F.when(stream, F.col("dist"))).alias("std_s"),
        F.avg("turn").alias("mean_turn"), F.count("turn").alias("turns"), F.count_if(F.col("turn") >= 150).alias("reversals"), F.avg("spread").alias("mean_spread"),
        *[share(F.col("hit_sound").bitwiseAND(bit) > 0).alias(f"{k}_share") for k, bit in (("hitsound", -1), ("whistle", 2), ("finish", 4), ("clap", 8))],
    )
    kiai = timing.kiai_spans(points, sums.select(CHART, "last_end")).groupBy(CHART).agg(F.sum(F.col("end") - F.col("start")).alias("kiai_ms"))
    out = sums.join(timing.sv_changes(points), CHART, "left").join(kiai, CHART, "left").join(slider_overlap(events, charts).withColumnRenamed("sliders", "shaped_sliders"), CHART, "left")
    out = out.withColumn("seconds", F.expr("coalesce(nullif((last_end - first_time) / 1000.0D, 0.0D), 1.0D)"))
    c = F.col
    values = {
        "duration_s": (c("seconds"), 1), "density_per_s": (c("n_objects") / c("seconds"), 2), "bpm": (F.coalesce("bpm", F.lit(0.0)), 3),
        **{f"{k}_ratio": (c(f"{k}_share"), 3) for k in ("circle", "slider", "spinner", "new_combo", "hitsound", "whistle", "finish", "clap")},
        "bezier_slider_ratio": (c("bezier") / F.greatest(F.lit(1), "sliders"), 3), "curved_slider_ratio": (c("curved") / F.greatest(F.lit(1), "sliders"), 3),
        "mean_spacing_px": (F.coalesce("mean_d", F.lit(0.0)), 1), "std_spacing_px": (F.coalesce("std_d", F.lit(0.0)), 1),
        "stream_ratio": (ratio(c("streams"), c("pairs")), 3), "jump_ratio": (ratio(c("jumps"), c("pairs")), 3), "on_quarter_grid_ratio": (ratio(c("on_grid"), c("pairs")), 3),
        "stack_ratio": (ratio(c("stacks"), c("pairs")), 3), "mean_turn_angle_deg": (F.coalesce("mean_turn", F.lit(0.0)), 1), "reversal_ratio": (ratio(c("reversals"), c("turns")), 3),
        "stream_spacing_cv": (F.when(c("mean_s") > 1e-6, c("std_s") / c("mean_s")).otherwise(0.0), 3), "slider_anchor_spread_px": (F.coalesce("mean_spread", F.lit(0.0)), 1),
        "sv_changes_per_min": (F.coalesce("sv_changes", F.lit(0)) / (c("seconds") / 60), 2), "kiai_ratio": (F.coalesce("kiai_ms", F.lit(0.0)) / 1000 / c("seconds"), 3),
        "slider_overlap_ratio": (ratio(c("overlapping"), c("shaped_sliders")), 3),
    }
    return out.select(CHART, "n_objects", *[F.when(c("n_objects") >= 2, F.bround(v.cast("double"), d)).alias(k) for k, (v, d) in values.items()])


def slider_shape_summary(events: DataFrame) -> DataFrame:
    """One row: mean, median and p90 of chord, path ratio and sagitta over all sliders, and shares beyond thresholds."""
    shapes = type_flags(events).where("is_slider and size(curve_points) > 0").select(g.chord(g.polygon()).alias("chord"), g.path_ratio(g.polygon()).alias("ratio"), g.sagitta(g.polygon()).alias("sagitta"))
    from .bands import quantiles

    shapes = cut(shapes)  # three columns, read for the quantiles of each
    ranks = {v: [F.lit(q).cast("double") for q in quantiles(shapes, v, (0.5, 0.9), True)] for v in ("chord", "ratio", "sagitta")}
    stats = [e for v, (median, p90) in ranks.items() for e in (F.bround(F.avg(v), 4).alias(f"{v}_mean"), F.bround(median, 4).alias(f"{v}_median"), F.bround(p90, 4).alias(f"{v}_p90"))]
    beyond = [F.expr(f"bround(avg(cast({v} >= {t} as int)), 4)").alias(f"{v}_over_{i}") for v, ts in (("ratio", (1.06, 1.15, 1.3)), ("sagitta", (10, 20, 40))) for i, t in enumerate(ts, 1)]
    return shapes.agg(F.count("*").alias("n"), *stats, *beyond)


def sv_structure(points: DataFrame) -> DataFrame:
    """(chart_id, inherited, distinct_sv, changes, min_sv, max_sv) over each chart's green points; those without a time
    come last."""
    greens = points.where("not uninherited").withColumn("v", F.bround(timing.velocity(), 2))
    greens = greens.withColumn("before", F.lag("v").over(Window.partitionBy(CHART).orderBy(F.asc_nulls_last("time"), F.asc_nulls_last("line_no"))))
    return greens.groupBy(CHART).agg(F.count("*").alias("inherited"), F.countDistinct("v").alias("distinct_sv"), F.count_if(F.col("v") != F.col("before")).alias("changes"), F.min("v").alias("min_sv"), F.max("v").alias("max_sv"))


def sv_summary(structure: DataFrame) -> DataFrame:
    """One row: medians and p90 (nearest rank) of sv_structure's counts, its extremes, and the share of charts whose
    velocity varies or isn't 1."""
    from .bands import nearest_rank

    parts = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("inherited", "distinct_sv", "changes", "max_sv")]
    ranks = nearest_rank(structure.select(F.explode(F.array(*parts)).alias("m")).select("m.*"), ["metric"], at=(0.5, 0.9))
    wide = ranks.agg(*[F.max(F.when(F.col("metric") == c, F.col(p))).alias(f"{c}_{p}") for c in ("inherited", "distinct_sv", "changes") for p in ("p50", "p90")], F.max(F.when(F.col("metric") == "max_sv", F.col("p50"))).alias("max_sv_p50"))
    varies = (F.col("distinct_sv") > 1) | (F.abs(F.col("min_sv") - 1) > 0.05) | (F.abs(F.col("max_sv") - 1) > 0.05)
    rest = structure.agg(F.count("*").alias("charts"), F.min("min_sv").alias("least_sv"), F.max("max_sv").alias("greatest_sv"), F.bround(F.avg(varies.cast("int")), 4).alias("nontrivial"))
    return rest.crossJoin(wide)  # one row each


#: Beat divisors, coarse to fine, and how far from a line of theirs (in parts of a beat) an event may stand.
DIVISORS = (1, 2, 3, 4, 6, 8, 12, 16)
ON_LINE = 0.02


def divisor_mix(timed: DataFrame) -> DataFrame:
    """(divisor, events, share): the coarsest divisor on whose grid the step to the next event lies; 0 for none.

    timed events have beat_length; steps of no time are left out."""
    nb = (F.lead("time").over(in_time()) - F.col("time")) / F.col("beat_length")
    steps = timed.select(nb.alias("nb")).where("nb > 0")
    line = F.coalesce(*[F.when(F.abs(F.col("nb") - F.bround(F.col("nb") * d, 0) / d) <= ON_LINE, d) for d in DIVISORS], F.lit(0))
    counts = steps.groupBy(line.alias("divisor")).agg(F.count("*").alias("events"))
    return counts.select("divisor", "events", F.bround(F.col("events") / F.sum("events").over(Window.partitionBy(F.lit(1))), 4).alias("share"))  # nine rows at most


def aim_intensity(onset_frames: DataFrame) -> DataFrame:
    """(audio_id, aim): mean of strength over its maximum, over .35, within [0, 1]; silence and non-finite give 0."""
    got = onset_frames.groupBy("audio_id").agg(F.avg("strength").alias("mean"), F.max("strength").alias("top"))
    aim = F.expr("case when top > 0 and not isnan(mean) and top < double('infinity') then greatest(0.0D, least(1.0D, mean / top / 0.35D)) else 0.0D end")
    return got.select("audio_id", F.bround(aim, 4).alias("aim"))


def tempo_census(points: DataFrame) -> DataFrame:
    """One row: charts, and the share of those with more than one tempo among their red points."""
    tempos = points.where("uninherited and beat_length > 0").groupBy(CHART).agg(F.countDistinct(F.expr("bround(60000.0D / beat_length, 3)")).alias("tempos"))
    return tempos.agg(F.count("*").alias("charts"), F.expr("bround(avg(cast(tempos > 1 as int)), 4)").alias("multi_tempo_share"))
