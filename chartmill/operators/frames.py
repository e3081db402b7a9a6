"""Charts as frame tables (one row a chart and frame, one column a channel), and events back from frames.

Marks of events, spans and control points are dealt by chart and block of frames, sorted, and swept: frames are made
where the sorted marks lie, a block at a time, so a long chart spreads over tasks and no frame is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..plans.lineage import cut
from ..plans.ship import ship
from . import timing
from .metrics import in_time, type_flags

CHART = "chart_id"
#: Frame length, bump width, playfield and channel scales.
MS_PER_FRAME = 1000 * 256 / 22050
SIGMA = 1.2
WIDTH, HEIGHT = 512, 384
BUMPS = ["onset", "new_combo", "whistle", "finish", "clap"]
HOLDS = ["slider_hold", "spinner_hold", "kiai_hold"]
ANCHORS = [f"anchor{i}_{c}" for i in range(g.ANCHORS) for c in "xy"]
LAST = ["slides", "curve", "corner", *ANCHORS]
BASELINES = {**dict.fromkeys([*BUMPS, *HOLDS, "slides"], -1.0), **dict.fromkeys(["cursor_x", "cursor_y", *ANCHORS, "sv", "curve", "corner", "spacing"], 0.0)}

#: Frames that are swept at once, and the kinds of marks in the order in which a block takes them.
BLOCK = 2048
KINDS = ["spine", "bump", "hold", "kiai", "sv", "spacing", "cursor"]


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def to_frame(ms: Column) -> Column:
    return ms / MS_PER_FRAME


def frame_count(last_ms: Column, max_seconds: float = 240.0) -> Column:
    """Frames of a chart that ends at last_ms, at most those of max_seconds."""
    return F.least(F.floor(F.lit(max_seconds * 1000 / MS_PER_FRAME)), F.floor(to_frame(last_ms)) + 1).cast("int")


def covered(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """rows once for each frame from low to high, if there are any."""
    return rows.withColumns({"lo": low.cast("int"), "hi": high.cast("int")}).where("hi >= lo").withColumn("frame", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")


def marked(rows: DataFrame, kind: str, low: Column, high: Column, values: list[Column], order: tuple[Column, Column]) -> DataFrame:
    """One narrow row for each block of BLOCK frames that the frames low to high of a chart (with its size) touch."""
    lo, hi = F.greatest(F.lit(0), low.cast("int")), F.least(F.col("size") - 1, high.cast("int"))
    cells = F.array(*[v.cast("double") for v in values]).cast("array<double>")
    found = rows.select(CHART, lo.alias("lo"), hi.alias("hi"), F.lit(KINDS.index(kind)).alias("kind"), order[0].cast("double").alias("at"), order[1].cast("long").alias("then"), cells.alias("v"))
    return found.where("hi >= lo").withColumn("block", F.explode(F.sequence(F.expr(f"cast(lo div {BLOCK} as int)"), F.expr(f"cast(hi div {BLOCK} as int)"))))


def cursor_marks(shown: DataFrame) -> DataFrame:
    """Stretches between key frames, which are heads and where sliders end; before the first and after the last it rests."""
    norm = lambda c, size: clip(c / size * 2 - 1, -1.2, 1.2)
    tail = F.col("is_slider") & (F.size("curve_points") > 0) & (F.col("slides") % 2 != 0)
    end = lambda c: F.when(tail, F.element_at("curve_points", -1)[c]).otherwise(F.col(c))
    start = F.struct(F.col("f").alias("t"), F.lit(0).alias("o"), norm(F.col("x"), WIDTH).alias("x"), norm(F.col("y"), HEIGHT).alias("y"))
    stop = F.struct(F.least(F.col("size") - F.lit(1.0), to_frame(F.col("end_time"))).alias("t"), F.lit(1).alias("o"), norm(end("x"), WIDTH).alias("x"), norm(end("y"), HEIGHT).alias("y"))
    keys = shown.select(CHART, "size", "line_no", F.explode(F.when(F.col("is_slider"), F.array(start, stop)).otherwise(F.array(start))).alias("k")).select(CHART, "size", "line_no", "k.*")
    w = Window.partitionBy(CHART).orderBy("t", "line_no", "o")
    spans = keys.withColumns({"t2": F.lead("t").over(w), "x2": F.lead("x").over(w), "y2": F.lead("y").over(w), "first": F.row_number().over(w) == 1})
    low = F.when(F.col("first"), 0).otherwise(F.ceil("t"))
    high = F.when(F.col("t2").isNull(), F.col("size")).otherwise(F.ceil("t2")) - 1
    return marked(spans, "cursor", low, high, [F.col(c) for c in ("t", "x", "y", "t2", "x2", "y2")], (F.col("t"), F.col("line_no")))


def paint(canvas: dict[str, np.ndarray], kind: str, lo: np.ndarray, hi: np.ndarray, v: np.ndarray, first: int) -> None:
    """Put a block's marks of one kind, in their order, on its channels; first is the block's first frame."""
    lo, hi = np.maximum(lo - first, 0), np.minimum(hi - first, len(canvas["onset"]) - 1) + 1
    if kind == "bump":
        lengths = hi - lo
        at = np.arange(lengths.sum()) + np.repeat(lo - (np.cumsum(lengths) - lengths), lengths)
        own = np.repeat(np.arange(len(lo)), lengths)
        height = np.exp(-0.5 * ((at + first - v[own, 0]) / SIGMA) ** 2) * 2 - 1
        for c, on in zip(BUMPS, [np.ones(len(lo)), *v[:, 1:].T], strict=True):
            mine = on[own] > 0
            np.fmax.at(canvas[c], at[mine], height[mine])
        return
    for a, b, x in zip(lo.tolist(), hi.tolist(), v, strict=True):
        if kind == "hold":
            if x[0]:
                canvas["slider_hold"][a:b] = 1
                for c, value in zip(LAST, x[1:], strict=True):  # the later event's shape is held
                    canvas[c][a:b] = value
            else:
                canvas["spinner_hold"][a:b] = 1
        elif kind == "cursor":
            t, x1, y1, t2, x2, y2 = x
            frame = np.arange(a, b) + first
            part = np.where((frame <= t) | (t2 == t), 0.0, (frame - t) / (t2 - t)) if t2 == t2 and t2 != t else np.zeros(b - a)
            for c, p, q in (("cursor_x", x1, x2), ("cursor_y", y1, y2)):
                canvas[c][a:b] = np.fmax(canvas[c][a:b], p + part * ((p if q != q else q) - p))
        else:
            c, value = (kind, x[0]) if kind != "kiai" else ("kiai_hold", 1.0)
            canvas[c][a:b] = np.fmax(canvas[c][a:b], value)


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The frames of each block, from its sorted marks; a block's channels are all that is held."""
    key, canvas = None, {}

    def block() -> pa.RecordBatch:
        channels = [np.where(np.isnan(canvas[c]), base, canvas[c]).astype(np.float32) for c, base in BASELINES.items()]
        n = len(channels[0])
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, batch.schema.field(0).type), pa.array(np.arange(n, dtype=np.int32) + key[1] * BLOCK), *map(pa.array, channels)], names=[CHART, "frame", *BASELINES])

    for batch in batches:
        if not batch.num_rows:
            continue
        charts, blocks = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        kinds, lo, hi = (batch.column(i).to_numpy() for i in (2, 3, 4))
        lists = batch.column(5)
        flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        new = [i for i in range(batch.num_rows) if not i or charts[i] != charts[i - 1] or blocks[i] != blocks[i - 1] or kinds[i] != kinds[i - 1]]
        for a, b in zip(new, [*new[1:], batch.num_rows], strict=True):
            kind, now = KINDS[kinds[a]], (charts[a], int(blocks[a]))
            if kind == "spine":  # the first of a block's marks
                if canvas:
                    yield block()
                key, canvas = now, {c: np.full(min(BLOCK, int(hi[a]) - now[1] * BLOCK + 1), np.nan) for c in BASELINES}
            elif now == key:
                width = int(starts[a + 1] - starts[a])
                paint(canvas, kind, lo[a:b], hi[a:b], flat[starts[a] : starts[b]].reshape(b - a, width), now[1] * BLOCK)
    if canvas:
        yield block()


def rasterise(events: DataFrame, points: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chart_id, frame, channels) of each chart with as many frames as sizes (chart_id, size) says; events need end_time.

    Bumps are Gaussians at starts, the greatest winning; holds are 1 over a span; of overlapping sliders the later
    event's shape is held.  Events that start beyond the last frame are left out.  What is shuffled is one narrow row
    for each mark (event, span, stretch) and block of frames that it touches; frames are made block by block after it.
    """
    ship(events.sparkSession)
    sized = sizes.select(CHART, F.col("size").cast("int").alias("size")).where("size > 0")
    inside = type_flags(events).join(sized, CHART).withColumn("f", to_frame(F.col("time")))
    shown = inside.where("f < size")
    order = (F.col("time"), F.col("line_no"))
    spine = marked(sized, "spine", F.lit(0), F.col("size") - 1, [], (F.lit(0), F.lit(0)))

    accents = [F.col("is_new_combo"), *[F.col("hit_sound").bitwiseAND(b) != 0 for b in (2, 4, 8)]]
    bumps = marked(shown, "bump", F.floor(F.col("f") - 4 * SIGMA), F.ceil(F.col("f") + 4 * SIGMA), [F.col("f"), *[c.cast("int") for c in accents]], order)

    simple = shown.where("is_slider or is_spinner").withColumn("poly", g.polygon()).withColumn("simple", g.simplify(F.col("poly"))).withColumn("offsets", g.anchor_offsets("poly", "simple"))
    shape = [clip((F.col("slides") - 1) / 3, 0.0, 1.0) * 2 - 1, clip(g.sagitta(F.col("poly")) / 80, 0.0, 1.2), F.when(g.has_red_points(F.col("curve_points")), 1.0).otherwise(0.0), *[F.get("offsets", F.lit(i)) for i in range(len(ANCHORS))]]
    last = F.bround(F.least(F.col("size") - F.lit(1.0), to_frame(F.col("end_time"))), 0)
    holds = marked(simple, "hold", F.bround("f", 0), last, [F.col("is_slider").cast("int"), *[F.when(F.col("is_slider"), c) for c in shape]], order)

    spans = timing.kiai_spans(points, timing.last_ends(events)).join(sized, CHART)
    kiai = marked(spans, "kiai", F.bround(to_frame(F.col("start")), 0), F.bround(to_frame(F.col("end")), 0), [], (F.col("start"), F.lit(0)))

    sections = points.withColumns({"next_time": F.lead("time").over(timing.in_order()), "v": timing.velocity()}).join(sized, CHART)
    high = F.coalesce(F.bround(to_frame(F.col("next_time")), 0), F.col("size")) - 1
    sv = marked(sections, "sv", F.bround(to_frame(F.col("time")), 0), high, [clip(F.log2("v"), -2.0, 2.0) / 2], order)

    step = inside.withColumns({"nf": F.bround(to_frame(F.lead("time").over(in_time())), 0), "nx": F.lead("x").over(in_time()), "ny": F.lead("y").over(in_time())}).where("nf is not null")
    spacing = marked(step, "spacing", F.bround("f", 0), F.col("nf") - 1, [clip(g.distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")) / 300, 0.0, 1.2)], order)

    marks = reduce(DataFrame.unionByName, [spine, bumps, holds, kiai, sv, spacing, cursor_marks(shown)])
    laid = marks.repartition(CHART, "block").sortWithinPartitions(CHART, "block", "kind", "at", "then").select(CHART, "block", "kind", "lo", "hi", "v")
    return laid.mapInArrow(sweep, T.StructType([events.schema[CHART], T.StructField("frame", T.IntegerType()), *[T.StructField(c, T.FloatType()) for c in BASELINES]]))


def chart_sizes(events: DataFrame, max_seconds: float = 240.0) -> DataFrame:
    """(chart_id, size): each chart's own number of frames, up to its last end."""
    return events.groupBy(CHART).agg(F.max("end_time").alias("last_end")).select(CHART, frame_count(F.col("last_end"), max_seconds).alias("size"))


def stretches(frames: DataFrame, channel: str, level: bool = False) -> DataFrame:
    """(chart_id, first, last, total): frames that follow one another where they lie as one row, with the sum of the
    channel over them; with level only as long as the channel stays the same.

    Nothing is shuffled.  Frames may lie in any order and be cut anywhere: a stretch is then several rows, which touch.
    """
    ship(frames.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            chart, frame, value = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            new = np.ones(len(frame), bool)
            new[1:] = ~pc.fill_null(pc.equal(chart[1:], chart[:-1]), False).to_numpy(zero_copy_only=False) | (np.diff(frame) != 1)
            if level:
                new[1:] |= value[1:] != value[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(frame)) - 1
            yield pa.RecordBatch.from_arrays([chart.take(pa.array(first)), pa.array(frame[first]), pa.array(frame[last]), pa.array(np.add.reduceat(value, first))], names=[CHART, "first", "last", "total"])

    rows = frames.where("frame is not null").select(CHART, F.col("frame").cast("long").alias("frame"), F.coalesce(F.col(channel).cast("double"), F.lit(0.0)).alias("v"))
    return rows.mapInArrow(gather, T.StructType([frames.schema[CHART], T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("total", T.DoubleType())]))


def active_runs(frames: DataFrame, channel: str, threshold: float = 0.0) -> DataFrame:
    """(chart_id, first, last, total): contiguous frames above the threshold, and the sum of the channel over each.

    What is shuffled is one row for each stretch of frames as they lie; those that touch become one.
    """
    on = stretches(frames.where(F.col(channel) > threshold), channel)
    w = Window.partitionBy(CHART).orderBy("first")
    fresh = F.coalesce(F.col("first") - F.lag("last").over(w) > 1, F.lit(True)).cast("int")
    grouped = on.withColumn("fresh", fresh).withColumn("k", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kind = frames.schema["frame"].dataType
    return grouped.groupBy(CHART, "k").agg(F.min("first").cast(kind).alias("first"), F.max("last").cast(kind).alias("last"), F.sum("total").alias("total")).drop("k")


def merge_runs(runs: DataFrame, gap: float) -> DataFrame:
    """(chart_id, first, last): runs whose gap is at most so many frames become one."""
    w = Window.partitionBy(CHART).orderBy("first")
    fresh = F.coalesce(F.col("first") - F.lag("last").over(w) > gap, F.lit(True)).cast("int")
    grouped = runs.withColumn("fresh", fresh).withColumn("k", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(CHART, "k").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("k")


def spinner_spans(frames: DataFrame, min_frames: int = 26, min_mean: float = 0.3, merge_ms: float = 800) -> DataFrame:
    """(chart_id, first, last) of long, strong runs of the spinner channel, near ones merged."""
    strong = active_runs(frames, "spinner_hold").where((F.col("last") - F.col("first") + 1 >= min_frames) & (F.col("total") / (F.col("last") - F.col("first") + 1) > min_mean))
    return merge_runs(strong, int(merge_ms / MS_PER_FRAME))


def pick_peaks(frames: DataFrame, channel: str = "onset", threshold: float = 0.3, min_gap: int = 2) -> DataFrame:
    """(chart_id, frame, value) of local maxima at or above the threshold, at least min_gap frames after the one taken
    before; what lies beyond the ends is lower than anything."""
    w = Window.partitionBy(CHART).orderBy("frame")
    v = F.col(channel)
    # A neighbour below the threshold is no higher, so only frames at or above it are shuffled.
    high = frames.select(CHART, "frame", channel).where(v >= threshold)
    beside = lambda f, step: F.when(f("frame").over(w) == F.col("frame") + step, f(channel).over(w))
    low = F.lit(float("-inf"))
    top = high.withColumns({"l": F.coalesce(beside(F.lag, -1), low), "r": F.coalesce(beside(F.lead, 1), low)}).where((v >= F.col("l")) & (v >= F.col("r")))
    # Only candidates closer than min_gap compete: each such cluster is folded on its own.
    fresh = F.coalesce(F.col("frame") - F.lag("frame").over(w) >= min_gap, F.lit(True)).cast("int")
    clusters = top.withColumn("fresh", fresh).withColumn("k", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(CHART, "k").agg(F.sort_array(F.collect_list(F.struct("frame", v.alias("value")))).alias("c"))
    empty = F.slice("c", 1, 0)
    taken = F.aggregate("c", empty, lambda acc, x: F.when((F.size(acc) == 0) | (x["frame"] - F.element_at(F.concat(F.slice("c", 1, 1), acc), -1)["frame"] >= min_gap), F.concat(acc, F.array(x))).otherwise(acc))
    return clusters.select(CHART, F.explode(taken).alias("p")).select(CHART, "p.frame", "p.value")


def outside_spans(peaks: DataFrame, spans: DataFrame) -> DataFrame:
    """Peaks that no span (chart_id, first, last) of their chart covers.

    Points and span begins stand in one order; a point is covered if the furthest end of the spans begun so far isn't
    before it.  Spans may overlap and repeat.
    """
    names = [c for c in peaks.columns if c != CHART]
    points = peaks.select(CHART, F.col("frame").alias("at"), F.lit(1).alias("turn"), F.lit(None).cast("long").alias("last"), F.struct(*names).alias("row"))
    edges = spans.select(CHART, F.col("first").alias("at"), F.lit(0).alias("turn"), F.col("last").cast("long").alias("last"))
    upto = F.max("last").over(Window.partitionBy(CHART).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0))
    both = points.unionByName(edges, allowMissingColumns=True).withColumn("upto", upto)
    return both.where("turn = 1 and (upto is null or upto < at)").select(CHART, *[F.col(f"row.{c}").alias(c) for c in names])


def with_next_begin(peaks: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """peaks with the first begin of a span after each; null without one."""
    names = [c for c in peaks.columns if c != CHART]
    points = peaks.select(CHART, F.col("frame").alias("at"), F.lit(0).alias("turn"), F.lit(None).cast("int").alias("begin"), F.struct(*names).alias("row"))
    edges = spans.select(CHART, F.col("first").alias("at"), F.lit(1).alias("turn"), F.col("first").alias("begin"))
    # Backwards, a point comes before a span that begins at it, so that only later ones count.
    ahead = F.min("begin").over(Window.partitionBy(CHART).orderBy(F.desc("at"), "turn").rowsBetween(Window.unboundedPreceding, 0))
    both = points.unionByName(edges, allowMissingColumns=True).withColumn("ahead", ahead)
    return both.where("turn = 0").select(CHART, *[F.col(f"row.{c}").alias(c) for c in names], F.col("ahead").alias(name))


def with_hold(peaks: DataFrame, runs: DataFrame, ahead: int = 3) -> DataFrame:
    """peaks with off, the first frame at or after each that no run (chart_id, first, last; they don't touch) covers, and
    held: whether a run covers it or one of the ahead frames after it."""
    names = [c for c in peaks.columns if c != CHART]
    points = peaks.select(CHART, F.col("frame").alias("at"), F.lit(0).alias("turn"), F.struct(*names).alias("row"))
    edges = runs.select(CHART, F.col("last").alias("at"), F.lit(1).alias("turn"), F.struct("first", "last").alias("run"))
    # Backwards, a run's end comes before the points at it or before it; the last one seen is the next run.
    seen = F.last("run", True).over(Window.partitionBy(CHART).orderBy(F.desc("at"), F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    both = points.unionByName(edges, allowMissingColumns=True).withColumn("next", seen).where("turn = 0")
    first = F.col("next.first")
    off, held = F.when(first <= F.col("at"), F.col("next.last") + 1).otherwise(F.col("at")), F.coalesce(first <= F.col("at") + ahead, F.lit(False))
    return both.select(CHART, *[F.col(f"row.{c}").alias(c) for c in names], off.alias("off"), held.alias("held"))


def decode_kiai(frames: DataFrame, threshold: float = 0.0, min_ms: float = 1500, merge_ms: float = 1000, max_spans: int = 3) -> DataFrame:
    """(chart_id, start, end) in ms of the strongest merged runs of the kiai channel, by mean; earlier ones win ties."""
    merged = merge_runs(active_runs(frames, "kiai_hold", threshold), merge_ms / MS_PER_FRAME).where(F.col("last") - F.col("first") >= min_ms / MS_PER_FRAME)
    cells = covered(merged, F.col("first"), F.col("last"))
    strength = cells.join(frames.select(CHART, "frame", "kiai_hold"), [CHART, "frame"]).groupBy(CHART, "first", "last").agg(F.avg(F.col("kiai_hold").cast("double")).alias("mean"))
    rank = F.row_number().over(Window.partitionBy(CHART).orderBy(F.desc(F.bround("mean", 9)), "first"))
    ms = lambda c: F.bround(F.col(c) * MS_PER_FRAME, 0).cast("long")
    return strength.withColumn("r", rank).where(F.col("r") <= max_spans).select(CHART, ms("first").alias("start"), ms("last").alias("end"))


def span_mean(frames: DataFrame, spans: DataFrame, channel: str) -> DataFrame:
    """spans (chart_id, first, last) with the mean of a channel over each; those that don't begin and end at a frame of
    their chart are left out.

    Stretches of one level and the ends of spans stand in one order, with the sum of all stretches begun so far; of the
    last one, what lies beyond an end is taken off.  Frames themselves aren't shuffled.
    """
    names = [c for c in spans.columns if c != CHART]
    level = stretches(frames, channel, True)
    parts = level.select(CHART, F.col("first").alias("at"), F.lit(0).alias("turn"), F.struct("first", "last", "total").alias("part"))
    ends = F.explode(F.array(*[F.struct(F.col(c).cast("long").alias("at"), F.lit(i).alias("turn")) for i, c in enumerate(("first", "last"), 1)]))
    edges = spans.select(CHART, F.struct(*names).alias("span"), ends.alias("e")).select(CHART, "e.*", "span")
    so_far = Window.partitionBy(CHART).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    both = parts.unionByName(edges, allowMissingColumns=True).withColumns({"upto": F.sum("part.total").over(so_far), "now": F.last("part", True).over(so_far)}).where("turn > 0")
    upto = F.expr("case when now.last >= at then upto - now.total * (now.last + case when turn = 1 then 1 else 0 end - at) / (now.last - now.first + 1) end")
    means = both.withColumn("upto", upto).groupBy(CHART, "span").agg(F.max(F.when(F.col("turn") == 1, F.col("upto"))).alias("a"), F.max(F.when(F.col("turn") == 2, F.col("upto"))).alias("b"), F.count_if(F.col("turn") == 1).cast("int").alias("n"))
    again = F.explode(F.array_repeat(F.lit(0), F.col("n")))  # a repeated span has a row each
    return means.where("a is not null and b is not null").withColumn("again", again).select(CHART, *[F.col("span")[c].alias(c) for c in names], ((F.col("b") - F.col("a")) / (F.col("span.last") - F.col("span.first") + 1)).alias("mean"))


def decode_spacing(frames: DataFrame, events: DataFrame) -> DataFrame:
    """(chart_id, line_no, magnitude): the distance in px that the spacing channel sets for the step to each event, its
    mean over the gap before it; 0 for the first.  Charts whose channel is all but zero have no rows."""
    trained = frames.groupBy(CHART).agg(F.max(F.abs("spacing")).alias("top"), (F.max("frame") + 1).alias("size")).where("top >= 1e-3")
    here = in_time()
    steps = events.withColumn("before", F.lag("time").over(here)).join(trained.select(CHART, "size"), CHART)
    first = F.greatest(F.lit(0), F.least(F.col("size") - 1, F.bround(to_frame(F.col("before")), 0))).cast("int")
    gaps = steps.withColumn("first", first).withColumn("last", (F.greatest(F.col("first") + 1, F.least(F.col("size"), F.bround(to_frame(F.col("time")), 0))) - 1).cast("int"))
    means = span_mean(frames, gaps.where("before is not null").select(CHART, "line_no", "first", "last"), "spacing")
    out = steps.select(CHART, "line_no").join(means.select(CHART, "line_no", "mean"), [CHART, "line_no"], "left")
    return out.select(CHART, "line_no", F.coalesce(clip(F.col("mean"), 0.0, 1.2) * 300, F.lit(0.0)).alias("magnitude"))


def training_windows(frames: DataFrame, length: int, seed: int = 0) -> DataFrame:
    """frames of one window of each chart, renumbered from 0: a crop whose start an md5 of seed and chart chooses, or
    all and a padding of baselines."""
    sizes = frames.groupBy(CHART).agg((F.max("frame") + 1).alias("size"))
    start = F.when(F.col("size") > length, F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(CHART).cast("string"))), 1, 15), 16, 10).cast("long") % (F.col("size") - length + 1)).otherwise(0).cast("int")
    spine = sizes.select(CHART, start.alias("start"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("i"))
    own = spine.withColumn("frame", F.col("start") + F.col("i"))
    channels = [c for c in BASELINES if c in frames.columns]
    return own.join(frames.select(CHART, "frame", *channels), [CHART, "frame"], "left").select(CHART, F.col("i").alias("frame"), *[F.coalesce(c, F.lit(BASELINES[c]).cast("float")).alias(c) for c in channels])


def mirror(frames: DataFrame) -> DataFrame:
    """frames four times: as they are and mirrored in x, in y and in both; anchors mirror with the cursor."""
    flips = F.explode(F.expr("array(named_struct('fx', 1, 'fy', 1), named_struct('fx', -1, 'fy', 1), named_struct('fx', 1, 'fy', -1), named_struct('fx', -1, 'fy', -1))"))
    out = frames.withColumn("flip", flips)
    return out.withColumns({c: F.col(c) * F.col(f"flip.f{c[-1]}") for c in ["cursor_x", "cursor_y", *ANCHORS] if c in frames.columns})


def spacing_ratio(frames: DataFrame, events: DataFrame) -> DataFrame:
    """(chart_id, channel_mean, cursor_mean, ratio): spacing that the channel holds against that of the heads, in px."""
    channel = frames.where("spacing > 0").groupBy(CHART).agg((F.avg(F.col("spacing").cast("double")) * 300).alias("channel_mean"))
    heads = events.withColumns({"nx": F.lead("x").over(in_time()), "ny": F.lead("y").over(in_time())}).groupBy(CHART).agg(F.avg(g.distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))).alias("cursor_mean"))
    return heads.join(channel, CHART, "left").select(CHART, F.coalesce("channel_mean", F.lit(0.0)).alias("channel_mean"), F.coalesce("cursor_mean", F.lit(0.0)).alias("cursor_mean")).withColumn("ratio", F.col("channel_mean") / F.greatest("cursor_mean", F.lit(1.0)))


def recover_gaps(peaks: DataFrame, frames: DataFrame, channel: str = "onset", threshold: float = 0.3, min_gap: int = 2, share: float = 0.5, tolerance: float = 0.34, longest: int = 14) -> DataFrame:
    """peaks with those that a regular run seems to lack: where a gap is about twice the short one before it, the
    strongest frame around the missing beat, if the channel has at least a share of the threshold there."""
    w = Window.partitionBy(CHART).orderBy("frame")
    gaps = peaks.withColumns({"before": F.col("frame") - F.lag("frame").over(w), "after": F.lead("frame").over(w) - F.col("frame")})
    holes = gaps.where((F.col("before") > 0) & (F.col("before") <= longest) & (F.abs(F.col("after") - 2 * F.col("before")) <= F.col("before") * tolerance))
    reach = F.greatest(F.lit(1), F.floor(F.col("before") / 3))
    probes = holes.select(CHART, F.col("frame").alias("peak"), "after", (F.col("frame") + F.col("before") - reach).alias("low"), (F.col("frame") + F.col("before") + reach).alias("high"))
    strong = frames.select(CHART, "frame", F.col(channel).alias("value")).where(F.col("value") >= threshold * share)
    cells = covered(probes, F.greatest(F.lit(0), "low"), F.col("high")).drop("low", "high").join(strong, [CHART, "frame"])
    best = cells.groupBy(CHART, "peak", "after").agg(F.max_by(F.struct("frame", "value"), F.struct("value", -F.col("frame"))).alias("p")).select(CHART, "peak", "after", "p.*")
    found = best.where((F.col("frame") - F.col("peak") >= min_gap) & (F.col("peak") + F.col("after") - F.col("frame") >= min_gap))
    return peaks.select(CHART, "frame", "value").union(found.select(CHART, "frame", "value")).dropDuplicates([CHART, "frame"])


def decode_events(frames: DataFrame, onset: float = 0.3, min_gap: int = 2, min_slider: int = 4, accent: float = 0.85) -> DataFrame:
    """Events from frames: spinners from long runs, then a circle or slider at each onset outside them.

    A slider needs a hold within four frames that lasts min_slider frames before the next onset or spinner.  Its shape
    and slides come from the means of the anchor, curve, corner and slides channels over it; frames without anchor
    channels give a straight line to where the cursor is at its end, at least 10 px long.
    """
    spans = cut(spinner_spans(frames))  # few rows a chart, read by several branches, as are the peaks
    peaks = cut(recover_gaps(cut(pick_peaks(frames, "onset", onset, min_gap)), frames, "onset", onset, min_gap))
    n = frames.groupBy(CHART).agg((F.max("frame") + 1).alias("size"))
    nxt = F.lead("frame").over(Window.partitionBy(CHART).orderBy("frame"))
    ordered = peaks.select(CHART, "frame", nxt.alias("next_peak")).join(n, CHART).withColumn("next_peak", F.coalesce("next_peak", "size"))
    shown = outside_spans(ordered, spans)
    limits = with_next_begin(shown, spans, "spin").select(CHART, "frame", F.least("next_peak", "spin").alias("until"))
    # The first frame without a hold at or after each onset, and whether one of four frames is held, from the runs of holds.
    holds = active_runs(frames, "slider_hold").select(CHART, "first", "last")
    drawn_at = frames.select(CHART, "frame", "cursor_x", "cursor_y", "new_combo", "whistle", "finish", "clap").where(F.col("onset") >= min(onset, onset * 0.5))  # a recovered one has half at least
    at = with_hold(limits, holds).join(drawn_at, [CHART, "frame"])
    at = at.withColumn("end", F.greatest(F.col("frame") + 1, F.least(F.col("off") - 1, F.col("until") - 1)))
    slider = F.col("held") & (F.col("end") - F.col("frame") >= min_slider)
    xy = lambda c, size: F.bround((F.col(c).cast("double") + 1) / 2 * size, 0)
    place = lambda c, size: clip(xy(c, size), 0, size).cast("int")
    ms = lambda c: F.bround(F.col(c) * MS_PER_FRAME, 0).cast("long")
    sound = sum((F.when(F.col(c) > accent, b).otherwise(0) for c, b in (("whistle", 2), ("finish", 4), ("clap", 8))), F.lit(0))
    combo = F.when(F.col("new_combo") > 0, 4).otherwise(0)
    heads = at.withColumns({"is": F.coalesce(slider, F.lit(False)), "x": place("cursor_x", WIDTH), "y": place("cursor_y", HEIGHT)})
    none = F.array().cast(g.POINTS)
    if set(ANCHORS) <= set(frames.columns):
        read = [c for c in (*ANCHORS, "slides", "curve", "corner") if c in frames.columns]
        inside = frames.where("slider_hold > 0" if min_slider > 1 else "true").select(CHART, "frame", *read)  # a slider lies within a hold
        held = covered(heads.where("is").select(CHART, F.col("frame").alias("head"), "end"), F.col("head"), F.col("end")).join(inside, [CHART, "frame"])
        means = held.groupBy(CHART, F.col("head").alias("frame")).agg(*[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in read])
        wide = heads.where("is").join(means, [CHART, "frame"]).withColumn("offsets", F.array(*[F.col(f"mean_{c}") for c in ANCHORS]))
        cues = {c: f"mean_{c}" if c in read else None for c in ("curve", "corner", "slides")}
        wide = wide.withColumn("mean_curve", clip(F.col("mean_curve"), 0.0, 1.2) * 80) if cues["curve"] else wide
        drawn = g.slider_shape(wide, "x", "y", "offsets", cues["curve"], cues["corner"])
        count = F.bround((clip(F.col("mean_slides"), -1.0, 1.0) + 1) / 2 * 3, 0).cast("int") + 1 if cues["slides"] else F.lit(1)
        sliders = drawn.select(CHART, "frame", "curve_type", "curve_points", "length", count.alias("slides"))
    else:
        tails = frames.select(CHART, F.col("frame").alias("end"), place("cursor_x", WIDTH).alias("ex"), place("cursor_y", HEIGHT).alias("ey"))
        ends = heads.where("is").join(tails, [CHART, "end"], "left").withColumns({"ex": F.coalesce("ex", "x"), "ey": F.coalesce("ey", "y")})
        sliders = ends.select(CHART, "frame", F.lit("L").alias("curve_type"), F.array(F.struct(F.col("ex").alias("x"), F.col("ey").alias("y"))).cast(g.POINTS).alias("curve_points"), F.greatest(F.lit(10.0), g.distance(F.col("x"), F.col("y"), F.col("ex"), F.col("ey"))).alias("length"), F.lit(1).alias("slides"))
    events = heads.drop("slides").join(sliders, [CHART, "frame"], "left").select(
        CHART, F.col("frame").cast("long").alias("line_no"), ms("frame").alias("time"), "x", "y", (F.when(F.col("is"), 2).otherwise(1) + combo).alias("type"), sound.alias("hit_sound"), "curve_type",
        F.coalesce("curve_points", none).alias("curve_points"), F.coalesce("slides", F.lit(1)).alias("slides"), F.coalesce("length", F.lit(0.0)).alias("length"), F.when(F.col("is"), ms("end")).otherwise(ms("frame")).alias("end_time"),
    )
    spinners = spans.select(CHART, F.col("first").cast("long").alias("line_no"), ms("first").alias("time"), F.lit(256).alias("x"), F.lit(192).alias("y"), F.lit(8).alias("type"), F.lit(0).alias("hit_sound"), F.lit(None).cast("string").alias("curve_type"), none.alias("curve_points"), F.lit(1).alias("slides"), F.lit(0.0).alias("length"), ms("last").alias("end_time"))
    return events.unionByName(spinners)
