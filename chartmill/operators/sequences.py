"""Order-dependent folds: state passes from row to row of a chart, song or job.

respace and beat_f_measure fold pieces of a group in several tasks (see pieces.py); rolling_median and sv_sections deal a
chart in blocks of frames.  early_abort's jobs are dealt by id and sorted in their partitions, which Spark does on disk
where needed, and folded batch by batch; only the state goes from one batch to the next.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ship import ship
from .frames import BLOCK, MS_PER_FRAME
from .pieces import Fold, folded, rows_of


def _sorted(df: DataFrame, key: str, *order) -> DataFrame:
    """df dealt by a key, each of its groups in one piece and in order."""
    return df.repartition(key).sortWithinPartitions(key, *order)


def _number(value: float | None) -> float:
    return math.nan if value is None else value


def _reflect(value: float, high: float) -> float:
    """Mirror a coordinate into [0, high]."""
    folded = value % (2 * high)
    return 2 * high - folded if folded > high else folded


class Respacing(Fold):
    """Steps keep their direction and get a magnitude; what keeps its place begins anew."""

    def __init__(self, alpha: float, w: int, h: int) -> None:
        super().__init__()
        self.alpha, self.w, self.h = alpha, w, h
        self.place = (0.0, 0.0)

    def begins(self, row: tuple) -> bool:
        chart, _, x, y, kind, *_ = row
        if kind & 12:
            return True
        if self.before is None:
            return False
        last, _, last_x, last_y, last_kind, *_ = self.before
        return last != chart or bool(last_kind & 8) or math.hypot(x - last_x, y - last_y) < 1e-6

    def feed(self, row: tuple, fresh: bool) -> list[tuple]:
        chart, line, x, y, _, anchors, size, _ = row
        tx, ty = float(x), float(y)
        if not fresh:
            dx, dy = x - self.before[2], y - self.before[3]
            norm = math.hypot(dx, dy)
            size = 0.0 if size is None or size != size else max(0.0, size)
            tx, ty = _reflect(self.place[0] + size * dx / norm, self.w), _reflect(self.place[1] + size * dy / norm, self.h)
            tx, ty = self.alpha * tx + (1 - self.alpha) * x, self.alpha * ty + (1 - self.alpha) * y
        self.place = tx, ty
        sx, sy = round(tx - x), round(ty - y)
        moved = bool(sx or sy)
        return [(chart, line, round(tx) if moved else x, round(ty) if moved else y, [{"x": p["x"] + sx, "y": p["y"] + sy} for p in anchors or []], moved)]


def respace(events: DataFrame, magnitudes: DataFrame, alpha: float = 1.0, w: int = 512, h: int = 384) -> DataFrame:
    """(chart_id, line_no, x, y, curve_points, moved) of events, moved so that each step has its magnitude.

    A step keeps its direction; new combos, spinners and what follows a spinner keep their place; steps without
    direction stay; walls reflect.  Anchors move with their head by the same whole pixels; what would move by none
    stays.  magnitudes: (chart_id, line_no, magnitude) of the step to the event.  What keeps its place cuts a chart into
    segments that tasks fold apart.
    """
    rows = events.select("chart_id", "line_no", "time", "x", "y", "type", "curve_points").join(magnitudes.select("chart_id", "line_no", "magnitude"), ["chart_id", "line_no"], "left")
    out = T.StructType([events.schema["chart_id"], events.schema["line_no"], T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("curve_points", T.ArrayType(T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())]))), T.StructField("moved", T.BooleanType())])
    picked = rows.select("chart_id", "line_no", "x", "y", "type", "curve_points", "magnitude", "time")
    return folded(picked, ["chart_id", "time", "line_no"], lambda: Respacing(alpha, w, h), out)


class Matching(Fold):
    """Greedy matching of two sorted sides; what waits for a partner is of one side only and within the tolerance."""

    def __init__(self, tolerance: float) -> None:
        super().__init__()
        self.tolerance = tolerance
        self.waiting: deque = deque()  # [time, rows]
        self.side: str | None = None
        self.counts = [0, 0, 0]  # hits, pred and ref rows since the last reset

    def begins(self, row: tuple) -> bool:
        if self.before is None:
            return False
        (last, then, _), (song, at, _) = self.before, row
        return last != song or at - then > self.tolerance * (1 + 1e-9) + 1e-6

    def reset(self) -> list[tuple]:
        out = [(self.before[0], *self.counts)] if self.before else []
        self.counts = [0, 0, 0]
        return out

    def feed(self, row: tuple, fresh: bool) -> list[tuple]:
        _, at, kind = row
        if fresh:
            self.waiting, self.side = deque(), None
        if kind not in ("pred", "ref"):
            return []
        self.counts[1 if kind == "pred" else 2] += 1
        waiting, tolerance = self.waiting, self.tolerance
        if self.side != kind:
            # a pred waits until tolerance after it, a ref until tolerance before the pred
            while waiting and (at > waiting[0][0] + tolerance if self.side == "pred" else waiting[0][0] < at - tolerance):
                waiting.popleft()
            if waiting:
                self.counts[0] += 1
                waiting[0][1] -= 1
                if not waiting[0][1]:
                    waiting.popleft()
                return []
            self.side = kind
        if waiting and waiting[-1][0] == at:
            waiting[-1][1] += 1
        else:
            while waiting and waiting[0][0] < at - 2 * tolerance - 1:  # no partner can come any more
                waiting.popleft()
            waiting.append([at, 1])
        return []


def beat_f_measure(beats: DataFrame, tolerance: float = 70.0) -> DataFrame:
    """(song_id, precision, recall, f) of pred against ref beats; each takes the first unused one within reach.

    Both sides come in one time order.  No match crosses a gap of more than the tolerance, so songs are cut there and
    their stretches matched apart.  Beats without a time match nothing but count.
    """
    counts = T.StructType([beats.schema["song_id"], *[T.StructField(c, T.LongType()) for c in ("hits", "pred", "ref")]])
    timed = F.col("beat_ms").isNotNull() & ~F.isnan(F.col("beat_ms").cast("double"))
    got = folded(beats.where(timed).select("song_id", F.col("beat_ms").cast("double").alias("beat_ms"), "kind"), ["song_id", "beat_ms"], lambda: Matching(tolerance), counts)
    loose = beats.where(~timed).groupBy("song_id").agg(F.lit(0).cast("long").alias("hits"), *[F.count_if(F.col("kind") == c).alias(c) for c in ("pred", "ref")])
    total = got.unionByName(loose).groupBy("song_id").agg(*[F.sum(c).alias(c) for c in ("hits", "pred", "ref")])
    share = lambda n: F.coalesce(F.try_divide(F.col("hits"), F.col(n)), F.lit(0.0))
    scored = total.select("song_id", share("pred").alias("p"), share("ref").alias("r"))
    f = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    return scored.select("song_id", F.bround("p", 4).alias("precision"), F.bround("r", 4).alias("recall"), F.bround(f, 4).alias("f"))


def early_abort(trajectories: DataFrame, monitor_frac: float = 0.7, margin: float = 0.15, floor: float = 0.55, min_candidates: int = 2) -> DataFrame:
    """(job_id, cand, aborted, abort_k, steps_saved): candidates run one after the other, steps counting down.

    At a late step a candidate stops if it trails the best completed one at that step by more than the margin and is
    below the floor, once enough have completed; one that stops leaves no mark on the best.  The state is two numbers for
    each late step of a job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def completed_best() -> tuple[array, array]:
            """The best of each step after a candidate has completed, steps counting down."""
            ks, qs, i = array("q"), array("d"), 0
            for k, q in zip(seen_k, seen_q, strict=True):
                while i < len(best_k) and best_k[i] > k:
                    ks.append(best_k[i])
                    qs.append(best_q[i])
                    i += 1
                both = i < len(best_k) and best_k[i] == k
                ks.append(k)
                qs.append(max(q, best_q[i]) if both else q)
                i += both
            ks.extend(best_k[i:])
            qs.extend(best_q[i:])
            return ks, qs

        def results() -> pa.RecordBatch:
            kinds = {"job_id": pa.int64(), "cand": pa.int32(), "aborted": pa.bool_(), "abort_k": pa.int64(), "steps_saved": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))

        started, out = False, []
        for batch in batches:
            for new_job, new_cand, k, frac, q in rows_of(batch):
                if not started or (new_job, new_cand) != (job, cand):
                    if started:
                        out.append((job, cand, stop is not None, stop, saved))
                        if stop is None:
                            completed += 1
                            best_k, best_q = completed_best()
                    if not started or new_job != job:
                        best_k, best_q, completed = array("q"), array("d"), 0
                    started, job, cand, stop, saved, at, seen_k, seen_q = True, new_job, new_cand, None, 0, 0, array("q"), array("d")
                if stop is not None:
                    saved += k is not None and k < stop
                    continue
                if k is None or _number(frac) < monitor_frac:
                    continue
                q = _number(q)
                if seen_k and seen_k[-1] == k:
                    seen_q[-1] = q
                else:
                    seen_k.append(k)
                    seen_q.append(q)
                while at < len(best_k) and best_k[at] > k:
                    at += 1
                if completed >= min_candidates and at < len(best_k) and best_k[at] == k and q < best_q[at] - margin and q < floor:
                    stop = k
            if out:
                yield results()
                out = []
        if started:
            out.append((job, cand, stop is not None, stop, saved))
            yield results()

    ship(trajectories.sparkSession)
    rows = trajectories.select("job_id", "cand", "step_k", "frac_done", "quality").where(F.col("cand").isNotNull())
    return _sorted(rows, "job_id", "cand", F.desc_nulls_last("step_k")).mapInArrow(run, "job_id long, cand int, aborted boolean, abort_k long, steps_saved long")


class Ring:
    """The values of a sliding window in order of value: each step takes one out and puts one in."""

    def __init__(self, values: list[float]) -> None:
        self.sorted, self.recent = sorted(values), deque(values)

    def step(self, value: float) -> None:
        self.sorted.pop(bisect_left(self.sorted, self.recent.popleft()))
        insort(self.sorted, value)
        self.recent.append(value)

    def median(self) -> float:
        n = len(self.sorted)
        return (self.sorted[(n - 1) // 2] + self.sorted[n // 2]) / 2


def rolling_median(frames: DataFrame, channel: str, window: int) -> DataFrame:
    """(chart_id, frame, median): the median of the channel over window frames (an odd number) around each; the first
    and last frame are repeated beyond the ends.  A chart of fewer frames than the window keeps its values.

    Frames are numbered from 0 without holes; null or NaN count as 0.  Each block of frames is dealt with half a window
    of its neighbours', so a long chart spreads over tasks; within a task a sorted ring slides over the sorted rows.
    """
    half = window // 2
    if window < 1 or window % 2 == 0:
        raise ValueError("the window is an odd number of frames")
    ship(frames.sparkSession)
    value = F.coalesce(F.nanvl(F.col(channel).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("v")
    rows = frames.select("chart_id", F.col("frame").cast("long").alias("frame"), value)
    sizes = rows.groupBy("chart_id").agg((F.max("frame") + 1).alias("size"))
    # Each frame goes to its own block, and to those whose windows reach it.
    block = lambda f: F.floor(f / BLOCK).cast("int")
    dealt = rows.join(sizes, "chart_id").withColumn("block", F.explode(F.sequence(block(F.greatest(F.lit(0), F.col("frame") - half)), block(F.least(F.col("size") - 1, F.col("frame") + half)))))

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def medians() -> pa.RecordBatch:
            chart, at, size = key
            first, last = at * BLOCK, min(size, (at + 1) * BLOCK) - 1
            lo = held[0][0]
            value = lambda f: held[min(max(f, 0), size - 1) - lo][1]
            if size < window:
                out = [value(f) for f in range(first, last + 1)]
            else:
                ring, out = Ring([value(f) for f in range(first - half, first + half + 1)]), []
                for f in range(first, last + 1):
                    if f > first:
                        ring.step(value(f + half))
                    out.append(ring.median())
            return pa.RecordBatch.from_arrays([pa.array([chart] * len(out), kind), pa.array(range(first, last + 1), pa.int64()), pa.array(out, pa.float64())], names=["chart_id", "frame", "median"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for chart, at, size, frame, v in rows_of(batch):
                if key != (chart, at, size):
                    if held:
                        yield medians()
                    key, held = (chart, at, size), []
                held.append((frame, v))
        if held:
            yield medians()

    laid = dealt.repartition("chart_id", "block").sortWithinPartitions("chart_id", "block", "frame").select("chart_id", "block", "size", "frame", "v")
    return laid.mapInArrow(slide, T.StructType([frames.schema["chart_id"], T.StructField("frame", T.LongType()), T.StructField("median", T.DoubleType())]))


class Sections:
    """Stable levels of a chart, read from its runs of equal level in order."""

    def __init__(self, apart: int, change: float, most: int) -> None:
        self.apart, self.change, self.most = apart, change, most
        self.found: list[tuple[int, float]] = []
        self.run: tuple[int, float] | None = None

    def add(self, start: int, level: float) -> None:
        self.close(start)
        self.run = start, level
        if not self.found:
            self.found.append((start, level))

    def close(self, end: int) -> None:
        """The open run ends before the frame end: a section begins in it if it is far enough, in time and level."""
        if self.run and self.found:
            start, level = self.run
            begin, last = self.found[-1]
            at = max(start, begin + self.apart)
            if at < end and abs(level - last) >= self.change:
                self.found.append((at, level))

    def result(self) -> list[tuple[int, float]]:
        """While there are too many, the nearest neighbours in log2 merge, the first of equally near ones."""
        levels = [math.log2(max(s, 1e-3)) for _, s in self.found]
        n = len(levels)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(abs(levels[i] - levels[i - 1]), i) for i in range(1, n)]
        heapify(heap)
        gone, count = [False] * n, n
        while count > self.most:
            gap, i = heappop(heap)
            if gone[i] or gap != abs(levels[i] - levels[left[i]]):
                continue
            gone[i], count = True, count - 1
            before, after = left[i], right[i]
            right[before] = after
            if after < n:
                left[after] = before
                heappush(heap, (abs(levels[after] - levels[before]), after))
        kept = [s for s, g in zip(self.found, gone, strict=True) if not g]
        return [s for i, s in enumerate(kept) if not i or abs(s[1] - kept[i - 1][1]) >= 1e-6]


def sv_sections(frames: DataFrame, smooth_ms: float = 700.0, step: float = 0.1, change: float = 0.2, min_section_s: float = 3.0, most: int = 6) -> DataFrame:
    """(chart_id, start_ms, sv): few, stable velocity sections read off the sv channel.

    The channel is smoothed by an edge-padded running median over smooth_ms (if it is that long) and quantised; a
    section begins where the level differs by change from the last section's, at least min_section_s after its begin;
    while there are too many, the nearest neighbours in log2 merge; a section like the one before it is left out.

    Medians are made in blocks of frames; only runs of equal level go on, and are read in order, chart by chart.
    """
    window = max(1, round(smooth_ms / MS_PER_FRAME) | 1)
    apart = max(1, round(min_section_s * 1000 / MS_PER_FRAME))
    ship(frames.sparkSession)
    velocity = F.pow(F.lit(2.0), 2 * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sv").cast("double"))))
    smooth = rolling_median(frames.select("chart_id", "frame", velocity.alias("v")), "v", window)
    levels = smooth.select("chart_id", "frame", (F.bround(F.col("median") / step, 0) * step).alias("level"))
    # A run begins where the level changes within a block, and at each block's first frame.
    near = Window.partitionBy("chart_id", F.floor(F.col("frame") / BLOCK)).orderBy("frame")
    runs = levels.withColumn("was", F.lag("level").over(near)).where("was is null or was != level").drop("was")
    ends = levels.groupBy("chart_id").agg((F.max("frame") + 1).alias("end"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chart, sections, end = None, None, 0

        def told() -> pa.RecordBatch:
            sections.close(end)
            kept = sections.result()
            return pa.RecordBatch.from_arrays([pa.array([chart] * len(kept), kind), pa.array([round(f * MS_PER_FRAME) for f, _ in kept], pa.int64()), pa.array([round(s, 3) for _, s in kept], pa.float64())], names=["chart_id", "start_ms", "sv"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for now, frame, level, size in rows_of(batch):
                if sections is None or now != chart:
                    if sections:
                        yield told()
                    chart, end, sections = now, size, Sections(apart, change, most)
                sections.add(frame, level)
        if sections:
            yield told()

    ordered = _sorted(runs.join(ends, "chart_id"), "chart_id", "frame").select("chart_id", "frame", "level", "end")
    return ordered.mapInArrow(read, T.StructType([frames.schema["chart_id"], T.StructField("start_ms", T.LongType()), T.StructField("sv", T.DoubleType())]))
