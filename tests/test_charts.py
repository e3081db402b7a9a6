"""Chart operators on small inputs with known results."""

import hashlib
import math
import random
import statistics
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chartmill.functions import geometry as g
from chartmill.operators import bands, components, curation, edit, frames, metrics, score, sequences, timing
from chartmill.sources import charts as io

POINTS = "chart_id long, line_no long, time double, beat_length double, meter int, uninherited boolean, effects int"
EVENTS = "chart_id long, line_no long, time long, x int, y int, type int, hit_sound int, curve_type string, curve_points array<struct<x:int,y:int>>, slides int, length double, end_time long"
SAMPLE = """file format v14

[General]
AudioFilename: audio.mp3
Mode: 0
[Metadata]
Title:Song
Artist:Someone: else
Version:Hard
[Difficulty]
SliderMultiplier:1.4
CircleSize:bad
[Events]
//Background
0,0,"bg.jpg",0,0
[TimingPoints]
0,500,4,2,0,100,1,0
1000,-50,4,2,0,100,0,0
[HitObjects]
garbage,line
256,192,0,1,0,0:0:0:0:
100,100,1000,2,0,L|300:100,1,200
256,192,3000,12,0,5000,0:0:0:0:
1,2,4000.9,2,x
"""


def points(spark, rows, chart=1):
    return spark.createDataFrame([(chart, i, float(t), float(bl), 4, red, eff) for i, (t, bl, red, eff) in enumerate(rows)], POINTS)


def circles(spark, rows, chart=1, kind=1):
    return spark.createDataFrame([(chart, i, t, x, y, kind, 0, None, [], 1, 0.0, t) for i, (t, x, y) in enumerate(rows)], EVENTS)


def chart(spark, cs=4.0, sr=3.0):
    return spark.createDataFrame([(1, cs, 1.4, sr)], "chart_id long, cs double, slider_multiplier double, star_rating double")


def measured(spark, events, pts, cs=4.0):
    c = chart(spark, cs)
    return metrics.chart_metrics(timing.with_timing(events, pts, c), pts, c).first()


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("charts") / "1 Song"
    folder.mkdir()
    (folder / "a [Hard].chart").write_text(SAMPLE)
    return io.read_charts(spark, str(folder.parent))


def test_parser(sample):
    charts, pts, events = sample
    c = charts.first()
    assert (c.folder, c.filename, c.title, c.artist, c.slider_multiplier, c.cs, c.ar) == ("1 Song", "a [Hard].chart", "Song", "Someone: else", 1.4, 5.0, 5.0)
    rows = timing.with_timing(events, pts, charts).orderBy("time").collect()
    assert [r.type & 11 for r in rows] == [1, 2, 8, 2] and rows[1].sv == 2.0 and abs(rows[1].duration - 200 / 280 * 500) < 2
    assert (rows[2].end_time, rows[3].time, rows[3].curve_points, rows[3].hit_sound) == (5000, 4000, [], 0)
    assert pts.where("uninherited").count() == 1


def test_background(spark, tmp_path):
    (tmp_path / "x.chart").write_text(SAMPLE)
    assert io.background_ref(io.section_lines(io.chart_scan(spark, str(tmp_path)))).first().background == "bg.jpg"


def test_export_round_trip(spark, sample, tmp_path):
    charts, pts, events = sample
    timed = timing.with_timing(events, pts, charts)
    none = spark.createDataFrame([], "chart_id long, start long, end long")
    io.export_charts(charts, timed, pts, none, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"{r.chart_id}.txt".replace("/", "%2F").replace(":", "%3A") for r in charts.collect()]
    again = io.section_lines(io.chart_scan(spark, str(tmp_path / "out"), "*.txt"))
    key = ["time", "x", "y", "length", "slides", "curve_points"]
    want = sorted(tuple(r) for r in events.where("line_no < 25").select(*key).where("length > 0 or (type & 2) = 0").collect())
    assert want == sorted(tuple(r) for r in io.event_table(again).select(*key).where("time != 4000").collect())
    assert io.control_point_table(again).select("time", "beat_length", "uninherited").collect() == pts.select("time", "beat_length", "uninherited").collect()


def test_stacked_points(spark):
    pts = points(spark, [(0, 500, True, 0), (1000, -50, False, 0), (1000, 400, True, 0)])
    r = timing.with_timing(circles(spark, [(1000, 0, 0)], kind=2), pts, chart(spark)).first()
    assert (r.sv, r.beat_length) == (2.0, 400.0)
    early = timing.with_timing(circles(spark, [(-5, 0, 0)]), pts, chart(spark)).first()
    assert (early.sv, early.beat_length) == (1.0, 500.0)


def test_kiai_and_bpm(spark):
    pts = points(spark, [(0, 400, True, 0), (2000, -100, False, 1), (4000, -100, False, 0)])
    assert timing.chart_bpm(pts).first().bpm == 150
    ends = timing.last_ends(circles(spark, [(0, 0, 0), (5000, 0, 0)]))
    assert [(r.start, r.end) for r in timing.kiai_spans(pts, ends).collect()] == [(2000, 4000)]
    open_ = points(spark, [(0, 400, True, 1)])
    assert [(r.start, r.end) for r in timing.kiai_spans(open_, ends).collect()] == [(0, 5000)]


def test_stream_and_jumps(spark):
    pts = points(spark, [(0, 400, True, 0)])
    m = measured(spark, circles(spark, [(100 * i, 100 + 10 * i, 100) for i in range(8)]), pts)
    assert m.bpm == 150 and m.stream_ratio > 0.8 and m.on_quarter_grid_ratio > 0.8 and m.stream_spacing_cv < 0.05
    m = measured(spark, circles(spark, [(200 * i, 400 * (i % 2), 192) for i in range(5)]), pts)
    assert m.jump_ratio > 0.8 and m.reversal_ratio > 0.8 and m.mean_turn_angle_deg > 150 and m.stream_ratio == 0 and m.stream_spacing_cv == 0
    m = measured(spark, circles(spark, [(100 * i, 40 * i, 0) for i in range(6)]), pts)
    assert m.mean_turn_angle_deg < 10 and m.reversal_ratio == 0
    m = measured(spark, circles(spark, [(0, 1, 1)]), pts)
    assert m.n_objects == 1 and m.density_per_s is None


@pytest.mark.parametrize(("step", "low", "high"), [(100, 1, 1), (50, 1, 1), (400 / 6, 0.8, 1), (80, 0, 0.2)])
def test_grid_credit(spark, step, low, high):
    m = measured(spark, circles(spark, [(round(step * i), 10 * i, 0) for i in range(9)]), points(spark, [(0, 400, True, 0)]))
    assert low <= m.on_quarter_grid_ratio <= high


def test_geometry(spark):
    shape = "x int, y int, curve_points array<struct<x:int,y:int>>"
    rows = [(0, 0, [(50, 0), (100, 0)]), (0, 0, [(50, 80), (100, 0)]), (0, 0, [(1, 1), (2, 0)]), (0, 0, []), (0, 0, [(10, 0), (10, 0), (20, 5)]), (0, 0, [(30, 40), (0, 0)])]
    got = spark.createDataFrame(rows, shape).select(g.sagitta(g.polygon()).alias("s"), g.anchor_min_gap(g.polygon()).alias("a"), g.has_red_points(g.polygon()).alias("r"), g.path_ratio(g.polygon()).alias("p")).collect()
    assert [round(r.s, 6) for r in got][:4] == [0, 80, 1, 0] and got[5].s == 50
    assert got[0].a == 50 and got[2].a < 4 and got[3].a == float("inf")
    assert [r.r for r in got] == [False, False, False, False, True, False] and got[0].p == 1.0
    radius = spark.createDataFrame([(4.0,), (5.0,)], "cs double").select(g.circle_radius(F.col("cs")).alias("r")).collect()
    assert [round(r.r, 2) for r in radius] == [36.48, 32.0]


def test_band_score(spark):
    got = spark.createDataFrame([(float(v),) for v in (100, 120, 200, 210, 260, 1000)], "v double").select(score.band_score(F.col("v"), F.lit(100.0), F.lit(200.0)).alias("s")).collect()
    s = [r.s for r in got]
    assert s[:3] == [1, 1, 1] and s[4] < s[3] < 1 and s[5] == 0


def test_buckets(spark):
    rows = spark.createDataFrame([(v,) for v in (1.5, 2.6, 3.7, 5.0, 6.0, 8.0, 0.0, 50.0, -1.0)], "sr double").select(bands.sr_bucket(F.col("sr")).alias("b")).collect()
    assert [r.b for r in rows] == ["Easy", "Normal", "Hard", "Insane", "Expert", "Expert+", "Easy", "Expert+", "Expert+"]


def test_nearest_rank(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in range(1, 13)] + [("b", 5.0)] * 3, "k string, value double")
    got = {r.k: (r.p10, r.p90) for r in bands.nearest_rank(rows, ["k"]).collect()}
    assert got == {"a": (2.0, 10.0), "b": (5.0, 5.0)}


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_bands_same_for_any_layout(spark, parts):
    r = random.Random(0)
    rows = spark.createDataFrame([(i, 60, round(r.uniform(0, 8), 2), round(r.uniform(0, 300), 1)) for i in range(200)], "chart_id long, n_objects int, star_rating double, mean_spacing_px double")
    got = sorted(map(tuple, bands.corpus_bands(rows.repartition(parts)).collect()))
    assert got == sorted(map(tuple, bands.corpus_bands(rows.coalesce(1)).collect()))


def test_status_join(spark):
    charts = spark.createDataFrame([("17 Harbour", "a"), ("17 Harbour", "b")], "folder string, filename string")
    status = spark.createDataFrame([("17 Harbour", "a", 4, 0), ("17 Harbour", "b", 2, 0), ("18 Away", "c", 4, 0), ("17 Harbour", "b", 4, 3)], "folder string, filename string, status int, mode int")
    assert [r.filename for r in curation.ranked_join(charts, status).collect()] == ["a"]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    parent = {n: n for e in edges if None not in e for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {n for n in parent if all(a == b for a, b in edges if n in (a, b))}
    assert got == {n: find(n) for n in parent if n not in loops}


def test_split_does_not_leak(spark):
    titles = ["Paper Lantern", "paper  lantern!!", "North Pier", "North Pier", "north pier"] + [f"single {i}" for i in range(10)]
    audio = ["x", "y", "a1", "a2", "a1"] + [f"s{i}" for i in range(8)] + ["z", "z"]
    items = spark.createDataFrame([(i, t, a) for i, (t, a) in enumerate(zip(titles, audio, strict=True))], "item_id long, title string, audio_id string")
    groups = curation.song_groups(items)
    by = {r.item_id: r.group for r in groups.collect()}
    assert by[0] == by[1] and by[2] == by[3] == by[4] and by[13] == by[14] and len(by) == 15
    for seed in (1, 2, 3):
        split = curation.grouped_split(groups, 0.3, seed)
        sides = {r.item_id: r.side for r in split.collect()}
        assert len(sides) == 15 and sum(s == "val" for s in sides.values()) >= 4
        assert curation.leaks(items, split).count() == 0
        assert sides == {r.item_id: r.side for r in curation.grouped_split(groups, 0.3, seed).collect()}
    assert curation.grouped_split(groups, 0.0).where("side = 'val'").count() == 0


def test_beat_grid(spark):
    durations = spark.createDataFrame([(1, 5000.0)], "chart_id long, duration_ms double")
    one = timing.beat_grid(points(spark, [(1000, 500, True, 0)]), durations).orderBy("beat_ms").collect()
    assert [r.beat_ms for r in one] == [1000 + 500 * i for i in range(8)] and [r.beat_ms for r in one if r.is_downbeat] == [1000, 3000]
    two = timing.beat_grid(points(spark, [(1000, 500, True, 0), (3000, 400, True, 0)]), durations).collect()
    downs = {r.beat_ms for r in two if r.is_downbeat}
    assert {3000.0, 4600.0} <= downs and {1500.0, 3400.0} <= {r.beat_ms for r in two}


def test_timing_scores(spark):
    pred = spark.createDataFrame([(120.0, 1000.0, 120.0, 1000.0), (240.0, 1000.0, 120.0, 1000.0), (120.0, 1007.0, 120.0, 1000.0), (120.0, 1250.0, 120.0, 1000.0)], "pred_bpm double, pred_offset double, ref_bpm double, ref_offset double")
    got = timing.tempo_eval(pred).collect()
    assert [(r.exact, r.octave, r.bucket) for r in got] == [(True, True, "excellent"), (False, True, "excellent"), (True, True, "good"), (True, True, "off")]
    beats = spark.createDataFrame([(1, i, 1010.0 + 500 * i) for i in range(8)], "song_id long, line_no long, beat_ms double")
    grid = spark.createDataFrame([(1, 120.0, 1000.0)], "song_id long, bpm double, offset_ms double")
    assert timing.grid_drift(grid, beats).first().max_drift == pytest.approx(10)
    estimate = timing.tempo_estimate(beats).first()
    assert (estimate.bpm, estimate.offset_ms) == (120, 1010)


def plain_f(pred, ref, tol=70):
    used, hits = [False] * len(ref), 0
    for p in sorted(pred):
        for k, r in enumerate(sorted(ref)):
            if not used[k] and abs(r - p) <= tol:
                used[k], hits = True, hits + 1
                break
    return hits


def test_f_measure(spark):
    r = random.Random(2)
    rows, want = [], {}
    for song in range(30):
        pred, ref = ([float(r.randrange(2000)) for _ in range(r.randrange(0, 15))] for _ in range(2))
        rows += [(song, b, "pred") for b in pred] + [(song, b, "ref") for b in ref]
        want[song] = plain_f(pred, ref) / len(pred) if pred else 0
    got = {x.song_id: x.precision for x in sequences.beat_f_measure(spark.createDataFrame(rows, "song_id long, beat_ms double, kind string")).collect()}
    assert all(abs(got[s] - want[s]) < 1e-4 for s in got)


def test_octave_fold(spark):
    rows = spark.createDataFrame([(v,) for v in (0.0, 44.0, 89.0, 120.0, 205.0, 410.0, 30.0, 1000.0)], "b double").select(timing.octave_fold("b").alias("f")).collect()
    assert [r.f for r in rows] == [0, 176, 89, 120, 102.5, 102.5, 120, 125]


def test_edit(spark):
    lone = circles(spark, [(100 * i, 0, 0) for i in range(12)] + [(9000, 0, 0)])
    assert edit.trim_ends(lone).count() == 12
    intro = circles(spark, [(0, 0, 0)] + [(8000 + 100 * i, 0, 0) for i in range(12)])
    assert edit.trim_ends(intro).count() == 12
    assert edit.trim_ends(circles(spark, [(0, 0, 0), (90000, 0, 0)])).count() == 2
    assert [(r.start, r.end) for r in edit.breaks(circles(spark, [(0, 0, 0), (5000, 0, 0), (6000, 0, 0)])).collect()] == [(200, 4600)]
    tempo = timing.primary_timing(points(spark, [(0, 400, True, 0)]))
    moved = edit.snap_events(circles(spark, [(97, 0, 0), (150, 0, 0), (200, 0, 0)]), tempo).orderBy("line_no").collect()
    assert [r.time for r in moved] == [100, 200, 200]
    out = edit.clamp_playfield(spark.createDataFrame([(1, 0, 0, 500, 200, 2, 0, "L", [(520, 200)], 1, 300.0, 1000)], EVENTS)).first()
    assert (out.x, out.curve_points[0].x, out.length, out.end_time) == (500, 512, 12.0, 40)


def test_winner_and_abort(spark):
    rows = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.9), (1, 2, 0.9)], "job_id long, idx int, reward double")
    assert score.best_of_n(rows).first().winner == 1
    steps = [(1, c, k, 1 - k / 4, q) for c, q in ((0, 0.9), (1, 0.8), (2, 0.3), (3, 0.6), (4, 0.7)) for k in (3, 2, 1)]
    got = {r.cand: (r.aborted, r.abort_k) for r in sequences.early_abort(spark.createDataFrame(steps, "job_id long, cand int, step_k int, frac_done double, quality double")).collect()}
    assert got == {0: (False, None), 1: (False, None), 2: (True, 1), 3: (False, None), 4: (False, None)}


def test_frames_round_trip(spark):
    pts = points(spark, [(0, 500, True, 0), (1000, -50, False, 1), (2600, -100, False, 0)])
    rows = [(1, 0, 200, 256, 192, 1, 2, None, [], 1, 0.0, 200), (1, 1, 1000, 100, 100, 2, 0, "L", [(300, 100)], 1, 200.0, 1000), (1, 2, 3000, 256, 192, 12, 0, None, [], 1, 0.0, 5000)]
    c = chart(spark)
    events = timing.with_timing(spark.createDataFrame(rows, EVENTS), pts, c)
    f = frames.rasterise(events, pts, c.select("chart_id", F.lit(600).alias("size"))).cache()
    assert f.count() == 600
    ms = [r.frame * frames.MS_PER_FRAME for r in frames.outside_spans(frames.pick_peaks(f), frames.spinner_spans(f)).orderBy("frame").collect()]
    assert [round(t / 20) for t in ms] == [10, 50]
    spin = frames.spinner_spans(f).first()
    assert abs(spin["first"] * frames.MS_PER_FRAME - 3000) < 12 and abs(spin["last"] * frames.MS_PER_FRAME - 5000) < 12
    assert [(round(r.start, -2), round(r.end, -2)) for r in frames.decode_kiai(f).collect()] == [(1000, 2600)]
    at = {r.frame: r for r in f.collect()}
    assert at[0].cursor_x == pytest.approx(0) and at[90].slider_hold == 1 and at[90].sv == pytest.approx(0.5) and at[550].onset == -1
    assert frames.training_windows(f, 700).count() == 700 and frames.training_windows(f, 100).count() == 100
    assert frames.mirror(f).where("frame = 90").select(F.sum("cursor_x").alias("s")).first().s == pytest.approx(0)


def test_peak_refractory(spark):
    rows = [(1, i, v) for i, v in enumerate([0.9, 0.9, 0.9, 0.9, -1.0, 0.5, 0.2, 0.8])]
    got = frames.pick_peaks(spark.createDataFrame(rows, "chart_id long, frame int, onset double"), min_gap=2).orderBy("frame").collect()
    assert [r.frame for r in got] == [0, 2, 5, 7]


def test_respace(spark):
    events = circles(spark, [(0, 100, 100), (100, 110, 100), (200, 120, 100), (300, 130, 100)])
    sizes = spark.createDataFrame([(1, i, 100.0) for i in range(4)], "chart_id long, line_no long, magnitude double")
    assert [r.x for r in sequences.respace(events, sizes).orderBy("line_no").collect()] == [100, 200, 300, 400]
    assert [r.x for r in sequences.respace(events, sizes, alpha=0.0).orderBy("line_no").collect()] == [100, 110, 120, 130]


def plain_respace(rows, alpha):
    """(line_no, time, x, y, type, magnitude) of a chart, moved."""
    rows, out = sorted(rows, key=lambda r: (r[1], r[0])), []
    for k, (line, _, x, y, kind, size) in enumerate(rows):
        tx, ty = x, y
        if k:
            dx, dy = x - rows[k - 1][2], y - rows[k - 1][3]
            norm = (dx * dx + dy * dy) ** 0.5
            if not (kind & 12 or rows[k - 1][4] & 8) and norm:
                tx, ty = sequences._reflect(out[-1][1] + size / norm * dx, 512), sequences._reflect(out[-1][2] + size / norm * dy, 384)
        out.append((line, alpha * tx + (1 - alpha) * x, alpha * ty + (1 - alpha) * y))
    return out


def plain_abort(rows):
    """(cand, step_k, frac_done, quality) of a job."""
    best, completed, out = {}, 0, {}
    for c in sorted({r[0] for r in rows}):
        steps, stop = sorted((r for r in rows if r[0] == c), key=lambda r: -r[1]), None
        for _, k, frac, q in steps:
            if frac >= 0.7 and completed >= 2 and k in best and q < best[k] - 0.15 and q < 0.55:
                stop = k
                break
        if stop is None:
            completed += 1
            for _, k, frac, q in steps:
                if frac >= 0.7:
                    best[k] = max(q, best.get(k, q))
        out[c] = (stop is not None, stop, 0 if stop is None else sum(k < stop for _, k, _, _ in steps))
    return out


def test_folds_by_batch(spark):
    r, whole = random.Random(3), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(whole)
    spark.conf.set(whole, 7)
    try:
        # one id has most of the rows
        ids = [0] * 300 + [r.randrange(1, 6) for _ in range(60)]
        moves = {}
        for line, c in enumerate(ids):
            moves.setdefault(c, []).append((line, r.randrange(2000), r.randrange(513), r.randrange(385), r.choice((1, 1, 1, 2, 5, 8)), float(r.randrange(300))))
        rows = spark.createDataFrame([(c, *m) for c, ms in moves.items() for m in ms], "chart_id long, line_no long, time long, x int, y int, type int, magnitude double").withColumn("curve_points", F.expr("array(named_struct('x', x + 1, 'y', y))"))
        moved = sequences.respace(rows.drop("magnitude"), rows.select("chart_id", "line_no", "magnitude"), 0.7)
        got = {(x.chart_id, x.line_no): (x.x, x.y) for x in moved.collect()}
        assert all(abs(x.curve_points[0].x - x.x - 1) <= 1 and abs(x.curve_points[0].y - x.y) <= 1 for x in moved.collect())
        want = {(c, line): (x, y) for c, ms in moves.items() for line, x, y in plain_respace(ms, 0.7)}
        assert got.keys() == want.keys() and all(abs(got[k][i] - want[k][i]) < 0.51 for k in want for i in (0, 1))

        beats = [(c, float(r.randrange(3000)), r.choice(("pred", "ref"))) for c in ids]
        scored = sequences.beat_f_measure(spark.createDataFrame(beats, "song_id long, beat_ms double, kind string"))
        got = {x.song_id: (x.precision, x.recall) for x in scored.collect()}
        sides = {c: [[b for s, b, k in beats if (s, k) == (c, kind)] for kind in ("pred", "ref")] for c in set(ids)}
        assert got == {c: tuple(round(plain_f(p, q) / len(n), 4) if n else 0.0 for n in (p, q)) for c, (p, q) in sides.items()}

        jobs = {j: [(c, k, 1 - k / n, round(r.random(), 2)) for c in range(6) for k in range(1, n + 1) if r.random() < 0.9] for j, n in ((0, 90), (1, 8), (2, 5))}
        stopped = sequences.early_abort(spark.createDataFrame([(j, *s) for j, steps in jobs.items() for s in steps], "job_id long, cand int, step_k int, frac_done double, quality double"))
        assert {(x.job_id, x.cand): (x.aborted, x.abort_k, x.steps_saved) for x in stopped.collect()} == {(j, c): v for j, steps in jobs.items() for c, v in plain_abort(steps).items()}
        # no group is gathered in one frame
        assert all("FlatMapGroupsInPandas" not in d._jdf.queryExecution().toString() for d in (moved, scored, stopped))

        # the hot id is cut into pieces: with few rows a piece, and with all in one, the results are the same
        coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
        spark.conf.set(coalesce, "false")
        for shuffles in ("1", "7", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
            again = sequences.respace(rows.drop("magnitude"), rows.select("chart_id", "line_no", "magnitude"), 0.7)
            assert sorted(map(repr, again.collect())) == sorted(map(repr, moved.collect()))
            gapped = [(c, b * 9 if c else b, k) for c, b, k in beats] + [(7, None, "pred"), (7, float("nan"), "ref"), (None, 5.0, "ref")]
            scored = sequences.beat_f_measure(spark.createDataFrame(gapped, "song_id long, beat_ms double, kind string"))
            got = {x.song_id: (x.precision, x.recall) for x in scored.collect()}
            sides = {c: [[b for s, b, k in gapped if (s, k) == (c, kind) and b is not None and b == b] for kind in ("pred", "ref")] for c in set(ids)}
            assert got == {c: tuple(round(plain_f(p, q) / len(n), 4) if n else 0.0 for n in (p, q)) for c, (p, q) in sides.items()} | {7: (0.0, 0.0), None: (0.0, 0.0)}
    finally:
        spark.conf.set(whole, before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_hot_group_moves_little_twice(spark):
    """One chart of all rows: what is folded in the second step is heads and states alone."""
    from chartmill.operators import pieces

    seen = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = pieces.stored
        pieces.stored = lambda df: seen.append(stored(df)[0]) or (seen[-1], "")
        events = circles(spark, [(10 * i, i % 500, 5 * (i % 70)) for i in range(4000)]).withColumn("type", F.expr("if(line_no % 9 = 0, 5, 1)"))
        sizes = events.select("chart_id", "line_no", F.lit(30.0).alias("magnitude"))
        assert sequences.respace(events, sizes).count() == 4000
        told = seen[0].where("piece is not null")
        assert told.where("state is not null").count() == 8 and told.count() <= 8 + 8 * 9
        beats = spark.createDataFrame([(1, 400.0 * i + j, k) for i in range(1500) for j, k in ((0, "ref"), (20, "pred"))], "song_id long, beat_ms double, kind string")
        r = sequences.beat_f_measure(beats).first()
        assert (r.precision, r.recall, r.f) == (1.0, 1.0, 1.0)
        assert seen[1].where("piece is not null and state is null").count() <= 8 * 2
    finally:
        pieces.stored = stored
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_attempts_and_checkpoints(spark):
    rows = [(1, i, a, 4.5) for i, a in enumerate((3.0, 4.7, 4.4))] + [(2, 0, 3.0, 4.5), (2, 1, 4.0, 4.5), (2, 2, None, 4.5), (2, 3, 4.5, 4.5)] + [(3, 0, None, 4.5)]
    got = {r.job_id: r.chosen for r in score.match_attempts(spark.createDataFrame(rows, "job_id long, iter int, achieved_sr double, target_sr double")).collect()}
    assert got == {1: 1, 2: 1, 3: -1}
    log = spark.createDataFrame([(1, e, v) for e, v in enumerate((0.5, 0.4, 0.4, 0.3))], "run int, epoch int, val_loss double")
    assert [r.best for r in score.best_checkpoint(log).orderBy("epoch").collect()] == [True, True, False, True]


def shaped(spark, offsets, curve, corner, x=100, y=100):
    row = spark.createDataFrame([(x, y, [float(v) for v in offsets], curve, corner)], "x int, y int, o array<double>, curve double, corner double")
    r = g.slider_shape(row, "x", "y", "o", "curve", "corner").first()
    return r.curve_type, [(p.x, p.y) for p in r.curve_points], round(r.length, 3)


def test_slider_shapes(spark):
    at = lambda *pts: [v for x, y in pts for v in ((x - 100) / 512, (y - 100) / 384 + 1e-9)]
    assert shaped(spark, at((200, 100), (200, 100), (200, 100)), 0.0, 0.0) == ("L", [(200, 100)], 100.0)
    assert shaped(spark, at((100, 100), (100, 100), (100, 100)), 0.0, 0.0) == ("L", [(110, 100)], 10.0)  # fallen together
    bent = shaped(spark, at((150, 160), (200, 100), (200, 100)), 60.0, 0.0)
    assert bent == ("B", [(150, 160), (200, 100)], round(2 * (50**2 + 60**2) ** 0.5, 3))
    angular = shaped(spark, at((150, 160), (200, 100), (200, 100)), 60.0, 1.0)
    assert angular[:2] == ("B", [(150, 160), (150, 160), (200, 100)])
    bowed = shaped(spark, at((200, 100), (200, 100), (200, 100)), 40.0, 0.0)  # the bow gets its px
    assert bowed[0] == "B" and bowed[1] == [(150, 140), (200, 100)]
    assert shaped(spark, at((200, 100), (200, 100), (200, 100)), 999.0, 0.0)[1][0] == (150, 230)  # no more than 130 px
    assert shaped(spark, at((150, 160), (200, 100), (200, 100)), 3.0, 0.0)[:2] == ("L", [(200, 100)])  # a low cue is straight


def test_sliders_survive_frames(spark):
    """Sliders with anchors and repeats, through frames and back."""
    anchors = [[(150, 200)], [(150, 200), (250, 120)], [(120, 250), (250, 260), (300, 100)]]
    rows = [(1, i, 1000 + 1500 * i, 100, 100, 2, 0, "B" if i else "L", pts, 1 + i, 120.0, 2000 + 1500 * i) for i, pts in enumerate(anchors)]
    schema = "chart_id long, line_no long, time long, x int, y int, type int, hit_sound int, curve_type string, curve_points array<struct<x:int,y:int>>, slides int, length double, end_time long"
    charts = spark.createDataFrame([(1, 700)], "chart_id long, size int")
    points = spark.createDataFrame([(1, 0, 0.0, 500.0, 4, True, 0)], "chart_id long, line_no long, time double, beat_length double, meter int, uninherited boolean, effects int")
    table = frames.rasterise(spark.createDataFrame(rows, schema), points, charts)
    got = frames.decode_events(table).orderBy("time").collect()
    assert [r.slides for r in got] == [1, 2, 3] and [r.curve_type for r in got] == ["L", "B", "B"]
    for r, pts in zip(got, anchors, strict=True):
        told = [(p.x, p.y) for p in r.curve_points]
        assert len(told) == len(pts) and all(abs(a - c) <= 1 and abs(b - d) <= 1 for (a, b), (c, d) in zip(told, pts, strict=True))
    no_anchors = frames.decode_events(table.drop(*frames.ANCHORS)).collect()
    assert all(r.curve_type == "L" and len(r.curve_points) == 1 for r in no_anchors)


def test_stores(spark, tmp_path):
    from chartmill.sources import stores

    (tmp_path / "bands.json").write_text('{"n_maps": 3, "buckets": {"Easy": {"a": {"mean": 1.5, "p10": 1.0, "p90": 2.0, "n": 3}, "b": {"p10": 1.0, "p90": 1.0}, "c": {"p10": 0.0, "p90": 4.0}}, "Hard": {"a": {"p10": null, "p90": 2.0}}}}')
    got = {(r.bucket, r.metric): (r.n, r["mean"]) for r in stores.read_bands(spark, str(tmp_path / "bands.json")).collect()}
    assert got == {("Easy", "a"): (3, 1.5), ("Easy", "c"): (None, 2.0)}
    with pytest.raises(ValueError, match="p90"):
        stores.usable_bands(spark.createDataFrame([("Easy", "a", 1.0)], "bucket string, metric string, p10 double"))
    (tmp_path / "bare.json").write_text('["x", "y"]')
    (tmp_path / "told.json").write_text('{"val_frac": 0.1, "val_item_ids": ["z"]}')
    ids = lambda p: sorted(r.item_id for r in stores.read_split(spark, str(p)).collect())
    assert ids(tmp_path / "bare.json") == ["x", "y"] and ids(tmp_path / "told.json") == ["z"]
    split = spark.createDataFrame([("a", "val"), ("b", "train"), ("c", "val")], "item_id string, side string")
    stores.write_split(split, str(tmp_path / "split"), 0.5, 7)
    assert ids(tmp_path / "split") == ["a", "c"]
    assert spark.read.parquet(str(tmp_path / "split/provenance")).first().asDict() == {"val_frac": 0.5, "seed": 7, "n_total": 3, "n_val": 2, "n_train": 1}
    (tmp_path / "old.csv").write_text("run,epoch,val_loss\nr,1,0.5\nr,x,0.4\n")
    (tmp_path / "new.csv").write_text("run,epoch,train_loss,val_loss,val_loss_ema\nr,2,0.3,0.4,0.41\n")
    old, new = (stores.read_training_log(spark, str(tmp_path / f)).collect() for f in ("old.csv", "new.csv"))
    assert [(r.epoch, r.val_loss, r.val_loss_ema) for r in old + new] == [(1, 0.5, None), (2, 0.4, 0.41)]
    table = spark.createDataFrame([(c, f, 0.5) for c in range(5) for f in range(3)], "chart_id long, frame int, onset float")
    stores.write_frames(table, str(tmp_path / "frames"), 2)
    back = stores.read_frames(spark, str(tmp_path / "frames"))
    assert back.schema["onset"].dataType.simpleString() == "float" and sorted(back.collect()) == sorted(table.collect())
    stores.write_report(score.best_of_n_report(spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.75)], "job_id long, idx long, reward double")), str(tmp_path / "report"))
    report = spark.read.json(str(tmp_path / "report")).first()
    assert (report.winner, report.reward_mean, report.n_completed, report.n_aborted) == (1, 0.625, 2, 0) and [c.idx for c in report.candidates] == [0, 1]


def test_data_set_build(spark, tmp_path):
    from chartmill.plans import dataset

    charts = spark.createDataFrame([(c, "set 1!", f"map {c}.chart", 7, 0, 4.0, 1.4, 3.0 if c < 4 else 0.5) for c in range(1, 5)], "chart_id long, folder string, filename string, audio_id long, mode int, cs double, slider_multiplier double, star_rating double")
    rows = [(c, i, 500 * i, 100 + 30 * (i % 5), 100, 1 + 4 * (i % 4 == 0), 2, None, [], 1, 0.0, 500 * i) for c in range(1, 5) for i in range(60 if c != 2 else 5)]
    events = spark.createDataFrame(rows, "chart_id long, line_no long, time long, x int, y int, type int, hit_sound int, curve_type string, curve_points array<struct<x:int,y:int>>, slides int, length double, end_time long")
    points = spark.createDataFrame([(c, 0, 0.0, 500.0, 4, True, 1) for c in range(1, 5)], "chart_id long, line_no long, time double, beat_length double, meter int, uninherited boolean, effects int")
    status = charts.select("folder", "filename", F.lit(4).alias("status"), "mode")
    manifest, outcomes = dataset.build(charts, points, events, status)
    kept = manifest.orderBy("chart_id").collect()
    assert [r.chart_id for r in kept] == [1, 3] and {r.outcome: r.charts for r in outcomes.collect()} == {"kept": 2, "star_rating": 1}
    assert all(r.item_id.startswith("set_1__map_") and len(r.audio_key) == 16 and r.bucket == "Hard" for r in kept) and kept[0].item_id != kept[1].item_id
    dataset.write(manifest, events, points, str(tmp_path / "set"))
    sizes = {r.chart_id: r["count"] for r in spark.read.parquet(str(tmp_path / "set/frames")).groupBy("chart_id").count().collect()}
    assert sizes == {r.chart_id: r.frames for r in kept} and kept[0].frames == int(29_500 / frames.MS_PER_FRAME) + 1
    short, _ = dataset.build(charts, points, events, status, max_seconds=10.0)
    assert {r.frames for r in short.collect()} == {int(10_000 / frames.MS_PER_FRAME)}


def test_charts_of_one_path_keep_ids_apart(spark):
    from chartmill.plans import dataset

    charts = spark.createDataFrame([(c, "Set", "Map.chart" if c % 2 else "map.chart", 7 + c % 2, 0, 4.0, 1.4, 3.0) for c in range(1, 6)], "chart_id long, folder string, filename string, audio_id long, mode int, cs double, slider_multiplier double, star_rating double")
    events = spark.createDataFrame([(c, i, 500 * i, 100 + 30 * (i % 5), 100, 1, 2, None, [], 1, 0.0, 500 * i) for c in range(1, 6) for i in range(60)], EVENTS)
    points = spark.createDataFrame([(c, 0, 0.0, 500.0, 4, True, c % 2) for c in range(1, 6)], POINTS)
    onsets = spark.createDataFrame([(7, f, v) for f, v in enumerate((0.1, 0.1, 1.0, 0.2))], "audio_id long, frame int, strength double")
    manifest, _ = dataset.build(charts, points, events, charts.select("folder", "filename", F.lit(4).alias("status"), "mode"), {"require_kiai": False}, onsets=onsets)
    rows = {r.chart_id: r for r in manifest.collect()}
    assert len({r.item_id for r in rows.values()}) == 5 and {r.frames for r in rows.values()} == {int(29_500 / frames.MS_PER_FRAME) + 1}
    assert {c: (r.has_kiai, r.n_timing_points, r.n_uninherited, r.bpm) for c, r in rows.items()} == {c: (c % 2 == 1, 1, 1, 120.0) for c in rows}
    assert {c: r.aim_intensity for c, r in rows.items()} == {c: 1.0 if c % 2 == 0 else 0.0 for c in rows}


def test_charts_are_as_long_as_themselves(spark):
    """Charts of different lengths, one of many blocks, equal to a plain rendering."""
    rows = [(c, i, t, (7 * t) % 513, (3 * t) % 385, 2 if i % 3 == 0 else 5 if i % 3 == 1 else 8, 2 * (i % 8), "L" if i % 3 == 0 else None, [(10, 20)] if i % 3 == 0 else [], 1 + i % 3, 50.0, t + 300) for c, last in ((1, 60_000), (2, 700), (3, 3)) for i, t in enumerate(range(0, last, 701))]
    e, pts = spark.createDataFrame(rows, EVENTS), spark.createDataFrame([(c, 0, 0.0, 500.0, 4, True, 1) for c in (1, 2, 3)], POINTS)
    sizes = frames.chart_sizes(e)
    got = {}
    for r in frames.rasterise(e, pts, sizes).collect():
        got.setdefault(r.chart_id, {})[r.frame] = r
    for s in sizes.collect():
        mine, all_ = got[s.chart_id], [x for x in rows if x[0] == s.chart_id]
        assert sorted(mine) == list(range(s.size))
        for f, r in mine.items():
            bumps = [2 * math.exp(-0.5 * ((f - x[2] / frames.MS_PER_FRAME) / 1.2) ** 2) - 1 for x in all_ if math.floor(x[2] / frames.MS_PER_FRAME - 4.8) <= f <= math.ceil(x[2] / frames.MS_PER_FRAME + 4.8)]
            assert r.onset == pytest.approx(max(bumps, default=-1), abs=1e-5)
            held = [x for x in all_ if round(x[2] / frames.MS_PER_FRAME) <= f <= round(min(s.size - 1, x[11] / frames.MS_PER_FRAME))]
            assert (r.slider_hold == 1) == any(x[5] == 2 for x in held) and (r.spinner_hold == 1) == any(x[5] == 8 for x in held)
            assert r.slides == pytest.approx(([(x[9] - 1) / 3 * 2 - 1 for x in held if x[5] == 2] or [-1])[-1], abs=1e-6)


def plain_medians(values, window):
    half = window // 2
    if len(values) < window:
        return values
    padded = [values[0]] * half + values + [values[-1]] * half
    return [statistics.median(padded[i : i + window]) for i in range(len(values))]


def plain_sections(values, window, step, change, apart, most):
    levels = [round(v / step) * step for v in plain_medians([2.0 ** (2 * max(-1, min(1, v))) for v in values], window)]
    found = [(0, levels[0])]
    for f, level in enumerate(levels):
        if f >= found[-1][0] + apart and abs(level - found[-1][1]) >= change:
            found.append((f, level))
    while len(found) > most:
        logs = [math.log2(max(s, 1e-3)) for _, s in found]
        found.pop(1 + min(range(len(logs) - 1), key=lambda i: abs(logs[i + 1] - logs[i])))
    kept = [s for i, s in enumerate(found) if not i or abs(s[1] - found[i - 1][1]) >= 1e-6]
    return [(round(f * frames.MS_PER_FRAME), round(s, 3)) for f, s in kept]


def test_medians_and_sections(spark):
    """A chart of several blocks, short ones and one shorter than the window, in one go."""
    r, values = random.Random(4), {}
    for c, n in ((1, 9000), (2, 61), (3, 60), (4, 1), (5, 2048), (6, 2049), (7, 4500)):
        values[c], level = [], 0.0
        while len(values[c]) < n:
            level = r.choice([level, round(r.uniform(-1, 1), 1)])
            values[c] += [float(np.float32(level + r.choice([0, 0, 0, 0.2])))] * r.randrange(1, 150)
        del values[c][n:]
    table = spark.createDataFrame([(c, f, v) for c, vs in values.items() for f, v in enumerate(vs)], "chart_id long, frame int, sv double").repartition(7)
    for window in (1, 61):
        got = {}
        for x in sequences.rolling_median(table, "sv", window).collect():
            got.setdefault(x.chart_id, {})[x.frame] = x.median
        assert {c: [v for _, v in sorted(m.items())] for c, m in got.items()} == {c: plain_medians(vs, window) for c, vs in values.items()}
    got = {}
    for x in sequences.sv_sections(table).orderBy("chart_id", "start_ms").collect():
        got.setdefault(x.chart_id, []).append((x.start_ms, x.sv))
    assert got == {c: plain_sections(vs, 61, 0.1, 0.2, 258, 6) for c, vs in values.items()}
    assert "InPandas" not in sequences.sv_sections(table)._jdf.queryExecution().toString()
    assert sequences.rolling_median(table.limit(0), "sv", 3).collect() == sequences.sv_sections(table.limit(0)).collect() == []


def test_velocity_structure_without_times(spark):
    """Green points without a time or a line come last, as in the SQL."""
    rows = [(1, 1, 0.0, -100.0, 4, False, 0), (1, 2, None, -50.0, 4, False, 0), (1, 3, 10.0, -50.0, 4, False, 0), (2, None, 5.0, -100.0, 4, False, 0), (2, 4, 5.0, -50.0, 4, False, 0), (2, 5, 6.0, -100.0, 4, False, 0)]
    got = metrics.sv_structure(spark.createDataFrame(rows, POINTS)).orderBy("chart_id").collect()
    assert [tuple(r) for r in got] == [(1, 3, 2, 1, 1.0, 2.0), (2, 3, 2, 1, 1.0, 2.0)]


def test_sections_with_points_without_a_time(spark):
    """A point without a time is in force at no event; as in the SQL, its velocity is drawn over the whole chart."""
    points = spark.createDataFrame([(1, 1, None, -50.0, 4, False, 0), (1, 2, 1000.0, -100.0, 4, False, 0), (1, 3, None, 300.0, 4, True, 0), (1, 4, 2000.0, 400.0, 4, True, 0)], POINTS)
    events = spark.createDataFrame([(1, 5, 500, 0, 0, 2, 0, "L", [(140, 0)], 1, 140.0, 0), (1, 6, 9000, 0, 0, 1, 0, None, [], 1, 0.0, 9000)], EVENTS)
    e = timing.with_timing(events, points, spark.createDataFrame([(1, 1.4)], "chart_id long, slider_multiplier double"))
    assert [(r.line_no, r.beat_length, r.sv, r.end_time) for r in e.orderBy("line_no").collect()] == [(5, 400.0, 1.0, 900), (6, 400.0, 1.0, 9000)]
    table = frames.rasterise(e, points, frames.chart_sizes(e))
    assert [tuple(r) for r in sequences.sv_sections(table).collect()] == [(1, 0, 2.0)]


def test_z_scores_equal_their_sql_near_ties(spark):
    """Quotients that are a tie but for their last bit are rounded alike by the query and its SQL."""
    import duckdb

    from chartmill.queries import Z_SQL

    rows = [(i, 1.0, v, m, s) for i, (v, m, s) in enumerate(((0.621, 0.503, 0.08), (0.436, 0.502, 0.08), (0.385, 0.503, 0.08), (0.7, 0.585, 0.2), (0.3, 0.3, 0.0), (0.301, 0.3, 0.0), (0.625, 0.5, 1.0), (0.1, 0.9, 0.3)))]
    m = spark.createDataFrame([(i, sr, v) for i, sr, v, _, _ in rows], "chart_id long, star_rating double, kiai_ratio double")
    z = {}
    for i, _, _, mean, std in rows:
        band = spark.createDataFrame([("Easy", "kiai_ratio", mean, std, 0.0, 1.0)], "bucket string, metric string, mean double, std double, p10 double, p90 double")
        z[i] = bands.z_scores(m.where(F.col("chart_id") == i), band).first().z
    told = ", ".join(f"({i}, {v!r}::double, {mean!r}::double, {std!r}::double)" for i, _, v, mean, std in rows)
    assert z == dict(duckdb.sql(f"select i, {Z_SQL} from (values {told}) t(i, value, mean, std)").fetchall())


def shuffled_rows(spark, build, of="shuffleWriteRecords"):
    """The rows (or bytes) that building and running a job shuffles, with sort-merge joins as on large tables."""
    sc, joins = spark.sparkContext, "spark.sql.autoBroadcastJoinThreshold"
    none, was = sc._gateway.new_array(sc._jvm.double, 0), spark.conf.get(joins)

    def stages():
        seen = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList()).iterator()
        while seen.hasNext():
            s = seen.next()
            yield s.stageId(), getattr(s, of)()

    spark.conf.set(joins, "-1")
    try:
        before = dict(stages())
        build().write.format("noop").mode("overwrite").save()
        return sum(n for i, n in stages() if i not in before)
    finally:
        spark.conf.set(joins, was)


def test_span_means_and_runs_shuffle_stretches(spark):
    """Means over spans and runs equal plain loops for any layout of frames, and frames themselves aren't shuffled."""
    r = random.Random(19)
    held = {}
    for chart, size in ((1, 24_000), (2, 300), (3, 1), (4, 40)):
        held[chart] = []
        while len(held[chart]) < size:
            held[chart] += [(r.choice((-1.0, 1.0)), r.choice((0.0, 0.25, 0.5, 1.2)))] * r.randint(1, 60)
        del held[chart][size:]
    rows = [(c, f, *v) for c, vs in held.items() for f, v in enumerate(vs)]
    spans = []
    for i in range(200):
        chart = r.choice((1, 1, 2, 4))
        a, b = sorted(r.randint(0, len(held[chart]) + 3) for _ in range(2))
        spans.append((chart, a, b, i % 90))
    spans += [(3, 0, 0, 7), (3, 0, 0, 7), (9, 0, 3, 1), (1, 9_990, 10_010, 5)]
    schema = "chart_id long, frame int, slider_hold float, spacing float"
    asked = spark.createDataFrame(spans, "chart_id long, first int, last int, tag long")
    expected = sorted((c, a, b, t, round(sum(float(np.float32(v[1])) for v in held[c][a : b + 1]) / (b - a + 1), 9)) for c, a, b, t in spans if b < len(held.get(c, [])))
    runs = []
    for c, vs in held.items():
        edges = [f for f in range(len(vs) + 1) if (vs[f][0] > 0 if f < len(vs) else False) != (vs[f - 1][0] > 0 if f else False)]
        runs += [(c, a, b - 1, float(b - a)) for a, b in zip(edges[::2], [*edges[1::2], len(vs)])]
    for layout in (rows, r.sample(rows, len(rows))):
        for parts in (1, 5):
            table = spark.createDataFrame(layout, schema).repartition(parts) if parts > 1 else spark.createDataFrame(layout, schema).coalesce(1)
            got = frames.span_mean(table, asked, "spacing")
            assert sorted((x.chart_id, x.first, x.last, x.tag, round(x["mean"], 9)) for x in got.collect()) == expected
            assert sorted(tuple(x) for x in frames.active_runs(table, "slider_hold").select("chart_id", "first", "last", "total").collect()) == sorted(runs)
    none = spark.createDataFrame([], schema)
    assert frames.span_mean(none, asked, "spacing").collect() == frames.active_runs(none, "slider_hold").collect() == []
    table = spark.createDataFrame(rows, schema).coalesce(1).cache()
    table.count()
    assert shuffled_rows(spark, lambda: frames.span_mean(table, asked, "spacing")) < len(rows) / 8
    assert shuffled_rows(spark, lambda: frames.active_runs(table, "slider_hold")) < len(rows) / 8


def test_overlap_shuffles_few_rows_a_slider(spark):
    """A slider goes to the tiles of its body, not to each cell around each of its points."""
    r = random.Random(6)
    rows = [(c, i, 10 * i, r.randrange(513), r.randrange(385), 2, 0, "L", [(r.randrange(513), r.randrange(385))], 1, 9.0, 10 * i) for c in range(20) for i in range(50)]
    charts = spark.createDataFrame([(c, 4.0) for c in range(20)], "chart_id long, cs double")
    assert shuffled_rows(spark, lambda: metrics.slider_overlap(spark.createDataFrame(rows, EVENTS), charts)) < 12 * len(rows)


def test_decoding_shuffles_less_than_the_frames(spark):
    """Only frames with an onset or a hold move, not those between."""
    from chartmill.plans.lineage import cut

    rows = [(c, i, 1000 * i, 50 * i % 500, 100, 2 if i % 4 == 0 else 1, 0, "L" if i % 4 == 0 else None, [(200, 200)] if i % 4 == 0 else [], 1, 50.0, 1000 * i + (200 if i % 4 == 0 else 0)) for c in (1, 2) for i in range(100)]
    e = spark.createDataFrame(rows, EVENTS)
    table = cut(frames.rasterise(e, points(spark, [(0, 500, True, 0)]), frames.chart_sizes(e)))
    assert frames.decode_events(table).count() == 200
    assert shuffled_rows(spark, lambda: frames.decode_events(table)) < table.count()


def test_overlap_shuffles_no_neighbours(spark):
    """A slider's parts carry its rank, not where its neighbours stand; a place knows its first and last head."""
    r = random.Random(8)
    rows = [(c, i, 10 * i, r.randrange(0, 513, 40), r.randrange(0, 385, 40), r.choice((1, 2)), 0, "L", [(r.randrange(513), r.randrange(385))], 1, 9.0, 10 * i) for c in range(40) for i in range(60)]
    charts, e = spark.createDataFrame([(c, 4.0) for c in range(40)], "chart_id long, cs double"), spark.createDataFrame(rows, EVENTS)
    per_row = shuffled_rows(spark, lambda: metrics.slider_overlap(e, charts), "shuffleWriteBytes") / len(rows)
    assert per_row < 205
    got, want = {x.chart_id: (x.sliders, x.overlapping) for x in metrics.slider_overlap(e, charts).collect()}, {}
    for c in range(40):
        mine, hits = [x for x in rows if x[0] == c], []
        for i, x in enumerate(mine):
            if x[5] == 2:
                (ax, ay), (bx, by) = (x[3], x[4]), x[8][0]
                hits.append(any(abs(i - k) > 1 and math.hypot(ax + (bx - ax) * q / 12 - h[3], ay + (by - ay) * q / 12 - h[4]) <= 36.48 for k, h in enumerate(mine) for q in range(13)))
        want[c] = (len(hits), sum(hits))
    assert got == want


def test_overlap_gathers_no_places(spark):
    """Places are joined as they are; lists of them by tile were sorted twice, which spilled on large tables."""
    e = spark.createDataFrame([(1, i, 10 * i, 100, 100, 2, 0, "L", [(200, 200)], 1, 9.0, 10 * i) for i in range(4)], EVENTS)
    found = metrics.slider_overlap(e, spark.createDataFrame([(1, 4.0)], "chart_id long, cs double"))
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(x) for x in found.collect()] == [(1, 4, 4)]


def test_overlap_with_many_heads_at_one_place(spark):
    r = random.Random(5)
    rows = [(1, i, 10 * i, 256, 192, 1, 0, None, [], 1, 0.0, 10 * i) for i in range(1500)]
    rows += [(2, i, 10 * i, r.randrange(513), r.randrange(385), r.choice((1, 2, 2)), 0, "L", [(r.randrange(513), r.randrange(385))], 1, 9.0, 10 * i) for i in range(25)]
    for i in (0, 700, 1499):
        rows[i] = (1, i, 10 * i, 256, 192, 2, 0, "L", [(300, 192)], 1, 50.0, 10 * i)
    rows += [(3, i, 10 * i, x, 100, t, 0, "L", [(x + 50, 100)], 1, 50.0, 10 * i) for i, (x, t) in enumerate(((10, 1), (10, 2), (10, 1), (400, 2)))]
    e = spark.createDataFrame(rows, EVENTS)
    charts = spark.createDataFrame([(c, 4.0) for c in (1, 2, 3)], "chart_id long, cs double")
    got = {x.chart_id: (x.sliders, x.overlapping) for x in metrics.slider_overlap(e, charts).collect()}
    want = {}
    for c in (1, 2, 3):
        mine = [x for x in rows if x[0] == c]
        hit = sliders = 0
        for i, x in enumerate(mine):
            if x[5] != 2:
                continue
            sliders += 1
            (ax, ay), (bx, by) = (x[3], x[4]), x[8][0]
            hit += any(abs(i - k) > 1 and math.hypot(ax + (bx - ax) * q / 12 - h[3], ay + (by - ay) * q / 12 - h[4]) <= 36.48 for k, h in enumerate(mine) for q in range(13))
        want[c] = (sliders, hit)
    assert got == want and want[1] == (3, 3) and want[3] == (2, 0)


def test_points_and_spans(spark):
    r = random.Random(6)
    peaks = [(c, f, float(f)) for c in (1, 2, 3) for f in sorted(r.sample(range(200), 60))]
    spans = [(c, a, a + r.choice((0, 1, 5, 40))) for c in (1, 2) for a in r.choices(range(200), k=9)] + [(1, 50, 90), (1, 60, 61)]
    p, s = spark.createDataFrame(peaks, "chart_id long, frame int, value double"), spark.createDataFrame(spans, "chart_id long, first int, last int")
    assert sorted(map(tuple, frames.outside_spans(p, s).collect())) == [x for x in peaks if not any(c == x[0] and a <= x[1] <= b for c, a, b in spans)]
    assert sorted(map(repr, map(tuple, frames.with_next_begin(p, s, "spin").collect()))) == sorted(repr((*x, min((a for c, a, _ in spans if c == x[0] and a > x[1]), default=None))) for x in peaks)


def test_export_writes_one_file_a_chart(spark, tmp_path):
    """Many lines of one chart are streamed; a failed write leaves nothing."""
    from chartmill.sources.line_files import LineFiles, LineWriter

    out = str(tmp_path / "files")
    spark.dataSource.register(LineFiles)
    lines = spark.range(200_000).selectExpr("if(id % 3 = 0, 'b/1', 'a') as name", "id").repartition("name").sortWithinPartitions("name", "id").selectExpr("name", "concat('line ', id) as line")
    for _ in range(2):  # a second write replaces the files
        lines.write.format("linefiles").option("path", out).mode("append").save()
    assert sorted(p.name for p in (tmp_path / "files").iterdir()) == ["a.txt", "b%2F1.txt"]
    assert (tmp_path / "files/b%2F1.txt").read_text().split("\n") == [f"line {i}" for i in range(0, 200_000, 3)]
    with pytest.raises(Exception, match="nothing to divide|DIVIDE_BY_ZERO|Division by zero"):
        lines.selectExpr("name", "cast(1 div (length(line) - 6) as string) as line").write.format("linefiles").option("path", str(tmp_path / "failed")).mode("append").save()
    assert not [p for p in (tmp_path / "failed").rglob("*") if p.is_file() and p.parent == tmp_path / "failed"]

    # memory doesn't grow with a chart's lines: the writer takes batches as they come
    def batches():
        batch = pa.RecordBatch.from_arrays([pa.array(["big"] * 10_000), pa.array(["x" * 40] * 10_000)], names=["name", "line"])
        for _ in range(100):
            yield batch

    writer = LineWriter(str(tmp_path / "big"), ".chart")
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    message = writer.write(batches())
    assert tracemalloc.get_traced_memory()[1] < 20_000_000 and pa.total_allocated_bytes() - before < 20_000_000
    tracemalloc.stop()
    writer.commit([message, None])
    assert (tmp_path / "big/big.chart").stat().st_size == 41_000_000 - 1 and len(list((tmp_path / "big").iterdir())) == 1


def test_refresh_measures_what_changed(spark, tmp_path, monkeypatch):
    from chartmill.plans import dataset

    folder, ids = str(tmp_path / "set"), range(1, 8)
    charts = spark.createDataFrame([(c, "Set", f"map {c}", c, 0, 4.0, 1.4, 3.0 if c != 4 else 7.0) for c in ids], "chart_id long, folder string, filename string, audio_id long, mode int, cs double, slider_multiplier double, star_rating double")
    rows = [(c, i, 500 * i, 100 + 30 * (i % 5), 100, 1, 2 * (c != 6), None, [], 1, 0.0, 500 * i) for c in ids for i in range(55)]
    points = spark.createDataFrame([(c, 0, 0.0, 500.0, 4, True, 1) for c in ids], POINTS)
    status = charts.select("folder", "filename", F.lit(4).alias("status"), "mode")
    given, build = [], dataset.build
    monkeypatch.setattr(dataset, "build", lambda c, *a: given.append({r.chart_id for r in c.collect()}) or build(c, *a))

    def run(charts, rows, status=status):
        given.clear()
        told = dataset.refresh(charts, points, spark.createDataFrame(rows, EVENTS), status, folder)
        kept = {r.chart_id: r for r in spark.read.parquet(f"{folder}/manifest").collect()}
        sizes = {r.chart_id: r["count"] for r in spark.read.parquet(f"{folder}/frames").groupBy("chart_id").count().collect()}
        assert sizes == {c: r.frames for c, r in kept.items()}
        return told, list(given), kept

    told, measured, kept = run(charts, rows)
    assert told == (7, 0) and measured == [set(ids)] and set(kept) == set(ids) - {6}  # 6 has no hitsounds
    files = sorted(p.name for p in (tmp_path / "set/manifest").rglob("*.parquet"))
    told, measured, _ = run(charts, rows)
    assert told == (0, 0) and measured == [] and files == sorted(p.name for p in (tmp_path / "set/manifest").rglob("*.parquet"))
    more = [(*r[:6], 2, *r[7:]) if r[0] == 6 else r for r in rows if r[0] != 2] + [r for r in rows if r[0] == 2][:52]
    told, measured, kept = run(charts, more[::-1])
    assert told == (2, 0) and measured == [{2, 6}] and set(kept) == set(ids) and kept[2].n_objects == 52
    assert {p.name for p in (tmp_path / "set/manifest/bucket=Expert+").glob("*.parquet")} <= set(files)  # not written anew
    told, measured, kept = run(charts.where("chart_id != 4"), [r for r in more if r[0] != 4], status.where("filename != 'map 3'"))
    assert told == (1, 1) and measured == [{3}] and set(kept) == {1, 2, 5, 6, 7} and not (tmp_path / "set/manifest/bucket=Expert+").exists()


def test_band_states_add_up(spark):
    r = random.Random(7)
    rows = spark.createDataFrame([(i, r.choice((1, 60)), round(r.uniform(0, 8), 2), round(r.uniform(0, 3), 1) if r.random() < 0.9 else None) for i in range(300)], "chart_id long, n_objects int, star_rating double, mean_spacing_px double")
    states = [bands.band_state(rows.where(f"chart_id % 3 = {k}")) for k in range(3)]
    want = sorted(map(tuple, bands.corpus_bands(rows).select("bucket", "metric", "n", "mean", "std", "p10", "p90").collect()))
    assert sorted(map(tuple, bands.bands_of(bands.merge_states(*states)).select("bucket", "metric", "n", "mean", "std", "p10", "p90").collect())) == want
    two = bands.merge_states(bands.merge_states(*states), gone=states[2])
    assert sorted(map(tuple, two.collect())) == sorted(map(tuple, bands.merge_states(*states[:2]).select(two.columns).collect()))


def test_limit_measures_slices(spark):
    charts = spark.range(5000).selectExpr("id as chart_id").union(spark.createDataFrame([(None,)], "chart_id long"))
    given = []

    def even(some):
        given.append(some.count())
        return some.where("chart_id % 2 = 0")

    first, measured = curation.usable_limit(charts, even, 10)
    assert [x.chart_id for x in first.collect()] == list(range(0, 20, 2)) and measured == 20 and given == [20]
    given.clear()
    first, measured = curation.usable_limit(charts, lambda some: even(some).where("chart_id % 100 = 98"), 10)
    assert [x.chart_id for x in first.collect()] == list(range(98, 1000, 100)) and measured == sum(given) == 20 + 80 + 320 + 1280
    assert curation.usable_limit(charts, lambda some: some, 9000)[0].count() == 5000 and curation.usable_limit(charts, even, 0)[0].count() == 0
    assert curation.usable_limit(charts.limit(0), even, 3)[0].count() == 0


@pytest.mark.parametrize("edge", [1, 20, 20_000])
def test_hash_order_without_sorting_all(spark, monkeypatch, edge):
    monkeypatch.setattr(curation, "EDGE", edge)
    md5 = lambda seed, v: hashlib.md5(f"{seed}:{v}".encode()).hexdigest()
    rows = spark.range(3000).selectExpr("id as item_id", "'x' as _hash")
    order = sorted(range(3000), key=lambda v: md5(7, v))
    for n in (1, 17, 2999, 3000, 4000):
        assert {r.item_id for r in curation.seeded_sample(rows, "item_id", n, 7).collect()} == set(order[:n])
    groups = rows.selectExpr("item_id", "item_id div 5 as group")
    for fraction in (0.001, 0.1, 0.5, 1.0):
        want, taken = set(), 0
        for group in sorted(range(600), key=lambda v: md5(1234, v)):
            if taken < max(1, round(3000 * fraction)):
                want.add(group)
            taken += 5
        got = curation.grouped_split(groups, fraction)
        assert {r.group for r in got.where("side = 'val'").collect()} == want and got.count() == 3000


def test_heads_moved_and_given_tempo(spark):
    e = spark.createDataFrame([(1, 0, 0, -5, 10, 1, 0, None, [], 1, 0.0, 0), (1, 1, 10, 5, 10, 1, 0, None, [], 1, 0.0, 10), (1, 2, 20, 500, 200, 2, 0, "L", [(520, 200)], 1, 300.0, 1000), (2, 0, 0, 512, 384, 1, 0, None, [], 1, 0.0, 0)], EVENTS)
    assert {r.chart_id: (r.moved, r.reshaped) for r in edit.heads_moved(e).collect()} == {1: (1, 1), 2: (0, 0)}
    beats = spark.createDataFrame([(1, 0, 100.0), (2, 0, 0.0), (2, 1, 500.0), (3, 0, 7.0)], "song_id long, line_no long, beat_ms double")
    given = spark.createDataFrame([(1, 50.0), (2, 99.0), (4, 410.0)], "song_id long, bpm double")
    assert {r.song_id: (r.bpm, r.offset_ms) for r in timing.tempo_estimate(beats, given=given).collect()} == {1: (100.0, 0.0), 2: (120.0, 0.0), 3: (0.0, 0.0), 4: (102.5, 0.0)}


def test_readers_of_status_and_onsets(spark, tmp_path):
    from chartmill.sources import stores

    (tmp_path / "status.csv").write_text("Set_Folder,file,Status,beatmap_id,other\n17 A,a,4,99,x\n17 A,b,x,1,x\n,c,4,1,x\n18 B,d,5,,x\n")
    got = stores.read_status(spark, str(tmp_path / "status.csv")).orderBy("filename").collect()
    assert [tuple(r) for r in got] == [("17 A", "a", 4, 0, None, 99), ("18 B", "d", 5, 0, None, None)]
    spark.createDataFrame([("f", "g", 7, 3)], "folder string, filename string, status int, ruleset int").write.parquet(str(tmp_path / "p"))
    assert stores.read_status(spark, str(tmp_path / "p")).first().mode == 3
    spark.createDataFrame([(1, [0.5, 1.0]), (2, [])], "audio_id long, strength array<float>").write.parquet(str(tmp_path / "o"))
    assert sorted(map(tuple, stores.read_onsets(spark, str(tmp_path / "o")).collect())) == [(1, 0, 0.5), (1, 1, 1.0)]


def test_unscored_chart_has_quality_zero(spark):
    metrics_ = spark.createDataFrame([(1, 1.0, 0.5), (2, 9.0, 0.5), (3, 1.0, None)], "chart_id long, star_rating double, kiai_ratio double")
    bands_ = spark.createDataFrame([("Easy", "kiai_ratio", 0.0, 1.0)], "bucket string, metric string, p10 double, p90 double")
    got = {r.chart_id: r for r in score.quality(metrics_, bands_, score.family_weights(spark)).collect()}
    assert {c: r.quality for c, r in got.items()} == {1: 1.0, 2: 0.0, 3: 0.0}
    assert got[1].per_metric == {"kiai_ratio": 1.0} and got[1].family == {"accents": 1.0} and got[2].family == got[3].per_metric == {}
