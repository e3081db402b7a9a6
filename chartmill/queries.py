"""Registered queries of the chart operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry
from .operators import bands, curation, edit, frames, metrics, score, sequences, timing
from .plans import dataset, views
from .plans.lineage import cut, shared_folder, stored
from .sources import charts as charts_io
from .sources import stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions of DuckDB that the oracles share; each may use those before it.
CTES = {
    "lg": """select user_id chart_id, event_id line_no, event_type, ts, value, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 86400000 "time",
      cast(regexp_extract(props, '([0-9]+)', 1) as bigint) k from events""",
    "e0": """select chart_id, line_no, "time", k, case when line_no % 11 = 0 then 256 else (line_no * 37 + k) % 513 end x, case when line_no % 11 = 0 then 192 else (line_no * 53 + k * 7) % 385 end y,
      case event_type when 'click' then 1 when 'purchase' then 2 else case when k < 10 then 8 else 1 end end + case when line_no % 4 = 0 then 4 else 0 end "type", (line_no % 8) * 2 hit_sound
      from lg where event_type in ('click', 'purchase', 'error')""",
    "ev0": """select *, ("type" & 2) <> 0 sl, case when ("type" & 2) <> 0 then case when k % 2 = 0 then 'B' else 'L' end end curve_type,
      (x + k) % 513 x1, (y + 2 * k) % 385 y1, (x + 3 * k) % 513 x2, (y + k) % 385 y2,
      case when ("type" & 2) <> 0 then 1 + line_no % 3 else 1 end slides, case when ("type" & 2) <> 0 then 50.0::double + k else 0 end "length" from e0""",
    "cp": """select chart_id, line_no, cast("time" as double) "time", cast(case event_type when 'signup' then 300 + 2 * k else -(50 + k) end as double) bl, event_type = 'signup' red,
      case when event_type = 'signup' then 0 else 1 end kind, line_no % 2 effects, case when event_type = 'signup' then 1.0::double else 100.0::double / (50 + k) end sv from lg where event_type in ('signup', 'view')""",
    "ch": """select distinct user_id chart_id, user_id // 3 set_id, user_id // 3 audio_id, 'set' || (user_id // 3) folder, 'c' || user_id filename, case when user_id % 10 = 9 then 3 else 0 end "mode",
      cast(3 + user_id % 4 as double) cs, ((user_id * 37) % 900) / 100.0::double star_rating from events""",
    "et": """select v.*, coalesce(
        (select arg_max(bl, row(p."time", p.line_no)) from cp p where p.chart_id = v.chart_id and red and p."time" <= v."time"),
        (select arg_min(bl, row(p."time", p.line_no)) from cp p where p.chart_id = v.chart_id and red), 500.0::double) beat,
      coalesce((select arg_max(sv, row(p."time", p.kind, p.line_no)) from cp p where p.chart_id = v.chart_id and p."time" <= v."time"), 1.0::double) sv from ev0 v""",
    "ev": """select *, case when sl then "length" / (1.4::double * 100 * sv) * beat * slides else 0 end duration,
      case when ("type" & 8) <> 0 then "time" + 500 when sl then cast(round_even("time" + "length" / (1.4::double * 100 * sv) * beat * slides, 0) as bigint) else "time" end end_time from et""",
    "pt": """select chart_id, arg_min(bl, row("time", line_no)) beat_length, arg_min("time", row("time", line_no)) offset_ms from cp where red and bl > 0 group by chart_id""",
    "w": """select *, lead("time") over o - "time" dt, lead("time") over o next_time, sqrt((lead(x) over o - x) ** 2 + (lead(y) over o - y) ** 2) dist, x - lag(x) over o ix, y - lag(y) over o iy, lead(x) over o - x ox, lead(y) over o - y oy,
      row_number() over o ord, lag(end_time) over o prev_end from ev window o as (partition by chart_id order by "time", line_no)""",
    "tn": """select *, case when sqrt(ix * ix + iy * iy) >= 1 and sqrt(ox * ox + oy * oy) >= 1 then
      degrees(acos(greatest(-1.0::double, least(1.0::double, (ix * ox + iy * oy) / (sqrt(ix * ix + iy * iy) * sqrt(ox * ox + oy * oy)))))) end turn from w""",
    "sg": """select *, sqrt((x2 - x) ** 2 + (y2 - y) ** 2) chord, sqrt((x1 - x) ** 2 + (y1 - y) ** 2) leg1, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) leg2 from tn""",
    "sh": """select *, leg1 + leg2 whole, case when chord < 1e-6 then leg1 else abs((x1 - x) * (y2 - y) - (y1 - y) * (x2 - x)) / chord end sagitta from sg""",
    "ki": """select chart_id, s "start", coalesce(e, last_end) "end" from (
        select chart_id, "time" s, on_, lead("time") over (partition by chart_id order by "time", kind, line_no) e from (
          select *, effects = 1 on_, lag(effects = 1, 1, false) over (partition by chart_id order by "time", kind, line_no) was from cp) where on_ <> was)
      left join (select chart_id, arg_max(end_time, row("time", line_no)) last_end from ev group by chart_id) using (chart_id) where on_""",
    "body": """select chart_id, ord, greatest(1.0::double, 54.4::double - 4.48::double * cs) r, q,
        case when target > leg1 then x1 + p2 * (x2 - x1) else x + p1 * (x1 - x) end px, case when target > leg1 then y1 + p2 * (y2 - y1) else y + p1 * (y1 - y) end py
      from (select *, least(1.0::double, greatest(0.0::double, target / case when leg1 = 0 then 1 else leg1 end)) p1,
          least(1.0::double, greatest(0.0::double, (target - leg1) / case when whole - leg1 = 0 then 1 else whole - leg1 end)) p2
        from (select *, case when whole = 0 then 1 else whole end * q / 12 target from sh, (select unnest(range(0, 13)) q) where sl)) join ch using (chart_id)""",
    "ov": """select chart_id, count(*) sliders, count_if(hit) overlapping from (
        select s.chart_id, s.ord, bool_or(coalesce(h.ord is not null, false)) hit from body s left join w h on h.chart_id = s.chart_id and abs(h.ord - s.ord) > 1
          and sqrt((s.px - h.x) ** 2 + (s.py - h.y) ** 2) <= s.r group by s.chart_id, s.ord) group by chart_id""",
    "svc": """select chart_id, count_if(abs(sv - p) > 1e-3) n from (select *, lag(sv, 1, 1.0::double) over (partition by chart_id order by "time", kind, line_no) p from cp) group by chart_id""",
    "a0": """select chart_id, count(*) n_objects, coalesce(nullif((arg_max(end_time, row("time", line_no)) - min("time")) / 1000.0::double, 0), 1.0::double) sec, any_value(round_even(60000.0::double / beat_length, 3)) bpm,
        avg((("type" & 1) <> 0)::int) c1, avg(sl::int) c2, avg((("type" & 8) <> 0)::int) c3, avg((("type" & 4) <> 0)::int) c4, count_if(sl) ns, count_if(curve_type = 'B') nb_, count_if(sl and sagitta >= 10) nc,
        count_if(dt > 0) m, avg(dist) filter (dt > 0) md, stddev_pop(dist) filter (dt > 0) sd, count_if(dt > 0 and nb <= .3::double and dist <= 120) st, count_if(dt > 0 and dist >= 200) ju,
        count_if(dt > 0 and least(abs(nb - round_even(nb * 8, 0) / 8), abs(nb - round_even(nb * 6, 0) / 6)) <= 0.03::double) og, count_if(dt > 0 and dist <= 3) sk,
        avg(dist) filter (dt > 0 and nb <= .3::double and dist <= 120) ms, stddev_pop(dist) filter (dt > 0 and nb <= .3::double and dist <= 120) ss,
        avg(turn) mt, count(turn) nt, count_if(turn >= 150) rv, avg(least(200.0::double, leg1, leg2)) filter (sl) sp,
        avg((hit_sound > 0)::int) h0, avg(((hit_sound & 2) > 0)::int) h2, avg(((hit_sound & 4) > 0)::int) h4, avg(((hit_sound & 8) > 0)::int) h8
      from (select sh.*, beat_length, dt / (60000.0::double / round_even(60000.0::double / beat_length, 3)) nb from sh left join pt using (chart_id)) group by chart_id""",
    "a1": """select chart_id, n_objects, v.* from (select a0.*, n, kms, sliders, overlapping from a0 left join svc using (chart_id) left join ov using (chart_id)
        left join (select chart_id, sum("end" - "start") kms from ki group by chart_id) using (chart_id)) z, lateral (select
        round_even(sec, 1) duration_s, round_even(n_objects / sec, 2) density_per_s, coalesce(z.bpm, 0.0::double) bpm, round_even(c1, 3) circle_ratio, round_even(c2, 3) slider_ratio, round_even(c3, 3) spinner_ratio, round_even(c4, 3) new_combo_ratio,
        round_even(h0, 3) hitsound_ratio, round_even(h2, 3) whistle_ratio, round_even(h4, 3) finish_ratio, round_even(h8, 3) clap_ratio,
        round_even(nb_::double / greatest(1, ns), 3) bezier_slider_ratio, round_even(nc::double / greatest(1, ns), 3) curved_slider_ratio, round_even(coalesce(md, 0), 1) mean_spacing_px, round_even(coalesce(sd, 0), 1) std_spacing_px,
        round_even(coalesce(st::double / nullif(m, 0), 0), 3) stream_ratio, round_even(coalesce(ju::double / nullif(m, 0), 0), 3) jump_ratio, round_even(coalesce(og::double / nullif(m, 0), 0), 3) on_quarter_grid_ratio,
        round_even(coalesce(sk::double / nullif(m, 0), 0), 3) stack_ratio, round_even(coalesce(mt, 0), 1) mean_turn_angle_deg, round_even(coalesce(rv::double / nullif(nt, 0), 0), 3) reversal_ratio,
        round_even(case when ms > 1e-6 then ss / ms else 0 end, 3) stream_spacing_cv, round_even(coalesce(sp, 0), 1) slider_anchor_spread_px, round_even(coalesce(n, 0) / (sec / 60), 2) sv_changes_per_min,
        round_even(coalesce(kms, 0) / 1000 / sec, 3) kiai_ratio, round_even(coalesce(overlapping::double / nullif(sliders, 0), 0), 3) slider_overlap_ratio) v where n_objects >= 2""",
    "mb": """select a1.*, star_rating, case when star_rating >= 0 and star_rating < 2 then 'Easy' when star_rating < 2.7::double and star_rating >= 2 then 'Normal' when star_rating < 4 and star_rating >= 2 then 'Hard'
        when star_rating < 5.3::double and star_rating >= 2 then 'Insane' when star_rating < 6.5::double and star_rating >= 2 then 'Expert' else 'Expert+' end bucket from a1 join ch using (chart_id)""",
    "ml": "select chart_id, bucket, metric, value from (unpivot (select chart_id, bucket, " + ", ".join(f'{k}::double "{k}"' for k in metrics.KEYS) + " from mb) on " + ", ".join(metrics.KEYS) + " into name metric value value)",
    "bd": """select bucket, metric, count(*) n, cast(round_even(cast(cast(sum(cast(value as decimal(20, 6))) as double) / count(*) as decimal(30, 12)), 3) as double) mean, round_even(stddev_pop(value), 3) std, round_even(list_sort(list(value))[cast(floor(0.1::double * (count(*) - 1)) as bigint) + 1], 3) p10,
        round_even(list_sort(list(value))[cast(floor(0.9::double * (count(*) - 1)) as bigint) + 1], 3) p90 from ml group by bucket, metric""",
    "fw": "select * from (values " + ", ".join(f"('{f}', {i}, {w}::double, '{m}', {v}::double)" for i, (f, (w, ms)) in enumerate(score.FAMILIES.items()) for m, v in ms.items()) + ") t(family, family_ord, family_w, metric, metric_w)",
    "fs": """select chart_id, family, family_ord, family_w, sum(metric_w * s) / sum(metric_w) score from (
        select *, greatest(0.0::double, 1 - case when value < p10 then p10 - value when value > p90 then value - p90 else 0 end / greatest((p90 - p10) / 2, 1e-9::double)) s
        from ml join bd using (bucket, metric) join fw using (metric) where p90 > p10) group by all""",
    "ql": "select chart_id, sum(family_w * score) / sum(family_w) quality from fs group by chart_id",
    "pl": """select chart_id, coalesce(count_if(ddt > 0 and sqrt((lx - nx) ** 2 + (ly - ny) ** 2) / ddt > 10)::double / nullif(count_if(ddt > 0), 0), 0) penalty from (
        select chart_id, case when sl and slides % 2 <> 0 then x2 else x end lx, case when sl and slides % 2 <> 0 then y2 else y end ly, lead(x) over o nx, lead(y) over o ny,
          lead("time") over o - case when sl then coalesce(nullif(end_time, 0), "time") else "time" end ddt from ev window o as (partition by chart_id order by "time", line_no)) group by chart_id""",
    "rw": """select chart_id, bucket, round_even((0.65::double * quality + 0.35::double * (1 / (1 + ((star_rating - tgt) / 0.5::double) ** 2))) * least(1.0::double, greatest(0.0::double, 1 - penalty)), 4) reward, round_even(quality, 4) quality,
        round_even(1 / (1 + ((star_rating - tgt) / 0.5::double) ** 2), 4) sr_closeness, penalty from (select mb.*, coalesce(quality, 0) quality, floor(star_rating) tgt from mb left join ql using (chart_id)) join pl using (chart_id)""",
    "ca": """select l_orderkey job_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 idx, 1 - 2 * l_discount quality, 1 / (1 + (l_tax / 0.04::double) ** 2) sr_closeness,
        l_quantity / 6 achieved_sr, l_returnflag flag, round_even(0.65::double * (1 - 2 * l_discount) + 0.35::double * (1 / (1 + (l_tax / 0.04::double) ** 2)), 4) reward from lineitem""",
    "mf": "select doc_id item_id, md5(coalesce(text, '')) audio_id, substr(coalesce(text, ''), 1, 24) title, n_chars n_objects from documents",
    "sk": "select item_id, audio_id, case when s = '' then '__item__' || item_id else s end song from (select *, trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}_]+', ' ', 'g')) s from mf)",
    "bt": """select chart_id song_id, line_no, cast("time" as double) beat_ms, case event_type when 'click' then 'ref' else 'pred' end kind from lg where event_type in ('click', 'view')""",
    "tp": """select chart_id song_id, 60000.0::double / beat_length ref_bpm, offset_ms ref_offset, 60000.0::double / beat_length * [1.0::double, 2.0, 0.5, 1.001][chart_id % 4 + 1] pred_bpm, offset_ms + chart_id % 25 pred_offset from pt""",
}


def sql(body: str) -> str:
    """body with the common table expressions that it needs, directly or through others."""
    import re

    names, need, text = list(CTES), set(), [body]
    while text:
        found = {n for n in names if re.search(rf"\b{n}\b", text[-1])} - need
        text.pop()
        need |= found
        text += [CTES[n] for n in found]
    return "with recursive " + ",\n".join(f"{n} as ({CTES[n]})" for n in names if n in need) + "\n" + body if need else body


def query(name: str, oracle: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle)
        return f

    return register


def timed(spark: SparkSession, d: str) -> DataFrame:
    return timing.with_timing(views.events(spark, d), views.control_points(spark, d), views.charts(spark, d))


def timed_once(spark: SparkSession, d: str) -> DataFrame:
    """Timed events in a table of their own, of which each reader takes its columns."""
    return stored(timed(spark, d))[0]


def chart_metrics(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    """Metrics and star rating of each chart, computed once: bands, scores and joins read the one row a chart has."""
    got = metrics.chart_metrics(timed_once(spark, d) if events is None else events, views.control_points(spark, d), views.charts(spark, d))
    return cut(got.join(views.charts(spark, d).select("chart_id", "star_rating"), "chart_id").where("n_objects >= 2"))


def timing_pred(spark: SparkSession, d: str) -> DataFrame:
    factor = "element_at(array(1.0D, 2.0D, 0.5D, 1.001D), cast(chart_id % 4 as int) + 1)"
    return timing.primary_timing(views.control_points(spark, d)).selectExpr("chart_id as song_id", "bpm as ref_bpm", "offset_ms as ref_offset", f"bpm * {factor} as pred_bpm", "offset_ms + chart_id % 25 as pred_offset")


@query("J1_ranked_join", """select chart_id, folder, filename from ch where "mode" = 0 and chart_id % 17 <> 0 and chart_id % 8 in (4, 5, 7)""")
def _(spark, d):
    return curation.ranked_join(views.charts(spark, d), views.chart_status(spark, d)).select("chart_id", "folder", "filename")


@query("J2_J3_J4_timing", "select chart_id, line_no, round_even(beat, 6) beat_length, round_even(sv, 6) sv, round_even(duration, 6) duration, end_time from ev")
def _(spark, d):
    return timed(spark, d).select("chart_id", "line_no", *[F.bround(c, 6).alias(c) for c in ("beat_length", "sv", "duration")], "end_time")


@query("P1_type_flags", """select chart_id, count_if(("type" & 1) <> 0) circles, count_if(sl) sliders, count_if(("type" & 8) <> 0) spinners, count_if(("type" & 4) <> 0) combos from ev0 group by chart_id""")
def _(spark, d):
    names = {"circles": "circle", "sliders": "slider", "spinners": "spinner", "combos": "new_combo"}
    return metrics.type_flags(views.events(spark, d)).groupBy("chart_id").agg(*[F.count_if(f"is_{v}").alias(k) for k, v in names.items()])


@query("P3_W29_primary_timing", "select chart_id, round_even(60000.0::double / beat_length, 3) bpm, offset_ms, beat_length from pt")
def _(spark, d):
    return timing.primary_timing(views.control_points(spark, d)).select("chart_id", F.bround("bpm", 3).alias("bpm"), "offset_ms", "beat_length")


@query("P4_playable", """select chart_id from ch join (select chart_id, count(*) n from e0 group by chart_id) using (chart_id) where "mode" = 0 and n >= 35""")
def _(spark, d):
    return curation.playable(views.charts(spark, d), views.events(spark, d), 35).select("chart_id")


GATE = """select chart_id, case when n_objects < 35 then 'too_few' when not star_rating between 1 and 10 then 'star_rating' when not coalesce(kiai, false) then 'no_kiai'
  when coalesce(reds, 0) > 13 then 'multi_tempo' when hitsound_ratio < 0.1::double then 'few_hitsounds' end reject_reason from mb left join (select chart_id, count_if(red) reds, bool_or(effects = 1) kiai from cp group by chart_id) using (chart_id)"""


def gated(spark, d):
    return curation.gold_gate(chart_metrics(spark, d), views.control_points(spark, d), max_red=13, min_objects=35)


QUERIES["P5_gold_gate"], ORACLES["P5_gold_gate"] = gated, sql(GATE)


@query("A17_ingest_counters", f"select coalesce(reject_reason, 'kept') outcome, count(*) charts from ({GATE}) group by 1")
def _(spark, d):
    return curation.ingest_counters(gated(spark, d))


@query("P6_sr_bucket", "select chart_id, bucket from mb")
def _(spark, d):
    return chart_metrics(spark, d).select("chart_id", bands.sr_bucket(F.col("star_rating")).alias("bucket"))


@query("P7_P8_context", """select chart_id, round_even(least(1.5::double, star_rating / 10), 6) c1, round_even(least(1.5::double, least(10.0::double, 7.75::double + 0.25::double * star_rating) / 10), 6) c2,
  round_even(least(10.0::double, 4 + 0.7::double * star_rating) / 10, 6) c3, 0.5::double c4, round_even(4.0::double / 7, 6) c5, round_even(least(1.5::double, n_objects / greatest(1e-6::double, duration_s) / 12), 6) c6, 0.5::double c7 from mb""")
def _(spark, d):
    items = curation.target_settings(chart_metrics(spark, d), "star_rating").withColumn("aim", F.lit(0.5))
    return curation.context(items).select("chart_id", *[F.bround(F.col("ctx")[i], 6).alias(f"c{i + 1}") for i in range(7)])


@query("P15_song_key", "select item_id, song from sk")
def _(spark, d):
    return views.manifest(spark, d).select("item_id", curation.song_key(F.col("title"), F.col("item_id")).alias("song"))


@query("J7_slider_overlap", "select chart_id, sliders, overlapping from ov")
def _(spark, d):
    return metrics.slider_overlap(views.events(spark, d), views.charts(spark, d))


@query("W1_pair_delta", "select chart_id, line_no, dt, round_even(dist, 6) dist from w")
def _(spark, d):
    return metrics.pair_delta(views.events(spark, d)).select("chart_id", "line_no", "dt", F.bround("dist", 6).alias("dist"))


@query("W2_turn_angle", "select chart_id, line_no, round_even(turn, 4) turn from tn")
def _(spark, d):
    return metrics.turn_angle(views.events(spark, d)).select("chart_id", "line_no", F.bround("turn", 4).alias("turn"))


@query("W3_sv_changes", "select chart_id, n sv_changes from svc")
def _(spark, d):
    return timing.sv_changes(views.control_points(spark, d))


@query("W4_kiai_spans", 'select chart_id, "start", cast("end" as double) "end" from ki')
def _(spark, d):
    return timing.kiai_spans(views.control_points(spark, d), timing.last_ends(timed(spark, d)))


@query("A1_chart_metrics", "select * exclude (bucket) from mb")
def _(spark, d):
    return chart_metrics(spark, d)


@query("A2_corpus_bands", "select bucket, metric, n, mean, std, p10, p90 from bd")
def _(spark, d):
    return bands.corpus_bands(chart_metrics(spark, d))


@query("A3_distribution_summary", """select n, round_even(mean, 4) mean, round_even(v[cast(floor(0.5::double * (n - 1)) as bigint) + 1], 4) median, round_even(v[cast(floor(0.1::double * (n - 1)) as bigint) + 1], 4) p10,
  round_even(v[cast(floor(0.9::double * (n - 1)) as bigint) + 1], 4) p90, round_even(v[1], 4) "min", round_even(v[n], 4) "max" from (select count(*) n, avg(reward) mean, list_sort(list(reward)) v from ca)""")
def _(spark, d):
    return bands.distribution_summary(views.candidates(spark, d), "reward")


@query("A6_slider_shapes", "select count(*) n, " + ", ".join(f"round_even(avg({v}), 4) {v}_mean, round_even(quantile_cont({v}, 0.5), 4) {v}_median, round_even(quantile_cont({v}, 0.9), 4) {v}_p90" for v in ("chord", "ratio", "sagitta")) + ", "
       + ", ".join(f"round_even(avg(({v} >= {t}::double)::int), 4) {v}_over_{i}" for v, ts in (("ratio", (1.06, 1.15, 1.3)), ("sagitta", (10, 20, 40))) for i, t in enumerate(ts, 1)) + " from (select chord, case when chord <= 1 then 1 else whole / chord end ratio, sagitta from sh where sl)")
def _(spark, d):
    return metrics.slider_shape_summary(views.events(spark, d))


@query("A7_sv_structure", """select chart_id, count(*) inherited, count(distinct v) distinct_sv, count_if(v <> p) changes, min(v) min_sv, max(v) max_sv from (
  select *, lag(v) over (partition by chart_id order by "time", line_no) p from (select *, round_even(sv, 2) v from cp where not red)) group by chart_id""")
def _(spark, d):
    return metrics.sv_structure(views.control_points(spark, d))


def scored(spark, d):
    """Quality and playability of each chart, with the whole star below its rating as its target."""
    events = timed_once(spark, d)
    m = chart_metrics(spark, d, events)
    q = score.quality(m, bands.corpus_bands(m), score.family_weights(spark))
    joined = q.join(m.select("chart_id", "star_rating"), "chart_id").join(score.playability(events), "chart_id")
    return score.reward(joined.withColumns({"achieved_sr": F.col("star_rating"), "target_sr": F.floor("star_rating"), "bucket": bands.sr_bucket(F.col("star_rating"))}))


@query("A8_quality", "select chart_id, round_even(coalesce(quality, 0), 4) quality from mb left join ql using (chart_id)")
def _(spark, d):
    m = chart_metrics(spark, d)
    return score.quality(m, bands.corpus_bands(m), score.family_weights(spark)).select("chart_id", F.bround("quality", 4).alias("quality"))


@query("A8_effective_weights", "select metric, round_even(family_w * metric_w / sum(metric_w) over (partition by family), 6) weight from fw where metric in (select metric from ml)")
def _(spark, d):
    used = bands.melt(chart_metrics(spark, d), ["chart_id"]).select("metric").distinct()
    return score.effective_weights(score.family_weights(spark)).join(used, "metric", "left_semi").select("metric", F.bround("weight", 6).alias("weight"))


@query("A9_playability", "select chart_id, round_even(penalty, 6) penalty from pl")
def _(spark, d):
    return score.playability(timed(spark, d)).select("chart_id", F.bround("penalty", 6).alias("penalty"))


@query("A10_reward", "select chart_id, reward, quality, sr_closeness from rw")
def _(spark, d):
    return scored(spark, d).select("chart_id", "reward", "quality", "sr_closeness")


@query("A4_calibration", "select case when grouping(bucket) = 1 then 'overall' else 'bucket' end dim, coalesce(bucket, 'all') \"key\", count(*) n, cast(round_even(cast(cast(sum(cast(reward as decimal(20, 6))) as double) / count(*) as decimal(30, 12)), 4) as double) mean from rw group by grouping sets ((), (bucket))")
def _(spark, d):
    return score.calibration(scored(spark, d))


@query("T1_bottom_n", "select chart_id, reward, quality from rw order by reward, chart_id limit 20")
def _(spark, d):
    return score.bottom_n(scored(spark, d), 20).select("chart_id", "reward", "quality")


@query("T2_worst_family", "select chart_id, arg_min(family, row(round_even(score, 9), family_ord)) family from fs group by chart_id")
def _(spark, d):
    m = chart_metrics(spark, d)
    got = score.families(m, bands.corpus_bands(m), score.family_weights(spark), ["chart_id"])
    return score.worst_family(got.withColumn("score", F.bround("score", 9)), ["chart_id"])


@query("A13_sr_sweep", "select chart_id, count_if(value between p10 and p90) in_band, count(*) scored from ml join bd using (bucket, metric) group by chart_id")
def _(spark, d):
    m = chart_metrics(spark, d)
    return score.sr_sweep(m, bands.corpus_bands(m))


#: A quotient rounded by its own digits, as bround does; a double times 100 would make ties of near ones and miss others.
Z_SQL = "cast(round_even(cast(cast((value - mean) / coalesce(nullif(std, 0), 1e-9::double) as varchar) as decimal(38, 20)), 2) as double)"


@query("A18_J5_z_scores", f"select chart_id, metric, value, mean, std, {Z_SQL} z, value between p10 and p90 in_range from ml join bd using (bucket, metric)")
def _(spark, d):
    m = chart_metrics(spark, d)
    return bands.z_scores(m, bands.corpus_bands(m))


def halves(spark, d):
    """Bands of the charts with even and with odd ids."""
    m = chart_metrics(spark, d)
    return [bands.corpus_bands(m.where(F.col("chart_id") % 2 == r)) for r in (0, 1)]


HALVES = "select bucket, metric, chart_id % 2 half, cast(round_even(cast(cast(sum(cast(value as decimal(20, 6))) as double) / count(*) as decimal(30, 12)), 3) as double) mean from ml group by all"


@query("A16_drift", f"""with hv as ({HALVES}), both_ as (select a.bucket, a.metric, round_even((b.mean - a.mean) / nullif(abs(a.mean), 0), 4) change from hv a join hv b using (bucket, metric) where a.half = 0 and b.half = 1)
  select metric, bucket, change, same_sign from both_ join (select metric, count(distinct sign(change)) = 1 same_sign from both_ group by metric) using (metric)""".replace("with hv", ", hv", 1))
def _(spark, d):
    return bands.drift(*halves(spark, d))


@query("J6_compare", """select coalesce(a.metric, b.metric) metric, l, r from (select metric, round_even(avg(value), 6) l from ml where bucket = 'Easy' group by 1) a full join (select metric, round_even(avg(value), 6) r from ml where bucket = 'Expert+' group by 1) b using (metric)""")
def _(spark, d):
    long = bands.melt(chart_metrics(spark, d).withColumn("bucket", bands.sr_bucket(F.col("star_rating"))), ["bucket"])
    mean = lambda b: long.where(F.col("bucket") == b).groupBy("metric").agg(F.bround(F.avg("value"), 6).alias("value"))
    return bands.compare(mean("Easy"), mean("Expert+"))


@query("A11_aim_intensity", """select audio_id, round_even(case when top > 0 then greatest(0.0::double, least(1.0::double, mean / top / 0.35::double)) else 0 end, 4) aim from (select chart_id // 3 audio_id, avg(value) mean, max(value) top from lg group by 1)""")
def _(spark, d):
    return metrics.aim_intensity(views.onset_frames(spark, d))


@query("A12_P16_tempo_estimate", """select song_id, round_even(case when raw <= 0 then 0 when raw < 89 then raw * 2.0::double ** ceil(log2(89 / raw)) when raw >= 205 then raw / 2.0::double ** (floor(log2(raw / 205)) + 1) else raw end, 3) bpm,
  case when n < 2 then 0 else round_even(first, 1) end offset_ms from (select song_id, n, first, case when n < 2 or gap <= 0 then 0 else 60000.0::double / gap end raw from (
    select song_id, count(*) n, quantile_cont(g, 0.5) gap, min(beat_ms) first from (select *, beat_ms - lag(beat_ms) over (partition by song_id order by beat_ms, line_no) g from bt where kind = 'ref') group by song_id))""")
def _(spark, d):
    return timing.tempo_estimate(views.beats(spark, d).where("kind = 'ref'"))


EVAL = """select *, exact_ or exists(select 1 from (select unnest([0.25::double, 0.3333333333333333, 0.5, 0.6666666666666666, 1.5, 2.0, 3.0, 4.0]) r) where abs(pred_bpm - ref_bpm * r) <= greatest(0.1::double, 0.02::double * ref_bpm * r)) octave,
  case when phase_err < 5 then 'excellent' when phase_err < 10 then 'good' when phase_err < 20 then 'playable' else 'off' end bucket from (
  select *, abs(pred_bpm - ref_bpm) bpm_err, abs(pred_bpm - ref_bpm) <= 0.1::double exact_, least(ph, 60000.0::double / ref_bpm - ph) phase_err from (select *, ((pred_offset - ref_offset) % (60000.0::double / ref_bpm) + 60000.0::double / ref_bpm) % (60000.0::double / ref_bpm) ph from tp))"""


@query("A20_tempo_eval", f"select song_id, round_even(bpm_err, 6) bpm_err, exact_ exact, octave, round_even(phase_err, 6) phase_err, bucket from ({EVAL})")
def _(spark, d):
    return timing.tempo_eval(timing_pred(spark, d)).select("song_id", F.bround("bpm_err", 6).alias("bpm_err"), "exact", "octave", F.bround("phase_err", 6).alias("phase_err"), "bucket")


@query("A5_timing_summary", f"""select count(*) n, round_even(avg(exact_::int), 3) exact_bpm_rate, round_even(avg(octave::int), 3) octave_rate, round_even(avg((bucket = 'excellent')::int), 3) offset_excellent_rate,
  round_even(avg((bucket <> 'off')::int), 3) offset_playable_rate, round_even(avg((exact_ and bucket = 'excellent')::int), 3) exact_rate from ({EVAL})""")
def _(spark, d):
    return timing.timing_summary(timing.tempo_eval(timing_pred(spark, d)))


@query("A19_grid_drift", """select song_id, round_even(max(least(m, b - m)), 4) max_drift, round_even(avg(least(m, b - m)), 4) mean_drift from (
  select song_id, 60000.0::double / pred_bpm b, ((beat_ms - pred_offset) % (60000.0::double / pred_bpm) + 60000.0::double / pred_bpm) % (60000.0::double / pred_bpm) m from bt join tp using (song_id) where kind = 'ref') group by song_id""")
def _(spark, d):
    grid = timing_pred(spark, d).select("song_id", F.col("pred_bpm").alias("bpm"), F.col("pred_offset").alias("offset_ms"))
    return timing.grid_drift(grid, views.beats(spark, d).where("kind = 'ref'").select("song_id", "beat_ms")).select("song_id", F.bround("max_drift", 4).alias("max_drift"), F.bround("mean_drift", 4).alias("mean_drift"))


@query("A21_tempo_census", """select count(*) charts, round_even(avg((n > 1)::int), 4) multi_tempo_share from (select chart_id, count(distinct round_even(60000.0::double / bl, 3)) n from cp where red and bl > 0 group by 1)""")
def _(spark, d):
    return metrics.tempo_census(views.control_points(spark, d))


@query("W28_beat_grid", """select chart_id, round_even(s + k * bl, 6) beat_ms, k % 4 = 0 is_downbeat from (select chart_id, "time" s, bl, unnest(range(0, greatest(0, cast(ceil((coalesce(lead("time") over (partition by chart_id order by "time", line_no), 30000.0::double) - 1e-6::double - "time") / bl) as bigint)))) k from cp where red)""")
def _(spark, d):
    durations = views.charts(spark, d).select("chart_id", F.lit(30000.0).alias("duration_ms"))
    return timing.beat_grid(views.control_points(spark, d), durations).select("chart_id", F.bround("beat_ms", 6).alias("beat_ms"), "is_downbeat")


@query("T3_A14_best_of_n", "select job_id, arg_max(idx, row(reward, -idx)) winner, round_even(avg(reward), 9) mean_reward, max(reward) max_reward, count(*) n_completed, round_even(max(reward) - round_even(avg(reward), 9), 9) lift from ca group by job_id")
def _(spark, d):
    return score.best_of_n(views.candidates(spark, d))


@query("W21_match_attempts", """select job_id, cast(coalesce(min(idx) filter (stopped = 0 and err <= 0.4::double), arg_min(idx, row(err, idx)) filter (stopped = 0), -1) as bigint) chosen from (
  select *, abs(a - 4.5::double) err, count_if(a is null) over (partition by job_id order by idx rows unbounded preceding) stopped from (select *, case when flag = 'R' and idx = 2 then null else achieved_sr end a from ca)) group by job_id""")
def _(spark, d):
    return score.match_attempts(views.attempts(spark, d))


@query("W22_monotonic", "select job_id, bool_and(coalesce(achieved_sr <= nx + 0.3::double, true)) monotonic from (select *, lead(achieved_sr) over (partition by job_id order by idx) nx from ca) group by job_id")
def _(spark, d):
    return score.monotonic(views.candidates(spark, d))


LOG = "select o_custkey % 50 run, row_number() over (partition by o_custkey % 50 order by o_orderdate, o_orderkey) epoch, o_totalprice / 1e6::double val_loss from orders"


@query("W25_S10_best_checkpoint", f"select run, epoch, val_loss, coalesce(val_loss < min(val_loss) over (partition by run order by epoch rows between unbounded preceding and 1 preceding), true) best from ({LOG})")
def _(spark, d):
    return score.best_checkpoint(views.training_log(spark, d))


@query("A26_norm_summary", f"select round_even(avg(val_loss), 4) mean, round_even(quantile_cont(val_loss, 0.5), 4) median, round_even(quantile_cont(val_loss, 0.99), 4) p99, round_even(max(val_loss), 4) \"max\", count_if(val_loss > 0.1::double) over_1, count_if(val_loss > 0.3::double) over_2 from ({LOG})")
def _(spark, d):
    return score.norm_summary(views.training_log(spark, d), "val_loss", (0.1, 0.3))


@query("A25_ab_compare", "select count_if(x > 0.02::double) wins, count_if(x < -0.02::double) losses, count_if(abs(x) <= 0.02::double) ties, round_even(avg(x), 4) mean_delta from (select b.reward - a.reward x from ca a join ca b using (job_id) where a.idx = 0 and b.idx = 1)")
def _(spark, d):
    c = views.candidates(spark, d)
    return score.ab_compare(c.where("idx = 0"), c.where("idx = 1"), ["job_id"])


COMPONENTS = """, edges as (select distinct a, b from (select item_id a, min(item_id) over (partition by song) b from sk union all select item_id, min(item_id) over (partition by audio_id) from sk)),
  both_ as (select a, b from edges union select b, a from edges), reach(item_id, g) as (select item_id, item_id from sk union select both_.b, g from reach join both_ on both_.a = reach.item_id where both_.b > g),
  gr as (select item_id, min(g) grp from reach group by item_id)"""


@query("J13_components", COMPONENTS + ' select item_id, grp "group" from gr')
def _(spark, d):
    return curation.song_groups(views.manifest(spark, d))


@query("W24_grouped_split", COMPONENTS + """, sz as (select grp, count(*) n, md5('1234:' || grp) h from gr group by grp)
  select item_id, grp "group", case when coalesce(before, 0) < greatest(1, round_even((select count(*) from gr) * 0.1::double, 0)) then 'val' else 'train' end side
  from gr join (select grp, sum(n) over (order by h rows between unbounded preceding and 1 preceding) before from sz) using (grp)""")
def _(spark, d):
    return curation.grouped_split(curation.song_groups(views.manifest(spark, d))).select("item_id", "group", "side")


@query("J15_leak_check", """, s as (select *, case when item_id % 10 = 0 then 'val' else 'train' end side from sk)
  select 'song' kind, song "key" from s group by song having count(distinct side) > 1 union all select 'audio', audio_id from s group by audio_id having count(distinct side) > 1""")
def _(spark, d):
    m = views.manifest(spark, d)
    return curation.leaks(m, m.select("item_id", F.expr("case when item_id % 10 = 0 then 'val' else 'train' end").alias("side")))


@query("J10_resolve_split", "select item_id, case when item_id % 10 = 0 then 'val' else 'train' end side from mf")
def _(spark, d):
    m = views.manifest(spark, d)
    frozen = m.where("item_id % 10 = 0").select("item_id").union(m.select(-F.col("item_id") - 1))
    return curation.resolve_split(m, frozen).select("item_id", "side")


@query("U5_J9_dedupe_audio", "select audio_id, min(item_id) item_id, count(*) items from mf group by audio_id")
def _(spark, d):
    return curation.dedupe_audio(views.manifest(spark, d))


@query("T5_seeded_sample", "select item_id from mf order by md5('7:' || item_id), item_id limit 100")
def _(spark, d):
    return curation.seeded_sample(views.manifest(spark, d), "item_id", 100, 7).select("item_id")


@query("W23_first_per_audio", "select audio_id, min(item_id) item_id from mf group by audio_id order by 2 limit 50")
def _(spark, d):
    return curation.first_per_audio(views.manifest(spark, d), 50)


@query("W14_breaks", """select chart_id, end_time + 200 "start", next_time - 400 "end" from w where next_time - end_time >= 3500 and next_time - 400 - end_time - 200 >= 800""")
def _(spark, d):
    return edit.breaks(timed(spark, d))


@query("W15_clamp_length", """select chart_id, line_no, round_even(case when sl and "length" > mx then greatest(10.0::double, mx) else "length" end, 4) "length" from (
  select *, greatest(1.0::double, coalesce(next_time, "time" + 100000) - "time") * 0.9::double / beat * (140.0::double * sv) / greatest(1, slides) mx from w)""")
def _(spark, d):
    return edit.clamp_length(timed(spark, d)).select("chart_id", "line_no", F.bround("length", 4).alias("length"))


SNAP = " union all ".join(f"select chart_id, line_no, {i} ord, offset_ms + round_even((\"time\" - offset_ms) / (beat_length / {v}), 0) * (beat_length / {v}) grid from w join pt using (chart_id)" for i, v in enumerate((4, 8, 6)))


@query("W16_J12_snap_events", f"""select chart_id, line_no, "time" + s "time", end_time + s end_time from (select w.*, case when abs(grid - "time") > 0 and abs(grid - "time") <= least(60.0::double, 0.5::double * beat_length / 8) then cast(round_even(grid, 0) as bigint) - "time" else 0 end s
  from w left join pt using (chart_id) left join (select chart_id, line_no, arg_min(grid, row(abs(grid - t), ord)) grid from (select q.*, w."time" t from ({SNAP}) q join w using (chart_id, line_no)) group by 1, 2) using (chart_id, line_no))""")
def _(spark, d):
    return edit.snap_events(timed(spark, d), timing.primary_timing(views.control_points(spark, d)), (4, 8, 6)).select("chart_id", "line_no", "time", "end_time")


@query("W17_snap_slider_ends", """select chart_id, line_no, round_even(case when sl then greatest(10.0::double, kk * iv / beat * (140.0::double * sv) / greatest(1, slides)) else "length" end, 4) "length", case when sl then cast(round_even("time" + kk * iv, 0) as bigint) else end_time end end_time from (
  select *, greatest(1.0::double, least(round_even((end_time - "time") / iv, 0), floor(greatest(iv, coalesce(next_time, "time" + 10 * beat) - "time") * 0.88::double / iv))) kk from (select *, beat / 4 iv from w))""")
def _(spark, d):
    return edit.snap_slider_ends(timed(spark, d)).select("chart_id", "line_no", F.bround("length", 4).alias("length"), "end_time")


@query("W12_W13_trim_ends")
def _(spark, d):
    return edit.trim_ends(timed(spark, d)).select("chart_id", "line_no", "time", "end_time")


@query("F11_P13_clamp_playfield")
def _(spark, d):
    return edit.clamp_playfield(timed(spark, d)).select("chart_id", "line_no", "x", "y", F.bround("length", 4).alias("length"), "end_time")


@query("W27_U1_merge_green")
def _(spark, d):
    points = views.control_points(spark, d)
    base = points.where("uninherited").groupBy("chart_id").agg(F.min_by(F.struct("time", "effects"), F.struct("time", "line_no")).alias("p")).select("chart_id", "p.time", "p.effects")
    sections = points.where("not uninherited").groupBy("chart_id", "time").agg(F.max(F.bround(timing.velocity(), 1)).alias("sv"))
    return edit.merge_green(base, timing.kiai_spans(points, timing.last_ends(timed(spark, d))), sections)


def rastered(spark: SparkSession, d: str, *channels: str) -> DataFrame:
    """The frame table, each chart as long as itself, stored once: decoding reads some of its channels many times.

    A query that names channels reads no others, so only those are stored.
    """
    e = timed(spark, d)
    drawn = frames.rasterise(e, views.control_points(spark, d), frames.chart_sizes(e))
    return stored(drawn.select("chart_id", "frame", *channels) if channels else drawn)[0]


FR = f"{frames.MS_PER_FRAME!r}::double"
CTES["fz"] = f"select chart_id, cast(least(floor(240000 / {FR}), floor(max(end_time) / {FR}) + 1) as int) nf from ev group by chart_id having max(end_time) >= 0"
CTES["eo"] = f'select *, "time" / {FR} f, row_number() over (partition by chart_id order by "time", line_no) ord from ev join fz using (chart_id) where "time" / {FR} < nf'
CTES["bump"] = f"""select chart_id, q frame, max(exp(-0.5::double * ((q - f) / 1.2::double) ** 2)) onset, max(case when ("type" & 4) <> 0 then exp(-0.5::double * ((q - f) / 1.2::double) ** 2) end) new_combo,
  max(case when (hit_sound & 2) <> 0 then exp(-0.5::double * ((q - f) / 1.2::double) ** 2) end) whistle, max(case when (hit_sound & 4) <> 0 then exp(-0.5::double * ((q - f) / 1.2::double) ** 2) end) finish,
  max(case when (hit_sound & 8) <> 0 then exp(-0.5::double * ((q - f) / 1.2::double) ** 2) end) clap from (
  select *, unnest(range(greatest(0, floor(f - 4.8::double))::bigint, least(nf - 1, ceil(f + 4.8::double))::bigint + 1)) q from eo) group by all"""
CTES["hold"] = f"""select chart_id, q frame, max(case when sl then 1 end) slider_hold, max(case when not sl then 1 end) spinner_hold, arg_max(case when sl then (slides - 1) / 3.0::double end, ord) filter (sl) slides,
  arg_max(least(1.2::double, sag / 80), ord) filter (sl) curve from (
  select eo.*, s.sagitta sag, unnest(range(round_even(f, 0)::bigint, round_even(least(nf - 1, eo.end_time / {FR}), 0)::bigint + 1)) q from eo left join sh s using (chart_id, line_no) where eo.sl or (eo."type" & 8) <> 0) group by all"""
CTES["kf"] = f"""select distinct chart_id, unnest(range(greatest(0, round_even("start" / {FR}, 0))::bigint, least(nf - 1, round_even("end" / {FR}, 0))::bigint + 1)) frame from ki join fz using (chart_id)"""


@query("R1_rasterise", f"""select c.chart_id, round_even(sum(coalesce(onset * 2 - 1, -1)), 3) onset, round_even(sum(coalesce(new_combo * 2 - 1, -1)), 3) new_combo, round_even(sum(coalesce(whistle * 2 - 1, -1)), 3) whistle,
  round_even(sum(coalesce(finish * 2 - 1, -1)), 3) finish, round_even(sum(coalesce(clap * 2 - 1, -1)), 3) clap, cast(sum(coalesce(slider_hold, -1)) as double) slider_hold, cast(sum(coalesce(spinner_hold, -1)) as double) spinner_hold,
  cast(sum(case when kf.frame is null then -1 else 1 end) as double) kiai_hold, round_even(sum(coalesce(slides * 2 - 1, -1)), 3) slides, round_even(sum(coalesce(curve, 0)), 3) curve
  from (select chart_id, unnest(range(0, nf)) frame from fz) c left join bump using (chart_id, frame) left join hold using (chart_id, frame) left join kf using (chart_id, frame) group by all""")
def _(spark, d):
    sums = ["onset", "new_combo", "whistle", "finish", "clap", "slider_hold", "spinner_hold", "kiai_hold", "slides", "curve"]
    return rastered(spark, d).groupBy("chart_id").agg(*[F.bround(F.sum(F.col(c).cast("double")), 3).alias(c) for c in sums])


RUNS = "select chart_id, min(frame) \"first\", max(frame) \"last\" from (select chart_id, frame, frame - row_number() over (partition by chart_id order by frame) i from hold where {} = 1) group by chart_id, i"


@query("W5_active_runs", RUNS.format("slider_hold"))
def _(spark, d):
    return frames.active_runs(rastered(spark, d), "slider_hold").select("chart_id", "first", "last")


@query("W5_W6_spinner_spans", f"""select chart_id, min("first") "first", max("last") "last" from (select *, sum(fresh) over (partition by chart_id order by "first") g from (
  select *, case when "first" - lag("last") over (partition by chart_id order by "first") <= {int(800 / frames.MS_PER_FRAME)} then 0 else 1 end fresh from ({RUNS.format('spinner_hold')}) where "last" - "first" + 1 >= 26)) group by chart_id, g""")
def _(spark, d):
    return frames.spinner_spans(rastered(spark, d))


@query("W7_J8_peaks")
def _(spark, d):
    f = rastered(spark, d)
    return frames.outside_spans(frames.pick_peaks(f), frames.spinner_spans(f)).select("chart_id", "frame", F.bround(F.col("value").cast("double"), 4).alias("value"))


@query("R3_T4_decode_kiai")
def _(spark, d):
    return frames.decode_kiai(rastered(spark, d))


@query("W19_R4_span_mean")
def _(spark, d):
    f = rastered(spark, d, "slider_hold", "spacing")
    return frames.span_mean(f, frames.active_runs(f, "slider_hold").select("chart_id", "first", "last"), "spacing").select("chart_id", "first", "last", F.bround("mean", 6).alias("mean"))


@query("R4_decode_spacing")
def _(spark, d):
    return frames.decode_spacing(rastered(spark, d, "spacing"), views.events(spark, d)).select("chart_id", "line_no", F.bround("magnitude", 3).alias("magnitude"))


@query("A15_spacing_ratio")
def _(spark, d):
    return frames.spacing_ratio(rastered(spark, d), timed(spark, d)).select("chart_id", *[F.bround(c, 4).alias(c) for c in ("channel_mean", "cursor_mean", "ratio")])


@query("R5_training_windows")
def _(spark, d):
    return frames.training_windows(rastered(spark, d), 512).groupBy("chart_id").agg(F.count("*").alias("frames"), F.bround(F.sum(F.col("onset").cast("double")), 3).alias("onset"))


@query("R6_mirror")
def _(spark, d):
    return frames.mirror(rastered(spark, d)).groupBy("chart_id", "flip").agg(F.bround(F.sum(F.col("cursor_x").cast("double")), 2).alias("x"), F.bround(F.sum(F.col("cursor_y").cast("double")), 2).alias("y")).select("chart_id", "flip.fx", "flip.fy", "x", "y")


@query("W26_sv_sections")
def _(spark, d):
    return sequences.sv_sections(rastered(spark, d))


@query("W10_rolling_median")
def _(spark, d):
    """The sv channel as a velocity, its median over 61 frames."""
    f = rastered(spark, d).select("chart_id", "frame", F.pow(F.lit(2.0), 2 * F.col("sv").cast("double")).alias("v"))
    return sequences.rolling_median(f, "v", 61).select("chart_id", "frame", F.bround("median", 6).alias("median"))


@query("W18_P14_respace")
def _(spark, d):
    e = views.events(spark, d)
    got = sequences.respace(e, e.select("chart_id", "line_no", (F.col("line_no") % 300).cast("double").alias("magnitude")))
    return got.select("chart_id", "line_no", "x", "y", F.get("curve_points", F.lit(0))["x"].alias("x1"), F.get("curve_points", F.lit(1))["y"].alias("y2"), "moved")


@query("J11_beat_f_measure")
def _(spark, d):
    return sequences.beat_f_measure(views.beats(spark, d))


@query("W20_J14_early_abort")
def _(spark, d):
    return sequences.early_abort(views.trajectories(spark, d))


@query("S9_export")
def _(spark, d):
    charts = views.charts(spark, d).selectExpr("*", "'a.mp3' as audio_filename", "'t' as title", "'a' as artist", "'c' as creator", "'v' as version", "5.0D as hp", "8.0D as od", "9.0D as ar")
    e = timed(spark, d)
    folder = shared_folder(charts)
    charts_io.export_charts(charts, e, views.control_points(spark, d), edit.breaks(e), folder.removeprefix("file://") if folder.startswith("file:///") else folder)
    files = spark.read.text(f"{folder}/*.txt", wholetext=True)
    return files.select(F.regexp_extract("_metadata.file_name", r"^([0-9]+)\.txt$", 1).cast("long").alias("chart_id"), F.length("value").alias("characters"), F.md5("value").alias("md5"))


@query("W8_U2_recover_gaps")
def _(spark, d):
    f = rastered(spark, d)
    return frames.recover_gaps(frames.pick_peaks(f), f).select("chart_id", "frame", F.bround(F.col("value").cast("double"), 4).alias("value"))


@query("R2_decode_events")
def _(spark, d):
    return frames.decode_events(rastered(spark, d)).select("chart_id", "line_no", "time", "x", "y", "type", "hit_sound", "curve_type", F.size("curve_points").alias("anchors"), "slides", F.bround("length", 4).alias("length"), "end_time")


@query("R2_event_heads")
def _(spark, d):
    """What decoding tells of events but for the shapes of sliders."""
    return frames.decode_events(rastered(spark, d)).select("chart_id", "line_no", "time", "x", "y", "type", "hit_sound", "end_time")


@query("A22_proxy_quality")
def _(spark, d):
    """Quality of decoded events at one tempo, without a rating term, against the corpus's bands."""
    charts = views.charts(spark, d)
    events = cut(frames.decode_events(rastered(spark, d)))
    tempo = charts.select("chart_id", F.lit(0).cast("long").alias("line_no"), F.lit(0.0).alias("time"), F.lit(400.0).alias("beat_length"), F.lit(4).alias("meter"), F.lit(True).alias("uninherited"), F.lit(0).alias("effects"))
    m = cut(metrics.chart_metrics(events, tempo, charts).where("n_objects >= 2").join(charts.select("chart_id", "star_rating"), "chart_id"))
    q = score.quality(m, bands.corpus_bands(chart_metrics(spark, d)), score.family_weights(spark))
    return charts.select("chart_id").join(q, "chart_id", "left").select("chart_id", F.bround(F.coalesce("quality", F.lit(0.0)), 4).alias("quality"))


@query("A23_probe_mean", """select round_even(avg(reward), 6) probe, count(*) probes from (select reward, row_number() over (partition by set_id order by chart_id) r from rw join ch using (chart_id)) where r = 1""")
def _(spark, d):
    return score.probe_mean(scored(spark, d), views.charts(spark, d))


@query("A24_lever_sweep", """select chart_id % 4 knob, bucket, round_even(avg(density_per_s), 6) density, round_even(avg(mean_spacing_px), 6) spacing, round_even(avg(jump_ratio), 6) jump, round_even(avg(stream_ratio), 6) stream from mb group by all""")
def _(spark, d):
    rows = chart_metrics(spark, d).withColumn("bucket", bands.sr_bucket(F.col("star_rating")))
    return score.lever_sweep(rows, F.col("chart_id") % 4, {"density": "density_per_s", "spacing": "mean_spacing_px", "jump": "jump_ratio", "stream": "stream_ratio"}, ["bucket"])


@query("F6_simplify")
def _(spark, d):
    sliders = metrics.type_flags(views.events(spark, d)).where("is_slider")
    return sliders.select("chart_id", "line_no", F.size(geometry.simplify(geometry.polygon())).alias("points"))


@query("P17_safe_name", """select item_id, coalesce(nullif(trim(substr(trim(regexp_replace(title, '[<>:"/\\\\|?*]', '', 'g')), 1, 120)), ''), 'track') name from mf""")
def _(spark, d):
    return views.manifest(spark, d).select("item_id", curation.safe_name(F.col("title")).alias("name"))


CTES["ke"] = 'select chart_id, "start" s, "end" e from ki'
CTES["gb"] = """select chart_id, arg_min("time", row("time", line_no)) bt, arg_min(effects, row("time", line_no)) bk from cp where red group by chart_id"""
CTES["gs"] = """select chart_id, "time", max(round_even(sv, 1)) sv from cp where not red group by 1, 2"""
GREEN = """select chart_id, gt "time", bl beat_length, eff effects from (select *, lag(bl, 1, -100.0::double) over w b0, coalesce(lag(eff) over w, bk) e0 from (
  select chart_id, t, bk, gt, cast((select count(*) from ke where ke.chart_id = z.chart_id and s <= gt and gt < e) > 0 as int) eff,
    round_even(-100.0::double / greatest(coalesce((select arg_max(sv, "time") from gs where gs.chart_id = z.chart_id and "time" <= gt), 1.0::double), 1e-3::double), 4) bl
  from (select chart_id, t, bk, greatest(cast(floor(t) as bigint), cast(floor(bt) as bigint) + 1) gt from (select distinct chart_id, t from (select chart_id, "time" t from gs union all select chart_id, s from ke union all select chart_id, e from ke)) join gb using (chart_id)) z)
  window w as (partition by chart_id order by gt, t)) where bl <> b0 or eff <> e0"""
ORACLES["W27_U1_merge_green"] = sql(GREEN)
ORACLES["A15_spacing_ratio"] = sql(f"""select chart_id, round_even(coalesce(cm, 0), 4) channel_mean, round_even(coalesce(m, 0), 4) cursor_mean, round_even(coalesce(cm, 0) / greatest(coalesce(m, 0), 1), 4) ratio
  from (select chart_id, avg(dist) m from w group by 1) left join (
    select chart_id, sum(v * n) / sum(n) cm from (select chart_id, cast(least(1.2::double, dist / 300) as float)::double * 300 v, least(nf, round_even(next_time / {FR}, 0)) - round_even("time" / {FR}, 0) n from w join fz using (chart_id) where dist > 0 and next_time is not null) where n > 0 group by 1) using (chart_id)""")
ORACLES["R3_T4_decode_kiai"] = sql(f"""select chart_id, cast(round_even(f * {FR}, 0) as bigint) "start", cast(round_even(l * {FR}, 0) as bigint) "end" from (
  select *, row_number() over (partition by chart_id order by round_even((2 * n_on - (l - f + 1))::double / (l - f + 1), 9) desc, f) r from (
    select chart_id, min(f) f, max(l) l, sum(l - f + 1) n_on from (select *, sum(fresh) over (partition by chart_id order by f) g from (
      select *, case when f - lag(l) over (partition by chart_id order by f) <= 1000 / {FR} then 0 else 1 end fresh from (
        select chart_id, min(frame) f, max(frame) l from (select chart_id, frame, frame - row_number() over (partition by chart_id order by frame) i from kf) group by chart_id, i))) group by chart_id, g)
  where l - f >= 1500 / {FR}) where r <= 3""")
ORACLES["F11_P13_clamp_playfield"] = sql("""select chart_id, line_no, cx x, cy y, round_even(case when nl < "length" - 0.5 then greatest(10.0::double, nl) else "length" end, 4) "length",
  case when nl < "length" - 0.5 then "time" + cast(round_even((end_time - "time") * nl / "length", 0) as bigint) else end_time end end_time from (
  select *, case when sl and "length" > pl + 0.5 then pl + least("length" - pl, case when norm < 1e-6 then 0 else greatest(0.0::double, least(norm * 10,
      case when dx / norm > 1e-6 then (512 - bx) / (dx / norm) when dx / norm < -1e-6 then (0 - bx) / (dx / norm) else norm * 10 end,
      case when dy / norm > 1e-6 then (384 - b_y) / (dy / norm) when dy / norm < -1e-6 then (0 - b_y) / (dy / norm) else norm * 10 end)) end) end nl from (
    select *, bx - ax dx, b_y - ay dy, sqrt((bx - ax) ** 2 + (b_y - ay) ** 2) norm, sqrt((ax - cx) ** 2 + (ay - cy) ** 2) + sqrt((bx - ax) ** 2 + (b_y - ay) ** 2) pl from (
      select *, least(512, greatest(0, x)) cx, least(384, greatest(0, y)) cy, least(512, greatest(0, x1)) ax, least(384, greatest(0, y1)) ay, least(512, greatest(0, x2)) bx, least(384, greatest(0, y2)) b_y from ev)))""")
ORACLES["R6_mirror"] = sql(f"""with km as (select chart_id, sum(cx) x, sum(cy) y from (select chart_id, q, case when t2 is null or q <= t or t2 = t then x else x + (q - t) / (t2 - t) * (x2 - x) end cx, case when t2 is null or q <= t or t2 = t then y else y + (q - t) / (t2 - t) * (y2 - y) end cy from (
    select *, unnest(range(case when fst then 0 else ceil(t)::bigint end, case when t2 is null then nf else least(nf, ceil(t2)::bigint) end)) q from (
      select chart_id, nf, t, x, y, lead(t) over w t2, lead(x) over w x2, lead(y) over w y2, row_number() over w = 1 fst from (
        select chart_id, nf, line_no, f t, 0 o, x / 512.0::double * 2 - 1 x, y / 384.0::double * 2 - 1 y from eo union all
        select chart_id, nf, line_no, least(nf - 1, end_time / {FR}), 1, case when slides % 2 <> 0 then x2 else x end / 512.0::double * 2 - 1, case when slides % 2 <> 0 then y2 else y end / 384.0::double * 2 - 1 from eo where sl)
      window w as (partition by chart_id order by t, line_no, o)))) group by 1)
  select chart_id, fx, fy, round_even(coalesce(x, 0) * fx, 2) x, round_even(coalesce(y, 0) * fy, 2) y from fz left join km using (chart_id), (values (1, 1), (-1, 1), (1, -1), (-1, -1)) s(fx, fy)""".replace("with km as", ", km as", 1))


# Oracles of what comes from frames.
CTES["ons"] = f"""select chart_id, frame, coalesce(cast(onset * 2 - 1 as float), cast(-1 as float)) v from (select chart_id, unnest(range(0, nf)) frame from fz) left join bump using (chart_id, frame)"""
CTES["pk"] = """select chart_id, frame, v from (select *, (frame - min(frame) over (partition by chart_id, i)) % 2 = 0 taken from (select *, frame - row_number() over (partition by chart_id order by frame) i from (
  select *, coalesce(lag(v) over w, cast('-infinity' as float)) l, coalesce(lead(v) over w, cast('-infinity' as float)) r from ons window w as (partition by chart_id order by frame)) where v >= cast(0.3 as double) and v >= l and v >= r)) where taken"""
CTES["sps"] = f"""select chart_id, min("first") f, max("last") l from (select *, sum(fresh) over (partition by chart_id order by "first") g from (
  select *, case when "first" - lag("last") over (partition by chart_id order by "first") <= {int(800 / frames.MS_PER_FRAME)} then 0 else 1 end fresh from ({RUNS.format("spinner_hold")}) where "last" - "first" + 1 >= 26)) group by chart_id, g"""
CTES["spc"] = f"""select chart_id, frame, max(v) v from (select chart_id, cast(least(1.2::double, dist / 300) as float)::double v,
  unnest(range(greatest(0, round_even("time" / {FR}, 0))::bigint, least(nf, round_even(next_time / {FR}, 0))::bigint)) frame from w join fz using (chart_id) where next_time is not null) group by 1, 2"""
CTES["svf"] = f"""select chart_id, frame, power(2.0::double, 2 * greatest(-1.0::double, least(1.0::double, coalesce(v, 0)))) v from (select chart_id, unnest(range(0, nf)) frame from fz) left join (
  select chart_id, frame, max(v) v from (select chart_id, cast(greatest(-2.0::double, least(2.0::double, log2(sv))) / 2 as float)::double v, unnest(range(greatest(0, round_even("time" / {FR}, 0))::bigint,
    least(nf, coalesce(round_even(nt / {FR}, 0), nf))::bigint)) frame from (select *, lead("time") over (partition by chart_id order by "time", kind, line_no) nt from cp) join fz using (chart_id)) group by 1, 2) using (chart_id, frame)"""
CTES["rmd"] = """select chart_id, frame, case when nf < 61 then v else m end m from (select chart_id, frame, v, nf, median(v) over (partition by chart_id order by frame rows between 30 preceding and 30 following) m from (
  select * from svf union all select chart_id, k - 31, v from svf, (select unnest(range(1, 31)) k) where frame = 0 union all select chart_id, nf - 1 + k, v from svf join fz using (chart_id), (select unnest(range(1, 31)) k) where frame = nf - 1) join fz using (chart_id)) where frame between 0 and nf - 1"""
CTES["svl"] = """select chart_id, frame, round_even(m / 0.1::double, 0) * 0.1::double s from rmd"""
ORACLES["W10_rolling_median"] = sql("select chart_id, frame, round_even(m, 6) as median from rmd")
CTES["svs"] = f"""select chart_id, frame, s from svl where frame = 0 union all select chart_id, r[1], r[2] from (
  select z.chart_id, (select min([q.frame::double, q.s]) from svl q where q.chart_id = z.chart_id and q.frame >= z.frame + {round(3000 / frames.MS_PER_FRAME)} and abs(q.s - z.s) >= 0.2::double) r from svs z) where r is not null"""
CTES["mgd"] = """select chart_id, list({'frame': frame, 's': s} order by frame) q from svs group by 1 union all select chart_id, list_concat(q[:p], q[p + 2:]) from (
  select chart_id, q, list_position(g, list_min(g)) p from (select chart_id, q, list_transform(range(1, len(q)), lambda i: abs(log2(greatest(q[i + 1].s, 1e-3)) - log2(greatest(q[i].s, 1e-3)))) g from mgd where len(q) > 6))"""
ORACLES["W7_J8_peaks"] = sql("select chart_id, frame, round_even(v::double, 4) as value from pk where not exists (select 1 from sps where sps.chart_id = pk.chart_id and pk.frame between f and l)")
ORACLES["W8_U2_recover_gaps"] = sql("""select chart_id, frame, round_even(v::double, 4) as value from pk union select chart_id, frame, round_even(v::double, 4) from (
  select h.chart_id, p, a, arg_min(n.frame, row(-n.v, n.frame)) frame, max(n.v) v from (select chart_id, frame p, b, a, greatest(1, b // 3) r from (
    select *, frame - lag(frame) over w b, lead(frame) over w - frame a from pk window w as (partition by chart_id order by frame)) where b > 0 and b <= 14 and abs(a - 2 * b) <= b * 0.34::double) h
  join ons n on n.chart_id = h.chart_id and n.frame between greatest(0, p + b - r) and p + b + r group by all) where v >= 0.15::double and frame - p >= 2 and p + a - frame >= 2""")
ORACLES["W19_R4_span_mean"] = sql(f"""select q.chart_id, "first", "last", round_even(coalesce(sum(v), 0) / any_value("last" - "first" + 1), 6) mean from ({RUNS.format("slider_hold")}) q
  left join spc on spc.chart_id = q.chart_id and frame between "first" and "last" group by 1, 2, 3""")
ORACLES["R4_decode_spacing"] = sql(f"""select chart_id, line_no, round_even(case when m is null then 0 else least(1.2::double, m) * 300 end, 3) magnitude from w left join (
  select a.chart_id, a.line_no, coalesce(sum(v), 0) / any_value(b - f) m from (select *, greatest(f + 1, least(nf, round_even("time" / {FR}, 0)))::bigint b from (
    select chart_id, nf, line_no, "time", greatest(0, least(nf - 1, round_even(lag("time") over (partition by chart_id order by "time", line_no) / {FR}, 0)))::bigint f, lag("time") over (partition by chart_id order by "time", line_no) was from w join fz using (chart_id))
    where was is not null) a left join spc on spc.chart_id = a.chart_id and frame >= f and frame < b group by 1, 2) using (chart_id, line_no)
  where chart_id in (select chart_id from spc group by 1 having max(v) >= 1e-3)""")
ORACLES["R5_training_windows"] = sql(f"""select c.chart_id, 512 frames, round_even(sum(v::double) - greatest(0, 512 - any_value(nf)), 3) onset from (select chart_id, nf, case when nf > 512 then cast('0x' || substr(md5('0:' || chart_id), 1, 15) as bigint) % greatest(1, nf - 511) else 0 end s from fz) c
  join ons n on n.chart_id = c.chart_id and n.frame between s and s + 511 group by 1""")
ORACLES["W26_sv_sections"] = sql(f"""select chart_id, cast(round_even(x.frame * {FR}, 0) as bigint) start_ms, round_even(x.s, 3) sv from (
  select chart_id, unnest(list_transform(list_filter(range(1, len(q) + 1), lambda i: i = 1 or abs(q[i].s - q[i - 1].s) >= 1e-6), lambda i: q[i])) x from mgd where len(q) <= 6)""")

# Oracles of edits and folds.
CTES["w0"] = """select chart_id, line_no, "time", end_time, "type", row_number() over o i, "time" - lag(end_time) over o g, count(*) over (partition by chart_id) size from ev window o as (partition by chart_id order by "time", line_no)"""
CTES["t1"] = """select * from (select *, max(case when i = 1 or not coalesce(g > 2200, false) then i end) over (partition by chart_id) keep from w0 where size >= 3) where i <= keep"""
CTES["t2"] = """select chart_id, line_no, "time", end_time, "type", i, g from (select *, max(case when i = 1 or not coalesce(g > floor_, false) then i end) over (partition by chart_id) keep2 from t1 join (
  select chart_id, case when count(g) filter (g >= 0) >= 8 then greatest(700.0::double, 6 * median(g) filter (g >= 0)) else 'infinity'::double end floor_ from t1 group by 1) using (chart_id)) where i <= keep2"""
CTES["t3"] = """select * from (select *, coalesce(lead(i) over o is null and i > 1 and ("type" & 1) <> 0 and (lag("type") over o & 8) <> 0 and g >= 0 and g < 1200, false) phantom from t2 window o as (partition by chart_id order by i)) where not phantom"""
ORACLES["W12_W13_trim_ends"] = sql("""select chart_id, line_no, "time", end_time from (select *, coalesce(max(case when ng > 3000 and i <= 4 then i end) over (partition by chart_id), 0) last_head,
    coalesce(min(case when ng > 3000 and i <= 4 then i end) over (partition by chart_id), 0) head from (select *, lead("time") over (partition by chart_id order by i) - end_time ng from t3)) where i > head
  union all select chart_id, line_no, "time", end_time from w0 where size < 3""")
ORACLES["F6_simplify"] = sql("""select chart_id, line_no, case when abs((y2 - y) * x1 - (x2 - x) * y1 + x2 * y - y2 * x) / case when x2 = x and y2 = y then 1 else sqrt((x2 - x) ** 2 + (y2 - y) ** 2) end > 18 then 3 else 2 end points from ev0 where sl""")
CTES["rs0"] = """select chart_id, line_no, x, y, x1, y2, sl, "type", row_number() over o i, lag(x) over o px, lag(y) over o py, lag("type") over o pt, (line_no % 300)::double mag from ev0 window o as (partition by chart_id order by "time", line_no)"""
FOLD = "case when ({0} % {1} + {1}) % {1} > {1} / 2 then {1} - ({0} % {1} + {1}) % {1} else ({0} % {1} + {1}) % {1} end"
CTES["rs"] = f"""select chart_id, i, x::double tx, y::double ty from rs0 where i = 1 union all select chart_id, i, case when n is null then x else {FOLD.format("(tx + mag * dx / n)", "1024.0::double")} end, case when n is null then y else {FOLD.format("(ty + mag * dy / n)", "768.0::double")} end from (
  select r.chart_id, r.i, r.x::double x, r.y::double y, mag, tx, ty, r.x - px dx, r.y - py dy, case when (r."type" & 12) = 0 and (pt & 8) = 0 and (r.x <> px or r.y <> py) then sqrt(((r.x - px) ** 2 + (r.y - py) ** 2)::double) end n from rs join rs0 r on r.chart_id = rs.chart_id and r.i = rs.i + 1)"""
ORACLES["W18_P14_respace"] = sql("""select chart_id, line_no, case when moved then round_even(tx, 0)::int else x end x, case when moved then round_even(ty, 0)::int else y end y, case when sl then x1 + sx end x1, case when sl then y2 + sy end y2, moved from (
  select *, sx <> 0 or sy <> 0 moved from (select *, round_even(tx - x, 0)::int sx, round_even(ty - y, 0)::int sy from rs0 join rs using (chart_id, i)))""")
CTES["bp"] = "select song_id, beat_ms, row_number() over (partition by song_id order by beat_ms, line_no) i from bt where kind = 'pred'"
CTES["br"] = "select song_id, beat_ms, row_number() over (partition by song_id order by beat_ms, line_no) i from bt where kind = 'ref'"
CTES["bm"] = """select song_id, 0::bigint i, 0::bigint used, 0::bigint hits from (select distinct song_id from bt) union all select song_id, i, case when hit then r else used end, hits + hit::int from (
  select z.song_id, p.i, used, hits, r, coalesce(r is not null, false) hit from bm z join bp p on p.song_id = z.song_id and p.i = z.i + 1
  left join lateral (select min(q.i) r from br q where q.song_id = z.song_id and q.i > z.used and abs(q.beat_ms - p.beat_ms) <= 70) on true)"""
ORACLES["J11_beat_f_measure"] = sql("""select song_id, round_even(pr, 4) "precision", round_even(rc, 4) recall, round_even(case when hits > 0 then 2 * pr * rc / (pr + rc) else 0 end, 4) f from (
  select song_id, hits, coalesce(hits::double / nullif(np, 0), 0) pr, coalesce(hits::double / nullif(nr, 0), 0) rc from (select song_id, max(hits) hits from bm group by 1)
  join (select song_id, count_if(kind = 'pred') np, count_if(kind = 'ref') nr from bt group by 1) using (song_id))""")
CTES["tr0"] = """select chart_id job_id, cast(line_no % 5 as int) cand, row_number() over (partition by chart_id, line_no % 5 order by ts desc, line_no desc) step_k, k / 100.0::double quality from lg"""
CTES["tr"] = """select *, 1 - step_k::double / max(step_k) over (partition by job_id, cand) >= 0.7::double late from tr0"""
CTES["ab0"] = "select job_id, 0 cand, null::bigint abort_k from tr where cand = 0 group by 1"
for _c in range(1, 5):
    _done = " union all ".join(f"select job_id, cand from ab{_b} where abort_k is null" for _b in range(_c))
    CTES[f"ab{_c}"] = f"""select t.job_id, {_c} cand, max(t.step_k) filter (late and n >= 2 and t.quality < best - 0.15::double and t.quality < 0.55::double) abort_k from tr t
  left join (select d.job_id, step_k, max(quality) best from ({_done}) d join tr using (job_id, cand) where late group by 1, 2) b on b.job_id = t.job_id and b.step_k = t.step_k
  left join (select job_id, count(*) n from ({_done}) group by 1) c on c.job_id = t.job_id where t.cand = {_c} group by 1"""
ORACLES["W20_J14_early_abort"] = sql("""select a.job_id, a.cand, abort_k is not null aborted, abort_k, coalesce(count_if(step_k < abort_k), 0) steps_saved from (""" + " union all ".join(f"select * from ab{_c}" for _c in range(5)) + """) a join tr t on t.job_id = a.job_id and t.cand = a.cand group by 1, 2, 3, 4""")
ORACLES["S9_export"] = sql(r"""select chart_id, length(t) characters, md5(t) md5 from (select chart_id, string_agg(line, chr(10) order by part, a, b, c) t from (
  select chart_id, 0 part, 0::double a, 0::double b, 0::double c, '[General]' || chr(10) || 'AudioFilename: a.mp3' || chr(10) || 'Mode: ' || "mode" line from ch
  union all select chart_id, 1, 0, 0, 0, concat_ws(chr(10), '[Metadata]', 'Title:t', 'Artist:a', 'Creator:c', 'Version:v') from ch
  union all select chart_id, 2, 0, 0, 0, concat_ws(chr(10), '[Difficulty]', 'HPDrainRate:5.0', 'CircleSize:' || cs, 'OverallDifficulty:8.0', 'ApproachRate:9.0', 'SliderMultiplier:1.4') from ch
  union all select chart_id, p, -1e18, 0, 0, n from ch, (values (3, '[Events]'), (4, '[TimingPoints]'), (5, '[HitObjects]')) v(p, n)
  union all select chart_id, 3, end_time + 200, 0, 0, '2,' || (end_time + 200) || ',' || (next_time - 400) from w where next_time - end_time >= 3500 and next_time - 400 - end_time - 200 >= 800
  union all select chart_id, 4, "time", kind, line_no, concat_ws(',', "time"::bigint, bl::bigint, '4,2,0,100', red::int, effects) from cp
  union all select chart_id, 5, "time", line_no, 0, case when sl then concat_ws(',', x, y, "time", "type", hit_sound, curve_type || '|' || x1 || ':' || y1 || '|' || x2 || ':' || y2, slides, "length"::bigint, array_to_string(list_transform(range(0, slides + 1), lambda i: '0'), '|'))
    when ("type" & 8) <> 0 then concat_ws(',', x, y, "time", "type", hit_sound, end_time, '0:0:0:0:') else concat_ws(',', x, y, "time", ("type" & ~10) | 1, hit_sound, '0:0:0:0:') end from ev) group by 1)""")


# Data set, stores and reports.
@query("P9_stable_ids", """select chart_id, substr(sha1(lower('Songs/' || folder || '/' || audio_id)), 1, 16) audio_key,
  replace(substr(regexp_replace(folder || '__' || filename || ' (' || audio_id || ')!', '[^\\p{L}\\p{N}._ -]', '', 'g'), 1, 120), ' ', '_') || '__' || substr(sha1(lower(folder || '/' || filename)), 1, 8) item_id from ch""")
def _(spark, d):
    version = F.concat(F.col("filename"), F.lit(" ("), F.col("audio_id").cast("string"), F.lit(")!"))
    path = F.concat_ws("/", "folder", "filename")
    return views.charts(spark, d).select("chart_id", curation.audio_key(F.concat_ws("/", F.lit("Songs"), "folder", F.col("audio_id").cast("string"))).alias("audio_key"), curation.item_key(F.col("folder"), version, path).alias("item_id"))


@query("T6_usable_limit", """, us as (select chart_id, coalesce(n_objects, 0) >= 35 ok, row_number() over (order by chart_id) r from ch left join mb using (chart_id)),
  sizes as (select size, count_if(ok and r <= size) found from us, (select unnest([50, 250, 1050, 4250, 17050, 68250]) size) group by size),
  given as (select least(total, coalesce((select min(size) from sizes where found >= 25), total)) measured from (select count(*) total from us))
  select chart_id, (select measured from given) measured from us where ok order by chart_id limit 25""")
def _(spark, d):
    """The first charts that are large enough; only slices of the library are timed and measured until there are 25."""
    points, e = views.control_points(spark, d), views.events(spark, d)

    def large(charts: DataFrame) -> DataFrame:
        mine = lambda df: df.join(charts.select("chart_id"), "chart_id", "left_semi")
        return metrics.chart_metrics(cut(timing.with_timing(mine(e), mine(points), charts)), mine(points), charts).where("n_objects >= 35")

    first, measured = curation.usable_limit(views.charts(spark, d), large, 25)
    return first.select("chart_id", F.lit(measured).cast("long").alias("measured"))


@query("A2_band_state", "select bucket, metric, n, mean, std, p10, p90 from bd")
def _(spark, d):
    """Bands of all charts from the stored states of three parts of them, one of which was counted twice and taken away."""
    m = chart_metrics(spark, d)
    states = [stored(bands.band_state(m.where(F.col("chart_id") % 3 == r)))[0] for r in range(3)]
    return bands.bands_of(bands.merge_states(states[0], states[1], states[2], states[1], gone=states[1]))


@query("P7_missing_settings", """select chart_id, round_even(least(1.5::double, coalesce(sr, 0) / 10), 6) c1, round_even(coalesce(ar, 5) / 10, 6) c2, 0.5::double c3, 0.5::double c4, round_even(coalesce(cs, 4) / 7, 6) c5,
  round_even(least(1.5::double, coalesce(n_objects, 0) / greatest(1e-6::double, coalesce(dur, 1)) / 12), 6) c6, 0.0::double c7
  from (select chart_id, case when chart_id % 3 <> 0 then star_rating end sr, case when chart_id % 4 <> 0 then 9.0::double end ar, case when chart_id % 5 <> 0 then cs end cs, case when chart_id % 6 <> 0 then n_objects end n_objects, case when chart_id % 7 <> 0 then duration_s end dur from mb join (select chart_id, cs from ch) using (chart_id))""")
def _(spark, d):
    """Settings that rows lack: some null, od, hp and aim no columns at all."""
    less = lambda c, k: F.when(F.col("chart_id") % k != 0, c)
    rows = chart_metrics(spark, d).join(views.charts(spark, d).select("chart_id", "cs"), "chart_id")
    items = rows.select("chart_id", less(F.col("star_rating"), 3).alias("star_rating"), less(F.lit(9.0), 4).alias("ar"), less(F.col("cs"), 5).alias("cs"), less(F.col("n_objects"), 6).alias("n_objects"), less(F.col("duration_s"), 7).alias("duration_s"))
    return curation.context(items).select("chart_id", *[F.bround(F.col("ctx")[i], 6).alias(f"c{i + 1}") for i in range(7)])


@query("A12_given_tempo", """select song_id, round_even(case when raw <= 0 then 0 when raw < 89 then raw * 2.0::double ** ceil(log2(89 / raw)) when raw >= 205 then raw / 2.0::double ** (floor(log2(raw / 205)) + 1) else raw end, 3) bpm,
  case when coalesce(n, 0) < 2 then 0 else round_even(first, 1) end offset_ms from (select coalesce(g.song_id, t.song_id) song_id, n, first, case when coalesce(n, 0) < 2 or gap <= 0 then coalesce(told, 0) else 60000.0::double / gap end raw from (
    select song_id, count(*) n, quantile_cont(g, 0.5) gap, min(beat_ms) first from (select *, beat_ms - lag(beat_ms) over (partition by song_id order by beat_ms, line_no) g from bt where kind = 'ref' and (song_id % 3 <> 0 or line_no % 97 = 0)) group by song_id) g
    full join (select chart_id song_id, 60.0::double + chart_id told from ch where chart_id % 2 = 0) t using (song_id))""")
def _(spark, d):
    beats = views.beats(spark, d).where("kind = 'ref' and (song_id % 3 != 0 or line_no % 97 = 0)")
    given = views.charts(spark, d).where("chart_id % 2 = 0").select(F.col("chart_id").alias("song_id"), (F.col("chart_id") + 60.0).alias("bpm"))
    return timing.tempo_estimate(beats, given=given)


@query("P13_heads_moved", """select chart_id, count_if(hx < 0 or hx > 512) moved from (select chart_id, x * 2 - 256 hx from ev) group by chart_id""")
def _(spark, d):
    """Heads that a stretched playfield moves out, clamped."""
    return edit.heads_moved(timed(spark, d).withColumn("x", F.col("x") * 2 - 256)).select("chart_id", "moved")


@query("P8_overrides", "select chart_id, case when chart_id % 3 = 0 then cs else least(10.0::double, 7.75::double + 0.25::double * star_rating) end ar, round_even(least(10.0::double, 4 + 0.7::double * star_rating), 9) od, cs, greatest(0.8::double, 0.8::double * star_rating) density from ch")
def _(spark, d):
    own = views.charts(spark, d).withColumns({"own_cs": F.col("cs"), "own_ar": F.when(F.col("chart_id") % 3 == 0, F.col("cs"))})
    return curation.target_settings(own, "star_rating", {"cs": "own_cs", "ar": "own_ar"}).select("chart_id", "ar", F.bround("od", 9).alias("od"), "cs", "density")


@query("P10_frame_count", f"select chart_id, cast(least(floor(240000 / {FR}), floor(max(end_time) * 12 / {FR}) + 1) as int) frames from ev group by 1")
def _(spark, d):
    ends = timed(spark, d).groupBy("chart_id").agg((F.max("end_time") * 12).alias("last"))
    return ends.select("chart_id", frames.frame_count(F.col("last")).alias("frames"))


CTES["svst"] = """select chart_id, count(*) n, count(distinct v) k, count_if(v <> p) c, min(v) lo, max(v) hi from (select *, lag(v) over (partition by chart_id order by "time", line_no) p from (select *, round_even(sv, 2) v from cp where not red)) group by 1"""


@query("A7_sv_summary", """select count(*) charts, min(lo) least_sv, max(hi) greatest_sv, round_even(avg((k > 1 or abs(lo - 1) > 0.05::double or abs(hi - 1) > 0.05::double)::int), 4) nontrivial,
    """ + ", ".join(f"list_sort(list({c}::double))[cast(floor({q}::double * (count(*) - 1)) as bigint) + 1] {n}_p{round(100 * q)}" for c, n in (("n", "inherited"), ("k", "distinct_sv"), ("c", "changes")) for q in (0.5, 0.9)) + """, list_sort(list(hi))[cast(floor(0.5::double * (count(*) - 1)) as bigint) + 1] max_sv_p50 from svst""")
def _(spark, d):
    return metrics.sv_summary(metrics.sv_structure(views.control_points(spark, d)))


MIX = "coalesce(" + ", ".join(f"case when abs(nb - round_even(nb * {v}, 0) / {v}) <= 0.02::double then {v} end" for v in metrics.DIVISORS) + ", 0)"


@query("A21_divisor_mix", f"select divisor, count(*) events, round_even(count(*)::double / sum(count(*)) over (), 4) share from (select {MIX} divisor from (select dt / beat nb from w where dt > 0)) group by 1")
def _(spark, d):
    return metrics.divisor_mix(timed(spark, d))


@query("A21_settings", """select count(*) n, round_even(avg(cs), 4) mean, """ + ", ".join(f"round_even(list_sort(list(cs))[cast(floor({q}::double * (count(*) - 1)) as bigint) + 1], 4) {n}" for q, n in ((0.5, "median"), (0.1, "p10"), (0.9, "p90"))) + """, min(cs) "min", max(cs) "max" from ch""")
def _(spark, d):
    return bands.distribution_summary(views.charts(spark, d), "cs")


def calibrated(spark, d):
    events = timed_once(spark, d)
    m = chart_metrics(spark, d, events)
    q = score.quality(m, bands.corpus_bands(m), score.family_weights(spark))
    joined = q.join(m.select("chart_id", "star_rating"), "chart_id").join(score.playability(events), "chart_id")
    got = score.reward(joined.withColumns({"achieved_sr": F.col("star_rating"), "target_sr": F.floor("star_rating"), "bucket": bands.sr_bucket(F.col("star_rating"))}))
    return got.withColumns({"unhittable": F.bround("penalty", 4), "playability": F.bround("playability", 4)})


CTES["ms"] = """select chart_id, metric, family, greatest(0.0::double, 1 - case when value < p10 then p10 - value when value > p90 then value - p90 else 0 end / greatest((p90 - p10) / 2, 1e-9::double)) s
  from ml join bd using (bucket, metric) join fw using (metric) where p90 > p10"""
CTES["cal"] = """select 'overall' dim, 'reward' "key", reward v from rw union all select 'overall', 'quality', quality from rw union all select 'overall', 'sr_closeness', sr_closeness from rw
  union all select 'playability', 'all', round_even(1 - penalty, 4) from rw union all select 'bucket_reward', bucket, reward from rw union all select 'bucket_quality', bucket, quality from rw
  union all select 'defect', 'unhittable', round_even(penalty, 4) from rw union all select 'family', family, round_even(score, 3) from fs union all select 'metric', metric, round_even(s, 3) from ms"""


@query("A4_calibration_report", """select dim, "key", count(*) n, cast(round_even(cast(cast(sum(cast(v as decimal(20, 6))) as double) / count(*) as decimal(30, 12)), 4) as double) mean, """ + ", ".join(f"round_even(list_sort(list(v))[cast(floor({q}::double * (count(*) - 1)) as bigint) + 1], 4) {n}" for q, n in ((0.5, "median"), (0.1, "p10"), (0.9, "p90"))) + """, round_even(min(v), 4) "min", round_even(max(v), 4) "max" from cal group by 1, 2""")
def _(spark, d):
    return score.calibration_report(calibrated(spark, d), ["unhittable"])


@query("S8_nested_report", """, st as (select dim, "key", count(*) n, cast(round_even(cast(cast(sum(cast(v as decimal(20, 6))) as double) / count(*) as decimal(30, 12)), 4) as double) mean, round_even(list_sort(list(v))[cast(floor(0.9::double * (count(*) - 1)) as bigint) + 1], 4) p90 from cal group by 1, 2)
  select dim part, "key" as name, case when dim not in ('metric', 'defect') then n end n, case when dim not in ('metric', 'defect') then p90 end p90, mean from st
  union all select 'bottom', chart_id::varchar, row_number() over (order by reward, chart_id), null, reward from (select * from rw order by reward, chart_id limit 20) union all select 'all', 'scored', count(*), null, null from rw""")
def _(spark, d):
    """The audit as one JSON document, written, read and taken apart again."""
    rows = cut(calibrated(spark, d))
    report = score.nested_report(cut(score.calibration_report(rows, ["unhittable"])), rows)
    folder = shared_folder(rows)
    stores.write_document(report, folder)
    told = spark.read.schema(report.schema).json(folder)
    part = lambda name, key, n, p90, mean: F.struct(F.lit(name).alias("part"), key.cast("string").alias("name"), n.cast("long").alias("n"), p90.cast("double").alias("p90"), mean.cast("double").alias("mean"))
    stat = lambda name, key, s: part(name, key, s["n"], s["p90"], s["mean"])
    each = lambda column, make: F.transform(F.map_entries(column), lambda e: make(e["key"], e["value"]))
    none = F.lit(None)
    parts = [
        each("overall", lambda k, s: stat("overall", k, s)), F.array(stat("playability", F.lit("all"), F.col("playability"))), each("per_bucket", lambda k, s: stat("bucket_reward", k, s["reward"])), each("per_bucket", lambda k, s: stat("bucket_quality", k, s["quality"])),
        each("per_family", lambda k, s: stat("family", k, s)), each("per_metric", lambda k, v: part("metric", k, none, none, v)), each("per_defect", lambda k, v: part("defect", k, none, none, v)),
        F.transform("bottom_n", lambda c, i: part("bottom", c["chart_id"], i + 1, none, c["reward"])), F.array(part("all", F.lit("scored"), F.col("n_scored"), none, none)),
    ]
    return told.select(F.explode(F.concat(*parts)).alias("p")).select("p.*")


@query("S3_status_table", """select chart_id, folder, filename from ch where "mode" = 0 and chart_id % 17 <> 0 and chart_id % 8 in (4, 5, 7)""")
def _(spark, d):
    """Wanted charts by a status table in CSV, under other column names."""
    status = views.chart_status(spark, d)
    folder = f"{shared_folder(status)}.csv"
    status.select(F.col("folder").alias("Set_Folder"), F.col("filename").alias("file"), F.col("status").alias("ranked_status"), F.col("mode").alias("MODE")).write.option("header", True).csv(folder)
    return curation.ranked_join(views.charts(spark, d), stores.read_status(spark, folder)).select("chart_id", "folder", "filename")


@query("S4_audio_frames", """select audio_id, frames, round_even(case when top > 0 then greatest(0.0::double, least(1.0::double, mean / top / 0.35::double)) else 0 end, 4) aim from (select chart_id // 3 audio_id, count(*) frames, avg(value) mean, max(value) top from lg group by 1)""")
def _(spark, d):
    """Aim from a stored table of onset strengths."""
    rows = views.onset_frames(spark, d)
    folder = shared_folder(rows)
    rows.write.parquet(folder)
    read = stores.read_onsets(spark, folder)
    return metrics.aim_intensity(read).join(read.groupBy("audio_id").agg(F.count("*").alias("frames")), "audio_id")


CTES["abx"] = "select a.job_id, a.cand, count_if(step_k < abort_k) saved from (" + " union all ".join(f"select * from ab{_c}" for _c in range(5)) + ") a join tr t on t.job_id = a.job_id and t.cand = a.cand where abort_k is not null group by 1, 2"


@query("A14_report", """select job_id, winner, reward_mean, reward_max, n_completed, coalesce(n_aborted, 0) n_aborted, coalesce(steps_saved, 0) steps_saved, candidates from (
  select job_id, arg_max(idx, row(reward, -idx)) winner, round_even(avg(reward), 9) reward_mean, max(reward) reward_max, count(*) n_completed, string_agg(idx || ':' || flag, ',' order by idx) candidates
  from ca where not exists (select 1 from abx where abx.job_id = ca.job_id and abx.cand = ca.idx) group by 1) left join (select job_id, count(*) n_aborted, cast(sum(saved) as bigint) steps_saved from abx group by 1) using (job_id)""")
def _(spark, d):
    report = score.best_of_n_report(views.candidates(spark, d), sequences.early_abort(views.trajectories(spark, d)))
    return report.withColumn("candidates", F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["idx"].cast("string"), c["flag"])), ","))


@query("W21_next_target", """select job_id, idx as iter, case when a is not null then round_even(least(11.0::double, greatest(1.0::double, 4.5::double + 0.25::double * idx + 0.8::double * (4.5::double - a))), 9) end next_sr from (select *, case when flag = 'R' and idx = 2 then null else achieved_sr end a from ca)""")
def _(spark, d):
    return views.attempts(spark, d).select("job_id", "iter", F.bround(score.next_target(4.5 + 0.25 * F.col("iter"), F.col("target_sr"), F.col("achieved_sr")), 9).alias("next_sr"))


@query("A13_target_sweep", """select chart_id, floor(star_rating) target_sr, star_rating achieved_sr, density_per_s, stream_ratio, coalesce(in_band, 0) in_band, coalesce(scored, 0) scored from mb
  left join (select chart_id, count_if(value between p10 and p90) in_band, count(*) scored from ml join bd using (bucket, metric) group by 1) using (chart_id)""")
def _(spark, d):
    m = chart_metrics(spark, d)
    return score.target_sweep(m.withColumn("target_sr", F.floor("star_rating").cast("double")), bands.corpus_bands(m), ["density_per_s", "stream_ratio"])


@query("A25_ab_without", """select count_if(x > 0.02::double) wins, count_if(x < -0.02::double) losses, count_if(abs(x) <= 0.02::double) ties, round_even(avg(x), 4) mean_delta, round_even(avg(x) filter (job_id % 10 <> 3), 4) mean_delta_without
  from (select job_id, b.reward - a.reward x from ca a join ca b using (job_id) where a.idx = 0 and b.idx = 1)""")
def _(spark, d):
    c = views.candidates(spark, d)
    return score.ab_compare_without(c.where("idx = 0"), c.where("idx = 1"), ["job_id"], c.select("job_id").distinct().where("job_id % 10 = 3"))


@query("F14_quality_maps", "select chart_id, family, round_even(score, 3) score from fs union all select chart_id, metric, round_even(s, 3) from ms")
def _(spark, d):
    m = chart_metrics(spark, d)
    q = cut(score.quality(m, bands.corpus_bands(m), score.family_weights(spark)))
    return q.select("chart_id", F.explode(F.map_concat("family", "per_metric")).alias("family", "score"))


@query("S6_bands", "select * from bd where p10 < p90")
def _(spark, d):
    folder = shared_folder(views.charts(spark, d))
    stores.write_bands(bands.corpus_bands(chart_metrics(spark, d)), folder)
    return stores.read_bands(spark, folder)


ORACLES["S7_frozen_split"] = ORACLES["W24_grouped_split"].replace('select item_id, grp "group", case', "select item_id, case")


@query("S7_frozen_split")
def _(spark, d):
    split = cut(curation.grouped_split(curation.song_groups(views.manifest(spark, d))))
    folder = shared_folder(split)
    stores.write_split(split, folder, 0.1, 1234)
    return curation.resolve_split(views.manifest(spark, d), stores.read_split(spark, folder)).select("item_id", "side")


KEPT = f"""select mb.*, ch.folder, ch.filename, ch.audio_id, ch.cs from mb join ch using (chart_id) where "mode" = 0 and chart_id % 17 <> 0 and chart_id % 8 in (4, 5, 7) and chart_id in (select chart_id from ({GATE}) where reject_reason is null)"""


def built(spark: SparkSession, d: str) -> DataFrame:
    charts, points, e = views.charts(spark, d), views.control_points(spark, d), views.events(spark, d)
    return dataset.build(charts, points, e, views.chart_status(spark, d), {"max_red": 13, "min_objects": 35}, onsets=views.onset_frames(spark, d))[0]


@query("R7_dataset", f"""select chart_id, bucket, cast(least(floor(240000 / {FR}), floor(last_end / {FR}) + 1) as int) frames, n_objects, substr(sha1(lower(folder || '/' || audio_id)), 1, 16) audio_key,
  regexp_replace(folder || '__' || filename, '[^\\p{{L}}\\p{{N}}._ -]', '', 'g') || '__' || substr(sha1(lower(folder || '/' || filename)), 1, 8) item_id, bpm, n_timing_points, n_uninherited, chart_id in (select chart_id from ki) has_kiai, aim aim_intensity
  from ({KEPT}) join (select chart_id, max(end_time) last_end from ev group by 1) using (chart_id) join (select chart_id, count(*) n_timing_points, count_if(red) n_uninherited from cp group by 1) using (chart_id)
  join (select chart_id // 3 audio_id, round_even(greatest(0.0::double, least(1.0::double, avg(value) / max(value) / 0.35::double)), 4) aim from lg group by 1) using (audio_id)""")
def _(spark, d):
    manifest = built(spark, d)
    folder = shared_folder(manifest)
    stores.write_manifest(manifest, folder)
    return spark.read.parquet(folder).select("chart_id", F.col("bucket").cast("string"), "frames", "n_objects", "audio_key", "item_id", "bpm", "n_timing_points", "n_uninherited", "has_kiai", "aim_intensity")


@query("R7_refresh", f"""select chart_id, bucket, cast(least(floor(240000 / {FR}), floor(last_end / {FR}) + 1) as int) frames, n_objects,
  regexp_replace(folder || '__' || filename, '[^\\p{{L}}\\p{{N}}._ -]', '', 'g') || '__' || substr(sha1(lower(folder || '/' || filename)), 1, 8) item_id, aim aim_intensity,
  case when chart_id % 7 = 0 then 2 else 1 end build, (select count(*) from ch where chart_id % 7 = 0) measured, 0::bigint gone
  from ({KEPT}) join (select chart_id, max(end_time) last_end from ev group by 1) using (chart_id) join (select chart_id // 3 audio_id, round_even(greatest(0.0::double, least(1.0::double, avg(value) / max(value) / 0.35::double)), 4) aim from lg group by 1) using (audio_id)""")
def _(spark, d):
    """A data set of six charts in seven, then of all: build tells in which of the two a row was made."""
    charts, points, e, status = views.charts(spark, d), views.control_points(spark, d), views.events(spark, d), views.chart_status(spark, d)
    folder = shared_folder(charts)
    some = charts.where("chart_id % 7 != 0")
    options = {"gates": {"max_red": 13, "min_objects": 35}, "onsets": views.onset_frames(spark, d), "with_frames": False}
    dataset.refresh(some, points.where("chart_id % 7 != 0"), e.where("chart_id % 7 != 0"), status, folder, **options)
    first = cut(spark.read.parquet(f"{folder}/manifest").select("chart_id", F.lit(1).alias("build")))
    measured, gone = dataset.refresh(charts, points, e, status, folder, **options)
    whole = spark.read.parquet(f"{folder}/manifest").join(first, "chart_id", "left")
    return whole.select("chart_id", F.col("bucket").cast("string"), "frames", "n_objects", "item_id", "aim_intensity", F.coalesce("build", F.lit(2)).alias("build"), F.lit(measured).cast("long").alias("measured"), F.lit(gone).cast("long").alias("gone"))


@query("S5_S11_frames", f"""select chart_id, cast(least(floor(240000 / {FR}), floor(last_end / {FR}) + 1) as bigint) frames from ({KEPT}) join (select chart_id, max(end_time) last_end from ev group by 1) using (chart_id)""")
def _(spark, d):
    manifest = built(spark, d)
    folder = shared_folder(manifest)
    dataset.write(cut(manifest), timed(spark, d), views.control_points(spark, d), folder)
    return stores.read_frames(spark, f"{folder}/frames").groupBy("chart_id").agg(F.count("*").alias("frames"))


# All channels, frame by frame: sums over blocks of 32 frames, each frame with a weight of its own.
CTES["shp"] = """select chart_id, line_no, (x1 - x) / 512.0::double u1, (y1 - y) / 384.0::double v1, (x2 - x) / 512.0::double u2, (y2 - y) / 384.0::double v2, (x1 = x2 and y1 = y2)::int corner,
  abs((y2 - y) * x1 - (x2 - x) * y1 + x2 * y - y2 * x) / case when x2 = x and y2 = y then 1 else sqrt((x2 - x) ** 2 + (y2 - y) ** 2) end > 18 mid from ev0 where sl"""
CTES["hsh"] = f"""select chart_id, q frame, arg_max(z, ord) z from (select chart_id, ord, [least(1.2::double, greatest(-1.2::double, a)) for a in case when mid then [u1, v1, u2, v2, u2, v2] else [u2, v2, u2, v2, u2, v2] end] || [corner] z,
  unnest(range(round_even(f, 0)::bigint, round_even(least(nf - 1, end_time / {FR}), 0)::bigint + 1)) q from eo join shp using (chart_id, line_no)) group by 1, 2"""
CTES["cur"] = f"""select chart_id, q frame, case when t2 is null or q <= t or t2 = t then x else x + (q - t) / (t2 - t) * (x2 - x) end cx, case when t2 is null or q <= t or t2 = t then y else y + (q - t) / (t2 - t) * (y2 - y) end cy from (
    select *, unnest(range(case when fst then 0 else ceil(t)::bigint end, case when t2 is null then nf else least(nf, ceil(t2)::bigint) end)) q from (
      select chart_id, nf, t, x, y, lead(t) over w t2, lead(x) over w x2, lead(y) over w y2, row_number() over w = 1 fst from (
        select chart_id, nf, line_no, f t, 0 o, x / 512.0::double * 2 - 1 x, y / 384.0::double * 2 - 1 y from eo union all
        select chart_id, nf, line_no, least(nf - 1, end_time / {FR}), 1, case when slides % 2 <> 0 then x2 else x end / 512.0::double * 2 - 1, case when slides % 2 <> 0 then y2 else y end / 384.0::double * 2 - 1 from eo where sl)
      window w as (partition by chart_id order by t, line_no, o)))"""
BLOCKS = {
    "onset": "coalesce(onset * 2 - 1, -1)", "new_combo": "coalesce(new_combo * 2 - 1, -1)", "whistle": "coalesce(whistle * 2 - 1, -1)", "finish": "coalesce(finish * 2 - 1, -1)", "clap": "coalesce(clap * 2 - 1, -1)", "slider_hold": "coalesce(slider_hold, -1)",
    "spinner_hold": "coalesce(spinner_hold, -1)", "kiai_hold": "case when kf.frame is null then -1 else 1 end", "slides": "coalesce(slides * 2 - 1, -1)", "curve": "coalesce(curve, 0)", "corner": "coalesce(z[7], 0)", "cursor_x": "coalesce(cx, 0)", "cursor_y": "coalesce(cy, 0)",
    "spacing": "coalesce(spc.v, 0)", "sv": "log2(svf.v) / 2", **{c: f"coalesce(z[{i + 1}], 0)" for i, c in enumerate(frames.ANCHORS)},
}


@query("R1_frame_blocks", "select c.chart_id, c.frame // 32 block, " + ", ".join(f"round_even(sum(({e}) * sqrt((2 + c.frame % 32)::double)), 2) + 0.0 {k}" for k, e in BLOCKS.items()) + f""" from (select chart_id, unnest(range(0, nf)) frame from fz) c
  left join bump using (chart_id, frame) left join hold using (chart_id, frame) left join kf using (chart_id, frame) left join hsh using (chart_id, frame) left join cur using (chart_id, frame) left join spc using (chart_id, frame) left join svf using (chart_id, frame) group by 1, 2""")
def _(spark, d):
    weight = F.sqrt((2 + F.col("frame") % 32).cast("double"))  # uneven, so that no sum ends halfway between two roundings
    sums = [(F.bround(F.sum(F.col(c).cast("double") * weight), 2) + F.lit(0.0)).alias(c) for c in BLOCKS]
    return rastered(spark, d).groupBy("chart_id", F.floor(F.col("frame") / 32).alias("block")).agg(*sums)


# Decoded events: peaks and recovered ones outside spinners, held as sliders until the next peak or spinner.
CTES["rcv"] = """select chart_id, frame from (
  select h.chart_id, p, a, arg_min(n.frame, row(-n.v, n.frame)) frame, max(n.v) v from (select chart_id, frame p, b, a, greatest(1, b // 3) r from (
    select *, frame - lag(frame) over w b, lead(frame) over w - frame a from pk window w as (partition by chart_id order by frame)) where b > 0 and b <= 14 and abs(a - 2 * b) <= b * 0.34::double) h
  join ons n on n.chart_id = h.chart_id and n.frame between greatest(0, p + b - r) and p + b + r group by all) where v >= 0.15::double and frame - p >= 2 and p + a - frame >= 2"""
CTES["pa"] = """select chart_id, frame, coalesce(lead(frame) over (partition by chart_id order by frame), nf) nxt, nf from (select chart_id, frame from pk union select chart_id, frame from rcv) join fz using (chart_id)"""
CTES["hf"] = """select c.chart_id, c.frame, min(case when coalesce(slider_hold, -1) <= 0 then c.frame end) over (w rows between current row and unbounded following) off, max(coalesce(slider_hold, -1)) over (w rows between current row and 3 following) held,
  cast(coalesce(cx, 0) as float)::double cx, cast(coalesce(cy, 0) as float)::double cy, cast(new_combo * 2 - 1 as float) nc, cast(whistle * 2 - 1 as float) w2, cast(finish * 2 - 1 as float) w4, cast(clap * 2 - 1 as float) w8
  from (select chart_id, unnest(range(0, nf)) frame from fz) c left join hold using (chart_id, frame) left join cur using (chart_id, frame) left join bump using (chart_id, frame) window w as (partition by c.chart_id order by c.frame)"""
CTES["dh"] = """select *, held > 0 and stop - frame >= 4 is_slider from (select *, greatest(frame + 1, least(coalesce(off, nf) - 1, least(nxt, spin) - 1)) stop from (
  select pa.*, hf.* exclude (chart_id, frame), (select min(f) from sps where sps.chart_id = pa.chart_id and f > pa.frame) spin from pa join hf using (chart_id, frame)
  where not exists (select 1 from sps where sps.chart_id = pa.chart_id and pa.frame between f and l)))"""
ORACLES["R2_event_heads"] = sql(f"""select chart_id, frame::bigint line_no, cast(round_even(frame * {FR}, 0) as bigint) "time", cast(least(512, greatest(0, round_even((cx + 1) / 2 * 512, 0))) as int) x, cast(least(384, greatest(0, round_even((cy + 1) / 2 * 384, 0))) as int) y,
  case when is_slider then 2 else 1 end + case when nc > 0 then 4 else 0 end "type", case when w2 > 0.85::double then 2 else 0 end + case when w4 > 0.85::double then 4 else 0 end + case when w8 > 0.85::double then 8 else 0 end hit_sound,
  cast(round_even(case when is_slider then stop else frame end * {FR}, 0) as bigint) end_time from dh
  union all select chart_id, f::bigint, cast(round_even(f * {FR}, 0) as bigint), 256, 192, 8, 0, cast(round_even(l * {FR}, 0) as bigint) from sps""")
