"""Building a training data set from a library of charts: one batch job from tables of charts to manifest and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bands, curation, frames, metrics, timing
from ..sources import stores
from .lineage import cut, exists, replace_partitions, stored


def build(charts: DataFrame, points: DataFrame, events: DataFrame, status: DataFrame, gates: dict | None = None, max_seconds: float = 240.0, onsets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest, outcomes) of the charts that are kept.

    Playable charts with a wanted status are timed and measured once and gated.  The manifest has one row for each that
    passes: ids, metrics, settings, counts of control points, has_kiai, bucket, the number of frames, which max_seconds
    bounds, and aim_intensity of the audio that the charts of a song share, from onsets (audio_id, frame, strength; 0
    without).  item_id is unique: charts of one path are told apart by their chart_id.  outcomes counts charts by the
    gate that they failed.
    """
    limits = {"max_red": 1, "min_objects": 50, **(gates or {})}
    wanted = curation.ranked_join(curation.playable(charts, events, limits["min_objects"]), status)
    ids = wanted.select("chart_id")
    timed = cut(timing.with_timing(events.join(ids, "chart_id", "left_semi"), points, wanted))
    measured = cut(metrics.chart_metrics(timed, points, wanted).join(wanted.select("chart_id", "star_rating"), "chart_id"))
    gated = cut(curation.gold_gate(measured, points, **limits))
    kept = gated.where("reject_reason is null").select("chart_id")
    rows = measured.join(kept, "chart_id", "left_semi").join(wanted.drop("star_rating"), "chart_id").join(frames.chart_sizes(timed, max_seconds).withColumnRenamed("size", "frames"), "chart_id")
    return described(rows, points, timed, onsets), curation.ingest_counters(gated)


def described(rows: DataFrame, points: DataFrame, timed: DataFrame, onsets: DataFrame | None) -> DataFrame:
    """Manifest rows of measured charts with their settings and frames."""
    counts = points.groupBy("chart_id").agg(F.count("*").alias("n_timing_points"), F.count_if("uninherited").alias("n_uninherited"))
    kiai = timing.kiai_spans(points, timing.last_ends(timed)).select("chart_id").distinct().withColumn("has_kiai", F.lit(True))
    known = rows.join(counts, "chart_id", "left").join(kiai, "chart_id", "left").withColumns({"has_kiai": F.coalesce("has_kiai", F.lit(False)), **{c: F.coalesce(c, F.lit(0)) for c in ("n_timing_points", "n_uninherited")}})
    if onsets is not None:
        known = known.join(metrics.aim_intensity(onsets).withColumnRenamed("aim", "aim_intensity"), "audio_id", "left")
    aim = F.coalesce("aim_intensity", F.lit(0.0)) if onsets is not None else F.lit(0.0)
    path = F.concat_ws("/", "folder", "filename")
    again = F.row_number().over(Window.partitionBy(F.lower(path)).orderBy("chart_id")) > 1
    told_apart = F.when(again, F.concat_ws("#", path, F.col("chart_id").cast("string"))).otherwise(path)
    keys = {"audio_key": curation.audio_key(F.concat_ws("/", "folder", F.col("audio_id").cast("string"))), "path_key": told_apart}
    keyed = known.withColumns(keys)
    return keyed.withColumns({"item_id": curation.item_key(F.col("folder"), F.col("filename"), F.col("path_key")), "bucket": bands.sr_bucket(F.col("star_rating")), "aim_intensity": aim}).drop("path_key")


def content_digest(charts: DataFrame, points: DataFrame, events: DataFrame, status: DataFrame) -> DataFrame:
    """(chart_id, digest) of all that a chart's manifest row comes from, in any order of the rows."""

    def sums(df: DataFrame, by: list[str], name: str) -> DataFrame:
        h = F.xxhash64(*sorted(c for c in df.columns if c not in by))
        told = F.concat_ws(":", F.count("*").cast("string"), F.sum(h.cast("decimal(20,0)")).cast("string"), F.bit_xor(h).cast("string"))
        return df.groupBy(*by).agg(told.alias(name))

    told = [sums(charts, ["chart_id"], "a"), sums(points, ["chart_id"], "b"), sums(events, ["chart_id"], "c")]
    told.append(charts.select("chart_id", "folder", "filename").join(sums(status, ["folder", "filename"], "d"), ["folder", "filename"]).groupBy("chart_id").agg(F.min("d").alias("d")))
    both = told[0]
    for t in told[1:]:
        both = both.join(t, "chart_id", "left")
    return both.select("chart_id", F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in "abcd"])).alias("digest"))


def refresh(charts: DataFrame, points: DataFrame, events: DataFrame, status: DataFrame, folder: str, gates: dict | None = None, max_seconds: float = 240.0, onsets: DataFrame | None = None, with_frames: bool = True) -> tuple[int, int]:
    """Bring the data set in folder up to date with a library; how many charts were measured, and how many are gone.

    folder/seen has the digest of every chart that was looked at, kept or not.  Only charts whose digest isn't there are
    timed, measured and drawn; those that changed or are gone leave.  Buckets of the manifest and parts of the frames
    that have such charts are written anew, others aren't touched.  A build that is cut short is made good by the next, as
    seen is written last.  Ids of charts of one path are told apart within a build; aim_intensity is that of the onsets
    at the time.
    """
    seen_path, manifest_path, frames_path = (f"{folder}/{x}" for x in ("seen", "manifest", "frames"))
    now = cut(content_digest(charts, points, events, status))
    spark = charts.sparkSession
    seen = spark.read.parquet(seen_path) if exists(charts, seen_path) else now.limit(0)
    changed = cut(now.join(seen, ["chart_id", "digest"], "left_anti"))
    gone = cut(seen.join(now, "chart_id", "left_anti").select("chart_id"))
    counts = changed.count(), gone.count()
    if counts == (0, 0):
        return counts
    stale = changed.select("chart_id").union(gone)
    mine = lambda df: df.join(changed.select("chart_id"), "chart_id", "left_semi")
    fresh, _ = stored(build(mine(charts), mine(points), mine(events), status, gates, max_seconds, onsets)[0].withColumn("bucket", F.col("bucket").cast("string")))
    old = spark.read.parquet(manifest_path) if exists(charts, manifest_path) else fresh.limit(0)
    touched = [r[0] for r in old.join(stale, "chart_id", "left_semi").select("bucket").union(fresh.select("bucket")).distinct().collect()]
    kept = old.where(F.col("bucket").isin(touched)).join(stale, "chart_id", "left_anti")
    replace_partitions(kept.unionByName(fresh), manifest_path, "bucket", touched)
    if with_frames:
        timed = timing.with_timing(mine(events), mine(points), charts)
        drawn = stores.in_parts(frames.rasterise(timed, mine(points), fresh.select("chart_id", F.col("frames").alias("size"))))
        before = spark.read.parquet(frames_path) if exists(charts, frames_path) else drawn.limit(0)
        parts = [r[0] for r in stores.in_parts(stale).select("part").distinct().collect()]
        replace_partitions(before.where(F.col("part").isin(parts)).join(stale, "chart_id", "left_anti").unionByName(drawn).repartition("part").sortWithinPartitions("part", "chart_id", "frame"), frames_path, "part", parts)
    rows, _ = stored(seen.join(stale, "chart_id", "left_anti").unionByName(changed))
    rows.write.mode("overwrite").parquet(seen_path)
    return counts


def write(manifest: DataFrame, events: DataFrame, points: DataFrame, folder: str) -> None:
    """The manifest and the frame tables of its charts, each chart's as long as its manifest row says."""
    stores.write_manifest(manifest, f"{folder}/manifest")
    sizes = manifest.select("chart_id", F.col("frames").alias("size"))
    mine = lambda df: df.join(sizes.select("chart_id"), "chart_id", "left_semi")
    stores.write_frames(frames.rasterise(mine(events), mine(points), sizes), f"{folder}/frames")
