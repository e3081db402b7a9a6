"""Choosing charts: status joins, gates, conditioning vectors, and splits that don't leak."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, stored, unused_name
from .components import components


def ranked_join(charts: DataFrame, status: DataFrame, statuses: tuple[int, ...] = (4, 5, 7)) -> DataFrame:
    """Charts of mode 0 whose folder and filename have one of the statuses."""
    good = status.where((F.col("mode") == 0) & F.col("status").isin(*statuses)).select("folder", "filename")
    return charts.join(good, ["folder", "filename"], "left_semi")


def playable(charts: DataFrame, events: DataFrame, min_objects: int = 50) -> DataFrame:
    """Charts of mode 0 with at least so many events."""
    enough = events.groupBy("chart_id").count().where(F.col("count") >= min_objects)
    return charts.where("mode = 0").join(enough.select("chart_id"), "chart_id", "left_semi")


def gold_gate(metrics: DataFrame, points: DataFrame, min_sr: float = 1.0, max_sr: float = 10.0, require_kiai: bool = True, max_red: int = 1, min_hitsound: float = 0.1, min_objects: int = 50) -> DataFrame:
    """(chart_id, reject_reason) in the order of the gates; null for a chart that passes all."""
    counts = points.groupBy("chart_id").agg(F.count_if("uninherited").alias("reds"), F.max(F.expr("(effects & 1) != 0")).alias("has_kiai"))
    rows = metrics.join(counts, "chart_id", "left")
    c = F.col
    reason = (
        F.when(c("n_objects") < min_objects, "too_few")
        .when(~c("star_rating").between(min_sr, max_sr), "star_rating")
        .when(F.lit(require_kiai) & ~F.coalesce("has_kiai", F.lit(False)), "no_kiai")
        .when(F.coalesce("reds", F.lit(0)) > max_red, "multi_tempo")
        .when(F.coalesce("hitsound_ratio", F.lit(0.0)) < min_hitsound, "few_hitsounds")
    )
    return rows.select("chart_id", reason.alias("reject_reason"))


def ingest_counters(gated: DataFrame) -> DataFrame:
    """(outcome, charts): charts by reason, kept for those that pass."""
    return gated.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("charts"))


#: What a manifest row that lacks a field, or has none, counts as.
MISSING = {"star_rating": 0.0, "ar": 5.0, "od": 5.0, "hp": 5.0, "cs": 4.0, "n_objects": 0, "duration_s": 1.0, "aim": 0.0}


def context(items: DataFrame) -> DataFrame:
    """items with ctx: sr/10, ar/10, od/10, hp/10, cs/7, density/12 and aim, each within [0, 1.5].

    A null field, or one that items lack, counts as its value in MISSING.
    """
    told = {c: F.coalesce(F.col(c), F.lit(v)) if c in items.columns else F.lit(v) for c, v in MISSING.items()}
    density = told["n_objects"] / F.greatest(F.lit(1e-6), told["duration_s"])
    parts = [told["star_rating"] / 10, told["ar"] / 10, told["od"] / 10, told["hp"] / 10, told["cs"] / 7, density / 12, told["aim"]]
    return items.withColumn("ctx", F.array(*[F.least(F.lit(1.5), F.greatest(F.lit(0.0), p)) for p in parts]))


def target_settings(targets: DataFrame, sr: str = "sr", overrides: dict[str, str] | None = None) -> DataFrame:
    """targets with the settings that suit a star rating; overrides name columns whose non-null values come first."""
    made = {"ar": F.expr(f"least(10.0D, 7.75D + 0.25D * {sr})"), "od": F.expr(f"least(10.0D, 4.0D + 0.7D * {sr})"), "hp": F.lit(5.0), "cs": F.lit(4.0), "density": F.expr(f"greatest(0.8D, 0.8D * {sr})")}
    own = overrides or {}
    return targets.withColumns({c: F.coalesce(own[c], v) if c in own else v for c, v in made.items()})


def audio_key(path: Column) -> Column:
    """16 hex digits for an audio file, the same whatever the case of its path."""
    return F.substring(F.sha1(F.lower(path)), 1, 16)


def item_key(folder: Column, version: Column, path: Column) -> Column:
    """A readable name of a chart, of letters, digits and ._- only, made unique by a digest of its path."""
    name = F.regexp_replace(F.concat_ws("__", folder, version), r"[^\p{L}\p{N}._ -]", "")
    return F.concat_ws("__", F.replace(F.substring(name, 1, 120), F.lit(" "), F.lit("_")), F.substring(F.sha1(F.lower(path)), 1, 8))


def usable_limit(charts: DataFrame, measure: Callable[[DataFrame], DataFrame], n: int, key: str = "chart_id", growth: int = 4) -> tuple[DataFrame, int]:
    """The first n charts, in the order of their key, that measure keeps, and how many charts it was given.

    measure(charts) returns the rows, with the key, of those that are usable.  It gets growing slices of the key order,
    the first of twice n charts, and no more once n are usable, so a small n measures few charts of a large library.
    Charts of one key go together; null keys are left out.
    """
    if n <= 0:
        return charts.limit(0), 0
    good, below, found, given, size = [], None, 0, 0, 2 * n
    while found < n:
        rest = charts.where(F.col(key).isNotNull() if below is None else F.col(key) > F.lit(below))
        keys = rest.select(key).distinct().orderBy(key).limit(size)
        last, there = keys.agg(F.max(key), F.count("*")).first()
        if not there:
            break
        some = rest.where(F.col(key) <= F.lit(last))
        usable, _ = stored(measure(some).select(key).distinct())
        good.append(usable)
        given, found, below, size = given + some.count(), found + usable.count(), last, size * growth
    if not good:
        return charts.limit(0), given
    usable = reduce(DataFrame.union, good)
    return charts.join(usable, key, "left_semi").orderBy(key).limit(n), given


#: Hex digits by which an edge is narrowed at a time, and the rows that one task may order at it.
DIGITS, EDGE = 3, 20_000


def hash_edge(hashed: DataFrame, weight: Column, target: float) -> tuple[str, int]:
    """(prefix, before): the slice of the hash column h in whose order the running weight reaches the target, and the
    weight of all that comes before the slice.

    Slices are counted by more and more leading digits, within the slice that has the edge, until it has at most EDGE
    rows.  If all the weight is less than the target, the prefix is "g", beyond every hash.
    """
    prefix, before, rows = "", 0, None
    while rows is None or rows > EDGE and len(prefix) < 32:
        inside = hashed.where(F.col("h").startswith(prefix)).groupBy(F.substring("h", 1, len(prefix) + DIGITS).alias("p"))
        for r in sorted(inside.agg(F.sum(weight).alias("w"), F.count("*").alias("n")).collect()):
            if before + r.w >= target:
                prefix, rows = r.p, r.n
                break
            before += r.w
        else:
            return "g", before
    return prefix, before


def song_key(title: Column, item: Column, artist: Column | None = None) -> Column:
    """Lower-case words of the title, after those of the artist if there is one; the item's own key if there are none."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))
    name = norm(title) if artist is None else F.when(norm(artist) == "", norm(title)).otherwise(F.concat(norm(artist), F.lit("\x1f"), norm(title)))
    return F.when(name == "", F.concat(F.lit("__item__"), item.cast("string"))).otherwise(name)


def song_groups(manifest: DataFrame) -> DataFrame:
    """(item_id, group): items that share a song key or an audio file, directly or through others; group is the least
    item of each."""
    keyed = manifest.select("item_id", song_key(F.col("title"), F.col("item_id")).alias("song"), "audio_id")
    by_song = keyed.groupBy("song").agg(F.min("item_id").alias("head"))
    by_audio = keyed.groupBy("audio_id").agg(F.min("item_id").alias("head"))
    edges = keyed.join(by_song, "song").select(F.col("item_id").alias("a"), F.col("head").alias("b")).union(keyed.join(by_audio, "audio_id").select(F.col("item_id").alias("a"), F.col("head").alias("b")))
    return manifest.select("item_id").join(components(edges).withColumnRenamed("node", "item_id"), "item_id", "left").select("item_id", F.coalesce("root", "item_id").alias("group"))


def grouped_split(groups: DataFrame, fraction: float = 0.1, seed: int = 1234) -> DataFrame:
    """groups with side (val or train): whole groups, in the order of a seeded hash, go to val until it has its share.

    Counts by leading digits of the hash tell where val ends; groups before that slice are val, those after it train, and
    only the slice's own are put in order.
    """
    sizes = cut(groups.groupBy("group").agg(F.count("*").alias("size")).withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("group").cast("string")))))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    target = max(1, round(total * fraction)) if fraction > 0 else 0
    prefix, before = hash_edge(sizes, F.col("size"), target) if target else ("", 0)
    here = F.col("h").startswith(prefix)
    inner = F.coalesce(F.sum("size").over(Window.partitionBy(F.lit(1)).orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # EDGE rows, or those of one hash
    edge = sizes.where(here).withColumn("inner", inner).select("group", F.when(F.col("inner") + before < target, "val").otherwise("train").alias("side"))
    clear = sizes.where(~here).select("group", F.when(F.col("h") < prefix, "val").otherwise("train").alias("side"))
    return groups.join(clear.union(edge) if target else sizes.select("group", F.lit("train").alias("side")), "group")


def leaks(manifest: DataFrame, split: DataFrame) -> DataFrame:
    """(kind, key) of song keys and audio ids that stand on both sides of a split; empty for a sound one."""
    rows = manifest.join(split.select("item_id", "side"), "item_id").select("side", song_key(F.col("title"), F.col("item_id")).alias("song"), F.col("audio_id").cast("string").alias("audio"))
    long = rows.unpivot(["side"], ["song", "audio"], "kind", "key")
    return long.groupBy("kind", "key").agg(F.countDistinct("side").alias("sides")).where("sides > 1").select("kind", "key")


def resolve_split(manifest: DataFrame, frozen: DataFrame) -> DataFrame:
    """manifest with side: val for frozen ids that still exist, train for the rest."""
    marked = frozen.select("item_id").distinct().withColumn("side", F.lit("val"))
    return manifest.join(marked, "item_id", "left").withColumn("side", F.coalesce("side", F.lit("train")))


def dedupe_audio(manifest: DataFrame) -> DataFrame:
    """(audio_id, item_id, items): the least item of each audio file, and how many share it."""
    return manifest.groupBy("audio_id").agg(F.min("item_id").alias("item_id"), F.count("*").alias("items"))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a seeded hash of the key, the same for any layout; 0 gives all.

    Counts by leading digits of the hash tell in which slice the n-th row is; rows before it are taken by a filter, and
    only the slice's own are put in order, so no task holds n rows.
    """
    if not n:
        return rows
    name = unused_name(rows, "_hash")
    hashed = rows.withColumn(name, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    prefix, before = hash_edge(hashed.select(F.col(name).alias("h")), F.lit(1), n)
    sure = hashed.where(~F.col(name).startswith(prefix) & (F.col(name) < prefix))
    edge = hashed.where(F.col(name).startswith(prefix)).orderBy(name, key).limit(max(0, n - before))
    return sure.union(edge).drop(name)


def first_per_audio(manifest: DataFrame, limit: int = 0) -> DataFrame:
    """The first item of each audio file in manifest order, at most limit of them (0: all)."""
    first = dedupe_audio(manifest).select("audio_id", "item_id")
    return first.orderBy("item_id").limit(limit) if limit else first


def safe_name(name: Column) -> Column:
    """A file name without reserved characters, of at most 120, track if nothing stays."""
    cleaned = F.trim(F.substring(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r'[<>:"/\\|?*]', "")), 1, 120))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("track"))
