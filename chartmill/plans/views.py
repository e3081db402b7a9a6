"""Chart tables as views over the star-schema and event-log tables.

One second of a map is one day of the log, the log's users are charts, and the number in props shapes positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "user_id as chart_id", "event_id as line_no", "event_type", "ts", "value", "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 86400000 as time", "cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k"
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Chart events without end_time of sliders (that needs timing)."""
    kind = "case event_type when 'click' then 1 when 'purchase' then 2 else case when k < 10 then 8 else 1 end end"
    placed = _log(spark, folder).where("event_type in ('click', 'purchase', 'error')").selectExpr(
        "chart_id", "line_no", "time", "k",
        "cast(case when line_no % 11 = 0 then 256 else (line_no * 37 + k) % 513 end as int) as x",
        "cast(case when line_no % 11 = 0 then 192 else (line_no * 53 + k * 7) % 385 end as int) as y",
        f"cast({kind} + case when line_no % 4 = 0 then 4 else 0 end as int) as type",
        "cast((line_no % 8) * 2 as int) as hit_sound",
    )
    slider = "(type & 2) != 0"
    anchors = "array(named_struct('x', cast((x + k) % 513 as int), 'y', cast((y + 2 * k) % 385 as int)), named_struct('x', cast((x + 3 * k) % 513 as int), 'y', cast((y + k) % 385 as int)))"
    return placed.selectExpr(
        "chart_id", "line_no", "time", "x", "y", "type", "hit_sound",
        f"case when {slider} then case when k % 2 = 0 then 'B' else 'L' end end as curve_type",
        f"case when {slider} then {anchors} else slice({anchors}, 1, 0) end as curve_points",
        f"cast(case when {slider} then 1 + line_no % 3 else 1 end as int) as slides",
        f"cast(case when {slider} then 50 + k else 0 end as double) as length",
        "case when (type & 8) != 0 then time + 500 else time end as end_time",
    )


def control_points(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).where("event_type in ('signup', 'view')").selectExpr(
        "chart_id", "line_no", "cast(time as double) as time", "cast(case event_type when 'signup' then 300 + 2 * k else -(50 + k) end as double) as beat_length",
        "4 as meter", "event_type = 'signup' as uninherited", "cast(line_no % 2 as int) as effects",
    )


def charts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("user_id").alias("chart_id")).distinct().selectExpr(
        "chart_id", "chart_id div 3 as set_id", "chart_id div 3 as audio_id", "concat('set', chart_id div 3) as folder", "concat('c', chart_id) as filename",
        "case when chart_id % 10 = 9 then 3 else 0 end as mode", "cast(3 + chart_id % 4 as double) as cs", "1.4D as slider_multiplier", "((chart_id * 37) % 900) / 100.0D as star_rating",
    )


def chart_status(spark: SparkSession, folder: str) -> DataFrame:
    return charts(spark, folder).where("chart_id % 17 != 0").selectExpr("folder", "filename", "cast(chart_id % 8 as int) as status", "mode", "set_id", "chart_id as chart_no")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").selectExpr("doc_id as item_id", "md5(coalesce(text, '')) as audio_id", "substring(coalesce(text, ''), 1, 24) as title", "source as creator", "lang as version", "n_chars as n_objects")


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, folder, "lineitem").withColumn("idx", F.row_number().over(order) - 1)
    scored = rows.selectExpr("l_orderkey as job_id", "idx", "1 - 2 * l_discount as quality", "1 / (1 + power(l_tax / 0.04D, 2)) as sr_closeness", "l_quantity / 6 as achieved_sr", "l_returnflag as flag")
    return scored.withColumn("reward", F.expr("bround(0.65D * quality + 0.35D * sr_closeness, 4)"))


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    return candidates(spark, folder).selectExpr("job_id", "idx as iter", "case when flag = 'R' and idx = 2 then null else achieved_sr end as achieved_sr", "4.5D as target_sr")


def trajectories(spark: SparkSession, folder: str) -> DataFrame:
    steps = Window.partitionBy("job_id", "cand").orderBy(F.desc("ts"), F.desc("line_no"))
    rows = _log(spark, folder).selectExpr("chart_id as job_id", "cast(line_no % 5 as int) as cand", "ts", "line_no", "k / 100.0D as quality").withColumn("step_k", F.row_number().over(steps))
    return rows.withColumn("frac_done", 1 - F.col("step_k") / F.max("step_k").over(Window.partitionBy("job_id", "cand"))).select("job_id", "cand", "step_k", "frac_done", "quality")


def beats(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).where("event_type in ('click', 'view')").selectExpr("chart_id as song_id", "line_no", "cast(time as double) as beat_ms", "case event_type when 'click' then 'ref' else 'pred' end as kind")


def onset_frames(spark: SparkSession, folder: str) -> DataFrame:
    order = Window.partitionBy("audio_id").orderBy("ts", "line_no")
    return _log(spark, folder).selectExpr("chart_id div 3 as audio_id", "ts", "line_no", "value as strength").withColumn("frame", F.row_number().over(order) - 1).select("audio_id", "frame", "strength")


def training_log(spark: SparkSession, folder: str) -> DataFrame:
    order = Window.partitionBy("run").orderBy("o_orderdate", "o_orderkey")
    return table(spark, folder, "orders").selectExpr("o_custkey % 50 as run", "o_orderdate", "o_orderkey", "o_totalprice / 1e6D as val_loss").withColumn("epoch", F.row_number().over(order)).select("run", "epoch", "val_loss")
