"""Reading chart files into tables of charts, control points and events, and writing them.

A chart file is sectioned text.  Files are read whole, so that lines keep their order; everything after that is
column expressions, and a line that doesn't parse is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ship import ship
from .line_files import LineFiles

#: Header keys, their column, type and default.
HEADER = {
    "AudioFilename": ("audio_filename", "string", ""), "Mode": ("mode", "int", 0), "Title": ("title", "string", ""), "Artist": ("artist", "string", ""), "Creator": ("creator", "string", ""), "Version": ("version", "string", ""),
    "SliderMultiplier": ("slider_multiplier", "double", 1.4), "CircleSize": ("cs", "double", 5.0), "OverallDifficulty": ("od", "double", 5.0), "ApproachRate": ("ar", "double", 5.0), "HPDrainRate": ("hp", "double", 5.0),
}


def chart_scan(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(chart_id, folder, filename, text) of each file under root that fits the pattern; chart_id is a hash of the path."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select("value", F.col("_metadata.file_path").alias("path"))
    parts = F.split("path", "/")
    return files.select(F.xxhash64("path").alias("chart_id"), F.url_decode(F.element_at(parts, -2)).alias("folder"), F.url_decode(F.element_at(parts, -1)).alias("filename"), F.col("value").alias("text"))


def section_lines(files: DataFrame) -> DataFrame:
    """(chart_id, section, line_no, line) without blank lines, comments and section headings."""
    lines = files.select("chart_id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).where("line != '' and not startswith(line, '//')")
    heading = F.regexp_extract("line", r"^\[(.*)\]$", 1)
    here = Window.partitionBy("chart_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("heading", F.when(heading != "", heading)).withColumn("section", F.last("heading", True).over(here))
    return marked.where("heading is null and section is not null").select("chart_id", "section", "line_no", "line")


def header_table(lines: DataFrame) -> DataFrame:
    """One row a chart with every column of HEADER: the last value of a key, its default if it is missing or bad."""
    pairs = lines.where(F.col("section").isin("General", "Metadata", "Difficulty") & F.col("line").contains(":"))
    split = F.split("line", ":", 2)
    kv = pairs.select("chart_id", "line_no", F.trim(split[0]).alias("key"), F.trim(split[1]).alias("value"))
    last = kv.where(F.col("key").isin(*HEADER)).groupBy("chart_id").agg(*[F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("line_no"))).alias(name) for k, (name, _, _) in HEADER.items()])
    every = lines.select("chart_id").distinct().join(last, "chart_id", "left")
    return every.select("chart_id", *[F.coalesce(F.col(n).try_cast(t), F.lit(d)).alias(n) for n, t, d in HEADER.values()])


def _field(i: int, kind: str) -> Column:
    return F.trim(F.get("p", F.lit(i))).try_cast(kind)


def control_point_table(lines: DataFrame) -> DataFrame:
    """(chart_id, line_no, time, beat_length, meter, uninherited, effects)."""
    rows = lines.where("section = 'TimingPoints'").withColumn("p", F.split("line", ","))
    size = F.size("p")
    out = rows.select(
        "chart_id", "line_no", _field(0, "double").alias("time"), _field(1, "double").alias("beat_length"), F.when(size > 2, _field(2, "int")).otherwise(4).alias("meter"),
        F.when(size > 6, F.trim(F.get("p", F.lit(6))) == "1").otherwise(_field(1, "double") > 0).alias("uninherited"), F.coalesce(F.when(F.get("p", F.lit(7)).rlike(r"^\s*[0-9]+\s*$"), _field(7, "int")), F.lit(0)).alias("effects"),
    )
    return out.dropna(subset=["time", "beat_length", "meter"])


def event_table(lines: DataFrame) -> DataFrame:
    """(chart_id, line_no, time, x, y, type, hit_sound, curve_type, curve_points, slides, length, end_time).

    Numbers lose their fraction; end_time is a spinner's own, else the start (timing gives sliders theirs).
    """
    rows = lines.where("section = 'HitObjects'").withColumn("p", F.split("line", ",")).where(F.size("p") >= 4)
    whole = lambda i: _field(i, "double").cast("long")
    rows = rows.withColumns({"x": whole(0).cast("int"), "y": whole(1).cast("int"), "time": whole(2), "type": _field(3, "int"), "hit_sound": F.coalesce(F.when(F.get("p", F.lit(4)).rlike("^[0-9]+$"), _field(4, "int")), F.lit(0))}).dropna(subset=["x", "y", "time", "type"])
    slider = (F.col("type").bitwiseAND(2) != 0) & (F.size("p") > 7)
    curve = F.split(F.get("p", F.lit(5)), r"\|")
    point = lambda s: F.struct(F.get(F.split(s, ":"), F.lit(0)).try_cast("double").cast("int").alias("x"), F.get(F.split(s, ":"), F.lit(1)).try_cast("double").cast("int").alias("y"))
    points = F.filter(F.transform(F.slice(curve, 2, F.greatest(F.lit(0), F.size(curve) - 1)), point), lambda v: v["x"].isNotNull() & v["y"].isNotNull())
    none = F.array().cast("array<struct<x:int,y:int>>")
    body = slider & (F.size(curve) > 1)
    spinner = (F.col("type").bitwiseAND(8) != 0) & ~(F.col("type").bitwiseAND(2) != 0)
    sized = slider & _field(6, "int").isNotNull()
    return rows.select(
        "chart_id", "line_no", "time", "x", "y", "type", "hit_sound", F.when(body, curve[0]).alias("curve_type"), F.when(body, points).otherwise(none).alias("curve_points"),
        F.when(sized, F.greatest(F.lit(1), _field(6, "int"))).otherwise(1).alias("slides"), F.when(sized, F.coalesce(_field(7, "double"), F.lit(0.0))).otherwise(0.0).alias("length"),
        F.when(spinner, F.coalesce(_field(5, "double").cast("long"), F.col("time"))).otherwise(F.col("time")).alias("end_time"),
    )


def background_ref(lines: DataFrame) -> DataFrame:
    """(chart_id, background): the image that the first background line of the Events section names."""
    named = lines.where("section = 'Events'").withColumn("background", F.regexp_extract("line", r'^0,0,"([^"]+)"', 1)).where("background != ''")
    return named.groupBy("chart_id").agg(F.min_by("background", "line_no").alias("background"))


def read_charts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """charts, control points and events of all chart files under root."""
    files = chart_scan(spark, root)
    lines = section_lines(files)
    return files.drop("text").join(header_table(lines), "chart_id"), control_point_table(lines), event_table(lines)


def export_lines(charts: DataFrame, events: DataFrame, points: DataFrame, breaks: DataFrame) -> DataFrame:
    """(chart_id, part, o, line): the lines of each chart's file, whose order is that of part and o."""
    number = lambda c: F.format_string("%s", F.regexp_replace(F.col(c).cast("string"), r"\.0$", ""))
    row = lambda df, part, order, line: df.select("chart_id", F.lit(part).alias("part"), F.struct(*order).cast("struct<a:double,b:double,c:double>").alias("o"), line.alias("line"))
    zero = F.lit(0.0)
    heads = [("[General]", lambda: F.concat_ws("\n", F.concat(F.lit("AudioFilename: "), "audio_filename"), F.concat(F.lit("Mode: "), "mode")))]
    heads += [("[Metadata]", lambda: F.concat_ws("\n", *[F.concat(F.lit(f"{k}:"), v) for k, v in (("Title", "title"), ("Artist", "artist"), ("Creator", "creator"), ("Version", "version"))]))]
    heads += [("[Difficulty]", lambda: F.concat_ws("\n", *[F.concat(F.lit(f"{k}:"), F.col(v).cast("string")) for k, v in (("HPDrainRate", "hp"), ("CircleSize", "cs"), ("OverallDifficulty", "od"), ("ApproachRate", "ar"), ("SliderMultiplier", "slider_multiplier"))]))]
    rows = [row(charts, i, (zero, zero, zero), F.concat(F.lit(f"{name}\n"), body())) for i, (name, body) in enumerate(heads)]
    rows += [row(charts, p, (F.lit(-1e18), zero, zero), F.lit(n)) for p, n in ((3, "[Events]"), (4, "[TimingPoints]"), (5, "[HitObjects]"))]
    rows += [row(breaks, 3, (F.col("start"), zero, zero), F.concat_ws(",", F.lit("2"), F.col("start").cast("string"), F.col("end").cast("string")))]
    rows += [row(points, 4, (F.col("time"), F.when(F.col("uninherited"), 0).otherwise(1), F.col("line_no")), F.concat_ws(",", number("time"), number("beat_length"), F.col("meter").cast("string"), F.lit("2,0,100"), F.col("uninherited").cast("int").cast("string"), F.col("effects").cast("string")))]
    head = [F.col(c).cast("string") for c in ("x", "y", "time", "type", "hit_sound")]
    curve = F.concat_ws("|", F.coalesce("curve_type", F.lit("L")), F.concat_ws("|", F.transform("curve_points", lambda p: F.concat_ws(":", p["x"].cast("string"), p["y"].cast("string")))))
    edges = F.concat_ws("|", F.transform(F.sequence(F.lit(0), F.col("slides")), lambda _: F.lit("0")))
    slider = F.expr("(type & 2) != 0 and size(curve_points) > 0")
    circle = F.concat_ws(",", head[0], head[1], head[2], F.expr("cast((type & ~10) | 1 as string)"), head[4], F.lit("0:0:0:0:"))
    line = F.when(slider, F.concat_ws(",", *head, curve, F.col("slides").cast("string"), number("length"), edges)).when(F.expr("(type & 8) != 0"), F.concat_ws(",", *head, F.col("end_time").cast("string"), F.lit("0:0:0:0:"))).otherwise(circle)
    rows += [row(events, 5, (F.col("time"), F.col("line_no"), zero), line)]
    all_rows = rows[0]
    for r in rows[1:]:
        all_rows = all_rows.unionByName(r)
    return all_rows


def export_charts(charts: DataFrame, events: DataFrame, points: DataFrame, breaks: DataFrame, out: str, suffix: str = ".txt") -> None:
    """Write each chart as one file under out, named by its chart_id.

    Lines are dealt by chart, sorted and streamed into the chart's file, so a chart may have any number of lines.  Files
    appear when all are written; existing ones of the same name are replaced.  out is a path that pyarrow can write from
    the executors: of a shared file system, hdfs:// or s3://.
    """
    ship(charts.sparkSession)
    charts.sparkSession.dataSource.register(LineFiles)
    laid = export_lines(charts, events, points, breaks).repartition("chart_id").sortWithinPartitions("chart_id", "part", "o")
    laid.select(F.col("chart_id").cast("string").alias("name"), "line").write.format("linefiles").option("path", out).option("suffix", suffix).mode("append").save()
