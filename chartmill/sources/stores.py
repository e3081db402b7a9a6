"""Tables that a data set keeps: manifest, frames, bands, split, reports and training logs; readers take what older or
hand-written files lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statistics of a band, which readers look for.
BAND = {"n": "bigint", "mean": "double", "std": "double", "p10": "double", "p90": "double"}


def write_manifest(items: DataFrame, path: str, bucket: str = "bucket") -> None:
    """items as Parquet, a folder for each difficulty bucket."""
    items.write.mode("overwrite").partitionBy(bucket).parquet(path)


def in_parts(rows: DataFrame, folders: int = 64) -> DataFrame:
    """rows with the part in which their chart's frames lie."""
    return rows.withColumn("part", F.pmod(F.xxhash64("chart_id"), F.lit(folders)).cast("int"))


def write_frames(frames: DataFrame, path: str, folders: int = 64) -> None:
    """Frame tables as Parquet in folders by a hash of their chart, so that a chart's frames are read from one."""
    in_parts(frames, folders).repartition("part").sortWithinPartitions("part", "chart_id", "frame").write.mode("overwrite").partitionBy("part").parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def write_bands(bands: DataFrame, path: str) -> None:
    bands.write.mode("overwrite").parquet(path)


def usable_bands(bands: DataFrame) -> DataFrame:
    """(bucket, metric, n, mean, std, p10, p90) of bands that can score: p10 below p90; a missing mean is their middle,
    other missing columns are null."""
    missing = [c for c in ("bucket", "metric", "p10", "p90") if c not in bands.columns]
    if missing:
        raise ValueError(f"bands lack {', '.join(missing)}")
    have = [F.col(c).cast(t).alias(c) if c in bands.columns else F.lit(None).cast(t).alias(c) for c, t in BAND.items()]
    return bands.select("bucket", "metric", *have).where("p10 < p90").withColumn("mean", F.coalesce("mean", (F.col("p10") + F.col("p90")) / 2))


def read_bands(spark: SparkSession, path: str) -> DataFrame:
    """Usable bands of a Parquet folder, or of a JSON file {"buckets": {bucket: {metric: {p10, p90, ...}}}}."""
    if not path.endswith(".json"):
        return usable_bands(spark.read.parquet(path))
    stat = ", ".join(f"{c}: {t}" for c, t in BAND.items())
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", f"buckets map<string, map<string, struct<{stat}>>>").alias("j"))
    by_bucket = parsed.select(F.explode("j.buckets").alias("bucket", "metrics"))
    return usable_bands(by_bucket.select("bucket", F.explode("metrics").alias("metric", "s")).select("bucket", "metric", "s.*"))


def write_split(split: DataFrame, path: str, fraction: float, seed: int) -> None:
    """The val ids of split (item_id, side) and one row that tells where they come from."""
    split.where("side = 'val'").select("item_id").write.mode("overwrite").parquet(f"{path}/val")
    told = split.agg(F.count("*").alias("n_total"), F.count_if(F.col("side") == "val").alias("n_val"), F.count_if(F.col("side") == "train").alias("n_train"))
    told.select(F.lit(fraction).alias("val_frac"), F.lit(seed).alias("seed"), "*").write.mode("overwrite").parquet(f"{path}/provenance")


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(item_id) of a frozen split: a folder that write_split made, or a JSON file, a bare list or {"val_item_ids": list}."""
    if not path.endswith(".json"):
        return spark.read.parquet(f"{path}/val")
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    ids = F.when(F.startswith("t", F.lit("[")), F.from_json("t", "array<string>")).otherwise(F.from_json("t", "val_item_ids array<string>")["val_item_ids"])
    return text.select(F.explode(ids).alias("item_id"))


def write_report(rows: DataFrame, path: str) -> None:
    """Report rows, with whatever they nest, as lines of JSON."""
    rows.write.mode("overwrite").json(path)


def write_document(report: DataFrame, path: str) -> None:
    """A report of one row as one JSON document, in one file of the folder."""
    report.coalesce(1).write.mode("overwrite").json(path)


#: Columns of a status table, and further names that they go by.
STATUS = {"folder": ("string", "set_folder"), "filename": ("string", "file"), "status": ("int", "ranked_status"), "mode": ("int", "ruleset"), "set_id": ("long", "beatmapset_id"), "chart_no": ("long", "beatmap_id")}


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """(folder, filename, status, mode, set_id, chart_no) of Parquet, or of CSV with a header (*.csv or a folder of them).

    Columns may go by their further names, in any case; what is missing or no number is null.  Rows without folder,
    filename or status are left out, and a missing mode is 0.
    """
    table = spark.read.option("header", True).csv(path) if path.rstrip("/").endswith("csv") else spark.read.parquet(path)
    have = {c.lower(): c for c in table.columns}
    found = {c: next((have[n] for n in (c, other) if n in have), None) for c, (_, other) in STATUS.items()}
    cell = lambda c, t: (F.col(f"`{found[c]}`").cast("string").try_cast(t) if found[c] else F.lit(None).cast(t)).alias(c)
    rows = table.select(*[cell(c, t) for c, (t, _) in STATUS.items()])
    return rows.withColumn("mode", F.coalesce("mode", F.lit(0))).where("folder is not null and filename is not null and status is not null")


def read_onsets(spark: SparkSession, path: str) -> DataFrame:
    """(audio_id, frame, strength) of Parquet that has a row for each frame, or for each audio file an array of strengths."""
    table = spark.read.parquet(path)
    kind = table.schema["strength"].dataType.simpleString()
    if kind.startswith("array"):
        return table.select("audio_id", F.posexplode("strength").alias("frame", "strength")).withColumn("strength", F.col("strength").cast("double"))
    return table.select("audio_id", F.col("frame").cast("int").alias("frame"), F.col("strength").cast("double").alias("strength"))


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """(run, epoch, train_loss, val_loss, val_loss_ema) of CSV logs with a header; a column that a log lacks is null."""
    columns = {"run": "string", "epoch": "int", "train_loss": "double", "val_loss": "double", "val_loss_ema": "double"}
    log = spark.read.csv(path, header=True)
    known = log.select(*[F.col(c).try_cast(t).alias(c) for c, t in columns.items() if c in log.columns])
    return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in columns.items())).unionByName(known, allowMissingColumns=True).where("epoch is not null")
