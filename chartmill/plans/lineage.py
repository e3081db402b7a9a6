"""Cutting the lineage of iterative jobs, and tables that a job writes for itself, in a folder that executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame


def root_folder(df: DataFrame) -> str:
    """The session's spark.checkpoint.dir, which all executors share.

    Only a local master may leave it unset, as tests do; there the driver's disk is everyone's.
    """
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="chartmill-")


def cut(df: DataFrame) -> DataFrame:
    """df written to the reliable checkpoint folder and read from it."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root_folder(df))
    return df.checkpoint(eager=True)


def shared_folder(df: DataFrame) -> str:
    """A new name in the folder that all executors share."""
    return f"{root_folder(df)}/chartmill-{uuid.uuid4().hex}"


def stored(df: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, str]:
    """df written once as Parquet to the shared folder and read from it, and the path; by: columns that name folders."""
    path = shared_folder(df)
    df.write.partitionBy(*by or []).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(df: DataFrame, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def exists(df: DataFrame, path: str) -> bool:
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(where)


def replace_partitions(kept: DataFrame, path: str, column: str, touched: list) -> None:
    """Make the folders of the touched values of a column in a Parquet table hold kept's rows, and leave the others.

    The rows are written to the shared folder first, so they may come from the table itself; Spark moves the new files of
    a folder in when all are written.
    """
    rows, folder = stored(kept)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    full = {r[0] for r in rows.select(column).distinct().collect()}
    for value in touched:
        if value not in full and exists(kept, f"{path}/{column}={value}"):
            forget(kept, f"{path}/{column}={value}")
    forget(rows, folder)


def unused_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def joined_by(df: DataFrame, key: Column, found: DataFrame, on: str) -> DataFrame:
    """df left joined with found by a key that found has in the column on; the key isn't kept."""
    name = unused_name(df, "_key")
    return df.withColumn(name, key).join(found.withColumnRenamed(on, name), name, "left").drop(name)
