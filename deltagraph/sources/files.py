"""File helpers on any Hadoop file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def glob(spark: SparkSession, pattern: str) -> list[str]:
    fs, p = _path(spark, pattern)
    return sorted(str(s.getPath()) for s in fs.globStatus(p) or [])


def stat(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """Paths and lengths."""
    fs, p = _path(spark, pattern)
    return sorted((str(s.getPath()), s.getLen()) for s in fs.globStatus(p) or [])


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def mkdirs(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.mkdirs(p)


def move(spark: SparkSession, old: str, new: str) -> bool:
    fs, p = _path(spark, old)
    return fs.rename(p, _path(spark, new)[1])


def remove(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.delete(p, True)


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def whole(spark: SparkSession, path: str) -> DataFrame:
    """path, content of each file as one row."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_progress(progress: DataFrame, path: str) -> None:
    """Convergence log, one line a check, tab-separated and in order of rounds."""
    line = F.concat_ws("\t", *[F.concat(F.lit(f"{c} "), F.col(c).cast("string")) for c in progress.columns])
    progress.repartitionByRange(1, "round").sortWithinPartitions("round").select(line.alias("value")).write.text(path)
