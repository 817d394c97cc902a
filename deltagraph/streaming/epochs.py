"""Epoch snapshots in Parquet, resume, and snapshots of a running iteration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from deltagraph.plans.engine import Adjacency, Options, Result, initial_state, run
from deltagraph.plans.kernel import Kernel


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def epoch_path(folder: str, k: int) -> str:
    return f"{folder}/epoch={k:05d}"


def write_epoch(state: DataFrame, folder: str, k: int, **about) -> None:
    """State and a marker with parameters; the marker is written last, so an epoch without one doesn't count."""
    spark = state.sparkSession
    state.write.mode("overwrite").parquet(epoch_path(folder, k))
    spark.createDataFrame([(json.dumps(about | {"round": k}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/finished={k:05d}")


def latest_epoch(spark: SparkSession, folder: str) -> int | None:
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    found = [int(n.split("=")[1]) for n in names if n.startswith("finished=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return max(found, default=None)


def snapshots(folder: str, every: int = 1):
    """An ``on_round`` hook that writes an epoch every so many rounds."""

    def hook(k: int, state: DataFrame) -> None:
        if k % every == 0:
            write_epoch(state, folder, k)

    return hook


def resume(vertices: DataFrame, adj: Adjacency, kernel: Kernel, folder: str, options: Options) -> Result:
    """Go on from the newest finished epoch, or start if there is none."""
    spark = vertices.sparkSession
    k = latest_epoch(spark, folder)
    state = initial_state(vertices, kernel) if k is None else spark.read.parquet(epoch_path(folder, k))
    return run(state, adj, kernel, options, start=k or 0)
