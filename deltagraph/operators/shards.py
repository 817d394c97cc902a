"""Run a function on the shards of a table: all, one, or a range."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Method = Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]


def run_all(df: DataFrame, shard: Column, shards: int, method: Method, schema: str) -> DataFrame:
    """``method`` gets the batches of a task; rows of one shard are in one task."""
    return df.repartition(shards, shard).mapInPandas(method, schema)


def run_range(df: DataFrame, shard: Column, shards: int, wanted: list[int], method: Method, schema: str) -> DataFrame:
    return run_all(df.where(shard.isin(wanted)), shard, min(shards, max(1, len(wanted))), method, schema)


def run_one(df: DataFrame, shard: Column, which: int, method: Method, schema: str) -> DataFrame:
    return df.where(shard == F.lit(which)).mapInPandas(method, schema)
