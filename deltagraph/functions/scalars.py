"""Scalar helpers over edges and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the histogram: bucket base and smallest value.
BASE, LEAST = 1.1, 1e-9


def log_bucket(x: Column) -> Column:
    """Bucket of a value in a logarithmic histogram."""
    return F.floor(F.log(x / LEAST + BASE) / F.log(F.lit(BASE))) + 1


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(log_bucket(F.col(column)).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


def pair_key(a: Column, b: Column) -> Column:
    """Canonical "min_max" text of a pair."""
    return F.concat_ws("_", F.least(a, b), F.greatest(a, b))


def edge_features(edges: DataFrame, shards: int) -> DataFrame:
    w = F.col("weight")
    return edges.select("src", "dst", w.alias("w"), F.log1p(w).alias("log1p_w"), (1 / w).alias("inv_w"), pair_key(F.col("src"), F.col("dst")).alias("edge_key"), F.pmod("src", F.lit(shards)).alias("shard"))
