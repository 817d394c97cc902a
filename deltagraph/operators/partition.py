"""Sharders: the shard of a key as a Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mod(key: Column, shards: int) -> Column:
    """Integer keys; never negative."""
    return F.pmod(key, F.lit(shards))


def pair_mod(key: Column, shards: int) -> Column:
    """Keys like "a_b": the number before the underscore."""
    return F.pmod(F.split(key, "_")[0].cast("bigint"), F.lit(shards))


def text_hash(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards))


def text_digest(key: Column, shards: int) -> Column:
    """By the leading 32 bits of the MD5, for shards that other systems must find again."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(shards))


def deal(df: DataFrame, shard: Column, shards: int) -> DataFrame:
    """Partition rows by a shard column expression of any kind."""
    return df.repartition(shards, shard)


def shard_sizes(df: DataFrame, shard: Column) -> DataFrame:
    return df.groupBy(shard.alias("shard")).agg(F.count("*").alias("n"))
