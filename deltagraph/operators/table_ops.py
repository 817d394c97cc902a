"""Operations on a keyed state table (id, v, delta) as immutable DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltagraph.plans.kernel import Accumulator, Kernel


def upsert(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``rows`` replace or join those of ``state`` with the same id."""
    return state.join(rows.select("id"), "id", "left_anti").unionByName(rows)


def get(state: DataFrame, ids: list[int], *columns: str) -> DataFrame:
    return state.where(F.col("id").isin(ids)).select("id", *(columns or ("v", "delta")))


def contains(state: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys that the table has."""
    return keys.join(state.select("id"), "id", "left_semi")


def update(state: DataFrame, condition, **new) -> DataFrame:
    """Overwrite fields where ``condition`` holds."""
    return state.withColumns({c: F.when(condition, e).otherwise(F.col(c)) for c, e in new.items()})


def combined(messages: DataFrame, accumulator: Accumulator) -> DataFrame:
    """Messages (dst, d) folded to one for each destination: dst, d; combined map-side."""
    return messages.groupBy("dst").agg(accumulator.over("d").alias("d"))


def accumulate(state: DataFrame, messages: DataFrame, kernel: Kernel, field: str = "delta") -> DataFrame:
    """Fold messages (dst, d) into a field; messages to unknown ids are dropped (see ``orphans``)."""
    agg = combined(messages, kernel.accumulate).select(F.col("dst").alias("id"), F.col("d").alias("_d"))
    folded = F.when(F.col("_d").isNull(), F.col(field)).otherwise(kernel.accumulate.fold(F.col(field), F.col("_d")))
    return state.join(agg, "id", "left").withColumn(field, folded).drop("_d")


def orphans(messages: DataFrame, state: DataFrame) -> DataFrame:
    """Destinations that no row of the table has; strict delivery wants none.  Made distinct first, map-side: the join sees destinations, not messages."""
    return messages.select("dst").distinct().join(state.select(F.col("id").alias("dst")), "dst", "left_anti")


def remove(state: DataFrame, keys: DataFrame) -> DataFrame:
    return state.join(keys.select("id"), "id", "left_anti")


def clear(state: DataFrame) -> DataFrame:
    return state.limit(0)


def swap(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    return b, a


def page(state: DataFrame, offset: int, count: int) -> DataFrame:
    """A page of the table in id order."""
    return state.orderBy("id").offset(offset).limit(count)


def entries(state: DataFrame) -> int:
    return state.count()


def is_empty(state: DataFrame) -> bool:
    return state.isEmpty()


def replace_latest(messages: DataFrame, order: str) -> DataFrame:
    """REPLACE accumulation: the message with the largest ``order`` wins."""
    return messages.groupBy("dst").agg(F.max_by("d", order).alias("d"))


def rank_in_shard(state: DataFrame, shards: int) -> DataFrame:
    """Position of each row in its shard by id."""
    shard = F.pmod("id", F.lit(shards))
    return state.select("id", shard.alias("shard"), F.row_number().over(Window.partitionBy(shard).orderBy("id")).alias("pos"))
