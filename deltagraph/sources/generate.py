"""Random graphs with log-normal degrees and weights, generated in parallel from a seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_DEGREE = 10_000


def uniform(*of) -> Column:
    """A number in (0, 1) that depends on the arguments only, not on partitions or order."""
    return (F.shiftrightunsigned(F.xxhash64(*[x if isinstance(x, Column) else F.lit(x) for x in of]), 11) + F.lit(0.5)) / F.lit(float(2**53))


def normal(*of) -> Column:
    """A standard normal number that depends on the arguments only."""
    return F.sqrt(-2 * F.log(uniform(*of, 1))) * F.cos(2 * math.pi * uniform(*of, 2))


def random_graph(spark: SparkSession, n: int, weighted: bool = False, degree_m: float = 0.0, degree_s: float = 2.0, weight_m: float = 0.0, weight_s: float = 1.0, seed: int = 42, inverse: bool = False) -> DataFrame:
    """src, dst[, weight]: degrees ceil(LogNormal) up to MOST_DEGREE, uniform targets other than the vertex itself, duplicates allowed; a
    single vertex has no edges.  Weights are log(1 + LogNormal), or 1 / LogNormal with ``inverse``.  Equal arguments give equal rows, whatever the partitioning."""
    degree = F.least(F.ceil(F.exp(degree_m + degree_s * normal(F.col("id"), seed))), F.lit(MOST_DEGREE)).cast("int")
    rows = spark.range(n if n > 1 else 0).select(F.col("id").alias("src"), degree.alias("k")).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k"))))
    hop = 1 + F.least(F.floor(uniform(F.col("src"), F.col("i"), seed + 1) * (n - 1)), F.lit(max(0, n - 2)))
    kept = ["src", F.pmod(F.col("src") + hop, F.lit(n)).alias("dst")]
    if not weighted:
        return rows.select(*kept)
    ln = F.exp(weight_m + weight_s * normal(F.col("src"), F.col("i"), seed + 2))
    return rows.select(*kept, (1 / ln if inverse else F.log1p(ln)).alias("weight"))
