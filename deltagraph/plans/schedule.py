"""Priority scheduling: only the rows with the largest pending changes take part in a round."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltagraph.plans.kernel import Kernel

#: Up to so many rows an exact percentile is one aggregate; beyond, rows are ranked by range partitions.
ONE_BUFFER = 200_000
_ROW = (1 << 33) - 1


def priorities(state: DataFrame, kernel: Kernel) -> DataFrame:
    return state.select("id", kernel.priority(F.col("v"), F.col("delta")).cast("double").alias("pri"))


def ranked(rows: DataFrame, *order: Column) -> tuple[DataFrame, Column]:
    """``rows`` stored in order over range partitions, and the rank (from 0) of each as a Column.  No task holds more than a range, and only the
    partitions' sizes come to the driver."""
    from deltagraph.plans.engine import shared_dir, truncate

    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    stored = truncate(dealt, f"{shared_dir(spark)}/ranks-{uuid.uuid4().hex}")
    part = F.shiftright("_at", 33)
    sizes = {r["p"]: r["n"] for r in stored.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    return stored, F.get(F.array(*[F.lit(b).cast("long") for b in before]), part.cast("int")) + F.col("_at").bitwiseAND(F.lit(_ROW))


def threshold(state: DataFrame, kernel: Kernel, portion: float, exact: bool = True) -> Column:
    """Condition on a state row: its priority is within the top ``portion``.  The cut is one number, a percentile (exact, or from a sketch) over the
    pending rows, so it is always reached by some row and a round makes progress."""
    pri = kernel.priority(F.col("v"), F.col("delta")).cast("double")
    pending = state.where(kernel.is_pending(F.col("delta")))
    if exact and (n := pending.count()) > ONE_BUFFER:
        # as an interpolating percentile: between the two rows around the place
        place = (1 - portion) * (n - 1)
        stored, rank = ranked(pending.select(pri.alias("pri")), F.col("pri"))
        lo, hi = _around(stored, rank, place)
        at = lo if lo == hi else lo + (hi - lo) * (place - math.floor(place))
    else:
        cut = F.percentile(pri, F.lit(1 - portion)) if exact else F.percentile_approx(pri, F.lit(1 - portion), F.lit(1000))
        at = pending.agg(cut.alias("cut")).first()["cut"]
    # equal priorities may differ in their last bits
    return F.lit(True) if at is None else pri >= F.lit(at * (1 - 1e-9))


def _around(stored: DataFrame, rank: Column, place: float) -> tuple[float, float]:
    found = sorted(r["pri"] for r in stored.where(rank.isin(math.floor(place), math.ceil(place))).collect())
    return found[0], found[-1]


def top_portion(state: DataFrame, kernel: Kernel, portion: float, digits: int = 9) -> DataFrame:
    """Ids of the ceil(portion * n) rows of the highest priority (rounded, so that equal sums tie), ties by id."""
    rows = priorities(state, kernel).withColumn("pri", F.round("pri", digits))
    stored, rank = ranked(rows, F.col("pri").desc(), F.col("id"))
    return stored.where(rank < math.ceil(portion * stored.count())).select("id")
