"""High-degree vertices: a physical strategy that never changes results.

The adjacency of a hub is spread over rows that are dealt by (id, part), and the hub's pending change is sent once to every part, not once per
edge: the two join on both columns, so no task holds a hub."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltagraph.plans.engine import CHUNK, packed, parts_for
from deltagraph.plans.kernel import Kernel, Message


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("n"))


def hub_vertices(edges: DataFrame, degree: int) -> DataFrame:
    return out_degree(edges).where(F.col("n") >= degree).select("src")


def hub_edges(edges: DataFrame, degree: int) -> DataFrame:
    return edges.join(hub_vertices(edges, degree), "src", "left_semi").select("src", "dst")


class HubSplit:
    """Edges (src, dst[, weight]) dealt once: a hub's over ``parts`` parts, all others whole."""

    def __init__(self, edges: DataFrame, degree: int, parts: int = 8):
        self.degree, self.parts = degree, parts
        weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
        n = out_degree(edges)
        part = F.when(F.col("n") >= degree, F.pmod(F.xxhash64("dst"), F.lit(parts))).otherwise(F.lit(0))
        dealt = edges.join(n, "src").select(F.col("src").alias("id"), part.alias("part"), "n", "dst", weight.alias("weight"))
        self.shuffled = parts_for(edges.sparkSession, edges.count())
        # a part in rows of bounded length, in the order in which the rounds join them
        row = F.when(F.col("n") > CHUNK, F.pmod(F.shiftright(F.xxhash64("dst"), 32), F.ceil(F.col("n") / CHUNK))).otherwise(F.lit(0))
        rows = packed(dealt.withColumn("row", row).repartition(self.shuffled, "id", "part"), "id", "part", "row", "n").drop("row")
        self.dealt = rows.sortWithinPartitions("id", "part").cache()
        self.degrees = n.withColumnRenamed("src", "id").cache()

    def round(self, state: DataFrame, kernel: Kernel) -> DataFrame:
        """The state after one round, the same as ``engine.one_round`` gives."""
        active = kernel.is_pending(F.col("delta"))
        delta = kernel.process(F.col("delta"), F.col) if kernel.process else F.col("delta")
        live = state.where(active).select("id", delta.alias("d"), "v").withColumn("sends", kernel.changes(F.col("v"), F.col("d"))).withColumn("v", kernel.accumulate.fold(F.col("v"), F.col("d")))
        sending = live.where("sends").join(self.degrees, "id")
        shares = sending.withColumn("part", F.explode(F.when(F.col("n") >= self.degree, F.sequence(F.lit(0), F.lit(self.parts - 1))).otherwise(F.array(F.lit(0)))))
        joined = self.dealt.join(shares.drop("n", "sends"), ["id", "part"]).select("id", "weight", "n", "d", "v", F.posexplode("dst").alias("at", "to"))
        sent = kernel.emit(Message(F.col("d"), F.col("v"), F.get("weight", F.col("at")), F.col("n"), F.col)).cast(kernel.kind)
        agg = joined.select(F.col("to").alias("dst"), sent.alias("m")).groupBy(F.col("dst").alias("id")).agg(kernel.accumulate.over("m").alias("m"))
        after = state.select("id", F.when(active, kernel.accumulate.fold(F.col("v"), delta)).otherwise(F.col("v")).alias("v"))
        return after.join(agg, "id", "left").select("id", "v", F.coalesce(F.col("m"), kernel.identity()).alias("delta"))

    def release(self) -> None:
        self.dealt.unpersist()
        self.degrees.unpersist()


def split_round(state: DataFrame, edges: DataFrame, kernel: Kernel, degree: int, parts: int = 8) -> DataFrame:
    """One round with hubs apart; for several rounds deal the edges once with ``HubSplit``."""
    return HubSplit(edges, degree, parts).round(state, kernel)
