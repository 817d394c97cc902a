"""Shortest paths where most vertices have one way in: rounds follow the vertices at which paths meet, not the length of a chain.

A vertex with a single in-edge is as far as that edge's start plus its weight.  Such vertices form trees; by pointer doubling each finds the root of
its tree (the source, or a vertex with several ways in, or none) in as many steps as its depth has binary digits.  The rounds run over the roots, the
edges into which start from the roots above them, and one join gives the distances of all others.  Sums are added in another order than along the path."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltagraph.operators.algorithms import shortest_paths
from deltagraph.plans.engine import Adjacency, Options, forget, initial_state, run, shared_dir, truncate


def _roots(edges: DataFrame, source: int, folder: str) -> DataFrame:
    """id, at, w of each vertex (not ``source``) with one in-edge: the root above it and the way from there.  ``at`` stays within the tree's loop if it has no root."""
    ins = edges.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("at"), F.min("weight").alias("w"))
    single = ins.where((F.col("n") == 1) & (F.col("dst") != F.lit(source)) & (F.col("at") != F.col("dst")))
    step = truncate(single.select(F.col("dst").alias("id"), "at", "w", F.lit(True).alias("moved")), folder)
    n, reach = step.count(), 1
    # after k steps each pointer is 2^k edges long or at a root; what is longer than all vertices runs in a loop without a root
    while reach < 2 * n and not step.where("moved").isEmpty():
        above = step.select(F.col("id").alias("at"), F.col("at").alias("to"), F.col("w").alias("more"))
        further = step.drop("moved").join(above, "at", "left")
        before, step = step, truncate(further.select("id", F.coalesce("to", "at").alias("at"), (F.col("w") + F.coalesce("more", F.lit(0.0))).alias("w"), F.col("to").isNotNull().alias("moved")), folder)
        forget(before)
        reach *= 2
    return step.drop("moved")


def distances(vertices: DataFrame, edges: DataFrame, source: int, options: Options | None = None) -> DataFrame:
    """id, v: the distance of each of ``vertices`` (id) from ``source`` over ``edges`` (src, dst[, weight]); null if unreachable."""
    folder = f"{shared_dir(vertices.sparkSession)}/trees-{uuid.uuid4().hex}"
    ids, weight = vertices.select("id"), F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    known = edges.select("src", "dst", weight.alias("weight")).where("weight is not null")
    for end in ("src", "dst"):
        known = known.join(ids.withColumnRenamed("id", end), end, "left_semi")
    known = truncate(known, folder)
    trees = _roots(known, source, folder)
    into = known.join(trees.select(F.col("id").alias("dst")), "dst", "left_anti")
    moved = into.join(trees.select(F.col("id").alias("src"), "at", "w"), "src", "left")
    moved = moved.select(F.coalesce("at", "src").alias("src"), "dst", (F.col("weight") + F.coalesce("w", F.lit(0.0))).alias("weight"))
    meeting = truncate(moved.groupBy("src", "dst").agg(F.min("weight").alias("weight")), folder)
    roots, kernel = truncate(ids.join(trees, "id", "left_anti"), folder), shortest_paths(source)
    adj = Adjacency.build(roots, meeting)
    state = run(initial_state(roots, kernel), adj, kernel, options).state.select("id", "v")
    adj.release()
    below = trees.join(state.withColumnRenamed("id", "at"), "at", "left").select("id", (F.col("v") + F.col("w")).alias("v"))
    return state.unionByName(below)
